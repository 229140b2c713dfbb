"""Toxicity by weak supervision.

Voters are lexicon terms (words and word beginnings) and
patterns, one of them that no term occurs.  The
lexicon is mined from a bounded sample of labelled training rows.  A
generative label model over the votes of all documents then estimates by
expectation maximisation how often each voter fires on toxic and on clean
documents and which voters depend on each other; dependent voters share their
weight.  Its posterior, not the labels, is what a logistic regression learns,
which gives the scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import free_name, frugal, written

#: Labelled documents of each class that the lexicon and the classifier are fitted on, about at most.
SAMPLE = 3_000
#: Share of the training rows with a term that are toxic, for the term to vote.
RIGHT = 0.8
#: Cells of the matrix of vote patterns up to which the classifier is fitted in the driver; beyond, by sums on Spark.
FITTED = 1_500_000
#: How much likelier a term is in toxic documents at least, and among how many
#: terms one that isn't may be taken for such by chance.
LIFT, CHANCE = 8.0, 1e7
STEMS = range(4, 8)
ROUNDS = 5
THRESHOLD = 0.7

_LETTERS = re.compile(r"\w+")
#: Pattern voters: strings whose presence is a vote, and tests on the hits.
MARKS = ("!!", "?!", "**", "@#")
PATTERNS = len(MARKS) + 3


def held_out(doc_id: Column | str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``; null ids are not held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part, F.lit(False))


def sampled(rows: DataFrame, by: str, most: int) -> DataFrame:
    """About ``most`` rows of each value of ``by``, chosen by the hash of ``doc_id``; all where there are fewer."""
    counts = {row[by]: row["n"] for row in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(by) == value, F.lit(min(1.0, most / n))).otherwise(share)
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / float(1 << 53)
    return rows.filter(place < share)


def terms_of(text: str) -> set[str]:
    """Words of a lower-cased text, and their beginnings with a ``*`` behind."""
    words = set(_LETTERS.findall(text.lower()))
    return words | {word[:k] + "*" for word in words for k in STEMS if len(word) > k}


def mine_terms(sample: DataFrame) -> list[str]:
    """All terms of toxic documents of the sample (``text``, ``toxic``) that pass the tests of chance and lift, best first."""

    def run(batches):
        import pyarrow as pa

        counts = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic].update(terms_of(text or ""))
        terms = [*counts[1]]
        for some in (terms, [x for x in counts[0] if x not in counts[1]]):
            for at in range(0, len(some), 50_000):
                part = some[at : at + 50_000]
                yield pa.RecordBatch.from_pydict({"term": part, "bad": [counts[1][x] for x in part], "good": [counts[0][x] for x in part]})
        yield pa.RecordBatch.from_pydict({"term": pa.array([], pa.string()), "bad": pa.array([], pa.int64()), "good": pa.array([], pa.int64())})

    total = {row["toxic"]: row["n"] for row in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad_all, good_all = total.get(1, 0), total.get(0, 0)
    counted = sample.select("text", "toxic").mapInArrow(frugal(run), "term string, bad long, good long")
    # A term that has nothing to do with toxicity is in `least` toxic and no other documents with probability 1 / CHANCE.
    least = math.ceil(math.log(CHANCE) / math.log((bad_all + good_all) / bad_all)) if bad_all and good_all else 5
    counted = counted.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter(F.col("bad") >= least)
    lift = ((F.col("bad") + 0.5) / (bad_all + 1)) / ((F.col("good") + 0.5) / (good_all + 1))
    gain = (F.col("bad") * F.log(lift)).alias("gain")
    found = counted.filter(lift >= LIFT).select("term", gain).orderBy(F.desc("gain"), F.desc(F.length("term")), "term")
    chosen: list[str] = []
    stems, heads = set(), set()
    for row in found.collect():  # terms of the bounded sample that pass
        term = row["term"]
        plain = term.rstrip("*")
        parts = {plain[:k] for k in range(1, len(plain) + 1)}
        if plain not in heads and not parts & stems:
            chosen.append(term)
            heads |= parts
            if term[-1] == "*":
                stems.add(plain)
    return chosen


class Voters:
    """Votes of a text: one per term, then the patterns."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.size = len(terms) + PATTERNS
        self.search = ahocorasick.Automaton()
        by_string: dict[str, list[tuple[int, bool]]] = {}
        for i, term in enumerate(terms):
            by_string.setdefault(term.rstrip("*"), []).append((i, term[-1] != "*"))
        for string, uses in by_string.items():
            self.search.add_word(string, (len(string), uses))
        self.any = bool(terms)
        if self.any:
            self.search.make_automaton()
        self.terms = len(terms)

    def votes(self, text: str) -> list[int]:
        low, found = text.lower(), set()
        if self.any:
            for end, (length, uses) in self.search.iter(low):
                before = end - length
                if before >= 0 and (low[before].isalnum() or low[before] == "_"):
                    continue
                follows = end + 1 < len(low) and (low[end + 1].isalnum() or low[end + 1] == "_")
                found.update(i for i, whole in uses if not (whole and follows))
        hits = len(found)
        out = sorted(found)
        out += [self.terms + k for k, mark in enumerate(MARKS) if mark in text]
        if hits >= 2:
            out.append(self.terms + len(MARKS))
        if len(text) > 3 and text.isupper():
            out.append(self.terms + len(MARKS) + 1)
        if not hits:
            out.append(self.terms + len(MARKS) + 2)
        return out


@dataclass
class LabelModel:
    """Prior, rates of the voters on toxic and clean documents, and how much they depend on one another (0 to 1)."""

    prior: float
    bad: list[float]
    good: list[float]
    depends: list[tuple[int, int, float]]

    def log_odds(self, votes):
        """Of a 0/1 matrix of votes the log odds of toxic.

        A voter that doesn't fire abstains; dependent ones that fire together share their weight.
        """
        import numpy as np

        # By voter, one and how far the other votes of the row depend on it.
        fired, shared = np.ascontiguousarray(votes.T), np.ones(votes.shape[::-1])
        for i, j, by in self.depends:
            shared[j] += by * fired[i]
        weight = np.log(np.array(self.bad) / np.array(self.good))
        return math.log(self.prior / (1 - self.prior)) + (weight[:, None] * fired / shared).sum(0)


def vote_patterns(docs: DataFrame, known: DataFrame, terms: list[str]) -> DataFrame:
    """Over all documents the sets of votes (``votes`` array), the label if a training row (``toxic``), and how many (``n``)."""

    def run(batches):
        import pyarrow as pa

        voters = Voters(terms)
        for batch in batches:
            votes = [voters.votes(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.list_(pa.int32()))], ["doc_id", "votes"])

    cast = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), "doc_id long, votes array<int>")
    return cast.join(known, "doc_id", "left").groupBy("votes", "toxic").agg(F.count(F.lit(1)).alias("n"))


def reliable(patterns: DataFrame, terms: list[str]) -> list[str]:
    """Of ``terms`` those that are right on most of all training rows where they occur."""
    seen = patterns.filter("toxic is not null").select(F.explode("votes").alias("vote"), "toxic", "n")
    right = F.sum(F.col("toxic") * F.col("n")) / F.sum("n")
    held = seen.filter(F.col("vote") < len(terms)).groupBy("vote").agg(right.alias("right")).filter(F.col("right") >= RIGHT)
    kept = {row["vote"] for row in held.collect()}  # at most one row per term
    return [term for i, term in enumerate(terms) if i in kept]


def fit_label_model(patterns: DataFrame, start: LabelModel, rounds: int = ROUNDS) -> LabelModel:
    """Expectation maximisation over the vote patterns of all documents.

    Training rows have their label for a posterior.  Each round sums, over the posterior of the last, how often voters fire
    alone and in pairs that occur.  Pairs that fire together more often than
    their rates explain are dependent; only those come to the driver.
    """
    import numpy as np

    size, model = len(start.bad), start

    for _ in range(rounds):

        def run(batches, model=model):
            import pyarrow as pa

            # Of clean documents only the rates are used.
            pairs, good = np.zeros((size + 1, size + 1)), np.zeros(size + 1)
            for batch in batches:
                for at in range(0, batch.num_rows, 1_000):
                    part = batch.slice(at, 1_000)
                    lists, n = part.column(0).to_pylist(), np.asarray(part.column(2), float)
                    label = np.array([np.nan if x is None else x for x in part.column(1).to_pylist()], float)
                    p = np.where(np.isnan(label), 1 / (1 + np.exp(-np.clip(model.log_odds(_matrix(lists, size)), -700, 700))), label)
                    ones = _matrix([[*some, size] for some in lists], size + 1)
                    pairs += ones.T @ (ones * (n * p)[:, None])
                    good += ones.T @ (n * (1 - p))
            for k, some in enumerate((pairs, np.diag(good))):
                i, j = np.nonzero(some)
                for at in range(0, len(i), 100_000):
                    a, b = i[at : at + 100_000], j[at : at + 100_000]
                    yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(a), k), pa.int32()), "i": pa.array(a, pa.int32()), "j": pa.array(b, pa.int32()), "s": pa.array(some[a, b], pa.float64())})

        cells = patterns.mapInArrow(frugal(run), "k int, i int, j int, s double").groupBy("k", "i", "j").agg(F.sum("s").alias("s"))
        cells = written(cells, "toxic-cells")
        alone, n = np.zeros((2, size)), np.zeros(2)
        for row in cells.filter("i = j").collect():  # at most 2 * (size + 1) cells
            if row["i"] == size:
                n[row["k"]] = row["s"]
            else:
                alone[row["k"], row["i"]] = row["s"]
        if n.sum() == 0:
            return model
        # The rates it began with weigh as a few documents.
        anchor = 20.0
        bad = (alone[0] + anchor * np.array(start.bad)) / (n[0] + anchor)
        good = (alone[1] + anchor * np.array(start.good)) / (n[1] + anchor)
        toxic = max(n[0], 1e-9)
        rate = alone[0] / toxic
        spread = np.sqrt(np.clip(rate * (1 - rate), 1e-9, None))
        pairs = cells.filter(f"k = 0 and i <> j and i < {size} and j < {size}")
        of = pairs.sparkSession.createDataFrame(list(zip(range(size), rate.tolist(), spread.tolist())), "i int, rate double, spread double")
        pairs = pairs.join(F.broadcast(of), "i").join(F.broadcast(of.toDF("j", "rate_j", "spread_j")), "j")
        by = (F.col("s") / float(toxic) - F.col("rate") * F.col("rate_j")) / (F.col("spread") * F.col("spread_j"))
        depends = [(x["i"], x["j"], min(x["by"], 1.0)) for x in pairs.select("i", "j", by.alias("by")).filter("by >= 0.3").orderBy("i", "j").collect()]
        clip = lambda x: np.clip(x, 1e-6, 1 - 1e-6)
        prior = float(np.clip((n[0] + 1) / (n.sum() + 2), 1e-4, 0.9))
        model = LabelModel(prior, clip(bad).tolist(), clip(good).tolist(), depends)
    return model


def _matrix(votes: list[list[int]], size: int):
    import numpy as np

    out = np.zeros((len(votes), size))
    for row, some in enumerate(votes):
        out[row, some] = 1
    return out


@dataclass
class Classifier:
    terms: list[str]
    weights: list[float]
    bias: float


def fit_linear(votes, target, n, l2: float = 0.3, rounds: int = 60) -> tuple[list[float], float]:
    """Logistic regression on soft labels, each row weighing ``n``, by Newton steps."""
    import numpy as np

    x = np.hstack([votes, np.ones((len(votes), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = -2.0
    ridge = np.full(x.shape[1], l2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - target)) + ridge * w
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), slope)
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-9))  # short steps, so that it can't run off
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1].tolist(), float(w[-1])


def fit_over(patterns: DataFrame, model: LabelModel, l2: float = 0.3, rounds: int = 60) -> tuple[list[float], float]:
    """What ``fit_linear`` fits, on all ``patterns`` (``votes``, ``n``), by sums of the loss and its slope on Spark."""
    import numpy as np

    size = len(model.bad)

    def loss(w):
        def run(batches):
            import pyarrow as pa

            total = np.zeros(size + 2)
            parts = (batch.slice(at, 1_000) for batch in batches for at in range(0, batch.num_rows, 1_000))
            for part in parts:
                x, n = _matrix(part.column(0).to_pylist(), size), np.sqrt(np.asarray(part.column(1), float))
                target = 1 / (1 + np.exp(-np.clip(model.log_odds(x), -30, 30)))
                z = x @ w[:-1] + w[-1]
                off = n * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
                total += np.r_[x.T @ off, off.sum(), (n * (np.logaddexp(0, z) - target * z)).sum()]
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(size + 2), pa.int32()), "s": pa.array(total, pa.float64())})

        total = np.zeros(size + 2)
        for row in patterns.mapInArrow(frugal(run), "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # size + 2 rows
            total[row["i"]] = row["s"]
        return total[-1] + l2 / 2 * (w @ w), total[:-1] + l2 * w

    # Quasi-Newton steps (L-BFGS) by the last ten changes of the slope.
    w, changes = np.r_[np.zeros(size), -2.0], []
    value, slope = loss(w)
    for _ in range(rounds):
        if np.abs(slope).max() < 1e-3:
            break
        step, shares = slope.copy(), []
        for s, y in reversed(changes):
            shares.append(s @ step / (y @ s))
            step -= shares[-1] * y
        step *= changes[-1][0] @ changes[-1][1] / (changes[-1][1] @ changes[-1][1]) if changes else 1 / np.linalg.norm(slope)
        for (s, y), a in zip(changes, reversed(shares)):
            step += s * (a - y @ step / (y @ s))
        reach = 1.0
        new_value, new_slope = loss(w - step)
        while new_value > value - 1e-4 * reach * (slope @ step) and reach > 1e-4:
            reach /= 2
            new_value, new_slope = loss(w - reach * step)
        if (change := -reach * step) @ (new_slope - slope) > 1e-12:
            changes = [*changes[-9:], (change, new_slope - slope)]
        w, value, slope = w + change, new_value, new_slope
    return w[:-1].tolist(), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``toxic``).

    Labels of held-out rows (crc32 of the id as text mod 3 is 1) are never
    read.  At most about ``sample`` labelled rows of each class are used;
    equal texts count once.  Votes are counted over all documents.  Without
    labelled rows every score is near 0.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = F.broadcast(sampled(known, "toxic", sample))  # about 2 * sample rows
    rows = docs.select("doc_id", "text").filter("text is not null").join(chosen, "doc_id")
    rows = written(rows.dropDuplicates(["text"]).select("text", "toxic"), "toxic-sample")
    terms = reliable(vote_patterns(docs, known, mined := mine_terms(rows)), mined)
    size = len(terms) + PATTERNS

    def vote(batches):
        import pyarrow as pa

        voters = Voters(terms)
        for batch in batches:
            votes = [voters.votes(text) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.list_(pa.int32())), batch.column(1)], ["votes", "toxic"])

    # The bounded sample, reduced to its votes.
    held = rows.select("text", "toxic").mapInArrow(frugal(vote), "votes array<int>, toxic int").orderBy("votes", "toxic").collect()
    import numpy as np

    votes, truth = _matrix([row["votes"] for row in held], size), np.array([row["toxic"] for row in held], float)
    n1, n0 = truth.sum(), (1 - truth).sum()
    if n1 == 0:
        return Classifier(terms, [0.0] * size, -6.0)
    patterns = written(vote_patterns(docs, known, terms), "toxic-votes")
    # Rates on the sample, for the start; the share of toxic documents among the labelled ones is the prior.
    counts = {row["toxic"]: row["n"] for row in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = counts.get(1, 0) / max(sum(counts.values()), 1)
    start = LabelModel(
        min(max(prior, 1e-4), 0.9),
        ((truth @ votes + 0.5) / (n1 + 1)).tolist(),
        (((1 - truth) @ votes + 0.5) / (n0 + 1)).tolist(),
        [],
    )
    model = fit_label_model(patterns, start)
    # The classifier learns the posterior on all patterns.
    every = written(patterns.groupBy("votes").agg(F.sum("n").alias("n")), "toxic-patterns")
    if every.count() * size > FITTED:
        weights, bias = fit_over(every, model)
    else:
        every = every.orderBy("votes").collect()
        votes = _matrix([row["votes"] for row in every], size)
        posterior = 1 / (1 + np.exp(-np.clip(model.log_odds(votes), -30, 30)))
        weights, bias = fit_linear(votes, posterior, np.sqrt([row["n"] for row in every]))
    return Classifier(terms, weights, bias)


def score(docs: DataFrame, model: Classifier, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (default ``doc_id``), ``score`` (0 to 1) and ``predicted`` of each row; null scores as empty."""
    keep = ["doc_id"] if keep is None else keep
    names = [*keep, "score"]
    picked = docs.select(*keep, docs[text].alias(free_name(docs, "__text")))

    def run(batches):
        import pyarrow as pa

        voters = Voters(model.terms)
        for batch in batches:
            scores = []
            for value in batch.column(len(keep)).to_pylist():
                logit = model.bias + sum(model.weights[i] for i in voters.votes(value or ""))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), pa.array(scores, pa.float64())], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    scored = picked.mapInArrow(frugal(run), f"{kinds}, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic, all columns as they are."""
    model = train(docs, labels)

    def run(batches):
        import pyarrow as pa

        voters, at = Voters(model.terms), None
        for batch in batches:
            at = batch.schema.get_field_index("text") if at is None else at
            logits = [model.bias + sum(model.weights[i] for i in voters.votes(x or "")) for x in batch.column(at).to_pylist()]
            clean = [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) < THRESHOLD for x in logits]
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(frugal(run), docs.schema)
