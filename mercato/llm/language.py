"""Language identification by a linear-chain conditional random field over words.

Each word of a text gets a label, so that code-switched texts are labelled in
parts.  Features of a word are its beginnings and endings, its character
2- and 3-grams and the word itself; transitions between the labels of adjacent
words are learnt with them.  Training pairs stretches of documents of
different languages, so that switches occur.  Prediction runs forward and
backward over the whole text and sums the labels' probabilities.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.chunks import slices
from mercato.llm.toxicity import sampled

#: Labelled documents of each language that the model is fitted on, about at most, and the longest of them in characters.
SAMPLE, LONGEST = 150, 20_000
STRETCH = 64
ROUNDS = 30
#: Words whose label scores a worker keeps between texts, and words scored together.
KEPT, TOGETHER = 600_000, 20_000


def clean(word: str) -> str:
    """The letters and inner marks of a lower-cased word: what stands before and behind is cut off."""
    start, end = 0, len(word)
    while start < end and not word[start].isalpha():
        start += 1
    while end > start and not word[end - 1].isalpha():
        end -= 1
    return word[start:end]


def features(word: str) -> list[str]:
    """Affixes, n-grams and the word; none for a word without letters."""
    if not word:
        return []
    marked = f"^{word}$"
    grams = dict.fromkeys([marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1)])
    affixes = [f"<{word[:n]}" for n in (1, 4)] + [f"{word[-n:]}>" for n in (1, 4)]
    return [*grams, *affixes, f"={word}"]


@dataclass
class Crf:
    languages: list[str]
    index: dict[str, int]
    weights: object  # features by languages
    steps: object  # languages by languages

    def scores(self, words: list[str]):
        """Label scores of each word and, last, whether it has a letter."""
        import numpy as np

        cleaned = [clean(word) for word in words]
        flat, counts = [], []
        for word in cleaned:
            found = [at for at in map(self.index.get, features(word)) if at is not None]
            flat += found
            counts.append(len(found))
        out = np.empty((len(words), len(self.languages) + 1), np.float32)
        owner, at = np.repeat(np.arange(len(words)), counts), np.array(flat, int)
        for label in range(len(self.languages)):
            out[:, label] = np.bincount(owner, self.weights[at, label], len(words))
        out[:, -1] = [bool(word) for word in cleaned]
        return out


def marginals(scores, starts, steps, forward=None):
    """Label probabilities of each word by forward-backward over a chain of texts.

    ``scores`` are words by labels; ``starts`` marks the first word of each
    text, at which nothing is carried over.  The chain is cut into blocks whose
    products of transition matrices are taken side by side; a pass over the
    blocks then gives what enters each, and the blocks are run through again.
    ``forward`` (words by labels) takes the probabilities given the words up to each.
    """
    import numpy as np

    count, labels = scores.shape
    width = 64
    blocks = -(-count // width)
    emit = np.ones((blocks * width, labels))
    emit[:count] = np.exp(scores - scores.max(1, keepdims=True))
    emit = emit.reshape(blocks, width, labels)
    # What fills the last block up must tell nothing of the words before it.
    fresh = np.ones(blocks * width, bool)
    fresh[:count] = starts
    fresh = fresh.reshape(blocks, width)
    move = np.exp(steps - steps.max())
    flat = np.ones((labels, labels))

    def into(k):
        return np.where(fresh[:, k, None, None], flat, move)

    def scaled(x, axis=-1):
        return x / x.sum(axis, keepdims=True)

    product = np.broadcast_to(np.eye(labels), (blocks, labels, labels)).copy()
    for k in range(width):
        product = (product @ into(k)) * emit[:, k, None, :]
        product /= product.sum((1, 2), keepdims=True)
    ahead, behind = np.ones((blocks, labels)), np.ones((blocks, labels))
    for b in range(1, blocks):
        ahead[b] = scaled(ahead[b - 1] @ product[b - 1])
    for b in range(blocks - 2, -1, -1):
        behind[b] = scaled(product[b + 1] @ behind[b + 1])
    alpha = np.empty((blocks, width, labels))
    for k in range(width):
        ahead = scaled((ahead[:, None, :] @ into(k))[:, 0] * emit[:, k])
        alpha[:, k] = ahead
    if forward is not None:
        forward[:] = alpha.reshape(-1, labels)[:count]
    for k in range(width - 1, -1, -1):
        mine = alpha[:, k].copy()
        alpha[:, k] = scaled(mine * behind)
        behind = scaled((into(k) @ (emit[:, k] * behind)[:, :, None])[:, :, 0])
    return alpha.reshape(-1, labels)[:count]


def pair_probabilities(scores, starts, steps):
    """Label probabilities of each word, and of each word with the next by both their labels.

    What the words from the next one on tell of its label is its probability
    over that foreseen from the words before, so the forward pass and the
    label probabilities are all that pairs need.  Pairs across texts are meaningless.
    """
    import numpy as np

    forward = np.empty(scores.shape)
    p = marginals(scores, starts, steps, forward)
    move = np.exp(steps - steps.max())
    foreseen = forward[:-1] @ move
    return p, forward[:-1, :, None] * move * (p[1:] / foreseen)[:, None, :]


def fit(texts: list[tuple[str, str]], rounds: int = ROUNDS, seed: int = 5) -> Crf:
    """Fit on (text, language) pairs by gradient ascent on the likelihood of the labels."""
    import numpy as np

    languages = sorted({language for _, language in texts})
    label = {language: i for i, language in enumerate(languages)}
    size = len(languages)
    stretches = []
    for text, language in texts:
        words = [w for w in map(clean, text.lower().split()) if w]
        stretches += [(words[a : a + STRETCH], label[language]) for a in range(0, len(words), STRETCH)]
    random.Random(seed).shuffle(stretches)
    # Two stretches follow one another as one text, so languages switch.
    words = [word for part, _ in stretches for word in part]
    gold = np.array([y for part, y in stretches for _ in part], int)
    starts = np.array([i == 0 and k % 2 == 0 for k, (part, _) in enumerate(stretches) for i in range(len(part))], bool)
    types: dict[str, int] = {}
    token = np.array([types.setdefault(word, len(types)) for word in words], int)
    index: dict[str, int] = {}
    flat, owner = [], []
    for i, word in enumerate(types):
        for feature in features(word):
            flat.append(index.setdefault(feature, len(index)))
            owner.append(i)
    if not words or size < 2:
        return Crf(languages, {}, np.zeros((1, size)), np.zeros((size, size)))
    flat, owner = np.array(flat), np.array(owner)
    weights, steps = np.zeros((len(index), size)), np.zeros((size, size))
    seen, seen_steps = np.full(weights.shape, 1e-8), np.full(steps.shape, 1e-8)
    inner = ~starts[1:]
    onehot = np.eye(size)[gold]
    for _ in range(rounds):
        emission = np.stack([np.bincount(owner, weights[flat, y], len(types)) for y in range(size)], 1)
        scores = emission[token]
        p, pair = pair_probabilities(scores, starts, steps)
        slope_type = np.stack([np.bincount(token, (onehot - p)[:, y], len(types)) for y in range(size)], 1)
        slope = np.stack([np.bincount(flat, slope_type[owner, y], len(index)) for y in range(size)], 1) - 0.02 * weights
        slope_steps = (onehot[:-1][inner].T @ onehot[1:][inner]) - pair[inner].sum(0) - 0.02 * steps
        seen += slope**2
        seen_steps += slope_steps**2
        weights += 0.3 * slope / np.sqrt(seen)
        steps += 0.1 * slope_steps / np.sqrt(seen_steps)
    return Crf(languages, index, weights, steps)


def train(docs: DataFrame, may_learn, text: str = "text", language: str = "lang", sample: int = SAMPLE) -> Crf:
    """Fit on rows of ``docs`` that ``may_learn`` (a column) admits and that have a language.

    At most about ``sample`` whole texts of each language, none longer than
    ``LONGEST`` characters, come to the driver.
    """
    known = docs.filter(may_learn & F.col(language).isNotNull() & F.col(text).isNotNull() & (F.length(text) <= LONGEST) & F.col("doc_id").isNotNull())
    rows = sampled(known.select("doc_id", F.col(text).alias("text"), F.col(language).alias("lang")), "lang", sample)
    return fit([(row["text"], row["lang"]) for row in rows.orderBy("doc_id").select("text", "lang").collect()])


class _Scores(dict):
    """Label scores by word, as bytes, kept between texts."""

    def __init__(self, crf: Crf):
        self.crf = crf

    def of(self, lists: list[list[str]]):
        """Rows of scores of all words of ``lists``; words not known yet are scored together."""
        import numpy as np

        if len(self) > KEPT:
            for key in list(self)[: len(self) - KEPT // 2]:
                del self[key]
        new = list(dict.fromkeys(word for words in lists for word in words if word not in self))
        width = 4 * (len(self.crf.languages) + 1)
        for start in range(0, len(new), TOGETHER):
            some = new[start : start + TOGETHER]
            raw = self.crf.scores(some).tobytes()
            for i, word in enumerate(some):
                self[word] = raw[width * i : width * (i + 1)]
        raw = b"".join([self[word] for words in lists for word in words])
        for word in new:
            if len(word) > 64:
                del self[word]
        return np.frombuffer(raw, np.float32).reshape(-1, len(self.crf.languages) + 1).astype(float)


def predict(docs: DataFrame, crf: Crf, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default ``doc_id``), ``lang_pred`` and ``score`` of each row.

    ``lang_pred`` is the language with the most words, each counted by its
    probability (words that also stand two places before are not counted again), and ``score`` its share of them; ``und`` with score 0 for
    null, for texts without a letter, and where nothing was learnt.  Ties go to
    the first language by name.  Rows are independent, other columns ignored.
    """
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    names = [*keep, "lang_pred", "score"]
    picked = docs.select(*keep, docs[text].alias("__text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        crf = shared.value
        size, table = len(crf.languages), _Scores(crf)

        def label(part: list[str]):
            lists = [value.lower().split() for value in part]
            ends = np.cumsum([0, *map(len, lists)])
            sums = np.zeros((len(part), size))
            if ends[-1] and size:
                scores = table.of(lists)
                starts = np.zeros(ends[-1], bool)
                starts[ends[:-1][ends[:-1] < ends[1:]]] = True
                # A phrase of one or two words said over and over counts once.
                again = [a == b for words in lists for a, b in zip(words, [None, None, *words])]
                p = marginals(scores[:, :size], starts, crf.steps) * scores[:, size:] * ~np.array(again)[:, None]
                sums = np.diff(np.concatenate([np.zeros((1, size)), np.cumsum(p, 0)])[ends], axis=0)
            for row in sums:
                total = row.sum()
                best = int(row.argmax()) if size else 0
                yield (crf.languages[best], float(min(1.0, row[best] / total))) if total > 1e-6 else ("und", 0.0)

        for batch in batches:
            found = [x for part in slices(batch.column(len(keep)).to_pylist()) for x in label(part)]
            kept = [batch.column(c) for c in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kinds}, lang_pred string, score double")
