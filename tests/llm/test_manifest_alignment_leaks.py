"""Merkle manifest, cross-tokenizer alignment and benchmark passages against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

np = pytest.importorskip("numpy")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from mercato.llm import alignment, common, decontaminate, merkle  # noqa: E402
from mercato.llm.bpe import byte_letters  # noqa: E402
from mercato.llm.pair_hash import SPREAD, PairHash, build_bucket, mix, spread  # noqa: E402
from mercato.llm.queries import PIECES, tokenizer_path  # noqa: E402

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, pos string, words string, row string, digest string, pairs string"
EXTRA = (7, "x", "x", "x", "x", "x")


@pytest.fixture(scope="module", autouse=True)
def workers_find_the_package(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


def frame(spark, rows):
    """Rows of (doc_id, text, lang, source, n_chars) with columns beside them whose names the operators use."""
    return spark.createDataFrame([(*row, *EXTRA) for row in rows], SCHEMA)


# --- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def manifest_by_hand(rows):
    def leaf(values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def climb(level, own):
        """Digest at the top, and the siblings from ``own`` up."""
        proof, steps = "", []
        while len(level) > 1:
            run = range(own // 8 * 8, min(own // 8 * 8 + 8, len(level)))
            steps.append(([level[i] for i in run if i < own], [level[i] for i in run if i > own]))
            proof += "".join(level[i] for i in run if i != own)
            level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
            own //= 8
        return level[0], proof, steps

    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        lowered = re.sub("[A-Z]", lambda x: x[0].lower(), text) if text is not None and tampered else text
        head = (doc_id, source, lang, n_chars)
        groups[lang].append((-1 if doc_id is None else doc_id, leaf((*head, text)), leaf((*head, lowered)), doc_id))
    names = sorted(groups, key=lambda x: b"" if x is None else b"\1" + x.encode())
    for group in groups.values():
        group.sort()
    subroots = [climb([x[1] for x in groups[name]], 0)[0] for name in names]
    out = []
    for at, name in enumerate(names):
        for own, (_, real, altered, doc_id) in enumerate(groups[name]):
            subroot, low, first = climb([x[1] for x in groups[name]], own)
            root, high, rest = climb(subroots, at)
            fold = altered
            for before, after in first + rest:
                fold = sha("".join(before) + fold + "".join(after))
            out.append((doc_id, real, subroot, root, sha(low + high), fold, fold == root))
    return out


def manifest_rows(n, langs, rng):
    texts = ["Some Text", "lower only", "", None, "ÄÖ É Ünï", "x" * 30_000]
    rows = [(i * 7 % 1009, rng.choice(texts), rng.choice(langs), rng.choice([None, "s", "ß"]), rng.choice([None, 5])) for i in range(n)]
    return rows


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, "Only", "en", "s", 4)],
        [(1, "Only", None, None, None), (None, None, None, None, None)],
        manifest_rows(9, ["en"], random.Random(1)),
        manifest_rows(8, ["en", "de"], random.Random(2)),
        manifest_rows(700, [None, "en", "en", "en", "", "é", "z"], random.Random(3)),
        manifest_rows(90, [f"l{i}" for i in range(70)], random.Random(4)) + [(5, "Twice", "l1", "s", 1)] * 20 + [(None, "No Id", "l2", None, 1)] * 20,
    ],
)
def test_manifest_is_that_of_the_rules(spark, rows):
    got = merkle.tamper_check(frame(spark, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda row: tuple(str(x) for x in row)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(manifest_by_hand(rows), key=key)


def test_manifest_shows_any_change_of_a_column(spark):
    rows = [(i, f"text {i}", "en", "s", i) for i in range(20)]
    docs = frame(spark, rows)
    for column, value in (("source", "other"), ("n_chars", 99), ("text", "")):
        from pyspark.sql import functions as F

        altered = F.when(F.col("doc_id") == 11, F.lit(value)).cast(docs.schema[column].dataType)
        built = merkle.manifest(docs, altered={column: altered}).withColumn("fold", merkle.folded(F.coalesce("altered_leaf", "leaf")))
        assert [r["doc_id"] for r in built.filter("fold <> root").collect()] == [11]


# --- Alignment


TEXTS = [
    None, "", " ", "a", "  two  blanks ", "don't<|endoftext|>stop<s> </s>", "};\r\n  foo\r bar \r", "\r", "a\r\rb\n\r\n{\r", "▁mark", "x ▁ y", "tab\tand\x0b\x0c\x1c",
    "日本語 テスト 🎉🎉", "Straße 12.5€ --- ###", "a" * 3000, "ab " * 4000, "\n\nlines\n\n\nmore\n", "\x85odd\xa0space 　x", "nul\0byte", "é ́", "<0x41> <unk>",
]


def align_by_hand(texts):
    a = tokenizers.Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    byte = {letter: i for i, letter in enumerate(byte_letters())}
    found, counts = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or {b"".join(raw_a), b"".join(raw_b)} != {(" " + text).encode()}:
            found.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((ids_a[i:k], ids_b[j:m]))
            i, j = k, m
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        counts.update(set(links))
        found.append((len(ids_a), len(ids_b), groups, links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for item in found:
        if item is None:
            out.append((0,) * 6 + ("",))
            continue
        n_a, n_b, groups, links = item
        spelled = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), spelled))
    return out


def odd_texts():
    rng = random.Random(8)
    letters = ["a", "b", "the", "ing", " ", " ", "  ", "\n", "\r", "\r\n", ";", ")", "{", "\t", "é", "ß", "日", "🎉", "\xa0", "▁", "1", "23", ".", "<s>"]
    return TEXTS + ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(400)] + ["the same text here"] * 5


@pytest.mark.parametrize("broadcast", [True, False])
def test_alignment_is_that_of_the_libraries(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(alignment, "PAIRS", 0)
    texts = odd_texts()
    want = [(i, *row) for i, row in enumerate(align_by_hand(texts))]
    docs = frame(spark, [(i, text, None, None, None) for i, text in enumerate(texts)]).repartition(3)
    got = alignment.align_tokenizers(docs, tokenizer_path(), tokenizer_path(PIECES))
    rows = sorted((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in got.collect())
    assert rows == want


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(None, "twice", None, None, None)] * 2])
def test_alignment_of_few_rows(spark, rows):
    got = alignment.align_tokenizers(frame(spark, rows), tokenizer_path(), tokenizer_path(PIECES)).collect()
    want = align_by_hand([row[1] for row in rows])
    assert [(r["n_a"], r["n_groups"], r["count_sum"]) for r in got] == [(w[0], w[2], w[5]) for w in want]


def test_a_full_table_and_long_groups_change_nothing(monkeypatch):
    monkeypatch.setattr(alignment, "LISTED", 2)
    aligner = alignment.Aligner(open(tokenizer_path(), encoding="utf-8").read(), open(tokenizer_path(PIECES), "rb").read())
    texts = [text for text in odd_texts() if text]
    want = align_by_hand(texts)
    table = alignment.PieceTable(aligner, spelled=True, limit=5000)
    for text, (n_a, n_b, n_groups, n_links, _, _, spelled) in zip(texts, want):
        flat, _, whole = table.texts([text])
        assert whole[0] == (n_a > 0)
        if whole[0]:
            sums = [int(table.values[name][flat].sum()) for name in ("n_a", "n_b", "n_groups", "n_links")]
            assert (*sums, ";".join(table.groups[i] for i in flat)) == (n_a, n_b, n_groups, n_links, spelled)
            pairs, times, _ = table.pairs_of(flat)
            assert int(times.sum()) == n_links


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 40_000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 47, n))
    count = max(1, len(keys) // 4096)
    bucket = spread(keys) * count >> SPREAD
    numbers = PairHash([build_bucket(keys[bucket == b]) for b in range(count)])
    found = numbers.find(keys)
    assert sorted(found.tolist()) == list(range(len(keys)))
    assert (numbers.keys[found] == keys).all()
    others = np.setdiff1d(mix(np.arange(5000), 3).astype(np.int64) >> 17, keys)
    assert (numbers.find(others) == -1).all()


def test_vectors_sum_up_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 16)
    monkeypatch.setattr(alignment, "BRANCHES", 2)
    rng = np.random.default_rng(1)
    rows = [(int(k), int(spread([k])[0]), int(n)) for k, n in zip(rng.integers(0, 50, 4000), rng.integers(1, 9, 4000))]
    pairs = spark.createDataFrame(rows, "pair long, spread long, docs long").repartition(7).persist()
    numbers = PairHash(alignment.hash_pairs(pairs))
    counts = alignment.dense_counts(pairs, spark.sparkContext.broadcast(numbers), len(numbers.keys))
    want = Counter()
    for key, _, n in rows:
        want[key] += n
    assert {key: counts[i] for i, key in enumerate(numbers.keys.tolist())} == want
    pairs.unpersist()


# --- Benchmark passages


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def leaks_by_hand(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for at in range(max(len(words) - 10, 0) + 1 if words else 0):
            windows[tuple(words[at : at + 10])].add(item)
    out = []
    for doc_id, text in docs:
        words = words_of(text)
        hit, held = set(), set()
        for size in {len(w) for w in windows}:
            for at in range(len(words) - size + 1):
                if tuple(words[at : at + size]) in windows:
                    hit.update(range(at, at + size))
                    held |= windows[tuple(words[at : at + size])]
        held = sorted(str(x) for x in held if x is not None)
        out.append((doc_id, len(words), len(hit), len(held), sha(",".join(held)), bool(hit)))
    return out


def passages():
    rng = random.Random(5)
    pool = ["the", "a", "of", *(f"w{i}" for i in range(30)), "ÄPFEL", "Été", "日本", "Ab1"]
    items = [(i, " ".join(rng.choices(pool, k=k))) for i, k in enumerate([0, 1, 2, 4, 5, 9, 10, 11, 14, 30, 60])]
    items += [(20, items[9][1]), (21, "the the the the the the the the the the the the"), (None, "no id here " * 4), (22, None), (9, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 never seen"), (9, "...")]
    texts = [None, "", " -- ", "the " * 40, "x"]
    for _ in range(120):
        text = " ".join(rng.choices(pool, k=rng.randint(0, 60)))
        if rng.random() < 0.5:
            words = words_of(rng.choice([i for i in items if i[1]])[1])
            start = rng.randint(0, max(0, len(words) - 10))
            text += rng.choice([" ", "\n", "!! "]) + rng.choice([" ", ", "]).join(words[start : start + rng.randint(8, 25)]).upper() + " tail"
        texts.append(text)
    texts.append(" ".join(rng.choices(pool, k=30_000)) + " " + items[9][1])
    docs = [(i, text) for i, text in enumerate(texts)] + [(None, items[9][1]), (None, None), (3, items[8][1]), (3, items[8][1])]
    return docs, items


ITEMS = "item_id long, text string, window string, id string"


@pytest.mark.parametrize("longest", [60, 9])
def test_leaks_are_those_of_brute_force(spark, longest):
    docs, items = passages()
    items = [(i, text) for i, text in items if len(words_of(text)) <= longest]
    table = spark.createDataFrame([(*row, "x", "y") for row in items], ITEMS)
    got = decontaminate.decontamination(frame(spark, [(i, text, None, None, None) for i, text in docs]), table)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    key = lambda row: tuple(str(x) for x in row)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(leaks_by_hand(docs, items), key=key)


def test_leaks_of_empty_tables(spark):
    docs, items = passages()
    some = frame(spark, [(i, text, None, None, None) for i, text in docs[:9]])
    none = spark.createDataFrame([], ITEMS)
    assert sorted(r["n_words"] for r in decontaminate.decontamination(some, none).collect()) == sorted(len(words_of(t)) for _, t in docs[:9])
    table = spark.createDataFrame([(*row, "x", "y") for row in items], ITEMS)
    assert decontaminate.decontamination(frame(spark, []), table).count() == 0


class Captured:
    """Stands for a frame and keeps the function that goes to ``mapInArrow``."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_alignment_takes_bounded_slices_and_hands_memory_back(monkeypatch):
    import pyarrow as pa

    with open(tokenizer_path(), encoding="utf-8") as spec, open(tokenizer_path(PIECES), "rb") as model:
        shared = type("Shared", (), {"value": ("slices", spec.read(), model.read())})
    taken, handed = [], []
    texts_of = alignment.PieceTable.texts
    monkeypatch.setattr(alignment.PieceTable, "texts", lambda self, texts: taken.append(sum(map(len, texts))) or texts_of(self, texts))
    monkeypatch.setattr(common, "hand_back", lambda: handed.append(len(taken)))
    texts = [None, "", *("some words in a row " * 5_000 for _ in range(25)), "the last one"]
    pairs = list(alignment.document_pairs(Captured(), shared).run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])))
    assert sum(taken) == sum(len(x or "") for x in texts) and max(taken) <= 1 << 20
    assert handed == [len(taken)]
    assert {26, 25} >= {n for batch in pairs for n in batch.column(2).to_pylist()} - {1}


def test_pieces_are_aligned_once_for_all_tasks_of_a_worker(monkeypatch):
    import pyarrow as pa

    with open(tokenizer_path(), encoding="utf-8") as spec, open(tokenizer_path(PIECES), "rb") as model:
        shared = type("Shared", (), {"value": ("two tasks", spec.read(), model.read())})
    aligned, plain = [], alignment.Aligner.align
    monkeypatch.setattr(alignment.Aligner, "align", lambda self, pieces, spelled: aligned.extend(pieces) or plain(self, pieces, spelled))
    texts = ["some words, some more", None, "words in two tasks"]
    found = []
    for _ in range(2):
        run = alignment.document_pairs(Captured(), shared).run
        found.append([batch.to_pydict() for batch in run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))])
    assert found[0] == found[1]
    assert len(aligned) == len(set(aligned)) == 7


def test_texts_cut_together_are_aligned_as_by_the_libraries():
    with open(tokenizer_path(), encoding="utf-8") as spec, open(tokenizer_path(PIECES), "rb") as model:
        aligner = alignment.Aligner(spec.read(), model.read())
    rng = random.Random(4)
    parts = ["Word", "don't", "é", "ß", "÷", "×", "½", "²", "_", ",", ".", "'s", "-", "(", " ", " ", "  ", "\n", "\n", "\r", "\r\n", "\x85", "\xa0", " ", " ", "　", "…", "é", "日本", "Я", "9"]
    texts = ["", *("".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(1500)), ""]
    want = align_by_hand(texts)
    table = alignment.PieceTable(aligner, spelled=True, limit=50_000)
    for at in range(0, len(texts), 100):
        flat, ends, whole = table.texts(texts[at : at + 100])
        groups = table.groups_of(flat, ends, whole)
        assert groups == [row[6] for row in want[at : at + 100]]
        links = np.append(0, np.cumsum(table.values["n_links"][flat]))[ends]
        assert (np.diff(links) * whole).tolist() == [row[3] for row in want[at : at + 100]]
