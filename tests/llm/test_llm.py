"""The training-data operators on small tables, against brute force and the library."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pytest

np = pytest.importorskip("numpy")
tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from mercato.llm import bpe, common, embedding_dedup, exact_dedup, language, minhash, mixing, pii, token_counts, token_files, toxicity  # noqa: E402
from mercato.llm.components import connected_components  # noqa: E402
from mercato.llm.queries import round_trip, tokenizer_path  # noqa: E402

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, keep_id string, component string, score string"
ODD = [
    None, "", " ", "\n\n a\tb ", "don't  stop <|endoftext|>now<|endoftext|>", "日本語 テスト 🎉", "Straße 12.5€ --- ###", "a" * 3000, "x y " * 5000,
    "\x1c odd\x85space  here", "one two three four", "One  TWO three\nfour",
]


@pytest.fixture(scope="module")
def docs(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = [*ODD, *(" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(60))]
    base = texts[20:26]
    for text in base:  # near and exact copies
        parts = text.split(" ")
        texts += [" ".join([*parts[:-1], "changed"]), "  ".join(parts), text]
    rows = [(i, text, None, [None, "b", "a", ""][i % 4], None, "s", "k", "c", "x") for i, text in enumerate(texts)]
    rows += [(None, "no id", None, None, None, "s", "k", "c", "x"), (None, None, None, None, None, "s", "k", "c", "x"), rows[15], rows[15]]
    return spark.createDataFrame(rows, SCHEMA)


def text_of(row):
    return row["text"] or ""


def norm(text):
    import re

    return re.sub("[\x20\x09-\x0d]+", " ", text)


def test_ids_and_texts_are_those_of_the_library(spark, docs):
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    want = {}
    for row in docs.collect():
        ids = library.encode(text_of(row), add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[row["doc_id"], hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] = (len(ids), hashlib.sha256(decoded.encode()).hexdigest())
    got = {(r["doc_id"], r["ids_sha256"]): (r["n_tokens"], r["decoded_sha256"]) for r in round_trip(docs).collect()}
    assert got == want
    counted = token_counts.count_tokens(docs, tokenizer_path()).collect()
    wanted = sorted((-1 if r["doc_id"] is None else r["doc_id"], len(text_of(r).encode()), len(library.encode(text_of(r), add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in counted) == wanted


def test_automaton_on_random_strings():
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    encoder = bpe.Encoder(open(tokenizer_path(), encoding="utf-8").read())
    rng = random.Random(9)
    for _ in range(1500):
        text = "".join(rng.choice("aabbeettss ..''$$**#1é ñ\n") for _ in range(rng.randint(0, 40)))
        ids = np.frombuffer(next(encoder.encode([text])), np.uint32).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert encoder.automaton.decode(ids) == text


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("high", [1, 2, 300, 50257, 2**32 - 1])
def test_blocks_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint32)
    ids[: min(n, 3)] = 2**32 - 1
    blocks = token_files.pack_blocks(ids)
    places = np.cumsum([0, *map(len, blocks)])
    assert (token_files.unpack_blocks(b"".join(blocks), places, n) == ids).all()


def test_token_files_keep_order_and_ids(spark, docs):
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    got = token_files.ids_crc32(token_files.token_files(docs, tokenizer_path(), 2)).collect()
    start = 0
    texts = {(r["doc_id"], text_of(r)) for r in docs.collect() if r["doc_id"] is not None}
    by_id = dict(texts)
    for row in sorted(got, key=lambda r: r["start"]):
        assert row["start"] == start
        start += row["n_tokens"]
        if row["doc_id"] is not None:
            ids = [*library.encode(by_id[row["doc_id"]], add_special_tokens=False).ids, 2]
            assert row["n_tokens"] == len(ids)
            assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    ordered = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ordered == sorted(ordered) and len(got) == docs.count()


@pytest.mark.parametrize("limit", [64 << 20, 400])
def test_exact_groups(docs, limit):
    groups = {}
    for row in docs.collect():
        groups.setdefault(norm(text_of(row)), []).append(row["doc_id"])
    for row in exact_dedup.exact_groups(docs, table_bytes=limit).collect():
        content = next(c for c in groups if hashlib.sha256(c.encode()).hexdigest() == row["text_sha256"])
        ids = [x for x in groups[content] if x is not None]
        assert row["group_size"] == len(groups[content])
        assert row["keep_id"] == (min(ids) if ids else None)
        assert row["kept"] == (row["doc_id"] == row["keep_id"])
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_near_groups_are_those_of_brute_force(docs):
    rows = [r for r in docs.collect()]
    sets = {}
    for row in rows:
        words = text_of(row).encode().lower().split()
        sets[row["doc_id"], text_of(row)] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    nodes = [k for k in sets if k[0] is not None and sets[k]]
    root = {k: k[0] for k in nodes}
    while True:
        moved = False
        for a in nodes:
            for b in nodes:
                both = len(sets[a] & sets[b])
                if root[a] < root[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    root[b], moved = root[a], True
        if not moved:
            break
    by_id = {k[0]: v for k, v in root.items()}
    for row in minhash.near_groups(docs).collect():
        if row["doc_id"] is None:
            assert row["component_id"] is None and row["kept"]
        else:
            assert row["component_id"] == by_id.get(row["doc_id"], row["doc_id"])
            assert row["kept"] == (row["doc_id"] == row["component_id"])
    assert minhash.drop_near_copies(docs).columns == docs.columns


def test_parities_never_exceed_the_shingles_that_differ():
    rng = np.random.default_rng(3)
    for n in (1, 31, 40, 300, 9_000):
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        one, other = (np.unique(np.r_[both, rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)]) for _ in "ab")
        x, y = minhash.Hasher.parities(one), minhash.Hasher.parities(other)
        assert len(x) == len(y) and len(x) * 8 <= minhash.MOST
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(one, other))
        half = len(x) // 2
        odd = np.bincount((one % np.uint64(half * 8)).astype(int), minlength=half * 8) & 1
        assert (np.unpackbits(x[:half] ^ x[half:], bitorder="little") == odd).all()


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 101), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}


def test_mix_comes_near_its_targets(spark, docs):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 60), ["a", "b", None][i % 7 % 3]) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(table).collect()
    assert len(got) == 3000 and got and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(table.repartition(7)).collect()), key=str)
    total, targets = sum(r["size"] for r in got), {}
    for source in ("a", "b", None):
        mine = [r for r in got if r["source"] == source]
        targets[source] = mine[0]["target"]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 130
        assert mine[0]["target"] <= 2 * mine[0]["source_size"] + 1e-6
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-3
    assert mixing.mix(docs).count() == docs.count()
    assert mixing.take(docs).columns == docs.columns


def test_toxic_terms_are_learnt(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT
    rng = random.Random(2)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = rng.choices(words, k=40)
        if i % 4 == 0:
            text[rng.randrange(40)] = rng.choice(["vilest", "grottyone", "grottytwo"])
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(i % 4 == 0)))
    rows += [(None, None, "x"), (601, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(600))
    assert got[None]["predicted"] == got[601]["predicted"] == 0
    assert {r["doc_id"] for r in toxicity.drop_toxic(docs, marks).collect()} == {i for i in range(600) if i % 4} | {None, 601}


def test_toxic_terms_are_not_cut_by_number(spark, monkeypatch):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT
    rng = random.Random(5)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    bad = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(66)]
    rows = [(i, " ".join([*rng.choices(words, k=10), bad[i // 2 % 66] if i % 2 else "fine"])) for i in range(7200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame([(i, i % 2) for i in range(7200)], "doc_id long, toxic int")
    for cells in (toxicity.FITTED, 0):  # in the driver, by sums on Spark
        monkeypatch.setattr(toxicity, "FITTED", cells)
        model = toxicity.train(docs, marks)
        assert len(model.terms) >= 64
        assert sum(r["predicted"] != r["doc_id"] % 2 for r in toxicity.score(docs, model).collect()) <= 400


def test_surrogates():
    key = b"k" * 32
    for kind, some in {
        "email": [f"a{i}b@mail.example.com" for i in range(300)], "ip": [f"10.0.{i // 256}.{i % 256}" for i in range(600)],
        "phone": [f"+1 (555) 000-{i:04d}" for i in range(600)], "card": [f"400000000000{i:04d}" for i in range(600)],
        "secret": [f"{i:08x}" for i in range(600)], "name": ["Anna Berg", "Maria Stein", "Anna Stein"],
    }.items():
        out = [pii.surrogate(kind, x, key) for x in some]
        assert len(set(out)) == len(some)
        assert out == [pii.surrogate(kind, x, key) for x in some]
    text = "Frau Anna Berg, anna@mail.de, +49 30 123456, 10.1.2.3 and Frau Anna Berg again. Version 1.2.3"
    done, kinds = pii.replace(text, key)
    assert kinds == ["name", "email", "phone", "ip", "name"]
    assert "Anna" not in done and "10.1.2.3" not in done and done.endswith("Version 1.2.3") and done.count("Frau ") == 2
    assert pii.replace("", key) == ("", [])


def test_whole_names_are_replaced():
    key = b"k" * 32
    for text, gone in {
        "Mrs. O'Brien": ["Brien", "O'"], "Mr. J. Smith came": ["Smith", "J."], "Dr. Martin Luther King spoke": ["Martin", "Luther", "King"],
        "Ms. Smith-Jones": ["Smith", "Jones"], "Frau Dr. Anna Berg": ["Anna", "Berg"], "Herr Ludwig van der Rohe": ["Ludwig", "Rohe"],
        "Mr. X": ["X"], "Mr. Li": ["Li"], "Dr. 山田 太郎": ["山", "田", "太", "郎"], "Mr. محمد علي": ["محمد", "علي"], "Ms. Él": ["É"],
        "Mr. राहुल": ["र"], "Mr. Smith Mrs. Jones": ["Smith", "Jones"], "Madame Jose\u0301 Garci\u0301a": ["Jose", "Garc"],
        "Anna Berg, then Frau Berg. Berg again, Berg's": ["Berg"], "Dr. 山田です。山田さん": ["山田"],
    }.items():
        done, kinds = pii.replace(text, key)
        assert kinds and not [x for x in gone if x in done], (text, done)
        assert len(done) == len(text)
    done, kinds = pii.replace("Mr. Smith's dog. The bergs, Smithson. Smith left.", key)
    word = done[4:9]
    assert done == f"Mr. {word}'s dog. The bergs, Smithson. {word} left." and word[-1] == "h" and kinds == ["name", "name"]
    for some in (list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), [a + "i" for a in "BCDFGHJKLMNPQRSTVWXYZ"], [chr(0x4E00 + i) for i in range(300)]):
        out = [pii.surrogate("name", x, key) for x in some]
        assert len(set(out)) == len(some) and not [x for x, y in zip(some, out) if x == y]


def test_linked_vectors_are_those_of_brute_force(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    vectors = np.concatenate([base, base[:10] + 0.05 * rng.standard_normal((10, 16)), base[:3], base[:1]]).astype(np.float32)
    rows = [(i, v.tolist(), [1, 2, None][i % 10 % 3], "x") for i, v in enumerate(vectors)]
    rows += [(90, None, 1, "x"), (91, [0.0] * 16, 1, "x"), (92, [float("nan")] * 16, 1, "x"), (None, vectors[0].tolist(), 1, "x"), (93, [], 1, "x"), (94, [None] * 16, 1, "x")]
    got = {r["vec_id"]: r for r in embedding_dedup.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")).collect()}
    usable = [(i, np.array(v, float), label) for i, v, label, _ in rows[: len(vectors)] if label is not None]
    for i, v, label in usable:
        links = [j for j, w, other in usable if j != i and label == other and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93]
        assert got[i]["n_links"] == len(links)
        assert got[i]["component_id"] <= min([i, *links])
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (90, 91, 92, 93, 94))
    assert got[None]["kept"] and got[None]["component_id"] is None


def test_isolated_pairs_near_the_threshold_are_found(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT
    rng = np.random.default_rng(11)
    one, aside = rng.standard_normal((2, 400, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    aside -= (aside * one).sum(1, keepdims=True) * one
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = np.linspace(0.931, 0.95, 400)[:, None]
    other = cosine * one + np.sqrt(1 - cosine**2) * aside
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([one, other]))]
    got = {r["vec_id"]: r for r in embedding_dedup.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert sum(got[i]["n_links"] == 1 and got[i + 400]["component_id"] == i for i in range(400)) >= 399
    # Vectors of few coordinates are all compared.
    turns = [(i, [float(np.cos(i / 9)), float(np.sin(i / 9))], 1) for i in range(40)]
    links = embedding_dedup.linked_vectors(spark.createDataFrame(turns, "vec_id long, embedding array<float>, label int")).collect()
    assert all(r["n_links"] == sum(np.cos((j - r["vec_id"]) / 9) >= 0.93 for j in range(40) if j != r["vec_id"]) for r in links)


def test_languages_of_code_switched_texts(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT
    rng = random.Random(6)
    words = {"xx": ["thing", "other", "then", "with"], "yy": ["jour", "votre", "dans", "leur"]}
    rows = [(i, " ".join(rng.choices(words["xx" if i % 2 else "yy"], k=30)), "xx" if i % 2 else "yy") for i in range(80)]
    rows += [(100, None, "xx"), (101, "12 34 !", None), (102, " ".join(["thing other then"] * 3 + ["jour votre dans leur"] * 9), None), (None, "thing", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    crf = language.train(docs, ~toxicity.held_out("doc_id", 4, 2))
    got = {r["doc_id"]: r for r in language.predict(docs, crf).collect()}
    assert all(got[i]["lang_pred"] == ("xx" if i % 2 else "yy") for i in range(80))
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[102]["lang_pred"] == "yy"


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(0)
    scores, steps = rng.standard_normal((130, 3)), rng.standard_normal((3, 3))
    starts = np.zeros(130, bool)
    starts[[0, 5, 100]] = True
    got = language.marginals(scores, starts, steps)
    p = np.zeros(3)
    import itertools

    whole = 0.0
    for path in itertools.product(range(3), repeat=5):
        weight = np.exp(sum(scores[t, y] for t, y in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:])))
        p[path[2]] += weight
        whole += weight
    assert np.allclose(got[2], p / whole)


def test_empty_tables(spark, docs):
    empty = docs.limit(0)
    for frame in (
        round_trip(empty), token_counts.count_tokens(empty, tokenizer_path()), exact_dedup.exact_groups(empty), minhash.near_groups(empty),
        mixing.mix(empty), pii.replace_private(empty, "k"), token_files.token_files(empty, tokenizer_path(), 2),
        toxicity.score(empty, toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))),
        language.predict(empty, language.train(empty, ~toxicity.held_out("doc_id", 4, 2))),
        embedding_dedup.linked_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
    ):
        assert frame.count() == 0


def test_decoding_apart_equals_decoding_at_once(docs):
    path = tokenizer_path()
    at_once = bpe.encode_and_decode(docs, path)
    apart = bpe.decode(bpe.encode(docs, path), path)
    assert at_once.columns == apart.columns
    assert sorted(map(str, at_once.collect())) == sorted(map(str, apart.collect()))


def test_unknown_and_null_ids_have_no_text(spark):
    rows = [(1, [15496, 99999, -5, None, 995]), (2, None), (3, []), (4, [50256])]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, token_ids array<int>"), tokenizer_path())
    assert {r["doc_id"]: r["decoded"] for r in got.collect()} == {1: "Hello world", 2: "", 3: "", 4: "<|endoftext|>"}


def test_the_mix_takes_rows_that_share_an_id_or_have_none(spark):
    rows = [(None, f"some words here {i}", "a", 1) for i in range(40)] + [(7, "twice " * 5, "a", 2)] * 30 + [(9, "b " * 50, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").withColumnRenamed("copies", "__copies")
    plan = mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    got = taken.withColumn("size", mixing.words("text")).groupBy("source").agg({"size": "sum"}).collect()
    assert {r["source"]: r["sum(size)"] for r in got} == {r["source"]: r["sum(taken)"] for r in plan}
    for r in plan:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 50


def test_packed_ids_are_digested_without_a_second_worker(spark, docs):
    packed = token_files.token_files(docs, tokenizer_path(), 2, packed=True)
    got = token_files.ids_crc32(packed)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    listed = token_files.token_files(docs, tokenizer_path(), 2)
    whole = {r["start"]: r for r in listed.collect()}
    rows = packed.collect()
    assert len(rows) == len(whole) == docs.count()
    for row in rows:
        same = whole[row["start"]]
        assert (row["doc_id"], np.frombuffer(row["token_bytes"], "<u4").tolist()) == (same["doc_id"], same["token_ids"])
    assert got.schema == token_files.ids_crc32(listed).schema
    assert sorted(map(str, got.collect())) == sorted(map(str, token_files.ids_crc32(listed).collect()))


def test_texts_are_unpacked_in_slices():
    import pyarrow as pa

    from mercato.llm.chunks import column_slices

    texts = ["a" * 40, None, "", "ü" * 30, "b" * 500, "c", "d" * 99, None]
    column = pa.array(["left out", *texts]).slice(1)
    for size in (1, 100, 10_000):
        parts = list(column_slices(column, size))
        assert [x for part in parts for x in part] == [x or "" for x in texts]
        assert all(len(part) == 1 or sum(len(x.encode()) for x in part) <= size for part in parts)
    assert list(column_slices(column.slice(0, 0), 100)) == []


def test_pieces_give_the_ids_of_the_library_for_all_characters():
    from mercato.llm.chunks import PieceIds, load_library
    from mercato.llm.queries import tokenizer_path

    with open(tokenizer_path(), encoding="utf-8") as file:
        library = load_library(file.read())
    special = list(library.get_added_tokens_decoder().values())[0].content
    letters = [chr(c) for c in [*range(0x3100), 0x4E00, 0xAC00, 0x1F600, 0x20000, 0x2FA1D]]
    texts = [f"a {x}b x{x}1{x}y\n{x}c{x}, d{x}'s {x} {x}\n{x}c" for x in letters]
    texts += ["", " ", "\n", " \n ", "a  b", "\t\t x\n\n\ny ", "no, no. No!", f"x{special}y {special}\n{special}", "word " * 5000]
    for limit in (1 << 30, 20_000):  # all kept, and forgotten again and again
        pieces = PieceIds(library, "uint16", limit)
        for start in range(0, len(texts), 500):
            some = texts[start : start + 500]
            ids, lengths = pieces.ids(some)
            ends = lengths.cumsum().tolist()
            for text, n, end in zip(some, lengths.tolist(), ends):
                assert ids[end - n : end].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_each_distinct_pre_token_is_encoded_once():
    """Words next to marks and line ends are the same words: op4 spends its time on distinct ones."""
    from mercato.llm.chunks import PRE_TOKEN, PieceIds, load_library
    from mercato.llm.queries import tokenizer_path

    with open(tokenizer_path(), encoding="utf-8") as file:
        pieces = PieceIds(load_library(file.read()), "uint16")
    before = pieces.known
    texts = [f" wörd{a}{mark}\n and word{b}{mark} – it's  {a}" for a in "abcdef" for b in "ghij" for mark in (",", ".", "!", "…", "")]
    pieces.ids(texts)
    assert pieces.known - before == len({x for text in texts for x in PRE_TOKEN.findall(text)})


def test_pre_tokens_cut_by_bytes_are_those_of_the_library():
    import pyarrow as pa

    from mercato.llm.chunks import PieceIds, load_library
    from mercato.llm.queries import tokenizer_path

    with open(tokenizer_path(), encoding="utf-8") as file:
        library = load_library(file.read())
    special = list(library.get_added_tokens_decoder().values())[0].content
    atoms = ["'", "'s", "'re", "'ll", "'d", "'", "s", "l", "ve", "S", " ", "  ", "\n", "\t", "\r", "\x00", "\x1c", "\x85", "\xa0", "\u2003", "\u2028"]
    atoms += ["a", "bc", "é", "ß", "ж", "1", "²", "٣", "\u0301", "\u0345", "\u052f", ".", ",!", "—", "’", "…", "\u200b", "\u206f"]
    far = ["\u0530", "Ա", "⁰", "中", "\u3000", "😀", special, special[:-1]]
    rng = np.random.default_rng(4)
    for limit, some in ((1 << 30, atoms), (1 << 30, atoms + far), (20_000, atoms + far)):
        pieces = PieceIds(library, "uint16", limit)
        for _ in range(20):
            texts = ["".join(rng.choice(some, rng.integers(0, 14))) for _ in range(200)]
            texts += [None, "", None, "".join(rng.choice(far, 3)), "'", "x'", "x'r", "'s"]
            want = [x.ids for x in library.encode_batch([x or "" for x in texts], add_special_tokens=False)]
            for given in (texts, pa.array(["left out", *texts]).slice(1), pa.array(texts, pa.large_string())):
                ids, lengths = pieces.ids(given)
                ends = lengths.cumsum().tolist()
                assert [ids[end - n : end].tolist() for n, end in zip(lengths.tolist(), ends)] == want
    for nothing in ([], [None], ["", None]):
        ids, lengths = pieces.ids(nothing)
        assert len(ids) == 0 and lengths.tolist() == [0] * len(nothing)


@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
def test_embeddings_take_labels_of_any_type(spark, kind):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 24))
    rows = [(i, (base[i // 3] + 0.05 * rng.standard_normal(24)).tolist(), i // 3 % 2) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    frame = frame.selectExpr("vec_id", "embedding", f"if(vec_id < 110, cast(label as {kind}), null) as label")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.linked_vectors(frame).collect()}
    assert got == {i: (2, i // 3 * 3) if i < 108 else (1, 108) if i < 110 else (0, i) for i in range(120)}


def test_embeddings_in_tight_and_loose_clusters_equal_brute_force(spark):
    """Groups above and below ``FEW``, above ``TOGETHER``, repeated vectors, many shared filters."""
    rng = np.random.default_rng(9)
    parts = []
    for spread, n in ((0.02, 700), (0.045, 60), (0.05, 20), (0.06, 5)):
        parts.append(rng.standard_normal(16) + spread * rng.standard_normal((n, 16)))
    parts += [parts[0][:7], rng.standard_normal((300, 16))]
    vectors = np.concatenate(parts)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= embedding_dedup.COSINE
    root = np.arange(len(near))
    while (least := np.where(near, root[None], len(near)).min(1)).tolist() != root.tolist():
        root = least
    got = {r["vec_id"]: r for r in embedding_dedup.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    links = np.array([got[i]["n_links"] for i in range(len(near))])
    assert (links <= near.sum(1) - 1).all() and links.sum() >= 0.999 * (near.sum() - len(near))
    assert [got[i]["component_id"] for i in range(785)] == root[:785].tolist()


def test_pair_probabilities_equal_all_paths():
    rng = np.random.default_rng(4)
    scores, steps = 2 * rng.standard_normal((6, 3)), 2 * rng.standard_normal((3, 3))
    starts = np.array([True, False, False, False, True, False])
    want, single, whole = np.zeros((5, 3, 3)), np.zeros((6, 3)), 0.0
    for path in itertools.product(range(3), repeat=6):
        weight = np.exp(sum(scores[t, y] for t, y in enumerate(path)) + sum(steps[path[t], path[t + 1]] for t in range(5) if not starts[t + 1]))
        whole += weight
        for t, y in enumerate(path):
            single[t, y] += weight
            if t < 5:
                want[t, y, path[t + 1]] += weight
    p, pair = language.pair_probabilities(scores, starts, steps)
    assert np.allclose(p, single / whole)
    inner = ~starts[1:]
    assert np.allclose(pair[inner], (want / whole)[inner])


def test_transitions_follow_the_slope_of_the_likelihood():
    rng = np.random.default_rng(6)
    scores, steps, gold = rng.standard_normal((200, 3)), rng.standard_normal((3, 3)), rng.integers(0, 3, 200)
    starts = np.zeros(200, bool)
    starts[[0, 70]] = True
    inner = np.flatnonzero(~starts[1:])

    def likelihood(steps):
        total = scores[np.arange(200), gold].sum() + steps[gold[inner], gold[inner + 1]].sum()
        alpha = None
        for t in range(200):
            if starts[t]:
                total -= np.logaddexp.reduce(alpha) if alpha is not None else 0
                alpha = scores[t]
            else:
                alpha = np.logaddexp.reduce(alpha[:, None] + steps, axis=0) + scores[t]
        return total - np.logaddexp.reduce(alpha)

    onehot = np.eye(3)[gold]
    slope = onehot[inner].T @ onehot[inner + 1] - language.pair_probabilities(scores, starts, steps)[1][inner].sum(0)
    for a, b in itertools.product(range(3), repeat=2):
        small = np.zeros((3, 3))
        small[a, b] = 1e-5
        assert abs((likelihood(steps + small) - likelihood(steps - small)) / 2e-5 - slope[a, b]) < 1e-4


@pytest.mark.parametrize("secret", ["!!@@##$$", "密码密码密码", "אבגדהוז", "密码密码密码1", "Tr0ub4dor&3", "0039ab54", "пароль12"])
def test_no_character_class_leaves_a_secret_in_clear(secret):
    out, kinds = pii.replace(f"password={secret} end", b"k" * 32)
    assert kinds == ["secret"] and secret not in out and out.startswith("password=") and out.endswith(" end")
    assert len(out) == len(f"password={secret} end")


def test_hex_and_other_secrets_never_share_a_surrogate():
    rng = random.Random(2)
    secrets = {"".join(rng.choices("0123456789", k=6)) for _ in range(4000)} | {rng.choice("ghyz") + "".join(rng.choices("0123456789", k=5)) for _ in range(4000)}
    assert len({pii.secret_text(x, b"k" * 32) for x in secrets}) == len(secrets)


def test_near_copies_are_dropped_row_by_row(spark):
    """Of rows that share an id only those with a copy elsewhere go; hidden names of the stages may be columns."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(3, b), (5, a), (5, b + " more"), (7, None), (7, ""), (7, None), (None, a), (2, "a b"), (9, "a b"), (9, a)]
    named = "doc_id long, text string, __doc_id string, __row string, ___row long, __sha string, __keep string, __copies string"
    docs = spark.createDataFrame([(i, t, "x", "x", 1, "x", "x", "x") for i, t in rows], named)
    got = minhash.drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(map(repr, ((r[0], r[1]) for r in got.collect()))) == sorted(map(repr, [(3, b), (5, a), (7, None), (7, ""), (7, None), (None, a), (2, "a b")]))
    alone = minhash.drop_near_copies(docs.filter("doc_id is null or doc_id <> 7").dropDuplicates(["doc_id"]))
    assert alone.columns == docs.columns
    exact = exact_dedup.drop_copies(docs)
    assert exact.columns == docs.columns
    assert sorted(repr((r[0], r[1])) for r in exact.collect()) == sorted(map(repr, [(3, b), (5, a), (5, b + " more"), (2, "a b"), (7, exact.filter("doc_id = 7").first()[1])]))


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Repeated rows, rows that share an id or have none, copies and near copies, toxic texts."""
    import corpus_pipeline

    spark.sparkContext.environment["PYTHONPATH"] = ROOT
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=30)), ["a", "b", None][i % 3]) for i in range(240)]
    rows = [(i, t + " vilething" if i % 6 == 0 else t, s) for i, t, s in rows]
    clean = [r for r in rows if r[0] % 6]
    rows += [(300 + k, clean[k][1] + " tail", "a") for k in range(10)] + [(400 + k, clean[k][1].replace(" ", "  "), "b") for k in range(10, 20)]
    rows += [(500, " ".join(rng.choices(words, k=30)), "a"), (500, clean[25][1] + " tail", "a"), (500, " ".join(rng.choices(words, k=30)), "a")]
    rows += [(None, " ".join(rng.choices(words, k=30)), "b"), clean[30], clean[30], (501, None, "a"), (502, "", "a")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    def texts(kept):
        seen, out = {}, []
        for i, t, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0)):
            parts = (t or "").split()
            shingles = frozenset(tuple(parts[k : k + 5]) for k in range(max(1, len(parts) - 4))) if parts else frozenset()
            same = any(100 * len(shingles & old) >= 75 * len(shingles | old) for old in seen if shingles)
            if not (same or (not shingles and shingles in seen)):
                out.append(t or "")
            seen[shingles] = True
        return out

    want = texts([r for r in rows if "vilething" not in (r[1] or "")])
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    digests = {hashlib.sha256(t.encode()).hexdigest(): len(library.encode(t, add_special_tokens=False).ids) for t in want}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.decoded_sha256 for r in got} <= set(digests)
    assert all(r.n_tokens == digests[r.decoded_sha256] for r in got)
    before_mix = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        before_mix = corpus_pipeline.written(stage(spark, before_mix, str(tmp_path)), "stage")
    assert sorted(r.text or "" for r in before_mix.collect()) == sorted(want)
    counts = {}
    for r in got:
        counts[r.decoded_sha256] = counts.get(r.decoded_sha256, 0) + 1
    taken = {}
    for r in corpus_pipeline.mixing(spark, before_mix, str(tmp_path)).collect():
        digest = hashlib.sha256((r.text or "").encode()).hexdigest()
        taken[digest] = taken.get(digest, 0) + 1
    assert counts == taken and max(counts.values()) <= 2


def test_round_trip_takes_bounded_slices_and_hands_memory_back(monkeypatch):
    import pyarrow as pa

    with open(tokenizer_path(), encoding="utf-8") as file:
        encoder = bpe.Encoder(file.read())
    taken, handed = [], []
    texts = [None, "", *("some words in a row " * 5_000 for _ in range(25)), "the last one"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    encode = encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda part: taken.append(sum(map(len, part))) or encode(part))
    monkeypatch.setattr(common, "hand_back", lambda: handed.append(len(taken)))
    names = ["doc_id", "token_ids", "decoded"]

    def run(batches):
        coded = bpe._encoded(encoder, batches, 1, names[:2])
        yield from bpe._decoded(bpe.Labels(encoder.automaton.label), coded, "token_ids", names)

    out = list(common.frugal(run)(iter([batch])))
    assert [x for part in out for x in part.column(2).to_pylist()] == [x or "" for x in texts]
    assert [x for part in out for x in part.column(0).to_pylist()] == list(range(len(texts)))
    assert sum(taken) == sum(len(x or "") for x in texts) and max(taken) <= 1 << 20
    assert handed == [len(taken)]


def test_every_python_step_of_the_pipeline_hands_memory_back(docs, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    seen, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, *rest, **more: seen.append(run.__name__) or plain(self, run, *rest, **more))
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic")
    round_trip(minhash.drop_near_copies(exact_dedup.drop_copies(toxicity.drop_toxic(docs, labels)))).collect()
    assert set(seen) == {"frugal_run"}


def test_automaton_takes_a_word_once_while_it_is_kept(monkeypatch):
    calls, plain = [], bpe.Automaton.encode
    monkeypatch.setattr(bpe.Automaton, "encode", lambda self, word: calls.append(len(word)) or plain(self, word))
    with open(tokenizer_path(), encoding="utf-8") as file:
        spec = file.read()
    library = tokenizers.Tokenizer.from_str(spec)
    encoder = bpe.Encoder(spec)
    texts = [" ".join(f"{n}" for n in range(at, at + 110_000)) for at in (0, 110_000, 0)]
    got = [next(encoder.encode([text])) for text in texts]
    assert got[0] == got[2] and [len(x) // 4 for x in got[:2]] == [len(library.encode(x, add_special_tokens=False).ids) for x in texts[:2]]
    assert len(calls) <= 220_100  # once more for the third text before
    small, rng = bpe.Encoder(spec, limit=400), random.Random(3)
    parts = ["word", " ", "  ", "\n", "don't", "日本語", "🎉", "é", "12", ",", "<|endoftext|>", "\xa0", "…", "Я"]
    for _ in range(300):
        odd = ["".join(rng.choices(parts, k=rng.randint(0, 20))) for _ in range(3)]
        assert [np.frombuffer(x, np.uint32).tolist() for x in small.encode(odd)] == [library.encode(x, add_special_tokens=False).ids for x in odd]
