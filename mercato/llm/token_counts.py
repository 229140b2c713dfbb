"""Token counts without a shuffle of pre-tokens.

Two tiers on the map side: a broadcast table of the counts of frequent text
pieces, and in each worker a bounded cache that the tokenizers library fills
with the pieces it meets besides.  The frequent pieces come from one pass over
all documents in which every task keeps a bounded count of its pieces; only
the few thousand most frequent of each task are summed up.
"""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.chunks import ChunkTable, library_encoder, load_library, slices

#: Pieces in the broadcast table (about 1 MB), and those a task reports and counts at most.
FREQUENT = 32_768
REPORTED = 4_096
COUNTED = 300_000


def frequent_pieces(docs: DataFrame, text: str = "text", most: int = FREQUENT) -> DataFrame:
    """The ``most`` most frequent pieces (``piece``, ``n``) over all documents.

    A task that has counted too many different pieces forgets those seen once,
    twice and so on, and reports the ``REPORTED`` most frequent ones, so
    counts of rare pieces may be low.  They decide what is looked up fast, not
    what is counted.
    """

    def run(batches):
        import pyarrow as pa

        cutter, counts = ChunkTable(list, {}), Counter()
        for batch in batches:
            for part in slices(batch.column(0).to_pylist()):
                for value in part:
                    counts.update(cutter.cut(value)[1])
                least = 1
                while len(counts) > COUNTED:
                    counts = Counter({k: n for k, n in counts.items() if n > least})
                    least *= 2
        top = [(k, n) for k, n in counts.most_common(REPORTED) if len(k) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    counted = docs.select(text).mapInArrow(run, "piece string, n long")
    return counted.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(most)


_BUILT: dict[str, ChunkTable] = {}


def _table(spec: str, pieces: list[str], counts: bytes) -> ChunkTable:
    key = hashlib.sha256(spec.encode() + counts + "\0".join(pieces).encode()).hexdigest()
    if key not in _BUILT:
        tokenizer = load_library(spec)
        encode = library_encoder(tokenizer, tokenizer.token_to_id("Ċ"), "uint32")
        specials = {x.content: 1 for x in tokenizer.get_added_tokens_decoder().values()}
        _BUILT.clear()
        _BUILT[key] = ChunkTable(
            lambda pieces: [len(x) // 4 for x in encode(pieces)],
            specials,
            frequent=dict(zip(pieces, memoryview(counts).cast("H"), strict=True)),
        )
    return _BUILT[key]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default ``doc_id``), ``n_bytes`` (UTF-8) and ``n_tokens`` of each row.

    Counts are those of the tokenizers library for the byte-level BPE in the
    file ``tokenizer``: no added special tokens, special strings within a text
    one token each, whole texts.  Null counts as empty, empty texts have no
    token.  Rows are independent; repeated rows stay, other columns are ignored.
    """
    from array import array

    keep = ["doc_id"] if keep is None else keep
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    # A bounded table: at most FREQUENT pieces of at most 64 characters.
    pieces = [row["piece"] for row in frequent_pieces(docs, text).collect()]
    once = load_library(spec)
    encode = library_encoder(once, once.token_to_id("Ċ"), "uint32")
    whole = [piece if piece[:1] == "\n" else " " + piece for piece in pieces]
    counts = array("H", [len(x) // 4 for x in encode(whole)]).tobytes()
    shared = docs.sparkSession.sparkContext.broadcast((spec, pieces, counts))
    names = [*keep, "n_bytes", "n_tokens"]

    def run(batches):
        import pyarrow as pa

        table = _table(*shared.value)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            tokens, sizes = [], []
            for part in slices(texts):
                tokens += map(sum, table.values(part))
                sizes += [len(value.encode()) for value in part]
            kept = [batch.column(c) for c in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names)

    picked = docs.select(*keep, docs[text].alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kinds}, n_bytes long, n_tokens long")
