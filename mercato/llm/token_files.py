"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of a range of documents.  Ids are cut into blocks of
``BLOCK``.  A block stores its minimum, and what each id is above it in as few
bits as ``PERCENT`` of the ids need; the rest of the larger ids stand in an
exception list (positions and high bits).  Layout, little-endian::

    magic "PFOR1\\0\\0\\0"
    blocks: u32 minimum, u8 width, u8 0, u16 exceptions,
            width * BLOCK / 8 bytes, exceptions u16 positions, exceptions u32 high bits
    u64 place of each block, u64 end of the blocks
    documents: i64 id and u8 "has an id" each, u64 end (in ids) of each
    u64 ids, u64 documents, u64 place of the index, magic

The packed bits stand in lanes: id ``i`` of a block is row ``i // LANES`` of
lane ``i % LANES``, and each lane packs its rows into ``width`` 64-bit words.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.chunks import PieceIds, column_parts, load_library
from mercato.llm.common import partitions, scratch, written

MAGIC = b"PFOR1\0\0\0"
BLOCK, LANES, ROWS = 1024, 16, 64
PERCENT = 95


def _pack(values, width: int):
    """(blocks, BLOCK) numbers below 2**width to (blocks, width, LANES) words."""
    import numpy as np

    rows = values.reshape(len(values), ROWS, LANES).astype(np.uint64)
    words = np.zeros((len(values), width + 1, LANES), np.uint64)
    for row in range(ROWS):
        word, shift = divmod(row * width, 64)
        words[:, word] |= rows[:, row] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= rows[:, row] >> np.uint64(64 - shift)
    return words[:, :width]


def _unpack(words, width: int):
    import numpy as np

    out = np.zeros((len(words), ROWS, LANES), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for row in range(ROWS if width else 0):
        word, shift = divmod(row * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        out[:, row] = value & mask
    return out.reshape(len(words), BLOCK)


def pack_blocks(ids) -> list[bytes]:
    """The blocks of ``ids`` (a numpy array of unsigned integers below 2**32), each as bytes."""
    import numpy as np

    count = -(-len(ids) // BLOCK)
    padded = np.empty(count * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[-1] if len(ids) else 0
    blocks = padded.reshape(count, BLOCK)
    least = blocks.min(1) if count else np.zeros(0, np.uint32)
    above = blocks - least[:, None]
    place = BLOCK * PERCENT // 100
    common = np.partition(above, place, axis=1)[:, place] if count else least
    widths = np.ceil(np.log2(common.astype(np.float64) + 1)).astype(int)
    out: list[bytes] = [b""] * count
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        mine = above[at]
        high = mine.astype(np.uint64) >> np.uint64(width)
        row, position = np.nonzero(high)
        high = high[row, position].astype("<u4")
        position = position.astype("<u2")
        ends = np.searchsorted(row, np.arange(len(at) + 1))
        words = _pack(mine & np.uint32((1 << width) - 1), width).astype("<u8")
        for k, block in enumerate(at.tolist()):
            a, b = ends[k], ends[k + 1]
            head = int(least[block]).to_bytes(4, "little") + bytes([width, 0]) + int(b - a).to_bytes(2, "little")
            out[block] = head + words[k].tobytes() + position[a:b].tobytes() + high[a:b].tobytes()
    return out


def unpack_blocks(raw: bytes, places, count: int):
    """``count`` ids of the blocks of ``raw`` that begin at ``places`` (with the end as the last place)."""
    import numpy as np

    n = len(places) - 1
    out = np.empty((n, BLOCK), np.uint32)
    whole = np.frombuffer(raw, np.uint8)
    widths = whole[places[:-1] + 4] if n else np.zeros(0, np.uint8)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        size = width * BLOCK // 8
        packed = np.stack([whole[p + 8 : p + 8 + size] for p in places[at].tolist()])
        words = packed.view("<u8").reshape(len(at), width, LANES)
        out[at] = _unpack(words, width)
        for block in at.tolist():
            p = int(places[block])
            least, extra = int.from_bytes(raw[p : p + 4], "little"), int.from_bytes(raw[p + 6 : p + 8], "little")
            if extra:
                p += 8 + size
                position = np.frombuffer(raw, "<u2", extra, p)
                out[block, position] |= np.frombuffer(raw, "<u4", extra, p + 2 * extra) << np.uint32(width)
            out[block] += np.uint32(least)
    return out.reshape(-1)[:count]


class FileWriter:
    """Writes one file to any store that Arrow reaches; it appears when it is whole."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        self.store, path = fs.FileSystem.from_uri(folder)
        self.store.create_dir(path, recursive=True)
        self.path = f"{path}/{name}"
        self.part = f"{path}/.{name}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.part)
        self.out.write(MAGIC)
        self.at, self.places = len(MAGIC), []
        self.rest, self.ids, self.docs, self.ends = [], 0, [], []

    def add(self, doc_ids: list, lengths: list[int], ids) -> None:
        """Documents with the numbers of their ids, and all those ids in one array."""
        import numpy as np

        self.docs += doc_ids
        for n in lengths:
            self.ids += n
            self.ends.append(self.ids)
        self.rest.append(ids)
        if sum(map(len, self.rest)) >= 256 * BLOCK:
            held = np.concatenate(self.rest)
            cut = len(held) // BLOCK * BLOCK
            self.rest = [held[cut:]]
            self._write(pack_blocks(held[:cut]))

    def _write(self, blocks: list[bytes]) -> None:
        for block in blocks:
            self.places.append(self.at)
            self.at += len(block)
        self.out.write(b"".join(blocks))

    def close(self) -> None:
        import numpy as np

        if self.rest:
            self._write(pack_blocks(np.concatenate(self.rest)))
        index = [
            np.array([*self.places, self.at], "<u8").tobytes(),
            np.array([x or 0 for x in self.docs], "<i8").tobytes(),
            np.array([x is not None for x in self.docs], "u1").tobytes(),
            np.array(self.ends, "<u8").tobytes(),
            np.array([self.ids, len(self.docs), self.at], "<u8").tobytes(),
            MAGIC,
        ]
        self.out.write(b"".join(index))
        self.out.close()
        # A second run of the same task replaces the file by an equal one.
        self.store.move(self.part, self.path)


class FileReader:
    """Reads a file by its index."""

    def __init__(self, folder: str, name: str):
        import numpy as np
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        self.file = store.open_input_file(f"{path}/{name}")
        size = self.file.size()
        tail = self._raw(size - 32, 32)
        if tail[24:] != MAGIC or self._raw(0, 8) != MAGIC:
            raise ValueError(f"{name} is not a whole token file")
        self.ids, count, place = np.frombuffer(tail, "<u8", 3).tolist()
        blocks = -(-self.ids // BLOCK)
        index = self._raw(place, size - 32 - place)
        self.places = np.frombuffer(index, "<u8", blocks + 1).astype(np.int64)
        at = 8 * (blocks + 1)
        doc_ids, known = np.frombuffer(index, "<i8", count, at), np.frombuffer(index, "u1", count, at + 8 * count)
        self.docs = [x if ok else None for x, ok in zip(doc_ids.tolist(), known.tolist())]
        self.ends = np.frombuffer(index, "<u8", count, at + 9 * count).astype(np.int64)

    def _raw(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def read(self, start: int, end: int):
        """The ids from ``start`` to ``end``: only the blocks that hold them are read."""
        first, last = start // BLOCK, -(-end // BLOCK)
        places = self.places[first : last + 1]
        raw = self._raw(int(places[0]), int(places[-1] - places[0])) if end > start else b""
        ids = unpack_blocks(raw, places - places[0], (last - first) * BLOCK)
        return ids[start - first * BLOCK : end - first * BLOCK]


#: Bytes of text encoded at a time by one task.
TOGETHER = 4_000_000
_BUILT: dict[str, PieceIds] = {}


def _pieces(spec: str) -> PieceIds:
    """The pieces of this worker, kept between tasks."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _BUILT:
        tokenizer = load_library(spec)
        _BUILT.clear()
        _BUILT[key] = PieceIds(tokenizer, "uint16" if tokenizer.get_vocab_size() <= 1 << 16 else "uint32")
    return _BUILT[key]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, text: str = "text") -> DataFrame:
    """Write the ids of all ``docs`` in ascending ``doc_id`` order; return the files (``folder``, ``name``, ``ids``).

    Documents are dealt out by ranges of ``doc_id`` (ties by the text's hash,
    null ids first), one file for each range.  Each text is encoded by the
    tokenizers library without added special tokens and gets ``end_id`` after
    it; null and empty texts get it alone.  Repeated rows are written each.  No
    rows give one file without documents or none.  ``folder`` (default: a new one in
    ``spark.checkpoint.dir``) may be in any store that Arrow opens by its URI.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    folder = folder or scratch(spark, "tokens")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        pieces = _pieces(spec.value)
        name = f"part-{TaskContext.get().partitionId():06d}.pfor"
        writer = FileWriter(folder, name)
        for batch in batches:
            done = 0
            doc_ids = batch.column(0).to_pylist()
            for part in column_parts(batch.column(1), TOGETHER):
                ids, lengths = pieces.ids(part)
                ids = np.insert(ids.astype(np.uint32), np.cumsum(lengths), end_id)
                writer.add(doc_ids[done : done + len(part)], (lengths + 1).tolist(), ids)
                done += len(part)
        writer.close()
        yield pa.RecordBatch.from_pydict({"folder": [folder], "name": [name], "ids": [writer.ids]})

    dealt = docs.select("doc_id", docs[text].alias("__text"), F.xxhash64(docs[text]).alias("__tie"))
    dealt = dealt.repartitionByRange(partitions(spark), "doc_id", "__tie").sortWithinPartitions("doc_id", "__tie")
    return dealt.select("doc_id", "__text").mapInArrow(run, "folder string, name string, ids long")


def read_token_files(files: DataFrame, spark: SparkSession, packed: bool = False) -> DataFrame:
    """Read the documents of ``files`` back: ``doc_id``, ``start`` (ids of all documents before it) and ``token_ids``.

    Files follow one another by name.  ``files`` has a row for each file, not
    for each document, and tells how many ids come before.  ``packed`` gives
    the ids as ``token_bytes``, little-endian 32-bit integers, instead.
    """
    from pyspark.sql import Window

    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    column = "token_bytes binary" if packed else "token_ids array<int>"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                reader = FileReader(row["folder"], row["name"])
                first, done = 0, 0
                while first < len(reader.docs):
                    # Documents of about 2 million ids at a time, one at least.
                    upto = max(first + 1, int(np.searchsorted(reader.ends, done + 2_000_000, "right")))
                    end = int(reader.ends[upto - 1])
                    ids = reader.read(done, end)
                    ends = np.concatenate([[done], reader.ends[first:upto]])
                    if packed:
                        places = ((ends - done) * 4).astype(np.int32)
                        values = pa.Array.from_buffers(
                            pa.binary(), upto - first, [None, pa.py_buffer(places), pa.py_buffer(ids.astype("<u4", copy=False))]
                        )
                    else:
                        values = pa.ListArray.from_arrays(pa.array(ends - done, pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.docs[first:upto], pa.int64()), pa.array(ends[:-1] + row["before"], pa.int64()), values],
                        ["doc_id", "start", column.split()[0]],
                    )
                    first, done = upto, end

    spread = placed.repartition(max(1, partitions(spark)), "name")
    return spread.mapInArrow(run, f"doc_id long, start long, {column}")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", packed: bool = False) -> DataFrame:
    """Write ``docs`` as token files and read them back; see the two functions."""
    files = written(write_token_files(docs, tokenizer, end_id, text=text), "token-index")
    return read_token_files(files, docs.sparkSession, packed)


def ids_crc32(frame: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and the crc32 of the ids as little-endian 32-bit integers.

    Of packed ids by built-in expressions; of arrays by a second Python worker beside the one that reads.
    """
    if "token_bytes" in frame.columns:
        size = F.octet_length("token_bytes").cast("long")
        return frame.select("doc_id", "start", F.shiftright(size, 2).alias("n_tokens"), F.crc32("token_bytes").alias("ids_crc32"))

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(2)
            flat = np.asarray(lists.flatten()).astype("<u4")
            lengths = np.asarray(lists.value_lengths()).astype(np.int64)
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(flat[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lengths), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    picked = frame.select("doc_id", "start", "token_ids")
    return picked.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
