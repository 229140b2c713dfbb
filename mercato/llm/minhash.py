"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A document's signature is ``SYMBOLS`` MinHash values of 16 bits over its
5-word shingles, cut into ``CHUNKS`` chunks of ``WIDTH`` symbols.  Two
signatures that differ in at most ``2 * CHUNKS - 1`` symbols have, by
pigeonhole, a chunk that differs in one symbol at most.  So for each chunk all
places of one error are enumerated: the chunk without that symbol is a key,
and two documents meet under a key exactly if their chunks differ there at
most.  A pair of similarity 0.75 fails to meet with probability 1.5e-6.

Documents that meet are candidates; a link is confirmed on the full sets.
Within a key the documents are first compared with its hub, the one that meets
most others.  Where that leaves several components under a key, documents of
different components are compared block by block by the parities of their
sets, which rule out nearly all pairs that aren't linked and none that is; only
the pairs left are written and confirmed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import free_name, frugal, partitions, written
from mercato.llm.components import connected_components

SHINGLE = 5
CHUNKS, WIDTH = 10, 4
SYMBOLS = CHUNKS * WIDTH
#: Symbols in which a document and the hub of a key may differ to be measured, up to which a pair of similarity 0.5 passes.
HUB_DISTANCE = 34
#: Members of a key on either side of a block in which strangers are compared.
SIDE = 2048
#: Documents whose links are checked in one place.
TOGETHER = 256
#: Bits in which the documents to compare are marked: 4 MB.
BITS = 1 << 25
#: Bits of the parities of a set: the power of two from twice its size on, within these bounds.
FEWEST, MOST = 64, 8192
#: Distance (1 - likeness) of linked documents, with a margin for rounding.
GAP = 0.25 + 1e-9
#: Words hashed at a time.
WORDS = 50_000

_M1, _M2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53  # fixed values: the finaliser of MurmurHash3
_STEP = 0x9E3779B97F4A7C15 | 1


class Hasher:
    """Shingle sets and signatures; the same on every worker."""

    def __init__(self, symbols: int = SYMBOLS):
        import numpy as np

        rng = np.random.default_rng(20_011)
        self.bytes = rng.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.mult = rng.integers(0, 1 << 63, symbols, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.xor = rng.integers(0, 1 << 63, symbols, dtype=np.uint64)
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        import numpy as np

        if len(self.power) < n:
            size = max(n, 2 * len(self.power))
            for name, base in (("power", _STEP), ("inverse", pow(_STEP, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    @staticmethod
    def _mix(x):
        import numpy as np

        x = (x ^ x >> np.uint64(33)) * np.uint64(_M1)
        x = (x ^ x >> np.uint64(33)) * np.uint64(_M2)
        return x ^ x >> np.uint64(33)

    def shingles(self, text: str | None):
        """Sorted 64-bit hashes of the distinct shingles: five lower-cased words, or all where there are fewer."""
        import numpy as np

        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        parts = []
        for start in range(0, max(1, len(words) - SHINGLE + 1), WORDS):
            some = words[start : start + WORDS + SHINGLE - 1]
            data = np.frombuffer(b" ".join(some), np.uint8)
            self._powers(len(data) + 1)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.bytes[data] * self.power[: len(data)], out=sums[1:])
            gaps = np.flatnonzero(data == 32)
            begin, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
            size = min(SHINGLE, len(some))
            begin, end = begin[: len(some) - size + 1], end[size - 1 :]
            parts.append(self._mix((sums[end] - sums[begin]) * self.inverse[begin]))
        return np.unique(np.concatenate(parts))

    def signature(self, shingles):
        """16-bit symbols of a set of shingles (not empty)."""
        import numpy as np

        least = None
        for start in range(0, len(shingles), 2048):
            part = (shingles[start : start + 2048] ^ self.xor[:, None]) * self.mult[:, None]
            low = part.min(1)
            least = low if least is None else np.minimum(least, low)
        return (self._mix(least) >> np.uint64(48)).astype("<u2")

    @staticmethod
    def parities(shingles):
        """For each value of the low bits, whether an odd number of shingles has it (an odd sketch).

        A shingle that only one of two sets has changes one parity, so sets
        differ in at least as many shingles as in parities.  Folding the halves
        of a sketch gives the sketch of half its width.
        """
        import numpy as np

        width = min(MOST, max(FEWEST, 1 << (2 * len(shingles) - 1).bit_length()))
        odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little")


_HASHER: list[Hasher] = []


def hasher() -> Hasher:
    if not _HASHER:
        _HASHER.append(Hasher())
    return _HASHER[0]


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``print`` (128-bit hash of the set, null when empty), ``signature`` and ``parity`` of each row."""

    def run(batches):
        from hashlib import blake2b

        import pyarrow as pa

        own = hasher()
        for batch in batches:
            sizes, prints, marks, parities = [], [], [], []
            for value in batch.column(1).to_pylist():
                found = own.shingles(value)
                sizes.append(len(found))
                prints.append(blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                marks.append(own.signature(found).tobytes() if len(found) else None)
                parities.append(own.parities(found).tobytes() if len(found) else None)
            hashes = [pa.array(x, pa.binary()) for x in (prints, marks, parities)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *hashes], ["doc_id", "n_shingles", "print", "signature", "parity"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    return picked.mapInArrow(frugal(run), "doc_id long, n_shingles long, print binary, signature binary, parity binary")


def _symbols(column):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SYMBOLS)


def keys(nodes: DataFrame) -> DataFrame:
    """``key`` and ``node``: for each chunk and place of an error the hash of the other symbols."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = hasher()
        for batch in batches:
            for start in range(0, batch.num_rows, 20_000):
                part = batch.slice(start, 20_000)
                cut = _symbols(part.column(1)).astype(np.uint64).reshape(-1, CHUNKS, WIDTH)
                out = np.empty((len(cut), CHUNKS, WIDTH), np.uint64)
                for gone in range(WIDTH):
                    rest = [k for k in range(WIDTH) if k != gone]
                    packed = (cut[:, :, rest[0]] << np.uint64(32)) | (cut[:, :, rest[1]] << np.uint64(16)) | cut[:, :, rest[2]]
                    place = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(gone)
                    out[:, :, gone] = own._mix(packed | place << np.uint64(48))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out.reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(part.column(0)), CHUNKS * WIDTH))],
                    ["key", "node"],
                )

    return nodes.select("node", "signature").mapInArrow(frugal(run), "key long, node long")


def _close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose signatures differ in few symbols."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                apart = (_symbols(batch.column(2)) != _symbols(batch.column(3))).sum(1)
                yield batch.filter(pa.array(apart <= HUB_DISTANCE)).select(["a", "b"])

    of_a = nodes.select(F.col("node").alias("a"), F.col("signature").alias("s"))
    of_b = nodes.select(F.col("node").alias("b"), F.col("signature").alias("t"))
    return pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "s", "t").mapInArrow(frugal(run), "a long, b long").distinct()


def _marked(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """``node`` and ``__text`` of ``texts`` whose hash is that of a ``needed`` node, and so a few others.

    The hashes are marked in a bitmap of ``BITS`` bits whatever the number of
    nodes, so it may be broadcast and no text is shuffled.  Where it fills up,
    more of the others pass.
    """
    at = F.pmod(F.xxhash64("node"), F.lit(BITS))
    slot, place = F.shiftright(at, 15).alias("slot"), at.bitwiseAND(F.lit((1 << 15) - 1)).alias("place")
    dealt = needed.select(slot, place).repartition(partitions(texts.sparkSession), "slot")
    bits = dealt.groupBy("slot").agg(F.bitmap_construct_agg("place").alias("bits"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = byte.bitwiseAND(F.expr("shiftleft(1, cast(place % 8 as int))")) != 0
    return texts.select("node", "__text", slot, place).join(F.broadcast(bits), "slot").filter(marked).select("node", "__text")


def confirm(pairs: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """``pairs`` (``a``, ``b``; distinct) with ``likeness``, intersection by union of their full sets, and ``linked``.

    Linked are pairs with 100 * intersection >= 75 * union; pairs whose sizes
    alone keep them from a likeness of 0.5 are left out.

    The ``b`` are dealt into blocks of about ``TOGETHER``, and the set of
    an ``a`` is sent once to each block it has a pair in.  A block with many
    pairs is sent to several places, which share its ``a``.
    """
    pairs = written(pairs, "pairs")
    centres = pairs.select("b").distinct()
    blocks = 1 + centres.count() // TOGETHER
    block = F.pmod(F.xxhash64("b"), F.lit(blocks)).alias("block")
    places = pairs.groupBy(block).agg(F.ceil(F.count(F.lit(1)) / (TOGETHER * TOGETHER // 2)).cast("int").alias("salts"))
    needed = pairs.select(F.col("a").alias("node")).union(centres.select(F.col("b").alias("node"))).distinct()

    def collect(batches):
        import pyarrow as pa

        own = hasher()
        for batch in batches:
            sets = [own.shingles(x).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.large_binary()).cast(pa.binary())], ["node", "set"])

    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("node"), F.col(text).alias("__text"))
    # Copies of a text have one node; of the rest of the texts none is needed.
    sets = written(_marked(texts, needed).mapInArrow(frugal(collect), "node long, set binary"), "sets")
    salt = F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt")
    lists = pairs.groupBy("a", block).agg(F.collect_list("b").alias("with")).join(places, "block").select("block", salt, "a", "with")
    others = lists.join(sets.select(F.col("node").alias("a"), "set"), "a").select(
        "block", "salt", F.lit(1).alias("kind"), F.col("a").alias("node"), "with", "set"
    )
    dealt = centres.select("b", block).join(places, "block").join(sets.select(F.col("node").alias("b"), "set"), "b")
    held_by = dealt.select(
        "block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("b").alias("node"),
        F.lit(None).cast("array<long>").alias("with"), "set",
    )

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        here, held = None, {}
        for batch in batches:
            found = []
            for block, salt, kind, node, others, raw in zip(*(column.to_pylist() for column in batch.columns)):
                if here != (block, salt):
                    here, held = (block, salt), {}
                own = np.frombuffer(raw, np.uint64)
                if kind == 0:
                    held.setdefault(node, []).append(own)
                    continue
                for b, other in ((b, other) for b in others for other in held.get(b, ())):
                    small, large = (own, other) if len(own) < len(other) else (other, own)
                    if not len(small) or 2 * len(small) < len(large):
                        continue
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    both = int((large[at] == small).sum())
                    every = len(small) + len(large) - both
                    found.append((node, b, both / every, 100 * both >= 75 * every))
            columns = list(zip(*found)) if found else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], ["a", "b", "likeness", "linked"])

    dealt = held_by.unionByName(others).repartition(partitions(docs.sparkSession), "block", "salt").sortWithinPartitions("block", "salt", "kind")
    measured = dealt.mapInArrow(frugal(compare), "a long, b long, likeness double, linked boolean")
    # Several rows only where rows share a doc_id: the best of their texts.
    return measured.groupBy("a", "b").agg(F.max("likeness").alias("likeness"), F.max("linked").alias("linked"))


def _across(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs between components that meet under a key and may be linked, but for pairs with its hub.

    ``members`` has ``key``, ``node``, ``component``, ``hub_component``, and
    bounds ``low`` and ``high`` of the distance (1 - likeness) from the key's
    hub.  That distance is a metric, so two documents whose distances from the
    hub differ by more than 0.25 can't be linked: strangers under a key need
    not be compared with the many close copies of its hub.  The rest is
    compared block by block.  A pair is dropped there only where sizes, bounds
    or parities (``Hasher.parities``) rule a link out for certain.
    """
    stranger = F.col("component") != F.col("hub_component")
    strangers = members.filter(stranger).groupBy("key").agg(F.min("low").alias("least"), F.max("high").alias("most"))
    near = (F.col("high") >= F.col("least") - GAP) & (F.col("low") <= F.col("most") + GAP)
    members = members.join(strangers, "key").filter(stranger | near)
    counted = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n"))
    mixed = members.join(counted.filter("x <> y").select("key", "n"), "key").join(nodes.select("node", "n_shingles", "parity"), "node")
    blocks = F.ceil(F.col("n") / SIDE).cast("int")
    groups = mixed.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    groups = groups.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = groups.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "low", "high", "n_shingles", "parity"
    )

    def folded(parity, bits):
        while parity.shape[1] * 64 > bits:
            half = parity.shape[1] // 2
            parity = parity[:, :half] ^ parity[:, half:]
        return parity

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        def pairs_of(rows):
            own, node, part, low, high, size = (np.array([x[c] for x in rows]) for c in range(3, 9))
            bits = np.array([8 * len(x[9]) for x in rows])
            first = own == own.min()
            sides = (first, ~first) if rows[0][1] != rows[0][2] else (first, first)
            for p in np.unique(bits[sides[0]]):
                left = np.flatnonzero(sides[0] & (bits == p))
                ours = np.frombuffer(b"".join(rows[x][9] for x in left), np.uint64).reshape(len(left), -1)
                # Sizes of a linked pair differ by a third at most, so their widths by one step.
                for q in (p // 2, p, 2 * p):
                    right = np.flatnonzero(sides[1] & (bits == q))
                    if not len(right):
                        continue
                    theirs = np.frombuffer(b"".join(rows[x][9] for x in right), np.uint64).reshape(len(right), -1)
                    mine, theirs = folded(ours, min(p, q)), folded(theirs, min(p, q))
                    for at in range(0, len(left), 256):
                        some = left[at : at + 256]
                        apart = np.zeros((len(some), len(right)), np.uint16)
                        for word in range(mine.shape[1]):
                            apart += np.bitwise_count(mine[at : at + 256, word, None] ^ theirs[None, :, word])
                        both = size[some][:, None] + size[right][None, :]
                        fit = (7 * apart.astype(np.int64) <= both) & (part[some][:, None] != part[right][None, :])
                        x, y = np.nonzero(fit)
                        x, y = some[x], right[y]
                        keep = (4 * size[x] >= 3 * size[y]) & (4 * size[y] >= 3 * size[x]) & (node[x] != node[y])
                        keep &= (low[x] <= high[y] + GAP) & (low[y] <= high[x] + GAP)
                        x, y = node[x[keep]], node[y[keep]]
                        yield np.maximum(x, y), np.minimum(x, y)

        def found(rows):
            for a, b in pairs_of(rows):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held = []
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if held and held[-1][:3] != row[:3]:
                    yield from found(held)
                    held = []
                held.append(row)
        if held:
            yield from found(held)

    dealt = groups.repartition(partitions(nodes.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(frugal(compare), "a long, b long").distinct()


def near_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """For each row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    Words are maximal runs without ASCII whitespace, A-Z lower-cased.  Rows
    with equal sets are one node, named by their smallest ``doc_id``.  Rows
    without words (null, empty) link with nothing.  Rows without a ``doc_id``
    are left alone: kept, ``component_id`` null.  Rows that share a ``doc_id``
    are one document with several texts and link by any of them.  An empty
    table gives no rows.
    """
    rows = written(signatures(docs, text), "signatures")
    usable = rows.filter("print is not null and doc_id is not null")
    same = [F.min(c).alias(c) for c in ("n_shingles", "signature", "parity")]  # of equal sets
    nodes = written(usable.groupBy("print").agg(F.min("doc_id").alias("node"), *same), "nodes")
    every = keys(nodes)
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(every.join(shared, "key"), "shared")
    # The document that meets most others is the hub of its keys: an original
    # is like all its copies, while two copies may differ too much.
    met = members.groupBy("node").agg(F.sum("n").alias("met"))
    hubs = members.join(met, "node").groupBy("key").agg(F.max_by("node", F.struct("met", -F.col("node"))).alias("hub"))
    members = written(members.select("key", "node").join(hubs, "key"), "members")
    spokes = members.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    measured = written(confirm(_close(spokes, nodes), docs, text), "measured")
    links = measured.filter("linked").select("a", "b")
    parts = written(connected_components(links), "components")
    of_hub = parts.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    placed = members.join(parts, "node", "left").join(of_hub, "hub", "left")
    placed = placed.join(measured.select(F.col("a").alias("node"), F.col("b").alias("hub"), "likeness"), ["node", "hub"], "left")
    # A pair with a hub that wasn't measured is of a likeness below 0.5.
    known = F.when(F.col("node") == F.col("hub"), 0.0).otherwise(1 - F.col("likeness"))
    placed = placed.select(
        "key", "node", F.coalesce("component", "node").alias("component"), F.coalesce("hub_component", "hub").alias("hub_component"),
        F.coalesce(known, F.lit(0.5)).alias("low"), F.coalesce(known, F.lit(1.0)).alias("high"),
    )
    rest = _across(placed, nodes).join(
        measured.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti"
    )
    rest = written(rest, "across")
    if not rest.isEmpty():
        links = links.unionByName(confirm(rest, docs, text).filter("linked").select("a", "b"))
        parts = written(connected_components(links), "components")
    named = nodes.select("print", "node").join(parts, "node", "left").select("print", F.coalesce("component", "node").alias("found"))
    # Rows that share a doc_id lie in one component through its node.
    out = rows.join(named, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each group, all columns as they are; rows without a ``doc_id`` stay.

    The row with the smallest ``doc_id`` of a group stays.  Rows that share a
    ``doc_id`` are documents of their own here and each has its own group:
    where there are any, the rows are numbered in a written copy and the
    numbers stand for the ids.  Null and empty texts stay, and so do rows of an
    empty table (none); extra columns may have any names.
    """
    known = docs.filter(F.col("doc_id").isNotNull())
    if known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        key = free_name(docs, "__doc_id")
        dropped = near_groups(docs, text).filter("not kept").select(F.col("doc_id").alias(key)).distinct()
        return docs.join(dropped, docs["doc_id"] == F.col(key), "left_anti")
    number = free_name(docs, "__row")
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    usable = numbered.filter(F.col("doc_id").isNotNull())
    groups = near_groups(usable.select(F.col(number).alias("doc_id"), F.col(text).alias("text")))
    ids = usable.select(F.col(number).alias("row"), F.col("doc_id").alias("id"))
    placed = groups.select(F.col("doc_id").alias("row"), "component_id").join(ids, "row")
    stays = placed.groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("first")).select("first.row")
    dropped = placed.join(stays, "row", "left_anti").select(F.col("row").alias(number))
    return numbered.join(dropped, number, "left_anti").select(docs.columns)
