"""Near-duplicate embeddings by spherical-cap filters.

Filter directions are products of small random codes: a direction is one code
of each block of coordinates.  A vector, after a random rotation, lies in the
caps of the directions with which its product is greatest, as many for every
vector; they are listed by decoding block by block, keeping the best partial
sums.  Several rotations with codes of their own give a pair several
independent chances to meet.
Vectors that share a filter are compared.  Nothing is emitted by pair: where
two linked vectors meet in several filters only the first counts, and a task
gives for each vector its number of links and one tie to its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import partitions, written
from mercato.llm.components import connected_components

COSINE = 0.93
BLOCKS, CODES = 4, 16
#: Independent rotations and codes, and the directions of each that a vector is listed under.
TURNS, BEST = 4, 16
#: Coordinates of a block at least; vectors of fewer than two blocks are all compared.
LEAST_BLOCK = 4
#: Members of a filter compared with one another in one task.
TOGETHER = 512
#: Groups of at most so many rows are compared side by side, pairs of so many coordinates and filters at a time.
FEW, CELLS = 48, 4_000_000


class Filters:
    """Rotations and codes for vectors of ``size`` coordinates; the same on every worker."""

    def __init__(self, size: int):
        import numpy as np

        blocks = max(1, min(BLOCKS, size // LEAST_BLOCK))
        self.parts = np.array_split(np.arange(size), blocks)
        self.turns = []
        for turn in range(TURNS if blocks > 1 else 1):
            rng = np.random.default_rng([77 + size, turn])
            rotation = np.linalg.qr(rng.standard_normal((size, size)))[0]
            codes = [rng.standard_normal((CODES, len(part))) for part in self.parts]
            codes = [c / np.linalg.norm(c, axis=1, keepdims=True) * np.sqrt(c.shape[1] / size) for c in codes]
            self.turns.append((rotation, codes))

    def decode(self, vectors):
        """For each unit vector the sorted numbers of its filters, ``BEST`` of each rotation (one row per vector)."""
        import numpy as np

        if len(self.parts) == 1:
            return np.zeros((len(vectors), 1), np.int64)
        found = []
        for turn, (rotation, codes) in enumerate(self.turns):
            turned = vectors @ rotation
            sums, names = np.zeros((len(vectors), 1)), np.full((len(vectors), 1), turn, np.int64)
            for part, code in zip(self.parts, codes):
                sums = (sums[:, :, None] + (turned[:, part] @ code.T)[:, None, :]).reshape(len(vectors), -1)
                names = (names[:, :, None] * CODES + np.arange(CODES)).reshape(len(vectors), -1)
                # A partial sum with BEST better ones before it is in none of the BEST whole ones.
                if sums.shape[1] > BEST:
                    best = np.argpartition(-sums, BEST - 1, axis=1)[:, :BEST]
                    sums, names = np.take_along_axis(sums, best, 1), np.take_along_axis(names, best, 1)
            found.append(names)
        return np.sort(np.concatenate(found, axis=1), axis=1)


def unit_vectors(lists: list) -> list:
    """Unit vectors in double precision; None for null or zero vectors and such with null or non-finite components."""
    import numpy as np

    out = []
    for values in lists:
        vector = None if not values or None in values else np.array(values, np.float64)
        if vector is not None:
            top = np.abs(vector).max()
            vector = vector / top if np.isfinite(top) and top > 0 else None
        out.append(None if vector is None or not np.isfinite(vector).all() else vector / np.linalg.norm(vector))
    return out


def _unit_rows(rows):
    """Unit vectors of the rows of an array of usable vectors."""
    import numpy as np

    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _filtered(vectors: DataFrame, bare: bool = False) -> DataFrame:
    """Usable distinct vectors by filter: ``label``, ``size``, ``filter``, ``node``, ``weight``, ``filters`` (smaller ones), ``vector`` (bytes).

    ``bare`` leaves all but the first three out.
    """

    code = "f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "f8"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def cells(lengths, raw: bytes):
            """Binary values of these lengths, one after another in ``raw``."""
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])

        known: dict[int, Filters] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                raw = part.column(0).to_pylist()
                units = unit_vectors(raw)
                for size in {len(u) for u in units if u is not None}:
                    at = [i for i, u in enumerate(units) if u is not None and len(u) == size]
                    names = known.setdefault(size, Filters(size)).decode(np.stack([units[i] for i in at]))
                    width = names.shape[1]
                    each = pa.array(np.repeat(at, width))
                    columns = [part.column(1).take(each), pa.array(np.full(len(each), size, np.int32)), pa.array(names.ravel().astype(np.int32))]
                    if not bare:
                        before = np.tril(np.ones((width, width), bool), -1)
                        lists = np.broadcast_to(names.astype("<u4")[:, None, :], (len(at), width, width))[:, before]
                        own = np.array([raw[i] for i in at], code)
                        columns += [part.column(2).take(each), part.column(3).take(each)]
                        columns.append(cells(np.tile(4 * np.arange(width), len(at)), lists.tobytes()))
                        columns.append(cells(np.full(len(each), own[0].nbytes), np.repeat(own, width, axis=0).tobytes()))
                    yield pa.RecordBatch.from_arrays(columns, ["label", "size", "filter", "node", "weight", "filters", "vector"][: len(columns)])

    if bare:
        return vectors.select("embedding", "label").mapInArrow(run, "label string, size int, filter int")
    picked = vectors.select("embedding", "label", "node", "weight")
    return picked.mapInArrow(run, "label string, size int, filter int, node long, weight long, filters binary, vector binary")


def _pairs_of_small(starts, counts):
    """Places of all pairs within groups of consecutive rows, ``CELLS`` of them at most at a time."""
    import numpy as np

    for n in np.unique(counts).tolist():
        first, second = np.triu_indices(n, 1)
        own = starts[counts == n]
        step = max(1, CELLS // 64 // max(1, len(first)))
        for some in (own[i : i + step, None] for i in range(0, len(own), step)):
            yield (some + first).ravel(), (some + second).ravel()


def _near(unit, left, right):
    """Which of the pairs of rows are near."""
    import numpy as np

    step = max(1, CELLS // unit.shape[1])
    parts = [slice(i, i + step) for i in range(0, len(left), step)]
    return np.concatenate([np.einsum("ij,ij->i", unit[left[p]], unit[right[p]]) >= COSINE for p in parts] or [np.zeros(0, bool)])


class _Lists:
    """Sorted lists of the smaller filters of rows, from their joined bytes and lengths."""

    def __init__(self, raw: bytes, ends):
        import numpy as np

        self.flat = np.frombuffer(raw, "<u4").astype(np.int64)
        self.begin = np.concatenate([[0], ends[:-1]])
        self.count = ends - self.begin

    def rows(self, some):
        """Filters of ``some`` rows, one after another, and whose they are."""
        import numpy as np

        count = self.count[some]
        ends = np.cumsum(count)
        at = np.repeat(self.begin[some] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at], np.repeat(np.arange(len(some)), count)

    def strangers(self, left, right):
        """Which of the pairs share none of their filters."""
        import numpy as np

        out = np.ones(len(left), bool)
        step = max(1, CELLS // 64)
        for start in range(0, len(left), step):
            one, owner = self.rows(left[start : start + step])
            other, whose = self.rows(right[start : start + step])
            # Both sides by pair and filter: sorted, as pairs are and filters in them.
            one, other = owner << 32 | one, whose << 32 | other
            if len(one) and len(other):
                at = np.minimum(np.searchsorted(other, one), len(other) - 1)
                met = owner[other[at] == one]
                out[start + met] = False
        return out

    def apart(self, some):
        """Rows by rows: which of ``some`` share none of their filters."""
        import numpy as np

        flat, owner = self.rows(some)
        names, column = np.unique(flat, return_inverse=True)
        marks = np.zeros((len(some), max(len(names), 1)), np.float32)
        marks[owner, column] = 1
        return marks @ marks.T == 0


def _links(unit, lists: _Lists, starts, counts, own, across):
    """Pairs of rows that are linked and first met here, group by group; ``across`` marks rows that only meet those of another ``own``."""
    import numpy as np

    few = counts <= FEW
    for left, right in _pairs_of_small(starts[few], counts[few]):
        good = ~across[left] | (own[left] != own[right])
        left, right = left[good], right[good]
        good = _near(unit, left, right)
        left, right = left[good], right[good]
        good = lists.strangers(left, right)
        yield left[good], right[good]
    for start, count in zip(starts[~few].tolist(), counts[~few].tolist()):
        mine = slice(start, start + count)
        near = np.triu(unit[mine] @ unit[mine].T >= COSINE, 1)
        if across[start]:
            near &= own[mine, None] != own[None, mine]
        # Only rows with a neighbour are asked for the filters before.
        some = np.flatnonzero(near.any(0) | near.any(1))
        if len(some):
            left, right = np.nonzero(near[np.ix_(some, some)] & lists.apart(start + some))
            yield start + some[left], start + some[right]


def _compare(groups: DataFrame, code: str) -> DataFrame:
    """``node``, ``root`` (a smaller node it is tied to, or itself) and ``links`` (vectors first met in this filter)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def joined(column):
            """The bytes of a binary column and the end of each value."""
            column = column.combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = column.chunk(0) if column.num_chunks else pa.array([], pa.binary())
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            return column.buffers()[2].to_pybytes()[ends[0] : ends[-1]] if ends[-1] > ends[0] else b"", ends[1:] - ends[0]

        def whole_groups(rows, changes):
            """Compare the rows of whole groups of one size; ``changes`` are where groups begin."""
            width = rows.column("size")[0].as_py()
            unit = _unit_rows(np.frombuffer(joined(rows.column("vector"))[0], code).reshape(-1, width))
            raw, ends = joined(rows.column("filters"))
            numbers = {c: rows.column(c).to_numpy() for c in ("own", "node", "weight", "i", "j")}
            counts = np.diff(np.append(changes, len(unit)))
            node, weight, links = numbers["node"], numbers["weight"], np.zeros(len(unit), np.int64)
            found = list(_links(unit, _Lists(raw, ends // 4), changes, counts, numbers["own"], numbers["i"] != numbers["j"]))
            left, right = (np.concatenate([np.zeros(0, int), *(x[k] for x in found)]) for k in (0, 1))
            np.add.at(links, left, weight[right])
            np.add.at(links, right, weight[left])
            root = node.copy()
            while True:
                least = root.copy()
                np.minimum.at(least, left, root[right])
                np.minimum.at(least, right, root[left])
                if (least == root).all():
                    break
                root = least
            keep = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()) for x in (node, root, links)], ["node", "root", "links"])

        def by_size(rows, changes):
            sizes = rows.column("size").to_numpy()
            cuts = [0, *(np.flatnonzero(sizes[1:] != sizes[:-1]) + 1).tolist(), len(sizes)]
            for a, b in zip(cuts, cuts[1:]):
                own = changes[(changes >= a) & (changes < b)] - a
                yield whole_groups(rows.slice(a, b - a), own)

        def begins(rows):
            """Where groups begin, the first row among them."""
            new = np.zeros(rows.num_rows, bool)
            new[:1] = True
            for name in ("label", "size", "filter", "i", "j"):
                column = rows.column(name).combine_chunks()
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
            return np.flatnonzero(new)

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            changes = begins(rows)
            last = int(changes[-1])
            if last:
                yield from by_size(rows.slice(0, last), changes[:-1])
            held = rows.slice(last)
        if held is not None:
            yield from by_size(held, np.zeros(1, int))

    return groups.mapInArrow(run, "node long, root long, links long")


def _label_text(vectors: DataFrame):
    """Labels of any type as text; both zeros of a floating type are one."""
    label = F.col("label")
    if vectors.schema["label"].dataType.simpleString() in ("float", "double"):
        label = F.when(label == 0, F.abs(label)).otherwise(label)
    return label.cast("string").alias("label")


def linked_vectors(vectors: DataFrame) -> DataFrame:
    """For each row of ``vectors`` (``vec_id``, ``embedding``, ``label``): ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Linked are vectors of equal, non-null labels and equal length with cosine
    of at least ``COSINE`` in double precision; labels may have any type that
    Spark casts to text.  Null and zero vectors and
    those with null or non-finite components link with nothing, and neither do
    rows without a ``vec_id``, which are kept with a null ``component_id``.
    Equal vectors are compared once and count each; so do repeated rows.  An
    empty table gives no rows.  A pair is found if it shares a filter, which
    a random pair right at ``COSINE`` does with a chance of about 0.967 in each of the
    ``TURNS`` rotations.
    """
    bits = F.hash("embedding"), F.xxhash64("embedding")
    rows = vectors.select("vec_id", _label_text(vectors), "embedding", F.concat_ws("/", *[b.cast("string") for b in bits], F.size("embedding").cast("string")).alias("bits"))
    rows = rows.withColumn("usable", F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    usable = rows.filter("usable")
    nodes = usable.groupBy("label", "bits").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding"))
    nodes = written(nodes, "vectors")
    single = nodes.schema["embedding"].dataType.elementType.simpleString() == "float"
    # Only filters with more vectors than are compared in one task are looked up; Spark broadcasts their table if its files are small.
    key = ["label", "size", "filter"]
    crowded = _filtered(nodes, bare=True).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TOGETHER)
    crowded = written(crowded.withColumn("blocks", F.ceil(F.col("n") / TOGETHER).cast("int")).drop("n"), "crowded")
    groups = _filtered(nodes).join(crowded, key, "left").fillna(1, ["blocks"])
    groups = groups.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    groups = groups.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = groups.select(
        "label", "size", "filter", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "weight", "filters", "vector"
    )
    key = ["label", "size", "filter", "i", "j"]
    dealt = groups.repartition(partitions(vectors.sparkSession), *key).sortWithinPartitions(*key)
    met = _compare(dealt, "f4" if single else "f8")
    met = written(met.groupBy("node", "root").agg(F.sum("links").alias("links")), "met")
    parts = connected_components(met.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    placed = nodes.select("label", "bits", "node", "weight").join(links, "node", "left").join(parts, "node", "left")

    def finite(batches):
        import pyarrow as pa

        for batch in batches:
            good = [u is not None for u in unit_vectors(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good)], ["label", "bits", "good"])

    good = nodes.select("label", "bits", "embedding").mapInArrow(finite, "label string, bits string, good boolean").filter("good").select("label", "bits")
    placed = placed.join(good, ["label", "bits"], "left_semi")
    placed = placed.select("label", "bits", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("component"))
    out = rows.join(placed, (rows["label"] == placed["label"]) & (rows["bits"] == placed["bits"]) & rows["usable"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
