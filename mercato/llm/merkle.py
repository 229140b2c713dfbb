"""Merkle manifest of a table: a tree of digests per group, and one over the groups.

Digests are SHA-256 over lowercase hex texts; tables hold them as 32 bytes.
Leaves of a group stand in ascending key order.  Per level, windows over the
nodes of a run give each node its siblings by ``lag`` and ``lead`` at the fixed
offsets 1 to 7, masked by its slot and the length of its run, and the rows of
first children hash the parents.  Every level is a table in the shared folder.

A leaf's place in its group comes from a range partitioning of (group, key),
the place within its partition and counts per (partition, group), so that no
task sorts a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import partitions, written

FANOUT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:binary,after:binary>>"


def digest(data: Column) -> Column:
    """The digest of digests set one after another (binary), as hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(data)), 256))


def hex_text(data: Column) -> Column:
    return F.lower(F.hex(data))


def leaf_digest(values: list[Column]) -> Column:
    """The leaf over ``values``: each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    texts = [value.cast("string") for value in values]
    parts = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _empty() -> Column:
    return F.lit("").cast("binary")


def _with_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``run`` and the siblings ``before`` and ``after`` each, joined."""
    run, slot = F.floor(F.col("pos") / FANOUT).cast("long"), F.col("pos") % FANOUT
    nodes = nodes.withColumns({"run": run, "slot": slot})
    length = F.least(F.lit(FANOUT).cast("long"), F.col("n") - F.col("run") * FANOUT)
    order = Window.partitionBy("tree", "run").orderBy("pos")
    ago = [F.when(F.col("slot") >= k, F.lag("digest", k).over(order)) for k in range(FANOUT - 1, 0, -1)]
    ahead = [F.when(F.col("slot") + k < length, F.lead("digest", k).over(order)) for k in range(1, FANOUT)]
    joined = [F.concat(*(F.coalesce(x, _empty()) for x in side)) for side in (ago, ahead)]
    return nodes.withColumns({"before": joined[0], "after": joined[1]})


def _climb(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Node tables (``tree``, ``pos``, ``n`` of its tree's nodes, ``digest``) from ``nodes`` up; a tree ends where ``n`` is 1."""
    levels = [nodes]
    while most > 1:
        parents = _with_siblings(levels[-1].filter("n > 1")).filter("slot = 0").select(
            "tree",
            F.col("run").alias("pos"),
            F.ceil(F.col("n") / FANOUT).cast("long").alias("n"),
            digest(F.concat("digest", "after")).alias("digest"),
        )
        levels.append(written(parents, "merkle-level"))
        most = -(-most // FANOUT)
    return levels


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The rows of ``levels[0]`` with ``path`` (siblings per level, upwards) and the other columns of ``tops``.

    ``tops`` has a row per tree: ``tree``, the ``path`` above it, and more.
    """
    more = [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for nodes in reversed(levels):
        own = nodes.columns
        here = nodes.filter("n = 1").join(tops, "tree").select(*own, "path", *more)
        if above is not None:
            up = above.select("tree", F.col("pos").alias("run"), F.col("path").alias("above"), *more)
            step = F.array(F.struct("before", "after")).cast(PATH)
            below = _with_siblings(nodes.filter("n > 1")).join(up, ["tree", "run"])
            here = here.unionByName(below.select(*own, F.concat(step, "above").alias("path"), *more))
        above = here
    return above


def _placed(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """``leaves`` (``group``, ``key``, ``digest`` and more) with ``tree`` (number of the group), ``pos`` and ``n``; most leaves of a group; groups.

    Equal rows may stand in any order; a running number lets them be split.
    """
    spark = leaves.sparkSession
    order = [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest"), F.col("salt")]
    dealt = leaves.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order)
    dealt = dealt.sortWithinPartitions(*order).drop("salt")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = written(dealt.withColumns({"part": F.spark_partition_id(), "place": place}), "merkle-order")
    # One row per partition and group in it: at most the partitions and the groups together.
    stretch = dealt.groupBy("part", "group").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("group")
    ahead = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    stretch = written(stretch.withColumns({"ahead": F.coalesce(ahead, F.lit(0)), "total": F.sum("n").over(whole)}), "merkle-stretch")
    # Groups are numbered where they begin: by the groups that begin in partitions before, and by their order within.
    begun = stretch.filter("ahead = 0")
    counts = begun.groupBy("part").agg(F.count(F.lit(1)).alias("groups"))
    earlier = F.sum("groups").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("part", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("group").asc_nulls_first()))
    numbers = begun.withColumn("within", within).join(counts, "part")
    numbers = numbers.select(F.col("group").alias("named"), (F.col("earlier") + F.col("within") - 1).cast("long").alias("tree"))
    stretch = stretch.join(numbers, stretch["group"].eqNullSafe(numbers["named"])).drop("named")
    stretch = written(stretch.select(F.col("part").alias("in_part"), F.col("group").alias("in_group"), "first", "ahead", "total", "tree"), "merkle-stretch")
    size = stretch.agg(F.max("total").alias("most"), F.max("tree").alias("last")).first()
    placed = dealt.join(stretch, (F.col("part") == F.col("in_part")) & F.col("group").eqNullSafe(F.col("in_group")))
    pos = F.col("ahead") + F.col("place") - F.col("first")
    more = [c for c in leaves.columns if c != "digest"]
    placed = placed.select(*more, "digest", "tree", pos.alias("pos"), F.col("total").alias("n"))
    return placed, size["most"] or 0, 0 if size["last"] is None else size["last"] + 1


def manifest(docs: DataFrame, altered: dict[str, Column] | None = None, columns: tuple[str, ...] = COLUMNS, group: str = "lang", key: str = "doc_id") -> DataFrame:
    """A row per row of ``docs``: ``key``, ``leaf``, ``subroot``, ``root`` (binary digests), ``path`` and ``altered_leaf``.

    Leaves of a ``group`` ascend by ``key`` (null first, ties by their digest);
    while several nodes remain, every 8 consecutive ones become the digest over
    them, a last run of fewer, even of one, too.  What remains is the
    ``subroot``; subroots in the order of their groups (null first, by UTF-8
    bytes) make the ``root`` in the same way.  ``path`` has the siblings of a
    leaf's run before and after it and those of each parent up to the root:
    see ``folded`` and ``proof``.  ``altered_leaf`` is the leaf with the values
    of ``altered`` that aren't null in place of the columns of that name, null
    where there are none.

    Null values are ``-`` in a leaf.  Repeated rows are leaves each; texts may
    be of any length, empty ones included.  An empty table gives no rows.
    Other columns of ``docs`` are ignored whatever their names.
    """
    altered = altered or {}
    values = [docs[c] for c in columns]
    other = leaf_digest([F.coalesce(altered[c], docs[c]) if c in altered else docs[c] for c in columns])
    changed = F.lit(False)
    for x in altered.values():
        changed = changed | x.isNotNull()
    leaves = docs.select(
        docs[group].alias("group"),
        docs[key].alias("key"),
        leaf_digest(values).alias("digest"),
        (F.when(changed, other) if altered else F.lit(None).cast("binary")).alias("altered_leaf"),
    )
    placed, most, groups = _placed(written(leaves, "merkle-leaves"))
    levels = _climb(placed.select("tree", "pos", "n", "digest"), most)
    subroots = levels[0].filter("n = 1")
    for nodes in levels[1:]:
        subroots = subroots.unionByName(nodes.filter("n = 1"))
    subroots = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(groups).cast("long").alias("n"), "digest")
    upper = _climb(written(subroots, "merkle-subroots"), groups)
    root = upper[-1].select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    tops = _paths(upper, root).select(F.col("pos").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    levels[0] = placed.select("tree", "pos", "n", "digest", "key", "altered_leaf")
    whole = _paths(levels, written(tops, "merkle-tops"))
    return whole.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "path", "altered_leaf")


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that ``leaf`` (a binary digest) and the siblings in ``path`` give."""
    return F.aggregate(F.col(path), leaf, lambda own, step: digest(F.concat(step["before"], own, step["after"])))


def proof(path: str = "path") -> Column:
    """All siblings of ``path``, level by level from the leaf, left to right, as one binary."""
    return F.aggregate(F.col(path), _empty(), lambda held, step: F.concat(held, step["before"], step["after"]))


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def tamper_check(docs: DataFrame) -> DataFrame:
    """Check the manifest against texts of which those with a crc32 of ``doc_id`` that 3 divides come in lower case.

    ``doc_id``, ``leaf``, ``subroot``, ``root`` and ``proof_sha256`` of the
    table as it is, ``folded_root`` from the tampered leaf and the untouched
    siblings, and whether it equals the root.  Rows without ``doc_id`` aren't
    tampered with; null texts stay null.
    """
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    built = manifest(docs, altered={"text": F.when(tampered, lower_ascii(F.col("text")))})
    built = built.withColumn("folded", folded(F.coalesce("altered_leaf", "leaf")))
    return built.select(
        "doc_id",
        *(hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")),
        F.sha2(hex_text(proof()), 256).alias("proof_sha256"),
        hex_text(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
