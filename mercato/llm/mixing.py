"""Mixing sources to target weights by systematic sampling.

Sizes are counted in words.  Each source gets a target; a document's expected
copies are its source's target by its source's size.  Within a source the
documents stand in the order of size, hash of the id and id.  The expected
copies are summed up along that order, one random offset is added, and a
document is taken once for each whole number that the sum crosses at it.  Long
and short documents are thus taken in their proportion, and what a source
gives differs from its target by little more than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import WORD

#: Parts of a copy: expected copies are whole numbers of these, so sums are exact.
UNIT = 1 << 28
#: Parts into which rows of the same source and size are cut for the sums.
SLOTS = 64

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def words(text: str) -> Column:
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from one row per source.

    ``weights`` repeat over the sources by code point, null last.  The sources
    share ``share`` times all sizes by weight; a target stops at ``most`` times
    its source's size and what is above goes to the others by weight, until
    none is above.  Sources fill up in the order of limit by weight, so the
    common level of the rest follows from sums along that order.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    position = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    limits = sizes.select(
        "source", "source_size",
        F.element_at(F.array(*map(F.lit, weights)), position).cast("double").alias("weight"),
        (F.col("source_size") * most).alias("limit"),
    )
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(everything) * share
    level = (total - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    # Full are the sources whose limit lies below the level; from the first
    # that isn't, the level holds for all.
    ranked = limits.withColumn("level", level).withColumn("open", F.col("limit") >= F.col("weight") * F.col("level"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.least("limit", F.coalesce(F.col("weight") * final, F.col("limit")))
    return ranked.select("source", "source_size", target.alias("target"))


def _hash(column: str) -> Column:
    """Of an id a number below 2**32 that other engines can compute, too."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def _offset(seed: int) -> Column:
    """The random offset of a source, in units."""
    key = F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("source"), F.lit("")))
    return F.floor(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") * F.lit(UNIT) / F.lit(1 << 32)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7) -> DataFrame:
    """For each row of ``docs``: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``copies`` is at most ``most`` rounded up, and ``taken`` is ``copies`` times
    ``size``.  The same table and ``seed`` give the same copies, however the
    rows are dealt out.  Null sources are one source, null texts have size 0;
    sources without any word have target 0 and no copies.  Repeated rows are
    taken each on its own.  No rows give no rows.  Sums are exact for up to
    10**10 documents of a source.

    Prefix sums come from rows counted by (source, size, slot of the hash), a
    table bounded by the different sizes, and from windows inside those
    groups, so no source lies in one task.
    """
    return _mixed(docs.select("doc_id", "source", words("text").alias("size")), weights, share, most, seed)


def _mixed(sized: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int) -> DataFrame:
    """``sized`` (``doc_id``, ``source``, ``size`` and more) with the columns of ``mix``."""
    more = [c for c in sized.columns if c not in ("doc_id", "source", "size")]
    base = sized.withColumn("hash", _hash("doc_id"))
    base = base.withColumn("slot", F.shiftright("hash", 26).cast("int"))
    counts = base.groupBy("source", "size", "slot").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    plan = targets(sizes, weights, share, most)
    step = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size")) * UNIT), F.lit(0)).cast("long")
    plan = plan.withColumn("step", step)
    along = Window.partitionBy("source").orderBy("size", "slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(_marked(plan), F.col("source").eqNullSafe(F.col("plan_source")))
    starts = starts.select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("slot").alias("t"), "source_size", "target", "step",
        (_offset(seed) + F.col("step") * F.coalesce(F.sum("n").over(along), F.lit(0))).alias("before"),
    )
    key = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("slot") == F.col("t"))
    rows = base.join(starts, key)
    inside = Window.partitionBy("source", "size", "slot").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("before") + F.sum("step").over(inside)
    crossed = F.shiftright(upto, 28) - F.shiftright(upto - F.col("step"), 28)
    return rows.withColumn("copies", crossed.cast("int")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *more
    )


def _marked(plan: DataFrame) -> DataFrame:
    return plan.withColumnRenamed("source", "plan_source")


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, all columns as they are, whatever their names.

    Rows are taken each on its own, also those that share a ``doc_id`` or have none.
    """
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    mixed = _mixed(docs.select("doc_id", "source", words("text").alias("size"), row), weights, share, most, seed)
    taken = mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select("row.*")
