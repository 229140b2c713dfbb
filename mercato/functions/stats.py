"""Exact order statistics that never sort a whole column in one task.

Spark's ``percentile`` and an un-keyed ``rank`` window both end in a single
task that holds every distinct value.  Here the distinct values are spread
over buckets by approximate quantiles, ranked inside their bucket, and shifted
by the weight of the lower buckets.  The edges only balance the work; the
result is exact whatever they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.columns import cut_at

DEFAULT_LEVELS = 8  # 256 buckets


def value_distribution(
    df: DataFrame,
    value: Column | str,
    weight: Column | str | None = None,
    levels: int = DEFAULT_LEVELS,
) -> DataFrame:
    """One row per distinct non-null value: ``value, weight, below, total``.

    ``weight`` is the number of rows with the value (or the sum of the weight
    column), ``below`` the weight of all smaller values.  Repeated values are
    combined map-side, so a hot value costs one row per task.  The work is
    spread over ``2 ** levels`` buckets.
    """
    value = F.col(value) if isinstance(value, str) else value
    weight = F.col(weight) if isinstance(weight, str) else weight
    rows = F.lit(1) if weight is None else weight
    values = (
        df.select(value.alias("value"), rows.cast("bigint").alias("rows"))
        .where(F.col("value").isNotNull() & (F.col("rows") > 0))
        .groupBy("value")
        .agg(F.sum("rows").alias("weight"))
    )
    buckets = 2**levels
    fractions = [i / buckets for i in range(1, buckets)]
    shape = values.agg(
        F.struct(
            F.percentile_approx("value", fractions, 10 * buckets).alias("edges"),
            F.sum("weight").alias("total"),
        ).alias("shape")
    ).scalar()
    # The shape is attached once as a column: a subquery mentioned n times is
    # planned n times.
    placed = values.withColumn("shape", shape).selectExpr(
        "value", "weight", "shape.total AS total", "shape.edges AS edges", "0 AS bucket"
    )
    # Binary search for the number of edges below the value, one level at a
    # time.  The result is never null, or the join below would push a null
    # test on it underneath the aggregate, to every row.
    for step in (2**i for i in reversed(range(levels))):
        placed = placed.selectExpr(
            "value", "weight", "total", "edges", f"bucket + if(edges[bucket + {step - 1}] < value, {step}, 0) AS bucket"
        )
    placed = placed.drop("edges")
    in_order = Window.partitionBy("bucket").orderBy("value")
    inside = placed.withColumn(
        "inside", F.sum("weight").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    )
    # At most `buckets` rows, so one window and a broadcast are bounded.
    by_bucket = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("bucket")
        .agg(F.sum("weight").alias("bucket_weight"))
        .select("bucket", F.coalesce(F.sum("bucket_weight").over(by_bucket), F.lit(0)).alias("offset"))
    )
    return inside.join(F.broadcast(offsets), "bucket").selectExpr(
        "value", "weight", "offset + coalesce(inside, 0) AS below", "total"
    )


def quantiles(
    df: DataFrame,
    value: Column | str,
    fractions: dict[str, float],
    weight: Column | str | None = None,
    levels: int = DEFAULT_LEVELS,
) -> DataFrame:
    """One row of exact, linearly interpolated quantiles.

    ``fractions`` maps output names to fractions; with ``weight`` each value
    counts as that many equal rows.  Adds ``n``, the number of rows counted.
    """
    spread = value_distribution(df, value, weight, levels)
    below, upto = F.col("below"), F.col("below") + F.col("weight")

    def at(position: Column) -> Column:
        return F.max(F.when((below <= position) & (position < upto), F.col("value").cast("double")))

    picked, out = [], [F.col("n")]
    for name, q in fractions.items():
        place = (F.col("total") - 1) * F.lit(float(q))
        picked += [
            at(F.floor(place)).alias(f"{name}__lo"),
            at(F.ceil(place)).alias(f"{name}__hi"),
            F.max(place - F.floor(place)).alias(f"{name}__part"),
        ]
        lo, hi = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        out.append((lo + (hi - lo) * F.col(f"{name}__part")).alias(name))
    return spread.agg(F.coalesce(F.max("total"), F.lit(0)).alias("n"), *picked).select(*out)


def qcut(
    df: DataFrame,
    value: str,
    labels: Sequence[str],
    out: str,
    weight: str | None = None,
    ordinal: str | None = None,
) -> DataFrame:
    """Add the equal-frequency bin of ``value`` as label ``out``.

    Bins are ``(lo, hi]`` at exact interpolated quantiles, the lowest value
    included; equal edges merge into the lowest bin.  ``ordinal`` names an
    optional column with the bin number from 0.
    """
    k = len(labels)
    names = {f"e{i}": i / k for i in range(1, k)}
    edges = quantiles(df, value, names, weight).select(F.struct(*names)).scalar()
    uppers = [F.col(f"__edges.{n}") for n in names]
    binned = df.withColumn("__edges", edges).withColumn(out, cut_at(value, uppers, list(labels)))
    if ordinal:
        binned = binned.withColumn(ordinal, cut_at(value, uppers, list(range(k))))
    return binned.drop("__edges")


def pct_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add the fractional rank of ``value``: mean rank of ties / non-null rows.

    The ranked distinct values are joined back on the value, whose right side
    is unique; rows with a null value keep a null rank.
    """
    ranks = value_distribution(df, value).select(
        F.col("value").alias(value),
        ((F.col("below") + (F.col("weight") + 1) / 2) / F.col("total")).alias(out),
    )
    return df.join(ranks, value, "left")


def histogram(
    df: DataFrame,
    value: str,
    bins: int,
    low: float | None = None,
    high: float | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Counts in equal-width bins: ``bin, bin_start, bin_end, rows``.

    Bins are ``[lo, hi)``, the last one closed.  Missing bounds are taken from
    the data; values outside given bounds are left out.  Empty bins are absent.
    """
    weight_col = F.lit(1) if weight is None else F.col(weight)
    src = df.select(
        F.col(value).cast("double").alias("v"), weight_col.cast("bigint").alias("w")
    ).where(F.col("v").isNotNull())
    if low is None or high is None:
        bounds = src.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
        src = src.withColumn("seen", bounds)
    lo = F.col("seen.lo") if low is None else F.lit(float(low))
    hi = F.col("seen.hi") if high is None else F.lit(float(high))
    placed = src.select("v", "w", lo.alias("lo"), hi.alias("hi"))
    slot = f"cast(least(coalesce(floor(try_divide(v - lo, (hi - lo) / {bins})), 0), {bins - 1}) AS int)"
    return (
        placed.where("v BETWEEN lo AND hi")
        .groupBy(F.expr(slot).alias("bin"))
        .agg(F.sum("w").alias("rows"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        .selectExpr(
            "bin",
            f"lo + (hi - lo) / {bins} * bin AS bin_start",
            f"lo + (hi - lo) / {bins} * (bin + 1) AS bin_end",
            "rows",
        )
        .orderBy("bin")
    )
