"""Data quality checks and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import count_total, ratio, total
from mercato.operators.kpi import source_revenue
from mercato.operators.revenue import revenue_components
from mercato.plans.star import Star
from mercato.sources.schema import require_columns

__all__ = [
    "dup_count",
    "fanout_report",
    "joined_duplicates",
    "null_profile",
    "reconcile",
    "require_columns",
    "revenue_check",
]


def null_profile(df: DataFrame) -> DataFrame:
    """Percentage of nulls per column: ``column, null_pct``.  One pass, one row shuffled."""
    shares = df.agg(
        *[F.avg(F.col(c).isNull().cast("double") * 100).alias(c) for c in df.columns]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_pct")) for c in df.columns])
    return shares.select(F.inline(rows)).orderBy("column")


def dup_count(df: DataFrame, key: str) -> DataFrame:
    """Rows that repeat an earlier value of ``key``; null counts as a value."""
    rows = F.count(F.lit(1))
    distinct = F.count_distinct(key) + F.max(F.col(key).isNull().cast("int"))
    return df.agg(
        rows.alias("rows"),
        distinct.cast("bigint").alias("distinct_keys"),
        (rows - F.coalesce(distinct, F.lit(0))).cast("bigint").alias("duplicates"),
    )


def joined_duplicates(star: Star) -> DataFrame:
    """:func:`dup_count` of the order over the joined rows, from the row counts of the orders; nothing is joined wide."""
    rows, orders = count_total("rows"), F.count(F.lit(1))
    return star.orders().agg(rows.alias("rows"), orders.alias("distinct_keys"), (rows - orders).alias("duplicates"))


def revenue_check(star: Star) -> DataFrame:
    """Price plus freight summed over the joined rows."""
    return star.orders().agg(total("line_fanned").alias("item_revenue"))


def reconcile(star: Star, tolerance: float = 1.0) -> DataFrame:
    """Whether product, freight and other charges add up to the payments."""
    rebuilt = F.col("product_revenue") + F.col("freight_revenue") + F.col("other_charges")
    return (
        revenue_components(star)
        .withColumn("calculated_total", F.round(rebuilt, 4))
        .withColumn("balanced", F.abs(F.col("calculated_total") - F.col("total_revenue")) < tolerance)
    )


def fanout_report(star: Star) -> DataFrame:
    """Joined rows after each join and the inflation of revenue (R2 / R1).

    Read off the per-order row counts; nothing is joined many-to-many.
    """
    items, pays, revs = (F.col(c) for c in ("item_rows", "pay_rows", "review_rows"))
    stages = (
        ("orders", F.lit(1)),
        ("items", items),
        ("payments", items * pays),
        ("reviews", items * pays * revs),
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.col(name).alias("rows"))
            for i, (name, _) in enumerate(stages, 1)
        ]
    )
    return (
        star.orders()
        .agg(*[count_total(n).alias(name) for name, n in stages], total("revenue").alias("fanned_revenue"))
        .withColumn("source_revenue", source_revenue(star))
        .withColumn("inflation", ratio("fanned_revenue", "source_revenue"))
        .select(F.inline(rows), "fanned_revenue", "source_revenue", "inflation")
    )
