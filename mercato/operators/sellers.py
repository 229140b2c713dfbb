"""Seller ranking, segments and adjustments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.columns import cut, floor_days, merged_row, merged_sum, part_sums, ratio, total
from mercato.functions.stats import pct_rank
from mercato.operators.revenue import top_k
from mercato.plans.star import CATEGORY, Star, mean_over_rows, mean_score, share_of_rows

# Segments by percentile rank of revenue.
SEGMENT_EDGES = (0, 0.25, 0.75, 0.95, 1.0)
SEGMENT_LABELS = ("Bottom 25%", "Middle 50%", "Top 25%", "Top 5%")


def seller_performance(star: Star) -> DataFrame:
    """Revenue (R5), orders, mean score, delivery days and on-time share per seller.

    Means and shares are over joined rows; the on-time share divides by all of
    them, delivered or not.
    """
    return (
        star.per_order("seller_id")
        .groupBy("seller_id")
        .agg(
            total("revenue").alias("revenue"),
            F.count(F.lit(1)).alias("orders"),
            mean_score().alias("avg_review"),
            mean_over_rows("delivery_time").alias("avg_delivery_time"),
            share_of_rows("on_time_delivery").alias("on_time_pct"),
        )
    )


def seller_kpis(star: Star) -> DataFrame:
    """Sellers, mean and best revenue (R5), mean orders per seller."""
    return seller_performance(star).agg(
        F.count(F.lit(1)).alias("total_sellers"),
        ratio(total("revenue"), F.count(F.lit(1))).alias("avg_seller_revenue"),
        F.max("revenue").alias("top_seller_revenue"),
        ratio(F.sum("orders"), F.count(F.lit(1))).alias("avg_orders_per_seller"),
    )


def top_sellers(star: Star, n: int | None = 10) -> DataFrame:
    """Best sellers by revenue (R5)."""
    table = seller_performance(star).select("seller_id", "revenue", "orders", "avg_review")
    return top_k(table, "revenue", n, "seller_id")


def sellers_by_state(star: Star, n: int | None = 10) -> DataFrame:
    """States with most active sellers."""
    active = star.scoped(star.items().select("order_id", "seller_id")).select("seller_id").distinct()
    counts = (
        star.tables.sellers.where(F.col("seller_state").isNotNull())
        .join(active, "seller_id", "left_semi")
        .groupBy("seller_state")
        .agg(F.count(F.lit(1)).alias("sellers"))
    )
    return top_k(counts, "sellers", n, "seller_state")


def seller_matrix(star: Star, by: str = "seller_id", n: int = 100) -> DataFrame:
    """Sellers with a score, a delivery time and positive revenue (R5).

    ``by='seller_id'`` takes the first ``n`` by id, as published;
    ``by='revenue'`` the ``n`` best.
    """
    known = (
        seller_performance(star)
        .drop("on_time_pct")
        .where(F.col("avg_review").isNotNull() & F.col("avg_delivery_time").isNotNull())
        .where(F.col("revenue") > 0)
    )
    return known.orderBy("seller_id").limit(n) if by == "seller_id" else top_k(known, by, n, "seller_id")


def seller_segments(star: Star) -> DataFrame:
    """Seller table with percentile rank of revenue and segment."""
    ranked = pct_rank(seller_performance(star), "revenue", "revenue_percentile")
    return ranked.withColumns(
        {
            "segment": cut("revenue_percentile", SEGMENT_EDGES, SEGMENT_LABELS),
            "level": cut("revenue_percentile", SEGMENT_EDGES, range(len(SEGMENT_LABELS))),
        }
    )


def segment_summary(star: Star) -> DataFrame:
    """Sellers, revenue (R5) and mean score per segment."""
    score = F.col("avg_review")
    return (
        seller_segments(star)
        .groupBy("level", "segment")
        .agg(
            F.count(F.lit(1)).alias("sellers"),
            total("revenue").alias("revenue"),
            F.avg(score).alias("avg_review"),
        )
        .orderBy("level")
    )


def segment_delivery(star: Star) -> DataFrame:
    """Mean over sellers of delivery days, on-time share and score per segment."""
    return (
        seller_segments(star)
        .groupBy("level", "segment")
        .agg(
            F.avg("avg_delivery_time").alias("avg_delivery_time"),
            F.avg("on_time_pct").alias("on_time_pct"),
            F.avg("avg_review").alias("avg_review"),
        )
        .orderBy("level")
    )


def category_opportunity(star: Star, n: int | None = 15) -> DataFrame:
    """Revenue (R5), orders, sellers, score and revenue per seller of the best categories."""
    table = category_members(star, "seller_id", "sellers").withColumn("revenue_per_seller", ratio("revenue", "sellers"))
    return top_k(table.select("category", "revenue", "orders", "sellers", "avg_review", "revenue_per_seller"), "revenue", n, "category")


def category_members(star: Star, member: str, name: str) -> DataFrame:
    """Revenue (R5), orders, distinct members and mean score of each category.

    Rows lie by order, so the first row of each (order, category) is marked
    there; the marks are summed per (category, member), and these rows counted.
    Neither distinct count sends order ids or repeats a row per count.
    """
    lines = star.per_order(CATEGORY, member, product=True)
    first = F.row_number().over(Window.partitionBy("order_id", "order_hash", CATEGORY).orderBy(member)) == 1
    pairs = lines.withColumn("first", first).groupBy(F.col(CATEGORY).alias("category"), member).agg(
        *part_sums("revenue", "revenue"), F.count_if("first").alias("orders"), F.sum("scores").alias("scores"), F.sum("scored").alias("scored")
    )
    return pairs.groupBy("category").agg(
        merged_sum("revenue").alias("revenue"),
        F.sum("orders").alias("orders"),
        mean_score().alias("avg_review"),
        F.count(F.lit(1)).alias(name),
    )


def seller_size_adjusted(star: Star) -> DataFrame:
    """Revenue (R5) per product and per active day (first to last order) of each seller."""
    bought = "order_purchase_timestamp"
    return (
        star.lines()
        .where(F.col("seller_id").isNotNull())
        .groupBy("seller_id")
        .agg(
            total("revenue").alias("revenue"),
            F.sum("rows").alias("rows"),
            F.count_distinct("product_id").alias("products"),
            floor_days(F.max(bought), F.min(bought)).alias("days_active"),
        )
        .withColumn("revenue_per_product", ratio("revenue", "products"))
        .withColumn("revenue_per_day", ratio("revenue", "days_active"))
    )


def _difficulty(total_of: Callable[[str], Column], sellers: Column) -> tuple[Column, Column]:
    """Margin share and difficulty 1 / margin x ln(sellers) of a category."""
    revenue = total_of("revenue")
    margin = ratio(revenue - total_of("price") - total_of("freight"), revenue)
    return margin, ratio(F.lit(1.0), margin) * F.ln(sellers)


def category_difficulty(star: Star) -> DataFrame:
    """Per category: sellers, margin share and difficulty 1 / margin x ln(sellers)."""
    sellers = F.count(F.lit(1))
    margin, difficulty = _difficulty(merged_sum, sellers)
    sums = _seller_category(star).groupBy("category")
    return sums.agg(sellers.alias("sellers"), margin.alias("margin"), difficulty.alias("difficulty"))


def _seller_category(star: Star) -> DataFrame:
    """Per seller and category the sums of revenue, price and freight, in parts."""
    return (
        star.lines(product=True)
        .where(F.col(CATEGORY).isNotNull() & F.col("seller_id").isNotNull())
        .groupBy("seller_id", F.col(CATEGORY).alias("category"))
        .agg(
            *part_sums("revenue", "revenue"),
            *part_sums(F.col("price") * F.col("rows"), "price"),
            *part_sums(F.col("freight_value") * F.col("rows"), "freight"),
        )
    )


def category_mix_adjust(star: Star) -> DataFrame:
    """Seller revenue per category (R5) scaled by the category's difficulty.

    The margin is that of the category's summed joined rows, by a window over
    the (seller, category) sums, a row per seller at most: items are read and
    joined once.
    """
    whole = Window.partitionBy("category")
    _, difficulty = _difficulty(lambda name: merged_sum(name, whole), F.count(F.lit(1)).over(whole))
    rows = _seller_category(star).select("seller_id", "category", merged_row("revenue").alias("revenue"), difficulty.alias("difficulty"))
    return rows.withColumn("adjusted_revenue", F.col("revenue") * F.col("difficulty"))
