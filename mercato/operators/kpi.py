"""Executive indicators: one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.columns import (
    count_total,
    count_when,
    floor_days,
    merged_row,
    part_sums,
    percent,
    ratio,
    safe_div,
    total,
)
from mercato.functions.stats import quantiles
from mercato.plans.star import CUSTOMER, STATE, Star


def source_revenue(star: Star) -> Column:
    """R1 as a scalar: all payments of the source table, whatever the scope."""
    return star.tables.order_payments.agg(total("payment_value")).scalar()


def seller_count(star: Star) -> Column:
    """Distinct sellers in scope as a scalar.

    Only the order and the seller of each item travel to the semi-join.
    """
    return star.scoped(star.items().select("order_id", "seller_id")).agg(
        F.count_distinct("seller_id")
    ).scalar()


def customer_count(star: Star) -> Column:
    """Distinct customers in scope as a scalar."""
    return star.orders(customer=True).agg(F.count_distinct(CUSTOMER)).scalar()


def exec_kpis(star: Star, revenue: str = "source") -> DataFrame:
    """Revenue, orders, customers, sellers and average order value.

    ``revenue='source'`` is R1, ``'fanned'`` is R2.
    """
    base = star.orders(customer=True).agg(
        total("revenue").alias("fanned"),
        F.count(F.lit(1)).alias("total_orders"),
        F.count_distinct(CUSTOMER).alias("total_customers"),
    )
    amount = F.col("fanned") if revenue == "fanned" else source_revenue(star)
    return base.select(
        amount.alias("total_revenue"),
        "total_orders",
        "total_customers",
        seller_count(star).alias("total_sellers"),
    ).withColumn("avg_order_value", safe_div("total_revenue", "total_orders"))


def revenue_per_customer(star: Star) -> DataFrame:
    """Fanned revenue (R2) per customer."""
    return star.orders(customer=True).agg(
        total("revenue").alias("total_revenue"), F.count_distinct(CUSTOMER).alias("total_customers")
    ).withColumn("revenue_per_customer", ratio("total_revenue", "total_customers"))


def revenue_per_seller(star: Star) -> DataFrame:
    """Fanned revenue (R2) per active seller."""
    return (
        star.orders()
        .agg(total("revenue").alias("total_revenue"))
        .withColumn("total_sellers", seller_count(star))
        .withColumn("revenue_per_seller", ratio("total_revenue", "total_sellers"))
    )


def avg_review(star: Star) -> DataFrame:
    """Mean of one score per order, the first; 0 when nothing is scored."""
    first = F.col("first_score")
    return star.orders().agg(
        F.coalesce(F.try_divide(F.sum(first).cast("double"), F.count(first)), F.lit(0.0)).alias(
            "avg_review_score"
        ),
        F.count(first).alias("scored_orders"),
    )


def delivery_rate(star: Star) -> DataFrame:
    """Orders in status delivered as a share of all orders."""
    return star.orders().agg(
        count_when(F.col("order_status") == "delivered").alias("delivered_orders"),
        F.count(F.lit(1)).alias("total_orders"),
    ).withColumn("delivery_rate", percent("delivered_orders", "total_orders"))


def on_time_rate(star: Star, grain: str = "order", base: str = "delivered") -> DataFrame:
    """Share of on-time deliveries.

    ``grain`` counts ``'order'`` or joined ``'row'``; ``base`` divides by
    those ``'delivered'`` (with a date), in ``'status'`` delivered, or ``'all'``.
    """
    weight = F.lit(1) if grain == "order" else F.col("rows")
    of = {
        "delivered": F.col("order_delivered_customer_date").isNotNull(),
        "status": F.col("order_status") == "delivered",
        "all": F.lit(True),
    }[base]
    return star.orders().agg(
        count_total(F.when(F.col("on_time_delivery"), weight)).alias("on_time"),
        count_total(F.when(of, weight)).alias("base"),
    ).withColumn("on_time_rate", percent("on_time", "base"))


def executive_health(star: Star) -> DataFrame:
    """One row from one reading of the orders, equal to the operators named.

    ``avg_review_score`` (:func:`avg_review`), ``delivery_rate``,
    ``on_time_rate`` by order and ``row_on_time_rate`` by joined row, and
    ``top_state_pct``, the best state's revenue (R5) as a share of R1.  All are
    summed per state first, a few dozen rows.
    """
    first, rows = F.col("first_score"), F.col("rows")
    on_time, arrived = F.col("on_time_delivery"), F.col("order_delivered_customer_date").isNotNull()
    states = star.orders(customer=True).groupBy(STATE).agg(
        *part_sums("revenue", "revenue"),
        F.sum(first).alias("scores"),
        F.count(first).alias("scored"),
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("order_status") == "delivered").alias("delivered"),
        F.count_if(on_time).alias("on_time"),
        F.count_if(arrived).alias("arrived"),
        F.sum(F.when(on_time, rows)).alias("on_time_rows"),
        F.sum(F.when(arrived, rows)).alias("arrived_rows"),
    )
    sums = ("scored", "orders", "delivered", "on_time", "arrived", "on_time_rows", "arrived_rows")
    top = F.max(F.when(F.col(STATE).isNotNull(), merged_row("revenue"))).alias("top_revenue")
    return (
        states.agg(F.sum("scores").alias("scores"), *[count_total(c).alias(c) for c in sums], top)
        .withColumn("source_revenue", source_revenue(star))
        .select(
            F.coalesce(ratio("scores", "scored"), F.lit(0.0)).alias("avg_review_score"),
            percent("delivered", "orders").alias("delivery_rate"),
            percent("on_time", "arrived").alias("on_time_rate"),
            percent("on_time_rows", "arrived_rows").alias("row_on_time_rate"),
            (ratio("top_revenue", "source_revenue") * 100).alias("top_state_pct"),
        )
    )


def median_order_value(star: Star) -> DataFrame:
    """Median over orders of the fanned order revenue; unpaid orders count as 0."""
    value = star.orders().select(F.round(F.coalesce("revenue", F.lit(0.0)), 4).alias("revenue"))
    return quantiles(value, "revenue", {"median_order_value": 0.5}).select(
        F.col("n").alias("orders"), "median_order_value"
    )


def dataset_overview(star: Star) -> DataFrame:
    """Joined rows, orders, customers, sellers, products, dates and their span."""
    bought = F.col("order_purchase_timestamp")
    # Items become distinct pairs map-side; of these the first one of each seller and of each product is counted.
    sold = star.scoped(star.items().select("order_id", "seller_id", "product_id")).groupBy("seller_id", "product_id").count()

    def first(key: str, other: str) -> Column:
        return (F.row_number().over(Window.partitionBy(key).orderBy(other)) == 1) & F.col(key).isNotNull()

    marked = sold.withColumn("new_seller", first("seller_id", "product_id")).withColumn("new_product", first("product_id", "seller_id"))
    counts = marked.agg(F.struct(F.count_if("new_seller").alias("sellers"), F.count_if("new_product").alias("products"))).scalar()
    return (
        star.orders(customer=True)
        .agg(
            count_total("rows").alias("rows"),
            F.count(F.lit(1)).alias("orders"),
            F.count_distinct(CUSTOMER).alias("customers"),
            F.min(bought).alias("first"),
            F.max(bought).alias("last"),
        )
        .withColumn("sold", counts)
        .select(
            "rows",
            "orders",
            "customers",
            "sold.sellers",
            "sold.products",
            F.to_date("first").alias("first_date"),
            F.to_date("last").alias("last_date"),
            floor_days("last", "first").alias("span_days"),
        )
    )
