"""Delivery performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.columns import count_total, count_when, percent, ratio
from mercato.functions.stats import histogram, quantiles
from mercato.operators.revenue import top_k
from mercato.plans.star import STATE, Star, mean_over_rows, share_of_rows

ARRIVED = "order_delivered_customer_date"


def _arrived() -> Column:
    return F.col(ARRIVED).isNotNull()


def logistics_kpis(star: Star) -> DataFrame:
    """Delivery rate, mean days, on-time rate and mean positive delay.

    Rates count orders (on-time divides by orders in *status* delivered);
    means are over joined rows.
    """
    late = F.col("delivery_delay") > 0
    status = F.col("order_status") == "delivered"
    late_rows = F.sum(F.when(late, F.col("rows")))
    return star.orders().agg(
        count_when(status).alias("delivered_orders"),
        F.count(F.lit(1)).alias("total_orders"),
        mean_over_rows("delivery_time").alias("avg_delivery_time"),
        count_when(F.col("on_time_delivery")).alias("on_time_orders"),
        F.try_divide(
            F.sum(F.when(late, F.col("delivery_delay") * F.col("rows"))).cast("double"), late_rows
        ).alias("avg_delay"),
    ).select(
        "delivered_orders",
        "total_orders",
        percent("delivered_orders", "total_orders").alias("delivery_rate"),
        "avg_delivery_time",
        percent("on_time_orders", "delivered_orders").alias("on_time_rate"),
        "avg_delay",
    )


def status_flow(star: Star, n: int = 30) -> DataFrame:
    """The ``n`` strongest order-status to state links with node numbers.

    Nodes are numbered in order of first appearance, statuses before states.
    All windows run over the ``n`` kept links.
    """
    links = (
        star.orders(customer=True)
        .where(F.col("order_status").isNotNull() & F.col(STATE).isNotNull())
        .groupBy("order_status", STATE)
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    best_first = Window.orderBy(F.col("orders").desc(), "order_status", STATE)
    ranked = top_k(links, "orders", n, "order_status", STATE).withColumn("rank", F.row_number().over(best_first))
    seen = ranked.withColumn("status_seen", F.min("rank").over(Window.partitionBy("order_status"))).withColumn(
        "state_seen", F.min("rank").over(Window.partitionBy(STATE))
    )
    numbered = seen.withColumn("source", F.dense_rank().over(Window.orderBy("status_seen")) - 1)
    statuses = F.max("source").over(Window.partitionBy()) + 1
    return numbered.withColumn(
        "target", statuses + F.dense_rank().over(Window.orderBy("state_seen")) - 1
    ).select("rank", "order_status", STATE, "orders", "source", "target").orderBy("rank")


def flow_nodes(star: Star, n: int = 30) -> DataFrame:
    """The node table of :func:`status_flow`: ``node, label``."""
    ends = F.array(
        F.struct(F.col("source").alias("node"), F.col("order_status").alias("label")),
        F.struct(F.col("target").alias("node"), F.col(STATE).alias("label")),
    )
    return status_flow(star, n).select(F.inline(ends)).distinct().orderBy("node")


def status_dist(star: Star) -> DataFrame:
    """Orders by status."""
    return (
        star.orders()
        .where(F.col("order_status").isNotNull())
        .groupBy("order_status")
        .agg(F.count(F.lit(1)).alias("orders"))
        .orderBy("order_status")
    )


def delivery_histogram(star: Star, low: float = 0, high: float = 60, bins: int = 30) -> DataFrame:
    """Joined rows by delivery days within a fixed range."""
    return histogram(star.orders(), "delivery_time", bins, low, high, weight="rows")


def delivery_distribution(star: Star, bins: int = 20) -> DataFrame:
    """Joined rows by delivery days over the range seen."""
    return histogram(star.orders(), "delivery_time", bins, weight="rows")


def processing_distribution(star: Star, bins: int = 15) -> DataFrame:
    """Joined rows by processing days over the range seen."""
    return histogram(star.orders(), "processing_time", bins, weight="rows")


def fast_share(star: Star, days: int = 7) -> DataFrame:
    """Share of delivered joined rows that took at most ``days`` days."""
    known = F.col("delivery_time").isNotNull()
    fast = F.col("delivery_time") <= days
    return star.orders().agg(
        count_total(F.when(fast, F.col("rows"))).alias("fast_rows"),
        count_total(F.when(known, F.col("rows"))).alias("delivered_rows"),
    ).withColumn("fast_pct", percent("fast_rows", "delivered_rows"))


def processing_time(star: Star) -> DataFrame:
    """Mean days from approval to hand-over over joined rows."""
    return star.orders().agg(mean_over_rows("processing_time").alias("avg_processing_time"))


def fulfilment_time(star: Star) -> DataFrame:
    """Mean days from purchase to hand-over over joined rows."""
    return star.orders().agg(mean_over_rows("fulfilment_time").alias("avg_fulfilment_time"))


def state_delivery(star: Star, n: int | None = 15) -> DataFrame:
    """Mean days, on-time share and orders of delivered orders by state."""
    table = (
        star.orders(customer=True)
        .where(F.col("delivery_time").isNotNull() & F.col(STATE).isNotNull())
        .groupBy(STATE)
        .agg(
            mean_over_rows("delivery_time").alias("avg_delivery_time"),
            share_of_rows("on_time_delivery").alias("on_time_pct"),
            F.count(F.lit(1)).alias("orders"),
        )
    )
    return top_k(table, "orders", n, STATE)


def ops_kpis(star: Star, grain: str = "row") -> DataFrame:
    """Delivery, on-time and cancellation rates and mean days.

    With ``'row'``, as published, delivered joined rows are divided by orders,
    so the delivery rate may pass 100 %; ``'order'`` counts orders throughout.
    """
    weight = F.col("rows") if grain == "row" else F.lit(1)
    days = (
        mean_over_rows("delivery_time")
        if grain == "row"
        else F.try_divide(F.sum("delivery_time").cast("double"), F.count("delivery_time"))
    )
    return (
        star.orders()
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            count_total(F.when(_arrived(), weight)).alias("delivered"),
            count_total(F.when(_arrived() & F.col("on_time_delivery"), weight)).alias("on_time"),
            days.alias("avg_delivery_time"),
            count_when(F.col("order_status") == "canceled").alias("canceled_orders"),
        )
        .select(
            "total_orders",
            percent("delivered", "total_orders").alias("delivery_rate"),
            percent("on_time", "delivered").alias("on_time_rate"),
            "avg_delivery_time",
            percent("canceled_orders", "total_orders").alias("cancellation_rate"),
        )
    )


def state_performance(star: Star) -> DataFrame:
    """Mean days, on-time share and joined rows of delivered orders by state."""
    return (
        star.orders(customer=True)
        .where(_arrived() & F.col(STATE).isNotNull())
        .groupBy(STATE)
        .agg(
            mean_over_rows("delivery_time").alias("avg_delivery_time"),
            share_of_rows("on_time_delivery").alias("on_time_pct"),
            F.sum("rows").alias("volume"),
        )
    )


def problem_states(star: Star, on_time_below: float = 80.0, slower_by: float = 5.0) -> DataFrame:
    """States on time too rarely, or slower than the mean by some days."""
    mean = star.orders().where(_arrived()).agg(mean_over_rows("delivery_time")).scalar()
    slow = F.col("avg_delivery_time") > mean + slower_by
    return (
        state_performance(star)
        .where((F.col("on_time_pct") < on_time_below) | slow)
        .orderBy("on_time_pct", STATE)
    )


def hourly_rows(star: Star) -> DataFrame:
    """Joined rows by purchase hour."""
    return (
        star.orders()
        .where(F.col("order_hour").isNotNull())
        .groupBy("order_hour")
        .agg(F.sum("rows").alias("rows"))
        .orderBy("order_hour")
    )


def peak_hours(star: Star) -> DataFrame:
    """Busiest hour (the first on ties), its rows, mean of the other hours, their ratio."""
    return (
        hourly_rows(star)
        .agg(
            F.max_by("order_hour", F.struct("rows", -F.col("order_hour"))).alias("peak_hour"),
            F.max("rows").alias("peak_rows"),
            F.sum("rows").alias("all"),
            F.count(F.lit(1)).alias("hours"),
        )
        .withColumn("off_peak_avg", ratio(F.col("all") - F.col("peak_rows"), F.col("hours") - 1))
        .withColumn("peak_ratio", ratio("peak_rows", "off_peak_avg"))
        .select("peak_hour", "peak_rows", "off_peak_avg", "peak_ratio")
    )


def delivery_days(star: Star) -> DataFrame:
    """Joined rows per whole number of delivery days: a small table."""
    return (
        star.orders()
        .where(F.col("delivery_time").isNotNull())
        .groupBy("delivery_time")
        .agg(F.sum("rows").alias("rows"))
    )


def sla_stats(star: Star) -> DataFrame:
    """95th percentile, median and interquartile range of delivery days."""
    points = {"p95": 0.95, "median": 0.5, "q1": 0.25, "q3": 0.75}
    return quantiles(delivery_days(star), "delivery_time", points, weight="rows", levels=3).select(
        F.col("n").alias("rows"), "p95", "median", (F.col("q3") - F.col("q1")).alias("iqr")
    )


def spread_summary(star: Star, alpha: float = 0.05) -> DataFrame:
    """Centre and spread of delivery days: mean and sd if normal, else median and IQR.

    Normality is judged by Jarque-Bera, whose moments are taken around the
    mean on the table of distinct days; its p-value is exp(-JB / 2).
    """
    days = delivery_days(star)
    mean = days.agg(F.sum(F.col("delivery_time") * F.col("rows")).cast("double") / F.sum("rows")).scalar()
    order = sla_stats(star).select(F.struct("median", "iqr")).scalar()
    n = F.col("n").cast("double")
    m2, m3, m4 = (F.try_divide(F.col(f"s{i}"), n) for i in (2, 3, 4))
    skew = F.try_divide(m3, F.pow(m2, F.lit(1.5)))
    excess = F.try_divide(m4, m2 * m2) - 3
    return (
        days.withColumn("mean", mean)
        .selectExpr("rows", "mean", "delivery_time - mean AS off")
        .agg(
            F.sum("rows").alias("n"),
            F.max("mean").alias("mean"),
            *[F.expr(f"sum(rows * pow(off, {i}))").alias(f"s{i}") for i in (2, 3, 4)],
        )
        .select(
            "n",
            "mean",
            F.sqrt(F.try_divide(F.col("s2"), n - 1)).alias("sd"),
            (n / 6 * (skew * skew + excess * excess / 4)).alias("jarque_bera"),
        )
        .withColumn("p_value", F.exp(-F.col("jarque_bera") / 2))
        .withColumn("is_normal", F.col("p_value") >= alpha)
        .withColumn("robust", order)
        .selectExpr(
            "n",
            "jarque_bera",
            "p_value",
            "is_normal",
            "if(is_normal, mean, robust.median) AS center",
            "if(is_normal, sd, robust.iqr) AS spread",
        )
    )
