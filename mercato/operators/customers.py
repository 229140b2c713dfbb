"""Customer behaviour: repeat rate, NPS, cohorts, value segments, RFM, CLV."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.columns import (
    count_total,
    count_when,
    cut,
    floor_days,
    month_label,
    months_between_labels,
    nps_band,
    percent,
    ratio,
    total,
)
from mercato.functions.stats import qcut
from mercato.operators.kpi import source_revenue
from mercato.operators.revenue import top_k
from mercato.plans.star import CUSTOMER, STATE, Star, join_orders, mean_score

# Names and edges of the customer value classes.
VALUE_LABELS = ("Low", "Medium", "High", "VIP")
VALUE_EDGES = (0, 100, 500, 1000, float("inf"))
# Bins of the days until the second purchase.
SECOND_PURCHASE_EDGES = (0, 30, 60, 90, 180, 365, float("inf"))
SECOND_PURCHASE_LABELS = (
    "0-30 days", "31-60 days", "61-90 days", "91-180 days", "181-365 days", "365+ days",
)
# Names of the review scores.
REVIEW_CLASSES = {
    5: "Excellent (5 stars)",
    4: "Good (4 stars)",
    3: "Average (3 stars)",
    2: "Poor (2 stars)",
    1: "Terrible (1 star)",
}
ACQUISITION_COST = 45.0
Z_95 = 1.959964


def by_customer(star: Star, key: str = CUSTOMER) -> DataFrame:
    """One row per customer: frequency, monetary (R5), rows, first and last purchase.

    The table most customer operators start from; null customers are dropped.
    """
    bought = "order_purchase_timestamp"
    return (
        star.orders(customer=key in (CUSTOMER, STATE))
        .where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("frequency"),
            total("revenue").alias("monetary"),
            F.sum("rows").alias("rows"),
            F.min(bought).alias("first_purchase"),
            F.max(bought).alias("last_purchase"),
        )
    )


def customer_kpis(star: Star) -> DataFrame:
    """Customers and the mean review score over joined rows."""
    return star.orders(customer=True).agg(
        F.count_distinct(CUSTOMER).alias("total_customers"),
        F.coalesce(mean_score(), F.lit(0.0)).alias("avg_review"),
    )


def repeat_rate(star: Star) -> DataFrame:
    """Customers with more than one order, and their share."""
    return by_customer(star).agg(
        F.count(F.lit(1)).alias("total_customers"),
        count_when(F.col("frequency") > 1).alias("repeat_customers"),
    ).withColumn("repeat_rate", percent("repeat_customers", "total_customers"))


# --- reviews ------------------------------------------------------------------


def nps(star: Star, basis: str = "order") -> DataFrame:
    """Net promoter score (4-5 promote, 1-2 detract) with its band.

    ``'order'`` counts orders having any such review, so an order with two
    reviews may count on both sides; ``'first'`` one score per order;
    ``'row'`` joined rows.
    """
    orders, first = star.orders(), F.col("first_score")
    if basis == "order":
        sides = (
            count_when(F.col("promoters") > 0),
            count_when(F.col("detractors") > 0),
            count_when(F.col("score_count") > 0),
        )
    elif basis == "first":
        sides = (count_when(first >= 4), count_when(first <= 2), F.count(first))
    elif basis == "row":
        sides = tuple(count_total(c) for c in ("promoter_rows", "detractor_rows", "scored"))
    else:
        raise ValueError(f"unknown basis {basis!r}")
    names = ("promoters", "detractors", "total_reviews")
    return (
        orders.agg(*[s.alias(n) for s, n in zip(sides, names)])
        .withColumn("nps", percent(F.col("promoters") - F.col("detractors"), "total_reviews"))
        .withColumn("band", nps_band("nps"))
    )


def nps_ci(star: Star) -> DataFrame:
    """Row-level NPS with 95 % bounds.

    ``ci_low``/``ci_high`` use the published formula, se = sqrt((p + d) / n),
    which lacks the division by n; ``sampling_*`` use the standard error of
    the mean of a +1/0/-1 variable.
    """
    p, d, n = (F.col(c).cast("double") for c in ("promoters", "detractors", "total_reviews"))
    score = F.col("nps")
    net = F.try_divide(p - d, n)
    written = F.sqrt(F.try_divide(p + d, n)) * 100
    sampling = F.sqrt(F.try_divide(F.try_divide(p + d, n) - net * net, n)) * 100
    return nps(star, "row").select(
        "nps",
        written.alias("se"),
        (score - written * Z_95).alias("ci_low"),
        (score + written * Z_95).alias("ci_high"),
        sampling.alias("sampling_se"),
        (score - sampling * Z_95).alias("sampling_low"),
        (score + sampling * Z_95).alias("sampling_high"),
    )


def review_dist(star: Star) -> DataFrame:
    """Orders having each review score."""
    scored = (
        star.tables.order_reviews.where(F.col("review_score").isNotNull())
        .select("order_id", "review_score")
        .distinct()
    )
    return star.scoped(scored).groupBy("review_score").agg(F.count(F.lit(1)).alias("orders")).orderBy(
        "review_score"
    )


def review_classes(star: Star) -> DataFrame:
    """Joined rows by named review score."""
    weights = star.orders().select("order_id", (F.col("item_rows") * F.col("pay_rows")).alias("times"))
    names = F.create_map(*[F.lit(x) for pair in REVIEW_CLASSES.items() for x in pair])
    return (
        join_orders(star.tables.order_reviews.where(F.col("review_score").isin(list(REVIEW_CLASSES))), weights)
        .groupBy("review_score")
        .agg(F.sum("times").alias("rows"))
        .select("review_score", F.try_element_at(names, "review_score").alias("class"), "rows")
        .orderBy(F.col("review_score").desc())
    )


# --- cohorts ------------------------------------------------------------------


def cohorts(star: Star, grain: str = "month", key: str = CUSTOMER) -> DataFrame:
    """Customers by first purchase period and periods since: ``cohort, cohort_index, customers``.

    Orders are first reduced to distinct (customer, period) pairs, so the
    per-customer window sees at most one row per period however many orders a
    customer has.
    """
    bought = F.col("order_purchase_timestamp")
    period = month_label(bought) if grain == "month" else F.to_date(bought)
    active = (
        star.orders(customer=key in (CUSTOMER, STATE))
        .select(key, period.alias("period"))
        .where(F.col(key).isNotNull() & F.col("period").isNotNull())
        .distinct()
        .withColumn("cohort", F.min("period").over(Window.partitionBy(key)))
    )
    since = months_between_labels("period", "cohort") if grain == "month" else F.datediff("period", "cohort")
    return (
        active.groupBy("cohort", since.alias("cohort_index"))
        .agg(F.count(F.lit(1)).alias("customers"))
        .orderBy("cohort", "cohort_index")
    )


def retention(star: Star, grain: str = "month", key: str = CUSTOMER) -> DataFrame:
    """Cohort counts in long form with the share of the cohort still active."""
    first = Window.partitionBy("cohort").orderBy("cohort_index")
    size = F.first("customers").over(first)
    return cohorts(star, grain, key).select(
        "cohort",
        "cohort_index",
        "customers",
        size.alias("cohort_size"),
        (ratio("customers", size) * 100).alias("retention_pct"),
    )


def retention_matrix(star: Star, indexes: Sequence[int] | None = None) -> DataFrame:
    """Retention with one column per cohort index, ``m0, m1, ...``.

    Without ``indexes`` Spark first looks up which exist (one per month of data).
    """
    long = retention(star).withColumn("column", F.concat(F.lit("m"), F.col("cohort_index").cast("string")))
    names = None if indexes is None else [f"m{i}" for i in indexes]
    return long.groupBy("cohort").pivot("column", names).agg(F.first("retention_pct")).orderBy("cohort")


# --- value --------------------------------------------------------------------


def value_quartiles(star: Star) -> DataFrame:
    """Customers per spending quartile (R5)."""
    return (
        qcut(by_customer(star).select(CUSTOMER, "monetary"), "monetary", VALUE_LABELS, "segment", ordinal="level")
        .groupBy("level", "segment")
        .agg(F.count(F.lit(1)).alias("customers"))
        .orderBy("level")
    )


def value_bands(star: Star, edges: Sequence[float] = VALUE_EDGES, key: str = "customer_id") -> DataFrame:
    """Customers per fixed spending band (R5); spending outside the edges is left out."""
    level = cut("monetary", edges, range(len(edges) - 1))
    return (
        by_customer(star, key)
        .select(level.alias("level"), cut("monetary", edges, VALUE_LABELS).alias("segment"))
        .where(F.col("level").isNotNull())
        .groupBy("level", "segment")
        .agg(F.count(F.lit(1)).alias("customers"))
        .orderBy("level")
    )


def customers_by_state(star: Star, n: int | None = 15) -> DataFrame:
    """States with most customers."""
    counts = (
        star.orders(customer=True)
        .where(F.col(STATE).isNotNull())
        .groupBy(STATE)
        .agg(F.count_distinct(CUSTOMER).alias("customers"))
    )
    return top_k(counts, "customers", n, STATE)


def ltv(star: Star) -> DataFrame:
    """Mean revenue per customer (R5) and mean payment (R1)."""
    payment = star.tables.order_payments.agg(
        ratio(total("payment_value"), F.count("payment_value"))
    ).scalar()
    return by_customer(star).agg(
        ratio(total("monetary"), F.count(F.lit(1))).alias("avg_ltv")
    ).withColumn("avg_payment", payment)


def ltv_cac(star: Star, cac: float = ACQUISITION_COST) -> DataFrame:
    """Lifetime value over acquisition cost, and its status at 3 and 5."""
    r = F.col("ltv_cac")
    status = F.when(r < 3, "Below target").when(r < 5, "Good performance").otherwise("Excellent performance")
    return (
        ltv(star)
        .select("avg_ltv", F.lit(float(cac)).alias("cac"))
        .withColumn("ltv_cac", ratio("avg_ltv", "cac"))
        .withColumn("status", status)
    )


# --- RFM ----------------------------------------------------------------------


@dataclass(frozen=True)
class RfmRules:
    """Thresholds of the segment rules, applied in this order."""

    champion_frequency: int = 3
    champion_monetary: float = 500.0
    loyal_frequency: int = 2
    loyal_recency: int = 60
    potential_monetary: float = 300.0
    potential_recency: int = 90
    at_risk_recency: int = 180


def rfm(star: Star) -> DataFrame:
    """Recency, frequency and monetary value (R5) per customer.

    Recency counts back from the newest purchase of any customer.
    """
    newest = (
        star.orders(customer=True)
        .where(F.col(CUSTOMER).isNotNull())
        .agg(F.max("order_purchase_timestamp"))
        .scalar()
    )
    return by_customer(star).select(
        CUSTOMER,
        "frequency",
        "monetary",
        "last_purchase",
        floor_days(newest, "last_purchase").alias("recency_days"),
    )


def rfm_segments(star: Star, rules: RfmRules = RfmRules()) -> DataFrame:
    """RFM with the segment of each customer."""
    f, m, r = F.col("frequency"), F.col("monetary"), F.col("recency_days")
    segment = (
        F.when((f >= rules.champion_frequency) & (m > rules.champion_monetary), "Champions")
        .when((f >= rules.loyal_frequency) & (r < rules.loyal_recency), "Loyal Customers")
        .when((m > rules.potential_monetary) & (r < rules.potential_recency), "Potential Loyalists")
        .when(r > rules.at_risk_recency, "At Risk")
        .when(f == 1, "New Customers")
        .otherwise("Need Attention")
    )
    return rfm(star).withColumn("segment", segment)


def segment_counts(star: Star, rules: RfmRules = RfmRules()) -> DataFrame:
    """Customers and share per RFM segment."""
    return (
        rfm_segments(star, rules)
        .groupBy("segment")
        .agg(F.count(F.lit(1)).alias("customers"))
        .withColumn("share_pct", ratio("customers", F.sum("customers").over(Window.partitionBy())) * 100)
        .orderBy(F.col("customers").desc(), "segment")
    )


# --- second purchase ----------------------------------------------------------


def time_to_second(star: Star, grain: str = "row") -> DataFrame:
    """Days between the first and second purchase of each repeat customer.

    ``'row'`` counts joined rows, so a first order with two items, payments or
    reviews gives 0 days; ``'order'`` counts orders.  The two earliest orders
    per customer are picked by a row-number limit, which Spark applies in
    every task before the shuffle, so a customer with very many orders sends
    two rows per task.
    """
    bought = "order_purchase_timestamp"
    earliest = Window.partitionBy(CUSTOMER).orderBy(bought, "order_id")
    two = (
        star.orders(customer=True)
        .where(F.col(CUSTOMER).isNotNull() & F.col(bought).isNotNull())
        .select(CUSTOMER, "order_id", bought, "rows")
        .withColumn("nth", F.row_number().over(earliest))
        .where(F.col("nth") <= 2)
    )

    def nth(i: int, c: str) -> Column:
        return F.max(F.when(F.col("nth") == i, F.col(c)))

    pairs = two.groupBy(CUSTOMER).agg(
        nth(1, bought).alias("first"), nth(2, bought).alias("second"), nth(1, "rows").alias("first_rows")
    )
    if grain == "row":
        again = F.when(F.col("first_rows") > 1, F.col("first")).otherwise(F.col("second"))
        pairs = pairs.withColumn("second", again)
    return pairs.where(F.col("second").isNotNull()).select(
        CUSTOMER, floor_days("second", "first").alias("days_to_second")
    )


def second_purchase_bins(star: Star, grain: str = "row") -> DataFrame:
    """Repeat customers per bin of days to the second purchase."""
    edges, labels = SECOND_PURCHASE_EDGES, SECOND_PURCHASE_LABELS
    days = "days_to_second"
    return (
        time_to_second(star, grain)
        .groupBy(
            cut(days, edges, range(len(labels)), include_lowest=True).alias("level"),
            cut(days, edges, labels, include_lowest=True).alias("bin"),
        )
        .agg(F.count(F.lit(1)).alias("customers"))
        .orderBy("level")
    )


def second_purchase_summary(star: Star, grain: str = "row", quick: int = 30) -> DataFrame:
    """Repeat customers, mean days to the second purchase, share within ``quick`` days."""
    days = F.col("days_to_second")
    return time_to_second(star, grain).agg(
        F.count(F.lit(1)).alias("repeat_customers"),
        F.try_divide(F.sum(days).cast("double"), F.count(days)).alias("avg_days"),
        count_when(days <= quick).alias("quick_customers"),
    ).withColumn("quick_pct", percent("quick_customers", "repeat_customers"))


# --- lifetime value and acquisition -------------------------------------------


def clv(star: Star, retention_rate: float, key: str = "customer_id") -> DataFrame:
    """Monetary (R5) x frequency x retention per customer, with first and last purchase."""
    return by_customer(star, key).select(
        key,
        "monetary",
        "frequency",
        "first_purchase",
        "last_purchase",
        (F.col("monetary") * F.col("frequency") * float(retention_rate)).alias("clv"),
    )


def clv_span(star: Star, key: str = "customer_id", unit_days: float = 365.0) -> DataFrame:
    """Average order value x frequency x lifespan per customer.

    The lifespan runs from first to last purchase, in units of ``unit_days``.
    """
    lifespan = floor_days("last_purchase", "first_purchase") / F.lit(float(unit_days))
    return (
        by_customer(star, key)
        .select(
            key,
            ratio("monetary", "frequency").alias("avg_order_value"),
            "frequency",
            lifespan.alias("lifespan"),
        )
        .withColumn("clv", F.col("avg_order_value") * F.col("frequency") * F.col("lifespan"))
    )


def ltv_simple(star: Star) -> DataFrame:
    """Average order value (R1) x orders per customer."""
    return (
        star.orders(customer=True)
        .agg(F.count(F.lit(1)).alias("total_orders"), F.count_distinct(CUSTOMER).alias("total_customers"))
        .withColumn("avg_order_value", ratio(source_revenue(star), "total_orders"))
        .withColumn("orders_per_customer", ratio("total_orders", "total_customers"))
        .withColumn("ltv", F.col("avg_order_value") * F.col("orders_per_customer"))
    )


def cac(star: Star, spend: DataFrame) -> DataFrame:
    """Acquisition cost by month: ``spend`` (``month, spend``) / customers first seen then."""
    first = (
        star.orders(customer=True)
        .where(F.col(CUSTOMER).isNotNull())
        .groupBy(CUSTOMER)
        .agg(month_label(F.min("order_purchase_timestamp")).alias("month"))
        .groupBy("month")
        .agg(F.count(F.lit(1)).alias("new_customers"))
    )
    return first.join(spend.select("month", "spend"), "month").select(
        "month", "new_customers", "spend", ratio("spend", "new_customers").alias("cac")
    ).orderBy("month")
