"""Threshold alerts: a metric table matched with a rule table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.operators import customers, geo, kpi, logistics, portfolio, revenue
from mercato.operators.customers import RfmRules
from mercato.plans.star import Star
from mercato.sources.inline import inline_table

INF = float("inf")

# Page, metric, lowest value (closed), highest value (open),
# level, alert.  The bands of one metric on one page do not overlap.
RULES = (
    ("executive", "avg_review_score", -INF, 4.0, "critical", "satisfaction_below_target"),
    ("executive", "on_time_rate", -INF, 85.0, "critical", "delivery_below_sla"),
    ("executive", "delivery_rate", -INF, 95.0, "warning", "fulfilment_rate_issues"),
    ("executive", "last_growth_pct", -INF, 0.0, "critical", "revenue_declining"),
    ("executive", "last_growth_pct", 0.0, 5.0, "warning", "growth_slowing"),
    ("executive", "last_growth_pct", 5.0, INF, "good", "strong_growth"),
    ("segments", "repeat_rate", -INF, 25.0, "critical", "few_repeat_customers"),
    ("delivery", "row_on_time_rate", -INF, 85.0, "critical", "sla_breach"),
    ("delivery", "row_on_time_rate", 85.0, 90.0, "warning", "improving"),
    ("delivery", "row_on_time_rate", 90.0, INF, "good", "excellent"),
    ("marketing", "repeat_rate", -INF, 30.0, "critical", "loyalty_crisis"),
    ("marketing", "ltv_cac", -INF, 3.0, "warning", "acquisition_inefficient"),
    ("marketing", "champion_pct", -INF, 5.0, "warning", "few_champions"),
    ("operations", "row_on_time_rate", -INF, 85.0, "critical", "sla_breach"),
    ("portfolio", "avg_product_rating", -INF, 4.0, "warning", "quality_concern"),
    ("portfolio", "cross_sell_rate", -INF, 25.0, "warning", "bundle_potential"),
    ("operations", "fast_pct", -INF, 50.0, "action", "target_fast_delivery"),
    ("overview", "row_on_time_rate", -INF, 85.0, "critical", "delivery_sla_issue"),
    ("overview", "avg_review_score", -INF, 4.0, "warning", "satisfaction_below_target"),
    ("overview", "operations_healthy", 1.0, INF, "good", "operations_healthy"),
)
# The same, firing above an open lower limit.
RULES_ABOVE = (
    ("executive", "top_state_pct", 40.0, "warning", "single_state_risk"),
    ("finance", "dominant_payment_pct", 70.0, "critical", "payment_dependency"),
    ("finance", "low_margin_categories", 0.0, "warning", "low_margin_categories"),
    ("marketing", "at_risk_pct", 25.0, "critical", "churn_risk"),
    ("marketing", "avg_days_to_second", 90.0, "warning", "slow_second_purchase"),
    ("marketing", "low_penetration_states", 0.0, "info", "under_penetrated_states"),
    ("operations", "cancellation_rate", 5.0, "warning", "high_cancellations"),
    ("operations", "avg_delivery_time", 15.0, "warning", "slow_delivery"),
    ("operations", "problem_states", 0.0, "critical", "states_below_target"),
    ("operations", "avg_processing_time", 3.0, "warning", "warehouse_bottleneck"),
    ("portfolio", "slow_pct", 30.0, "critical", "inventory_risk"),
    ("portfolio", "dog_categories", 5.0, "warning", "underperforming_categories"),
    ("portfolio", "low_quality_categories", 0.0, "critical", "low_quality_categories"),
    ("portfolio", "high_quality_categories", 0.0, "action", "promote_high_quality"),
    ("growth", "untapped_states", 5.0, "info", "untapped_states"),
    ("growth", "concentration_pct", 60.0, "warning", "geographic_concentration"),
    ("growth", "high_potential_states", 0.0, "info", "high_potential_states"),
    ("growth", "imbalanced_states", 0.0, "critical", "supply_gap"),
    ("growth", "emerging_states", 5.0, "info", "emerging_markets"),
)
RULE_COLUMNS = {
    "page": "string",
    "metric": "string",
    "low": "double",
    "low_open": "boolean",
    "high": "double",
    "level": "string",
    "alert": "string",
}


def default_rules(spark: SparkSession) -> DataFrame:
    """The usual thresholds as a rule table; a null limit leaves that side open."""

    def limit(x: float) -> float | None:
        return None if x in (INF, -INF) else x

    closed = [(p, m, limit(lo), False, limit(hi), lv, a) for p, m, lo, hi, lv, a in RULES]
    above = [(p, m, lo, True, None, lv, a) for p, m, lo, lv, a in RULES_ABOVE]
    return inline_table(spark, RULE_COLUMNS, closed + above)


def alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts that fire: ``page, metric, value, level, alert``.

    A rule fires when its band holds the value; a metric without a value
    fires nothing.  Both tables are a few dozen rows.
    """
    v, low, high = F.col("value"), F.col("low"), F.col("high")
    above = low.isNull() | F.when(F.col("low_open"), v > low).otherwise(v >= low)
    below = high.isNull() | (v < high)
    return (
        metrics.join(rules, "metric")
        .where(v.isNotNull() & above & below)
        .select("page", "metric", "value", "level", "alert")
        .orderBy("page", "metric", "alert")
    )


def _long(row: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row of indicators as ``metric, value`` rows."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value"))
            for c, name in names.items()
        ]
    )
    return row.select(F.inline(pairs))


def _size(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def executive_metrics(star: Star) -> DataFrame:
    """Metrics of the executive page and of the overview panel; the orders are read once for all but the growth."""
    fine = (F.col("row_on_time_rate") >= 90) & (F.col("avg_review_score") >= 4.2)
    names = ("avg_review_score", "row_on_time_rate", "operations_healthy", "on_time_rate", "delivery_rate", "top_state_pct")
    return _union(
        _long(kpi.executive_health(star).withColumn("operations_healthy", fine.cast("int")), dict(zip(names, names))),
        _long(revenue.last_growth(star), {"growth_pct": "last_growth_pct"}),
    )


def finance_metrics(star: Star) -> DataFrame:
    """Metrics of the finance page."""
    return _union(
        _long(revenue.payment_leaders(star.tables), {"dominant_pct": "dominant_payment_pct"}),
        _long(revenue.low_margin_count(star), {"low_margin": "low_margin_categories"}),
    )


def marketing_metrics(star: Star, pop: DataFrame, rules: RfmRules = RfmRules()) -> DataFrame:
    """Metrics of the marketing page."""
    shares = customers.segment_counts(star, rules).agg(
        *[
            F.max(F.when(F.col("segment") == name, F.col("share_pct"))).alias(out)
            for name, out in (("At Risk", "at_risk"), ("Champions", "champion"))
        ]
    )
    return _union(
        _long(customers.repeat_rate(star), {"repeat_rate": "repeat_rate"}),
        _long(customers.ltv_cac(star), {"ltv_cac": "ltv_cac"}),
        _long(shares, {"at_risk": "at_risk_pct", "champion": "champion_pct"}),
        _long(customers.second_purchase_summary(star), {"avg_days": "avg_days_to_second"}),
        _long(_size(geo.low_penetration(star, pop)), {"n": "low_penetration_states"}),
    )


def operations_metrics(star: Star) -> DataFrame:
    """Metrics of the operations page; its on-time rate is in the executive set."""
    return _union(
        _long(
            logistics.ops_kpis(star),
            {"cancellation_rate": "cancellation_rate", "avg_delivery_time": "avg_delivery_time"},
        ),
        _long(_size(logistics.problem_states(star)), {"n": "problem_states"}),
        _long(logistics.fast_share(star), {"fast_pct": "fast_pct"}),
        _long(logistics.processing_time(star), {"avg_processing_time": "avg_processing_time"}),
    )


def portfolio_metrics(star: Star, slow_below: int = 2) -> DataFrame:
    """Metrics of the product page; the items are read once."""
    page = portfolio.portfolio_summary(star, slow_below)
    return _long(page, {c: c for c in page.columns})


def growth_metrics(star: Star, pop: DataFrame) -> DataFrame:
    """Metrics of the growth page."""
    markets = geo.market_maturity(star, pop).agg(
        *[
            F.max(F.when(F.col("market") == name, F.col("states"))).alias(out)
            for name, out in (("Emerging Markets", "emerging"), ("Untapped Markets", "untapped"))
        ]
    )
    return _union(
        _long(markets, {"emerging": "emerging_states", "untapped": "untapped_states"}),
        _long(geo.market_coverage(star, pop), {"concentration_pct": "concentration_pct"}),
        _long(_size(geo.high_potential(star, pop)), {"n": "high_potential_states"}),
        _long(_size(geo.imbalanced_states(star)), {"n": "imbalanced_states"}),
    )


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def all_metrics(star: Star, pop: DataFrame) -> DataFrame:
    """Every metric the default rules look at."""
    return _union(
        executive_metrics(star),
        finance_metrics(star),
        marketing_metrics(star, pop),
        operations_metrics(star),
        portfolio_metrics(star),
        growth_metrics(star, pop),
    )
