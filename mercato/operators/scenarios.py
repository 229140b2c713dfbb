"""Investment scenarios: four initiatives per department, their return and ROI.

Each takes its indicators from the data as one row and its assumptions as
plain numbers, which may be overridden by name.  The result has one row per
initiative and a last row with the totals.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import count_when, total
from mercato.operators import customers, portfolio
from mercato.operators.customers import RfmRules
from mercato.plans.star import CUSTOMER, Star

# Assumptions of the scenarios.
MARKETING = {
    "loyalty_investment": 500000,
    "loyalty_participation": 0.30,
    "loyalty_ltv_uplift": 1.8,
    "loyalty_cost_per_customer": 25,
    "expansion_investment": 300000,
    "expansion_states": 5,
    "expansion_customers_per_state": 2000,
    "expansion_ltv_factor": 0.85,
    "expansion_cac_reduction": 0.15,
    "acquisition_cost": 45,
    "platform_investment": 200000,
    "platform_recovery_rate": 0.20,
    "platform_ltv_boost": 0.15,
    "platform_savings": 50000,
    "retention_investment": 150000,
    "retention_conversion": 0.12,
    "retention_order_value": 85,
    "retention_campaigns": 12,
    "retention_cost": 2.5,
}
OPERATIONS = {
    "periods_per_year": 4,
    "centers_investment": 2000000,
    "centers_saving_per_order": 8.50,
    "centers_satisfaction_per_order": 2.5,
    "centers_savings": 800000,
    "automation_investment": 800000,
    "automation_labor_savings": 400000,
    "automation_cost_per_error": 1.80,
    "automation_error_reduction": 0.30,
    "automation_value_per_order": 0.50,
    "automation_throughput": 0.40,
    "automation_maintenance": 50000,
    "partners_investment": 200000,
    "partners_saving_per_order": 3.20,
    "partners_value_per_order": 1.20,
    "partners_reliability_pct": 10.0,
    "partners_management": 30000,
    "digital_investment": 300000,
    "digital_hours": 2.0,
    "digital_wage": 25.0,
    "digital_days": 250,
    "digital_headcount": 8,
    "digital_value_per_order": 0.75,
    "digital_maintenance": 40000,
}
INVENTORY = {
    "periods_per_year": 4,
    "rationalize_investment": 300000,
    "rationalize_share": 0.60,
    "rationalize_value_per_sku": 150.0,
    "rationalize_cost_savings": 0.25,
    "rationalize_space_share": 0.02,
    "rationalize_space_savings": 0.15,
    "quality_investment": 400000,
    "quality_retention_boost": 0.12,
    "quality_return_rate": 0.03,
    "quality_return_reduction": 0.40,
    "bundle_investment": 250000,
    "bundle_penetration": 0.15,
    "bundle_uplift": 1.35,
    "bundle_margin_premium": 0.18,
    "category_investment": 500000,
    "category_count": 3,
    "category_potential": 800000,
    "category_share": 0.05,
}
GROWTH = {
    "periods_per_year": 4,
    "states_investment": 1500000,
    "states_count": 5,
    "states_customers": 2000,
    "states_ltv": 165.0,
    "states_cost_per_customer": 35,
    "sellers_investment": 800000,
    "sellers_count": 150,
    "sellers_volume": 50000,
    "sellers_retention": 0.75,
    "sellers_commission": 0.08,
    "sellers_onboarding": 2500,
    "digital_investment": 600000,
    "digital_customers": 15000,
    "digital_order_value": 120,
    "digital_repeat": 0.30,
    "logistics_investment": 2000000,
    "logistics_cost_share": 0.12,
    "logistics_cost_reduction": 0.15,
    "logistics_value_per_customer": 15,
    "logistics_satisfaction": 0.18,
}


def _assume(defaults: Mapping[str, float], changes: Mapping[str, float] | None) -> dict[str, Column]:
    unknown = set(changes or {}) - set(defaults)
    if unknown:
        raise ValueError(f"unknown assumptions: {sorted(unknown)}")
    return {k: F.lit(float(v)) for k, v in {**defaults, **(changes or {})}.items()}


def _plan(kpis: DataFrame, initiatives: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """Rows ``position, initiative, timeline, investment, expected_return, roi_pct``."""

    def row(i: int, name: str, timeline: str | None, invested: Column, back: Column) -> Column:
        return F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("initiative"),
            F.lit(timeline).cast("string").alias("timeline"),
            invested.alias("investment"),
            back.alias("expected_return"),
            ((back - invested) / invested * 100).alias("roi_pct"),
        )

    rows = [row(i, *entry) for i, entry in enumerate(initiatives, 1)]
    invested = sum((e[2] for e in initiatives[1:]), initiatives[0][2])
    back = sum((e[3] for e in initiatives[1:]), initiatives[0][3])
    rows.append(row(len(rows) + 1, "Total", None, invested, back))
    return kpis.select(F.inline(F.array(*rows)))


def roi_marketing(
    star: Star, assumptions: Mapping[str, float] | None = None, rules: RfmRules = RfmRules()
) -> DataFrame:
    """Loyalty, expansion, segmentation and retention; lifetime value is R5 per customer."""
    a = _assume(MARKETING, assumptions)
    kpis = customers.rfm_segments(star, rules).agg(
        F.count(F.lit(1)).alias("customers"),
        (total("monetary") / F.count(F.lit(1))).alias("ltv"),
        count_when(F.col("segment") == "At Risk").alias("at_risk"),
    )
    people, ltv = F.col("customers"), F.col("ltv")
    members = F.floor(people * a["loyalty_participation"])
    newcomers = a["expansion_states"] * a["expansion_customers_per_state"]
    recovered = F.floor(F.col("at_risk") * a["platform_recovery_rate"])
    loyalty = (
        members * (ltv * (a["loyalty_ltv_uplift"] - 1))
        - members * a["loyalty_cost_per_customer"]
        + a["loyalty_investment"]
    )
    expansion = newcomers * (ltv * a["expansion_ltv_factor"]) - newcomers * a["acquisition_cost"] * (
        1 - a["expansion_cac_reduction"]
    )
    platform = recovered * ltv + people * ltv * a["platform_ltv_boost"] + a["platform_savings"]
    campaigns = people * a["retention_campaigns"] * (
        a["retention_conversion"] * a["retention_order_value"] - a["retention_cost"]
    )
    return _plan(
        kpis,
        [
            ("Loyalty Program", "6 months", a["loyalty_investment"], loyalty),
            ("Geographic Expansion", "4 months", a["expansion_investment"], expansion),
            ("Customer Segmentation Platform", "3 months", a["platform_investment"], platform),
            ("Retention Campaigns", "2 months", a["retention_investment"], campaigns),
        ],
    )


def roi_operations(star: Star, assumptions: Mapping[str, float] | None = None) -> DataFrame:
    """Distribution centers, automation, partnerships and digitization, by yearly orders."""
    a = _assume(OPERATIONS, assumptions)
    kpis = star.orders().agg(F.count(F.lit(1)).alias("orders"))
    yearly = F.col("orders") * a["periods_per_year"]
    centers = yearly * (a["centers_saving_per_order"] + a["centers_satisfaction_per_order"]) + a["centers_savings"]
    automation = (
        a["automation_labor_savings"]
        + yearly * a["automation_cost_per_error"] * a["automation_error_reduction"]
        + yearly * a["automation_value_per_order"] * a["automation_throughput"]
        - a["automation_maintenance"]
    )
    partners = (
        yearly * a["partners_saving_per_order"]
        + yearly * a["partners_value_per_order"] * (a["partners_reliability_pct"] / 100)
        - a["partners_management"]
    )
    digital = (
        a["digital_hours"] * a["digital_wage"] * a["digital_days"] * a["digital_headcount"]
        + yearly * a["digital_value_per_order"]
        - a["digital_maintenance"]
    )
    return _plan(
        kpis,
        [
            ("Regional Distribution Centers", "12 months", a["centers_investment"], centers),
            ("Warehouse Automation", "8 months", a["automation_investment"], automation),
            ("Logistics Partnership Optimization", "4 months", a["partners_investment"], partners),
            ("Process Digitization", "6 months", a["digital_investment"], digital),
        ],
    )


def roi_inventory(
    star: Star, assumptions: Mapping[str, float] | None = None, slow_below: int = 2
) -> DataFrame:
    """SKU rationalization, quality, bundles and new categories, by yearly revenue (R5)."""
    a = _assume(INVENTORY, assumptions)
    slow = portfolio.slow_movers(star, slow_below).select("slow_movers").scalar()
    kpis = star.orders().agg(total("revenue").alias("revenue")).withColumn("slow_movers", slow)
    yearly = F.col("revenue") * a["periods_per_year"]
    removed = F.floor(F.col("slow_movers") * a["rationalize_share"])
    rationalize = (
        removed * a["rationalize_value_per_sku"] * a["rationalize_cost_savings"]
        + yearly * a["rationalize_space_share"] * a["rationalize_space_savings"]
    )
    quality = yearly * a["quality_retention_boost"] + yearly * a["quality_return_rate"] * a["quality_return_reduction"]
    bundles = yearly * a["bundle_penetration"] * (a["bundle_uplift"] - 1) * (1 + a["bundle_margin_premium"])
    categories = a["category_count"] * a["category_potential"] * a["category_share"]
    return _plan(
        kpis,
        [
            ("SKU Rationalization Program", "6 months", a["rationalize_investment"], rationalize),
            ("Quality Improvement Initiative", "8 months", a["quality_investment"], quality),
            ("Product Bundle Strategy", "4 months", a["bundle_investment"], bundles),
            ("Category Expansion Plan", "12 months", a["category_investment"], categories),
        ],
    )


def roi_growth(star: Star, assumptions: Mapping[str, float] | None = None) -> DataFrame:
    """New states, seller network, digital marketing and logistics."""
    a = _assume(GROWTH, assumptions)
    kpis = star.orders(customer=True).agg(
        total("revenue").alias("revenue"),
        F.count_distinct(CUSTOMER).alias("customers"),
    )
    newcomers = a["states_count"] * a["states_customers"]
    states = newcomers * (a["states_ltv"] - a["states_cost_per_customer"])
    sellers = (
        a["sellers_count"] * a["sellers_volume"] * a["sellers_retention"] * a["sellers_commission"]
        - a["sellers_count"] * a["sellers_onboarding"]
    )
    digital = a["digital_customers"] * a["digital_order_value"] * (1 + a["digital_repeat"])
    logistics = (
        F.col("revenue") * a["periods_per_year"] * a["logistics_cost_share"] * a["logistics_cost_reduction"]
        + F.col("customers") * a["logistics_value_per_customer"] * a["logistics_satisfaction"]
    )
    return _plan(
        kpis,
        [
            ("State Expansion Program", "12 months", a["states_investment"], states),
            ("Seller Partnership Network", "8 months", a["sellers_investment"], sellers),
            ("Digital Marketing Campaigns", "6 months", a["digital_investment"], digital),
            ("Logistics Infrastructure", "18 months", a["logistics_investment"], logistics),
        ],
    )
