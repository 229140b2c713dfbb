"""Population-adjusted geography, market coverage and expansion.

Every operator takes ``pop``, a table ``state, population``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import count_when, ratio, total
from mercato.operators.kpi import customer_count, source_revenue
from mercato.operators.revenue import top_k
from mercato.plans.star import CUSTOMER, STATE, Star
from mercato.sources.population import with_population


def state_metrics(star: Star, pop: DataFrame) -> DataFrame:
    """Revenue (R5), orders, customers and population by state.

    States of unknown population are dropped.
    """
    return with_population(
        star.orders(customer=True)
        .where(F.col(STATE).isNotNull())
        .groupBy(F.col(STATE).alias("state"))
        .agg(
            total("revenue").alias("revenue"),
            F.count(F.lit(1)).alias("orders"),
            F.count_distinct(CUSTOMER).alias("customers"),
        ),
        pop,
        "state",
    ).where(F.col("population").isNotNull())


def per_capita(star: Star, pop: DataFrame, top: int | None = None, by: str = "revenue_per_capita") -> DataFrame:
    """State metrics per inhabitant and per 1000; ``top`` best by any column."""
    table = (
        state_metrics(star, pop)
        .withColumn("revenue_per_capita", ratio("revenue", "population"))
        .withColumn("orders_per_1000", ratio("orders", "population") * 1000)
    )
    return top_k(table, by, top, "state")


def penetration(star: Star, pop: DataFrame, per: int = 10_000, top: int | None = 10) -> DataFrame:
    """Customers per ``per`` inhabitants by state, best first.

    States of unknown population come last with a null rate.
    """
    customers = (
        star.orders(customer=True)
        .where(F.col(STATE).isNotNull())
        .groupBy(F.col(STATE).alias("state"))
        .agg(F.count_distinct(CUSTOMER).alias("customers"))
    )
    table = with_population(customers, pop, "state").withColumn(
        "penetration", ratio("customers", "population") * per
    )
    return top_k(table, "penetration", top, "state")


def low_penetration(star: Star, pop: DataFrame, per: int = 10_000, top: int | None = 10) -> DataFrame:
    """Of the ``top`` states, those below half of *their* mean penetration."""
    listed = penetration(star, pop, per, top)
    mean = listed.agg(F.avg("penetration")).scalar()
    return listed.where(F.col("penetration") < mean / 2)


def market_coverage(star: Star, pop: DataFrame, by: str = "penetration") -> DataFrame:
    """Coverage of the known states, mean penetration, top-3 concentration.

    ``by`` ranks the three states: by ``'penetration'``, the usual reading here,
    or by ``'customers'``.
    """
    states = penetration(star, pop, top=None)
    three = top_k(states, by, 3, "state").agg(F.sum("customers")).scalar()
    known = pop.agg(F.count(F.lit(1))).scalar()
    return (
        states.agg(
            F.count(F.lit(1)).alias("active_states"), F.avg("penetration").alias("avg_penetration")
        )
        .withColumn("total_states", known)
        .withColumn("coverage_pct", ratio("active_states", "total_states") * 100)
        .withColumn("top3_customers", three)
        .withColumn("total_customers", customer_count(star))
        .withColumn("concentration_pct", ratio("top3_customers", "total_customers") * 100)
    )


def active_states(star: Star) -> DataFrame:
    """Distinct states of the customers in scope."""
    bought = star.orders().select("customer_id").distinct()
    return (
        star.tables.customers.where(F.col(STATE).isNotNull())
        .join(bought, "customer_id", "left_semi")
        .select(F.col(STATE).alias("state"))
        .distinct()
    )


def untapped(star: Star, pop: DataFrame) -> DataFrame:
    """Known states without a customer."""
    return pop.join(active_states(star), "state", "left_anti").select("state", "population").orderBy("state")


def mean_penetration(star: Star, pop: DataFrame, per: int = 10_000) -> Column:
    """Mean over active states of customers per ``per`` inhabitants, as a scalar."""
    return penetration(star, pop, per, top=None).agg(F.avg("penetration")).scalar()


def expansion(star: Star, pop: DataFrame, top: int | None = 10) -> DataFrame:
    """Customers each state lacks to reach the mean penetration, weighted by size."""
    table = penetration(star, pop, top=None).select("state", "customers")
    mean = mean_penetration(star, pop)
    gap = F.greatest(F.lit(0.0), mean / 10_000 * F.col("population") - F.col("current_customers"))
    scored = (
        pop.join(table, "state", "left")
        .select("state", "population", F.coalesce("customers", F.lit(0)).alias("current_customers"))
        .withColumn("gap", gap)
        .select(
            "state",
            "current_customers",
            F.floor("gap").cast("bigint").alias("potential_customers"),
            "population",
            (F.col("gap") * (F.col("population") / 1_000_000)).alias("opportunity_score"),
        )
    )
    return top_k(scored, "opportunity_score", top, "state")


def expansion_value(star: Star, pop: DataFrame, top: int | None = 10) -> DataFrame:
    """Potential customers of the ``top`` states and their worth at R1 per customer."""
    return (
        expansion(star, pop, top)
        .agg(F.sum("potential_customers").alias("total_opportunity"))
        .withColumn("revenue_per_customer", ratio(source_revenue(star), customer_count(star)))
        .withColumn("revenue_opportunity", F.col("total_opportunity") * F.col("revenue_per_customer"))
    )


def supply_demand(star: Star, how: str = "full") -> DataFrame:
    """Sellers and orders by state and their ratio.

    ``'full'`` keeps every state with zeros filled in (no orders but sellers
    gives infinity); ``'inner'`` keeps states having both.
    """
    sold = star.scoped(star.items().select("order_id", "seller_id")).select("seller_id").distinct()
    supply = (
        star.tables.sellers.where(F.col("seller_state").isNotNull())
        .join(sold, "seller_id", "left_semi")
        .groupBy(F.col("seller_state").alias("state"))
        .agg(F.count(F.lit(1)).alias("sellers"))
    )
    demand = (
        star.orders(customer=True)
        .where(F.col(STATE).isNotNull())
        .groupBy(F.col(STATE).alias("state"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    filled = supply.join(demand, "state", how).select(
        "state",
        F.coalesce("sellers", F.lit(0)).alias("sellers"),
        F.coalesce("orders", F.lit(0)).alias("orders"),
    )
    no_orders = F.when(F.col("sellers") == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    return filled.withColumn(
        "supply_demand_ratio",
        F.when(F.col("orders") == 0, no_orders).otherwise(ratio("sellers", "orders")),
    ).orderBy("state")


def imbalanced_states(star: Star, ratio_below: float = 0.001, orders_above: int = 100) -> DataFrame:
    """States with high demand and low supply."""
    return (
        supply_demand(star)
        .where((F.col("supply_demand_ratio") < ratio_below) & (F.col("orders") > orders_above))
        .orderBy(F.col("orders").desc(), "state")
    )


def high_potential(star: Star, pop: DataFrame, min_population: int = 5_000_000) -> DataFrame:
    """Populous states below the mean penetration."""
    return penetration(star, pop, top=None).where(
        (F.col("population") > min_population) & (F.col("penetration") < mean_penetration(star, pop))
    )


def market_maturity(
    star: Star,
    pop: DataFrame,
    mature: float = 1.2,
    emerging: float = 0.8,
    min_population: int = 1_000_000,
) -> DataFrame:
    """Numbers of mature, emerging and untapped states."""
    rate, mean = F.col("penetration"), F.col("mean")
    missing = untapped(star, pop).agg(F.count(F.lit(1))).scalar()
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("market"), F.col(c).alias("states"))
            for name, c in (
                ("Mature Markets", "mature"),
                ("Emerging Markets", "emerging"),
                ("Untapped Markets", "untapped"),
            )
        ]
    )
    return (
        penetration(star, pop, top=None)
        .withColumn("mean", mean_penetration(star, pop))
        .agg(
            count_when(rate > mean * mature).alias("mature"),
            count_when((rate < mean * emerging) & (F.col("population") > min_population)).alias("emerging"),
        )
        .withColumn("untapped", missing)
        .select(F.inline(rows))
    )


def _expected(star: Star, pop: DataFrame) -> DataFrame:
    table = state_metrics(star, pop).select("state", "revenue", "population")
    national = table.agg(ratio(total("revenue"), F.sum("population"))).scalar()
    return table.withColumn("expected_revenue", F.col("population") * national)


def opportunity_rel(star: Star, pop: DataFrame) -> DataFrame:
    """Shortfall against the revenue expected from population, as a share of it.

    Expected revenue is population x (all revenue / all population) of the
    listed states (R5).
    """
    e = F.col("expected_revenue")
    return _expected(star, pop).withColumn("opportunity_score", ratio(e - F.col("revenue"), e)).orderBy("state")


def opportunity_abs(star: Star, pop: DataFrame) -> DataFrame:
    """Share of expected revenue reached, and the amount not reached (R5)."""
    return (
        _expected(star, pop)
        .withColumn("penetration_rate", ratio("revenue", "expected_revenue"))
        .withColumn("opportunity_score", (1 - F.col("penetration_rate")) * F.col("expected_revenue"))
        .orderBy("state")
    )


def bias_reduction(star: Star, pop: DataFrame) -> DataFrame:
    """Correlation of revenue with population before and after the per-capita step."""
    raw, adjusted = F.col("raw_correlation"), F.col("adjusted_correlation")
    return (
        per_capita(star, pop)
        .agg(
            F.corr("population", "revenue").alias("raw_correlation"),
            F.corr("population", "revenue_per_capita").alias("adjusted_correlation"),
        )
        .withColumn("bias_reduction", F.abs(raw) - F.abs(adjusted))
        .withColumn("effectiveness_pct", ratio("bias_reduction", F.abs(raw)) * 100)
        .withColumn("reduced", F.col("bias_reduction") > 0)
    )
