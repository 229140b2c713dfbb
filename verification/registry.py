"""Every operator as a query on the retail tables, with its SQL twin.

``QUERIES`` maps a name to ``(spark, directory) -> DataFrame`` and ``ORACLES``
the same name to SQL.  Both sides round doubles to four places and give dates as text and whole
numbers as bigint.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato import Star, configure, export_csv, load_subset, master, order_payments, products_en, sample_cap
from mercato.functions.columns import growth, safe_div, total
from mercato.operators import (
    alerts,
    customers,
    filters,
    geo,
    kpi,
    logistics,
    portfolio,
    quality,
    revenue,
    scenarios,
    sellers,
    trends,
)
from mercato.operators.customers import RfmRules
from mercato.plans.star import CATEGORY, STATE, scope_to
from mercato.sources.readers import read_table
from mercato.sources.retail import retail_population, retail_tables
from mercato.sources.schema import coerce_ts
from verification.sql import mean, money, n_orders, oracle, pct, quantile, r4

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Thresholds that separate customers and products at the size of the test data.
TEST_RULES = RfmRules(
    champion_frequency=13,
    champion_monetary=30_000_000.0,
    loyal_frequency=10,
    loyal_recency=60,
    potential_monetary=20_000_000.0,
    potential_recency=90,
    at_risk_recency=180,
)
SLOW_BELOW = 25
SOME_STATES = ("NATION_1", "NATION_2", "NATION_3", "NATION_5", "NATION_8")
SOME_CATEGORIES = ("cat_Brand#1", "cat_Brand#12", "cat_Brand#3")


class Source:
    """The retail tables of one directory, conformed on first use."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = configure(spark), directory

    @cached_property
    def t(self):
        return retail_tables(self.spark, self.directory)

    @cached_property
    def star(self) -> Star:
        return Star(self.t)

    @cached_property
    def scoped(self) -> Star:
        return filters.apply_filters(self.star, SOME_STATES, SOME_CATEGORIES, 365)

    @cached_property
    def pop(self) -> DataFrame:
        return retail_population(self.spark, self.directory)

    @cached_property
    def more_pop(self) -> DataFrame:
        """The population with a state that has no customers."""
        nowhere = self.spark.range(1).select(F.lit("NOWHERE").alias("state"), F.lit(700000).cast("bigint").alias("population"))
        return self.pop.select("state", F.col("population").cast("bigint").alias("population")).unionByName(nowhere)


def settle(df: DataFrame) -> DataFrame:
    """Round doubles, widen integers and write dates as text."""

    def col(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # What lies within rounding errors of a half goes up on both sides.
            c = F.rint(c.cast("double") * 10000 + 0.001) / 10000
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return c.alias(f.name)

    return df.select(*[col(f) for f in df.schema.fields])


_SOURCES: dict[tuple[SparkSession, str], Source] = {}


def source(spark: SparkSession, directory: str) -> Source:
    """The source of a directory, its plans built once per session."""
    key = (spark, directory)
    if key not in _SOURCES:
        _SOURCES.clear()
        _SOURCES[key] = Source(spark, directory)
    return _SOURCES[key]


def check(name: str, build: Callable[[Source], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, directory: settle(build(source(spark, directory)))
    if sql is not None:
        ORACLES[name] = sql


TOP = "ORDER BY {0} DESC NULLS LAST, {1} LIMIT {2}"
STATE_IN = ", ".join(f"'{s}'" for s in SOME_STATES)
CATEGORY_IN = ", ".join(f"'{s}'" for s in SOME_CATEGORIES)
# The joined rows in the combined scope.
MF = (
    f"mc AS (SELECT * FROM m WHERE customer_state IN ({STATE_IN}) AND category IN ({CATEGORY_IN}))",
    "mf AS (SELECT * FROM mc WHERE ts >= (SELECT max(ts) FROM mc) - INTERVAL 365 DAY)",
)
R3 = "mo AS (SELECT DISTINCT order_id, order_month, order_status, customer_state, first_payment FROM m LEFT JOIN p1 USING (order_id))"

# --- sources ------------------------------------------------------------------


def _table_counts(s: Source) -> DataFrame:
    names = ("orders", "order_items", "order_payments", "order_reviews", "products", "sellers", "customers",
             "category_translation")
    parts = [getattr(s.t, n).agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("rows")) for n in names]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


check(
    "io1_table_counts",
    _table_counts,
    oracle(
        " UNION ALL ".join(
            f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {v}"
            for n, v in (("orders", "o"), ("order_items", "i"), ("order_payments", "p"), ("order_reviews", "r"),
                         ("products", "pe"), ("sellers", "s"), ("customers", "c"),
                         ("category_translation",
                          "(SELECT DISTINCT product_category_name FROM pe WHERE category IS NOT NULL)"))
        )
    ),
)


def _as_csv(s: Source, df: DataFrame, table: str) -> DataFrame:
    """``df`` written as CSV files in the shared folder and read back as ``table``."""
    shared = s.spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="mercato-")
    path = f"{shared.rstrip('/')}/csv-{uuid.uuid4().hex}"
    export_csv(df, path)
    return read_table(s.spark, path, table)


def _csv_reviews(s: Source) -> DataFrame:
    said = F.concat(F.lit('said "'), F.col("review_score").cast("string"), F.lit('",\n'), F.col("order_id").cast("string"))
    return _as_csv(s, s.t.order_reviews.withColumn("comment", said), "order_reviews").groupBy("review_score").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count_distinct("order_id").alias("orders"),
        F.sum(F.length("comment")).alias("letters"),
        F.max("review_creation_date").alias("latest"),
    )


check(
    "io1_csv_records_across_lines",
    _csv_reviews,
    oracle(
        "SELECT review_score, count(*) AS reviews, count(DISTINCT order_id) AS orders, "
        "sum(length('said \"' || review_score || '\",' || chr(10) || order_id))::bigint AS letters, "
        "strftime(max(created), '%Y-%m-%d %H:%M:%S') AS latest FROM r GROUP BY 1"
    ),
)
check(
    "io1_csv_items",
    lambda s: _as_csv(s, s.t.order_items, "order_items").groupBy(F.col("seller_id").cast("bigint").alias("seller_id")).agg(
        F.count(F.lit(1)).alias("items"), F.count_distinct("order_id").alias("orders"), total("price").alias("sold"), total("freight_value").alias("freight")
    ),
    oracle(f"SELECT seller_id, count(*) AS items, {n_orders()} AS orders, {money('price')} AS sold, {money('freight_value')} AS freight FROM i GROUP BY 1"),
)


def _coerced(s: Source) -> DataFrame:
    text = F.date_format("order_delivered_customer_date", "yyyy-MM-dd HH:mm:ss")
    broken = F.when(F.col("order_status") == "canceled", "bad").otherwise(
        F.when(F.col("order_id") % 7 == 0, F.concat(text, F.lit(" never"))).otherwise(text)
    )
    return (
        coerce_ts(s.t.orders.select("order_status", broken.alias("ts")), ["ts", "absent"])
        .groupBy("order_status")
        .agg(F.count(F.lit(1)).alias("rows"), F.count("ts").alias("valid"), F.max("ts").alias("latest"))
    )


check(
    "io2_coerce_timestamps",
    _coerced,
    oracle(
        "SELECT order_status, count(*) AS rows, count(ts) AS valid, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest "
        "FROM (SELECT order_status, CASE WHEN order_status <> 'canceled' AND order_id % 7 <> 0 THEN delivered END AS ts FROM o) "
        "GROUP BY 1"
    ),
)
check(
    "io3_population",
    lambda s: s.pop.groupBy().agg(F.count(F.lit(1)).alias("states"), F.sum("population").alias("population")),
    oracle("SELECT count(*) AS states, sum(population)::bigint AS population FROM pop"),
)


def _subset(s: Source) -> DataFrame:
    part = load_subset(s.t, ("1996-01-01", "1997-06-30 23:59:59"), SOME_STATES)
    return Star(part).orders(customer=True).groupBy(STATE).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("items").alias("items"), F.sum("payments").alias("payments")
    )


check(
    "io4_load_subset",
    _subset,
    oracle(
        "SELECT customer_state, count(*) AS orders, sum(coalesce(ni, 0))::bigint AS items, sum(coalesce(np, 0))::bigint AS payments "
        "FROM oc LEFT JOIN (SELECT order_id, count(*) AS ni FROM i GROUP BY 1) USING (order_id) "
        "LEFT JOIN (SELECT order_id, count(*) AS np FROM p GROUP BY 1) USING (order_id) "
        f"WHERE customer_state IN ({STATE_IN}) AND ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30 23:59:59' GROUP BY 1"
    ),
)
check(
    "io8_sample_cap",
    lambda s: sample_cap(s.t.order_items, 2500).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("price") > 0).alias("priced")
    ),
    oracle("SELECT least(2500, count(*)) AS rows, least(2500, count(*)) AS priced FROM i"),
)

# --- joins and features -------------------------------------------------------

check(
    "j1_products_en",
    lambda s: products_en(s.t).groupBy("product_category_name", CATEGORY).agg(F.count(F.lit(1)).alias("products")),
    oracle("SELECT product_category_name, category AS product_category_name_english, count(*) AS products FROM pe GROUP BY 1, 2"),
)


def _master_profile(s: Source) -> DataFrame:
    return master(s.t).groupBy("order_status").agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.sum("payment_value"), 2).alias("revenue"),
        F.round(F.sum("price"), 2).alias("price"),
        F.sum("review_score").alias("scores"),
        F.count_distinct("seller_state").alias("seller_states"),
        F.count(CATEGORY).alias("categorized"),
    )


_PROFILE = (
    f"SELECT order_status, count(*) AS rows, {money('payment_value')} AS revenue, {money('price')} AS price, "
    "sum(review_score)::bigint AS scores"
)
check(
    "j2_master",
    _master_profile,
    oracle(_PROFILE + ", count(DISTINCT seller_state) AS seller_states, count(category) AS categorized FROM m GROUP BY 1"),
)
check(
    "j3_order_facts",
    lambda s: s.star.orders().groupBy("order_status").agg(
        F.sum("rows").alias("rows"),
        F.round(F.sum("revenue"), 2).alias("revenue"),
        F.round(F.sum("price_fanned"), 2).alias("price"),
        F.sum("scores").alias("scores"),
    ),
    oracle(_PROFILE + " FROM m GROUP BY 1"),
)
check(
    "j4_delivery_features",
    lambda s: s.star.orders().groupBy("delivery_time", "estimated_delivery_time", "delivery_delay", "on_time_delivery").agg(
        F.count(F.lit(1)).alias("orders")
    ),
    oracle(
        "SELECT delivery_time, estimated_delivery_time, delivery_delay, on_time AS on_time_delivery, count(*) AS orders "
        "FROM of GROUP BY 1, 2, 3, 4"
    ),
)
_CALENDAR = ("order_year", "order_quarter", "order_month", "order_week", "order_date", "order_dayofweek", "order_hour")
check(
    "j5_time_features",
    lambda s: s.star.orders().groupBy(*_CALENDAR).agg(F.count(F.lit(1)).alias("orders")),
    oracle(f"SELECT {', '.join(_CALENDAR)}, count(*) AS orders FROM of GROUP BY ALL"),
)
check(
    "j6_processing_time",
    lambda s: logistics.processing_time(s.star),
    oracle(f"SELECT {r4(mean('processing_time'))} AS avg_processing_time FROM m"),
)
check(
    "j7_fulfilment_time",
    lambda s: logistics.fulfilment_time(s.star),
    oracle(f"SELECT {r4(mean('fulfilment_time'))} AS avg_fulfilment_time FROM m"),
)
check(
    "j8_order_payments",
    lambda s: order_payments(s.t).groupBy("order_month", "payment_type").agg(
        F.count(F.lit(1)).alias("payments"), F.round(F.sum("payment_value"), 2).alias("paid")
    ),
    oracle(
        f"SELECT order_month, payment_type, count(*) AS payments, {money('payment_value')} AS paid "
        "FROM of JOIN p USING (order_id) GROUP BY 1, 2"
    ),
)
check(
    "j9_scope_to",
    lambda s: scope_to(s.t.order_items, s.t.orders.where("order_status = 'canceled'")).agg(
        F.count(F.lit(1)).alias("items"), F.round(F.sum("price"), 2).alias("price")
    ),
    oracle(
        f"SELECT count(*) AS items, {money('price')} AS price FROM i "
        "WHERE order_id IN (SELECT order_id FROM o WHERE order_status = 'canceled')"
    ),
)
_SUPPLY = (
    "sup AS (SELECT seller_state AS state, count(DISTINCT seller_id) AS sellers FROM m WHERE seller_state IS NOT NULL GROUP BY 1)",
    "dem AS (SELECT customer_state AS state, count(DISTINCT order_id) AS orders FROM m WHERE customer_state IS NOT NULL GROUP BY 1)",
    "sd AS (SELECT state, coalesce(sellers, 0) AS sellers, coalesce(orders, 0) AS orders FROM sup FULL JOIN dem USING (state))",
    "sdr AS (SELECT *, CASE WHEN orders > 0 THEN sellers::double / orders WHEN sellers > 0 THEN 'Infinity'::double ELSE 0.0 END AS ratio FROM sd)",
)
check(
    "j10_full_join",
    lambda s: geo.supply_demand(s.star).select("state", "sellers", "orders"),
    oracle("SELECT state, sellers, orders FROM sd", *_SUPPLY),
)
check(
    "j11_anti_join",
    lambda s: s.pop.join(geo.active_states(filters.apply_filters(s.star, states=SOME_STATES)), "state", "left_anti"),
    oracle(f"SELECT state, population FROM pop WHERE state NOT IN ({STATE_IN})"),
)
# All customers; a population row of a state without any makes the result non-empty.
_NOWHERE = "popx AS (SELECT * FROM pop UNION ALL SELECT 'NOWHERE', 700000::bigint)"
check(
    "j11_anti_join_all",
    lambda s: s.more_pop.join(geo.active_states(s.star), "state", "left_anti"),
    oracle("SELECT state, population FROM popx WHERE state NOT IN (SELECT customer_state FROM m WHERE customer_state IS NOT NULL)", _NOWHERE),
)
check(
    "j12_lookup",
    lambda s: geo.state_metrics(s.star, s.pop).select("state", "population", "orders"),
    oracle(
        "SELECT state, population, count(DISTINCT order_id) AS orders FROM m JOIN pop ON customer_state = state GROUP BY 1, 2"
    ),
)

# --- filters ------------------------------------------------------------------

_SCOPE = "SELECT count(*) AS rows, count(DISTINCT order_id) AS orders FROM "
check(
    "f1_states",
    lambda s: filters.scope_counts(filters.apply_filters(s.star, states=SOME_STATES)),
    oracle(_SCOPE + f"m WHERE customer_state IN ({STATE_IN})"),
)
check(
    "f2_categories",
    lambda s: filters.scope_counts(filters.apply_filters(s.star, categories=SOME_CATEGORIES)),
    oracle(_SCOPE + f"m WHERE category IN ({CATEGORY_IN})"),
)
check("f3_window", lambda s: filters.scope_counts(s.scoped), oracle(_SCOPE + "mf", *MF))
check(
    "f3_last_90_days",
    lambda s: filters.scope_counts(filters.apply_filters(s.star, window_days=90)),
    oracle(_SCOPE + "m WHERE ts >= (SELECT max(ts) FROM m) - INTERVAL 90 DAY"),
)
check(
    "f4_filter_values",
    lambda s: filters.filter_values(s.star, CATEGORY),
    oracle("SELECT DISTINCT category AS product_category_name_english FROM m WHERE category IS NOT NULL"),
)
check(
    "f4_state_values",
    lambda s: filters.filter_values(s.star, STATE),
    oracle("SELECT DISTINCT customer_state FROM m WHERE customer_state IS NOT NULL"),
)
check(
    "f5_between",
    lambda s: filters.between(s.star.orders(), "delivery_time", 5, 20).groupBy("delivery_time").agg(
        F.sum("rows").alias("rows")
    ),
    oracle("SELECT delivery_time, count(*) AS rows FROM m WHERE delivery_time BETWEEN 5 AND 20 GROUP BY 1"),
)

# --- executive indicators -----------------------------------------------------

_R1 = f"(SELECT {money('payment_value')} FROM p)"
_COUNTS = "count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_unique_id) AS total_customers, count(DISTINCT seller_id) AS total_sellers"
check(
    "k1_exec_kpis",
    lambda s: kpi.exec_kpis(s.star),
    oracle(f"SELECT {_R1} AS total_revenue, {_COUNTS}, {r4(_R1 + ' / count(DISTINCT order_id)')} AS avg_order_value FROM m"),
)
check(
    "k2_exec_kpis_fanned",
    lambda s: kpi.exec_kpis(s.star, "fanned"),
    oracle(
        f"SELECT {money('payment_value')} AS total_revenue, {_COUNTS}, "
        f"{r4(money('payment_value') + ' / count(DISTINCT order_id)')} AS avg_order_value FROM m"
    ),
)
check(
    "k3_avg_review",
    lambda s: kpi.avg_review(s.star),
    oracle(
        f"SELECT {r4(mean('first_score'))} AS avg_review_score, count(first_score) AS scored_orders "
        "FROM o LEFT JOIN r1 USING (order_id)"
    ),
)
_DELIVERED = "order_status = 'delivered'"
check(
    "k4_delivery_rate",
    lambda s: kpi.delivery_rate(s.star),
    oracle(
        f"SELECT d AS delivered_orders, n AS total_orders, {r4(pct('d', 'n'))} AS delivery_rate "
        f"FROM (SELECT {n_orders(_DELIVERED)} AS d, {n_orders()} AS n FROM m)"
    ),
)
for _name, _grain, _base, _a, _b in (
    ("k5_on_time_orders", "order", "delivered", n_orders("on_time"), n_orders("delivered IS NOT NULL")),
    ("k5_on_time_of_status", "order", "status", n_orders("on_time"), n_orders(_DELIVERED)),
    ("k10_on_time_rows", "row", "delivered", "count(*) FILTER (WHERE on_time)", "count(delivered)"),
    ("k10_on_time_all_rows", "row", "all", "count(*) FILTER (WHERE on_time)", "count(*)"),
):
    check(
        _name,
        lambda s, g=_grain, b=_base: kpi.on_time_rate(s.star, g, b),
        oracle(
            f"SELECT a AS on_time, b AS base, {r4(pct('a', 'b'))} AS on_time_rate FROM (SELECT {_a} AS a, {_b} AS b FROM m)"
        ),
    )
check(
    "k6_revenue_per_customer",
    lambda s: kpi.revenue_per_customer(s.star),
    oracle(
        f"SELECT v AS total_revenue, n AS total_customers, {r4('v / n')} AS revenue_per_customer "
        f"FROM (SELECT {money('payment_value')} AS v, count(DISTINCT customer_unique_id) AS n FROM m)"
    ),
)
check(
    "k7_revenue_per_seller",
    lambda s: kpi.revenue_per_seller(s.star),
    oracle(
        f"SELECT v AS total_revenue, n AS total_sellers, {r4('v / n')} AS revenue_per_seller "
        f"FROM (SELECT {money('payment_value')} AS v, count(DISTINCT seller_id) AS n FROM m)"
    ),
)
check(
    "k8_median_order_value",
    lambda s: kpi.median_order_value(s.star),
    oracle(
        f"SELECT count(*) AS orders, {r4('quantile_cont(v, 0.5)')} AS median_order_value "
        f"FROM (SELECT order_id, {money('payment_value')} AS v FROM m GROUP BY 1)"
    ),
)
check(
    "k9_dataset_overview",
    lambda s: kpi.dataset_overview(s.star),
    oracle(
        "SELECT count(*) AS rows, count(DISTINCT order_id) AS orders, count(DISTINCT customer_unique_id) AS customers, "
        "count(DISTINCT seller_id) AS sellers, count(DISTINCT product_id) AS products, "
        "strftime(min(ts), '%Y-%m-%d') AS first_date, strftime(max(ts), '%Y-%m-%d') AS last_date, "
        "floor((epoch(max(ts)) - epoch(min(ts))) / 86400)::bigint AS span_days FROM m"
    ),
)
check(
    "k11_scoped_overview",
    lambda s: kpi.dataset_overview(s.scoped).select("rows", "orders", "sellers", "products", "span_days"),
    oracle(
        "SELECT count(*) AS rows, count(DISTINCT order_id) AS orders, count(DISTINCT seller_id) AS sellers, "
        "count(DISTINCT product_id) AS products, floor((epoch(max(ts)) - epoch(min(ts))) / 86400)::bigint AS span_days FROM mf",
        *MF,
    ),
)
check(
    "k11_overview_all",
    lambda s: kpi.dataset_overview(s.star).select("rows", "orders", "sellers", "products", "span_days"),
    oracle(
        "SELECT count(*) AS rows, count(DISTINCT order_id) AS orders, count(DISTINCT seller_id) AS sellers, "
        "count(DISTINCT product_id) AS products, floor((epoch(max(ts)) - epoch(min(ts))) / 86400)::bigint AS span_days FROM m"
    ),
)

# --- revenue ------------------------------------------------------------------

_MONTH_R1 = f"mr AS (SELECT order_month, {money('payment_value')} AS revenue FROM of JOIN p USING (order_id) GROUP BY 1)"
_MONTH_R5 = f"mr AS (SELECT order_month, {money('payment_value')} AS revenue FROM m GROUP BY 1)"
_MONTH_R3 = f"mr AS (SELECT order_month, {money('first_payment')} AS revenue FROM mo GROUP BY 1)"
check("v1_monthly_revenue", lambda s: revenue.monthly_revenue(s.star), oracle("SELECT * FROM mr", _MONTH_R1))
check("v2_monthly_revenue_fanned", lambda s: revenue.monthly_revenue(s.star, "fanned"), oracle("SELECT * FROM mr", _MONTH_R5))
check(
    "v2_monthly_peak",
    lambda s: revenue.monthly_peak(s.star),
    oracle(
        "SELECT (SELECT order_month FROM mr ORDER BY revenue DESC, order_month LIMIT 1) AS peak_month, max(revenue) AS peak_revenue, "
        f"{r4(money('revenue') + ' / count(*)')} AS avg_monthly_revenue, count(*) AS months FROM mr",
        _MONTH_R5,
    ),
)
_STATES = f"st AS (SELECT customer_state, {money('payment_value')} AS revenue FROM m WHERE customer_state IS NOT NULL GROUP BY 1)"
_R2 = f"(SELECT {money('payment_value')} FROM m)"
check(
    "v3_top_states",
    lambda s: revenue.top_states(s.star),
    oracle(
        f"SELECT customer_state, revenue, {r4('revenue / ' + _R2 + ' * 100')} AS share_pct FROM st "
        + TOP.format("revenue", "customer_state", 10),
        _STATES,
    ),
)
check(
    "v3_state_concentration",
    lambda s: revenue.state_concentration(s.star),
    oracle(
        f"SELECT {money('revenue')} AS top_revenue, {_R2} AS total_revenue, {r4(money('revenue') + ' / ' + _R2 + ' * 100')} AS concentration_pct "
        f"FROM (SELECT * FROM st {TOP.format('revenue', 'customer_state', 3)})",
        _STATES,
    ),
)
check(
    "v4_scoped_kpis",
    lambda s: revenue.scoped_kpis(s.scoped),
    oracle(
        f"SELECT {money('first_payment')} AS total_revenue, count(*) AS total_orders, "
        f"{r4(money('first_payment') + ' / count(*)')} AS avg_order_value "
        "FROM (SELECT DISTINCT order_id FROM mf) JOIN p1 USING (order_id)",
        *MF,
    ),
)
check(
    "v4_kpis_all",
    lambda s: revenue.scoped_kpis(s.star),
    oracle(
        f"SELECT {money('first_payment')} AS total_revenue, count(*) AS total_orders, "
        f"{r4(money('first_payment') + ' / count(*)')} AS avg_order_value "
        "FROM (SELECT DISTINCT order_id FROM m) JOIN p1 USING (order_id)"
    ),
)
check(
    "v5_mom_growth",
    lambda s: revenue.mom_growth(s.star),
    oracle(
        f"SELECT cm AS current_month, pm AS previous_month, cr AS current_revenue, pr AS previous_revenue, {r4(pct('cr - pr', 'pr'))} AS growth_pct "
        "FROM (SELECT cm, pm, coalesce((SELECT revenue FROM mr WHERE order_month = cm), 0.0) AS cr, "
        "coalesce((SELECT revenue FROM mr WHERE order_month = pm), 0.0) AS pr FROM "
        "(SELECT max(order_month) AS cm, strftime(CAST(max(order_month) || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') AS pm FROM mr))",
        R3,
        _MONTH_R3,
    ),
)


def _waterfall_sql(where: str, *ctes: str) -> str:
    return oracle(
        f"SELECT * FROM (SELECT 1::bigint AS step, 'Product Sales' AS component, a AS amount FROM w UNION ALL SELECT 2, 'Freight Charges', b FROM w "
        f"UNION ALL SELECT 3, 'Other Charges (Taxes/Fees)', {r4('t - (a + b)')} FROM w UNION ALL SELECT 4, 'Total Revenue', t FROM w)",
        *ctes,
        f"w AS (SELECT (SELECT {money('price')} FROM i {where}) AS a, (SELECT {money('freight_value')} FROM i {where}) AS b, "
        f"(SELECT {money('payment_value')} FROM p {where}) AS t)",
    )


check("v6_waterfall", lambda s: revenue.waterfall(s.star), _waterfall_sql(""))
_BY_STATE = "WHERE order_id IN (SELECT order_id FROM m WHERE customer_state IN (" + STATE_IN + "))"
check(
    "v6_waterfall_scoped",
    lambda s: revenue.waterfall(filters.apply_filters(s.star, states=SOME_STATES)),
    _waterfall_sql(_BY_STATE),
)
check(
    "v7_processing_margin",
    lambda s: revenue.processing_margin(s.star),
    oracle(
        f"SELECT t AS total_revenue, {r4('t - x')} AS other_charges, {r4('(t - x) / t * 100')} AS processing_margin_pct FROM "
        f"(SELECT {_R1} AS t, (SELECT {money('price')} + {money('freight_value')} FROM i) AS x)"
    ),
)
check(
    "v8_revenue_by_payment_type",
    lambda s: revenue.revenue_by_payment_type(s.star),
    oracle(f"SELECT payment_type, {money('payment_value')} AS revenue FROM m WHERE payment_type IS NOT NULL GROUP BY 1"),
)
check(
    "v8_payment_type_scoped",
    lambda s: revenue.revenue_by_payment_type(s.scoped),
    oracle(f"SELECT payment_type, {money('payment_value')} AS revenue FROM mf WHERE payment_type IS NOT NULL GROUP BY 1", *MF),
)
_MIX = (
    f"pm0 AS (SELECT payment_type, {money('payment_value')} AS revenue, count(payment_value) AS transactions FROM p GROUP BY 1)",
    "pm AS (SELECT *, revenue / transactions AS av, revenue / sum(revenue) OVER () * 100 AS share, "
    "row_number() OVER (ORDER BY revenue DESC, payment_type) AS rank FROM pm0)",
)
check(
    "v9_payment_mix",
    lambda s: revenue.payment_mix(s.t),
    oracle(
        f"SELECT payment_type, revenue, transactions, {r4('av')} AS avg_transaction, {r4('share')} AS share_pct, rank FROM pm", *_MIX
    ),
)
check(
    "v9_payment_leaders",
    lambda s: revenue.payment_leaders(s.t),
    oracle(
        f"SELECT (SELECT payment_type FROM pm WHERE rank = 1) AS dominant_type, {r4('(SELECT share FROM pm WHERE rank = 1)')} AS dominant_pct, "
        f"(SELECT payment_type FROM pm ORDER BY av DESC, rank LIMIT 1) AS highest_avg_type, {r4('(SELECT max(av) FROM pm)')} AS highest_avg",
        *_MIX,
    ),
)
_CATS = f"cr AS (SELECT category, {money('payment_value')} AS revenue FROM m WHERE category IS NOT NULL GROUP BY 1)"
check(
    "v10_top_categories",
    lambda s: revenue.top_categories(s.star),
    oracle("SELECT * FROM cr " + TOP.format("revenue", "category", 10), _CATS),
)
check(
    "v11_avg_by_hour",
    lambda s: revenue.revenue_by_hour(s.star),
    oracle(f"SELECT order_hour, {r4(money('payment_value') + ' / count(payment_value)')} AS revenue FROM m GROUP BY 1"),
)
check(
    "v12_top_hours",
    lambda s: revenue.revenue_by_hour(s.star, "sum", 5),
    oracle(f"SELECT order_hour, {money('payment_value')} AS revenue FROM m GROUP BY 1 " + TOP.format("revenue", "order_hour", 5)),
)
check(
    "v13_weekdays",
    lambda s: revenue.revenue_by_weekday(s.star, long_names=True),
    oracle(
        f"SELECT order_dayofweek, {money('payment_value')} AS revenue, "
        "['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][order_dayofweek + 1] AS day_name FROM m GROUP BY 1"
    ),
)
_MARGIN = (
    f"cm AS (SELECT category, {money('payment_value')} AS revenue, {money('price')} AS price, {money('freight_value')} AS freight "
    "FROM m WHERE category IS NOT NULL GROUP BY 1)",
    "cm10 AS (SELECT *, (revenue - price - freight) / revenue * 100 AS margin FROM cm ORDER BY revenue DESC, category LIMIT 10)",
)
check(
    "v14_category_margin",
    lambda s: revenue.category_margin(s.star),
    oracle(f"SELECT category, revenue, price, freight, {r4('margin')} AS margin_pct FROM cm10", *_MARGIN),
)
check(
    "v14_low_margin",
    lambda s: revenue.low_margin_count(s.star, below=92.0),
    oracle("SELECT count(*) FILTER (WHERE margin < 92.0) AS low_margin, count(*) AS categories FROM cm10", *_MARGIN),
)
check(
    "v15_last_growth",
    lambda s: revenue.last_growth(s.star),
    oracle(
        f"SELECT order_month, revenue, pr AS previous_revenue, {r4('(revenue - pr) / pr * 100')} AS growth_pct "
        "FROM (SELECT *, lag(revenue) OVER (ORDER BY order_month) AS pr FROM mr) ORDER BY order_month DESC LIMIT 1",
        _MONTH_R1,
    ),
)

# --- trends -------------------------------------------------------------------

_CHANGE = "({0} - lag({0}) OVER w)::double / lag({0}) OVER w * 100"


def _growth_sql(rows: str, *ctes: str) -> str:
    return oracle(
        f"SELECT order_month, revenue, orders, customers, {r4(_CHANGE.format('revenue'))} AS revenue_growth, "
        f"{r4(_CHANGE.format('orders'))} AS order_growth FROM {rows} WINDOW w AS (ORDER BY order_month)",
        *ctes,
    )


check(
    "w1_monthly_growth",
    lambda s: trends.monthly_growth(s.star),
    _growth_sql(
        f"(SELECT order_month, {money('payment_value')} AS revenue, count(DISTINCT order_id) AS orders, "
        "count(DISTINCT customer_unique_id) AS customers FROM m GROUP BY 1)"
    ),
)
check(
    "w2_category_trends",
    lambda s: trends.category_trends(s.star),
    oracle(
        f"SELECT order_month, category, {money('payment_value')} AS revenue FROM m WHERE category IN "
        "(SELECT category FROM cr ORDER BY revenue DESC, category LIMIT 5) GROUP BY 1, 2",
        _CATS,
    ),
)
check(
    "w3_monthly_growth_first",
    lambda s: trends.monthly_growth(s.star, "first").select("order_month", "revenue", "revenue_growth"),
    oracle(
        f"SELECT order_month, revenue, {r4(_CHANGE.format('revenue'))} AS revenue_growth FROM mr WINDOW w AS (ORDER BY order_month)",
        R3,
        _MONTH_R3,
    ),
)
_MA = "CASE WHEN count(*) OVER w = 3 THEN sum(revenue) OVER w / 3 END"
check(
    "w4_moving_average",
    lambda s: trends.monthly_moving_average(s.star),
    oracle(
        f"SELECT order_month, revenue, {r4(_MA)} AS moving_avg, {r4('revenue / (' + _MA + ')')} AS ratio_to_avg FROM mr "
        "WINDOW w AS (ORDER BY order_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
        R3,
        _MONTH_R3,
    ),
)
check(
    "w5_seasonal",
    lambda s: trends.monthly_seasonal(s.star),
    oracle(
        f"SELECT order_month, revenue, mon AS month, {r4('f')} AS seasonal_factor, {r4('revenue / f')} AS adjusted_revenue FROM "
        "(SELECT *, avg(revenue) OVER (PARTITION BY mon) / avg(revenue) OVER () AS f FROM "
        "(SELECT *, CAST(substr(order_month, 6, 2) AS BIGINT) AS mon FROM mr))",
        _MONTH_R5,
    ),
)
check(
    "w6_monthly_sellers",
    lambda s: trends.monthly_sellers(s.star),
    oracle("SELECT order_month, count(DISTINCT seller_id) AS sellers FROM m WHERE seller_id IS NOT NULL GROUP BY 1"),
)
check(
    "w7_growth_and_division",
    lambda s: revenue.monthly_revenue(s.star, "first").join(
        trends.monthly_sellers(s.star), "order_month", "left"
    ).select(
        "order_month",
        growth("revenue", F.col("revenue") - F.col("revenue")).alias("growth_on_zero"),
        growth(F.col("revenue") * 3, "revenue").alias("growth"),
        safe_div("revenue", F.coalesce("sellers", F.lit(0))).alias("revenue_per_seller"),
    ),
    oracle(
        f"SELECT order_month, 0.0::double AS growth_on_zero, {r4('(revenue * 3 - revenue) / revenue * 100')} AS growth, "
        f"{r4('CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE revenue / n END')} AS revenue_per_seller FROM mr LEFT JOIN "
        "(SELECT order_month, count(DISTINCT seller_id) AS n FROM m GROUP BY 1) USING (order_month)",
        R3,
        _MONTH_R3,
    ),
)

# --- customers ----------------------------------------------------------------

_REPEAT = "rc AS (SELECT customer_unique_id, count(DISTINCT order_id) AS n FROM {0} WHERE customer_unique_id IS NOT NULL GROUP BY 1)"
for _suffix, _rows, _ctes, _pick in (("", "m", (), "star"), ("_scoped", "mf", MF, "scoped")):
    check(
        f"c1_customer_kpis{_suffix}",
        lambda s, p=_pick: customers.customer_kpis(getattr(s, p)),
        oracle(
            f"SELECT count(DISTINCT customer_unique_id) AS total_customers, {r4(mean('review_score'))} AS avg_review FROM {_rows}",
            *_ctes,
        ),
    )
    check(
        f"c2_repeat_rate{_suffix}",
        lambda s, p=_pick: customers.repeat_rate(getattr(s, p)),
        oracle(
            f"SELECT count(*) AS total_customers, count(*) FILTER (WHERE n > 1) AS repeat_customers, "
            f"{r4(pct('count(*) FILTER (WHERE n > 1)', 'count(*)'))} AS repeat_rate FROM rc",
            *_ctes,
            _REPEAT.format(_rows),
        ),
    )
_BAND = (
    "CASE WHEN nps >= 70 THEN 'World Class' WHEN nps >= 50 THEN 'Excellent' WHEN nps >= 30 THEN 'Great' "
    "WHEN nps >= 10 THEN 'Good' WHEN nps >= 0 THEN 'Needs Improvement' ELSE 'Critical' END"
)
_NPS = {
    "order": (
        f"SELECT {n_orders('review_score >= 4')} AS p, {n_orders('review_score <= 2')} AS d, "
        f"{n_orders('review_score IS NOT NULL')} AS n FROM m"
    ),
    "first": (
        "SELECT count(*) FILTER (WHERE first_score >= 4) AS p, count(*) FILTER (WHERE first_score <= 2) AS d, "
        "count(first_score) AS n FROM o LEFT JOIN r1 USING (order_id)"
    ),
    "row": (
        "SELECT count(*) FILTER (WHERE review_score >= 4) AS p, count(*) FILTER (WHERE review_score <= 2) AS d, "
        "count(review_score) AS n FROM m"
    ),
}
for _id, _basis in (("c3", "order"), ("c4", "first"), ("c5", "row")):
    check(
        f"{_id}_nps_{_basis}",
        lambda s, b=_basis: customers.nps(s.star, b),
        oracle(
            f"SELECT p AS promoters, d AS detractors, n AS total_reviews, {r4('nps')} AS nps, {_BAND} AS band "
            f"FROM (SELECT *, {pct('p - d', 'n')} AS nps FROM ({_NPS[_basis]}))"
        ),
    )
_SE = "sqrt((p + d)::double / n) * 100"
_SSE = "sqrt((p + d)::double / n / n - ((p - d)::double / n) * ((p - d)::double / n) / n) * 100"
check(
    "c6_nps_interval",
    lambda s: customers.nps_ci(s.star),
    oracle(
        f"SELECT {r4('nps')} AS nps, {r4('se')} AS se, {r4('nps - se * 1.959964::double')} AS ci_low, {r4('nps + se * 1.959964::double')} AS ci_high, "
        f"{r4('sse')} AS sampling_se, {r4('nps - sse * 1.959964::double')} AS sampling_low, {r4('nps + sse * 1.959964::double')} AS sampling_high "
        f"FROM (SELECT {pct('p - d', 'n')} AS nps, {_SE} AS se, {_SSE} AS sse FROM ({_NPS['row']}))"
    ),
)
check(
    "c7_nps_band_by_state",
    lambda s: s.star.orders(customer=True).where(F.col(STATE).isNotNull()).groupBy(STATE).agg(
        ((F.sum("promoter_rows") - F.sum("detractor_rows")) / F.sum("scored") * 100).alias("nps")
    ).withColumn("band", customers.nps_band("nps")),
    oracle(
        f"SELECT customer_state, {r4('nps')} AS nps, {_BAND} AS band FROM (SELECT customer_state, "
        "(count(*) FILTER (WHERE review_score >= 4) - count(*) FILTER (WHERE review_score <= 2))::double / count(review_score) * 100 AS nps "
        "FROM m WHERE customer_state IS NOT NULL GROUP BY 1)"
    ),
)


def _cohort(key: str, period: str, index: str) -> tuple[str, ...]:
    return (
        f"ca AS (SELECT DISTINCT {key} AS k, {period} AS per FROM m WHERE {key} IS NOT NULL)",
        f"cb AS (SELECT cohort, {index} AS cohort_index, count(*) AS customers FROM "
        "(SELECT *, min(per) OVER (PARTITION BY k) AS cohort FROM ca) GROUP BY 1, 2)",
        "cz AS (SELECT *, first_value(customers) OVER (PARTITION BY cohort ORDER BY cohort_index) AS size FROM cb)",
    )


_MONTHS = (
    "((substr(per, 1, 4)::int * 12 + substr(per, 6, 2)::int) - (substr(cohort, 1, 4)::int * 12 + substr(cohort, 6, 2)::int))::bigint"
)
_BY_MONTH = _cohort("customer_unique_id", "order_month", _MONTHS)
_BY_DAY = _cohort("customer_id", "order_date", "date_diff('day', cohort::date, per::date)")
check("c8_cohorts", lambda s: customers.cohorts(s.star), oracle("SELECT * FROM cb", *_BY_MONTH))
_RETAINED = f"SELECT cohort, cohort_index, customers, size AS cohort_size, {r4('customers::double / size * 100')} AS retention_pct FROM cz"
check("c9_retention", lambda s: customers.retention(s.star), oracle(_RETAINED, *_BY_MONTH))
_INDEXES = range(80)
check(
    "c9_retention_matrix",
    lambda s: customers.retention_matrix(s.star, _INDEXES),
    oracle(
        "SELECT cohort, "
        + ", ".join(
            f"{r4(f'max(customers::double / size * 100) FILTER (WHERE cohort_index = {i})')} AS m{i}" for i in _INDEXES
        )
        + " FROM cz GROUP BY 1",
        *_BY_MONTH,
    ),
)
check("c10_cohorts_by_day", lambda s: customers.retention(s.star, "day", "customer_id"), oracle(_RETAINED, *_BY_DAY))
check(
    "c11_review_distribution",
    lambda s: customers.review_dist(s.star),
    oracle("SELECT review_score, count(DISTINCT order_id) AS orders FROM m WHERE review_score IS NOT NULL GROUP BY 1"),
)
check(
    "c11_review_distribution_scoped",
    lambda s: customers.review_dist(s.scoped),
    oracle("SELECT review_score, count(DISTINCT order_id) AS orders FROM mf WHERE review_score IS NOT NULL GROUP BY 1", *MF),
)
check(
    "c12_review_classes",
    lambda s: customers.review_classes(s.star),
    oracle(
        "SELECT review_score, ['Terrible (1 star)', 'Poor (2 stars)', 'Average (3 stars)', 'Good (4 stars)', 'Excellent (5 stars)'][review_score] "
        "AS class, count(*) AS rows FROM m WHERE review_score IS NOT NULL GROUP BY 1"
    ),
)
_VALUE = (
    f"cv AS (SELECT customer_unique_id, {money('payment_value')} AS v, count(DISTINCT order_id) AS f, max(ts) AS last, min(ts) AS first "
    "FROM m WHERE customer_unique_id IS NOT NULL GROUP BY 1)"
)


def _binned(source: str, value: str, n: int, labels: list[str]) -> tuple[str, str]:
    """Views: quantile edges of a value, and the rows with their bin."""
    edges = ", ".join(f"{quantile('l', 'n', i / n)} AS e{i}" for i in range(1, n))
    level = "CASE " + " ".join(f"WHEN {value} <= e{i} THEN {i - 1}" for i in range(1, n)) + f" ELSE {n - 1} END::bigint"
    names = "[" + ", ".join(f"'{x}'" for x in labels) + "]"
    return (
        f"qe AS (SELECT {edges} FROM (SELECT list_sort(list({value})) AS l, count(*) AS n FROM {source} WHERE {value} IS NOT NULL))",
        f"qb AS (SELECT *, {names}[level + 1] AS label FROM (SELECT x.*, {level} AS level FROM {source} x, qe WHERE {value} IS NOT NULL))",
    )


_VALUE_LABELS = ["Low", "Medium", "High", "VIP"]
check(
    "c13_value_quartiles",
    lambda s: customers.value_quartiles(s.star),
    oracle(
        "SELECT level, label AS segment, count(*) AS customers FROM qb GROUP BY 1, 2",
        _VALUE,
        *_binned("cv", "v", 4, _VALUE_LABELS),
    ),
)
_TEST_EDGES = (0, 5_000_000, 10_000_000, 20_000_000, float("inf"))
check(
    "c14_value_bands",
    lambda s: customers.value_bands(s.star, _TEST_EDGES),
    oracle(
        f"SELECT level, {_VALUE_LABELS!r}[level + 1] AS segment, count(*) AS customers FROM (SELECT CASE WHEN v <= 0 THEN NULL "
        "WHEN v <= 5000000 THEN 0 WHEN v <= 10000000 THEN 1 WHEN v <= 20000000 THEN 2 ELSE 3 END::bigint AS level FROM cv) "
        "WHERE level IS NOT NULL GROUP BY 1, 2",
        _VALUE,
    ),
)
check(
    "c15_customers_by_state",
    lambda s: customers.customers_by_state(s.star),
    oracle(
        "SELECT customer_state, count(DISTINCT customer_unique_id) AS customers FROM m WHERE customer_state IS NOT NULL GROUP BY 1 "
        + TOP.format("customers", "customer_state", 15)
    ),
)
_LTV = f"{money('v')} / count(*)"
check(
    "c16_ltv",
    lambda s: customers.ltv(s.star),
    oracle(
        f"SELECT {r4(_LTV)} AS avg_ltv, {r4('(SELECT ' + money('payment_value') + ' / count(payment_value) FROM p)')} AS avg_payment FROM cv",
        _VALUE,
    ),
)
check(
    "c17_ltv_cac",
    lambda s: customers.ltv_cac(s.star, 2_500_000),
    oracle(
        f"SELECT {r4('a')} AS avg_ltv, 2500000::double AS cac, {r4('a / 2500000')} AS ltv_cac, CASE WHEN a / 2500000 < 3 THEN 'Below target' "
        f"WHEN a / 2500000 < 5 THEN 'Good performance' ELSE 'Excellent performance' END AS status FROM (SELECT {_LTV} AS a FROM cv)",
        _VALUE,
    ),
)
_RFM = "rf AS (SELECT *, floor((epoch((SELECT max(last) FROM cv)) - epoch(last)) / 86400)::bigint AS r FROM cv)"
check(
    "c18_rfm",
    lambda s: customers.rfm(s.star),
    oracle(
        "SELECT customer_unique_id, f AS frequency, v AS monetary, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_purchase, r AS recency_days FROM rf",
        _VALUE,
        _RFM,
    ),
)


def _segment_sql(x: RfmRules) -> str:
    return (
        f"CASE WHEN f >= {x.champion_frequency} AND v > {x.champion_monetary} THEN 'Champions' "
        f"WHEN f >= {x.loyal_frequency} AND r < {x.loyal_recency} THEN 'Loyal Customers' "
        f"WHEN v > {x.potential_monetary} AND r < {x.potential_recency} THEN 'Potential Loyalists' "
        f"WHEN r > {x.at_risk_recency} THEN 'At Risk' WHEN f = 1 THEN 'New Customers' ELSE 'Need Attention' END"
    )


def _segments(x: RfmRules) -> tuple[str, ...]:
    return (_VALUE, _RFM, f"sg AS (SELECT *, {_segment_sql(x)} AS segment FROM rf)")


check(
    "c19_rfm_segments",
    lambda s: customers.rfm_segments(s.star, TEST_RULES).select("customer_unique_id", "segment"),
    oracle("SELECT customer_unique_id, segment FROM sg", *_segments(TEST_RULES)),
)
check(
    "c20_segment_counts",
    lambda s: customers.segment_counts(s.star, TEST_RULES),
    oracle(
        f"SELECT segment, count(*) AS customers, {r4('count(*)::double / (SELECT count(*) FROM sg) * 100')} AS share_pct FROM sg GROUP BY 1",
        *_segments(TEST_RULES),
    ),
)
check(
    "c20_segment_counts_default",
    lambda s: customers.segment_counts(s.star),
    oracle(
        f"SELECT segment, count(*) AS customers, {r4('count(*)::double / (SELECT count(*) FROM sg) * 100')} AS share_pct FROM sg GROUP BY 1",
        *_segments(RfmRules()),
    ),
)


def _second(rows: str) -> tuple[str, ...]:
    return (
        f"t2 AS (SELECT customer_unique_id, (list_sort(list(ts)))[1] AS a, (list_sort(list(ts)))[2] AS b FROM {rows} "
        "WHERE customer_unique_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1)",
        "td AS (SELECT customer_unique_id, floor((epoch(b) - epoch(a)) / 86400)::bigint AS d FROM t2 WHERE b IS NOT NULL)",
    )


_BIN_CASE = "CASE WHEN d <= 30 THEN 0 WHEN d <= 60 THEN 1 WHEN d <= 90 THEN 2 WHEN d <= 180 THEN 3 WHEN d <= 365 THEN 4 ELSE 5 END::bigint"
_BIN_NAMES = "['0-30 days', '31-60 days', '61-90 days', '91-180 days', '181-365 days', '365+ days']"
for _grain, _rows in (("row", "m"), ("order", "oc")):
    check(
        f"c21_time_to_second_{_grain}",
        lambda s, g=_grain: customers.time_to_second(s.star, g),
        oracle("SELECT customer_unique_id, d AS days_to_second FROM td", *_second(_rows)),
    )
    check(
        f"c22_second_purchase_bins_{_grain}",
        lambda s, g=_grain: customers.second_purchase_bins(s.star, g),
        oracle(
            f"SELECT level, {_BIN_NAMES}[level + 1] AS bin, count(*) AS customers FROM (SELECT {_BIN_CASE} AS level FROM td) GROUP BY 1, 2",
            *_second(_rows),
        ),
    )
    check(
        f"c22_second_purchase_summary_{_grain}",
        lambda s, g=_grain: customers.second_purchase_summary(s.star, g),
        oracle(
            f"SELECT count(*) AS repeat_customers, {r4(mean('d'))} AS avg_days, count(*) FILTER (WHERE d <= 30) AS quick_customers, "
            f"{r4(pct('count(*) FILTER (WHERE d <= 30)', 'count(*)'))} AS quick_pct FROM td",
            *_second(_rows),
        ),
    )
_BY_ID = _VALUE.replace("customer_unique_id", "customer_id")
check(
    "c23_clv",
    lambda s: customers.clv(s.star, 0.3),
    oracle(
        "SELECT customer_id, v AS monetary, f AS frequency, strftime(first, '%Y-%m-%d %H:%M:%S') AS first_purchase, "
        f"strftime(last, '%Y-%m-%d %H:%M:%S') AS last_purchase, {r4('v * f * 0.3::double')} AS clv FROM cv",
        _BY_ID,
    ),
)
_SPAN = "(floor((epoch(last) - epoch(first)) / 86400) / 365.0::double)"
check(
    "c24_clv_span",
    lambda s: customers.clv_span(s.star),
    oracle(
        f"SELECT customer_id, {r4('v / f')} AS avg_order_value, f AS frequency, {r4(_SPAN)} AS lifespan, {r4('v / f * f * ' + _SPAN)} AS clv FROM cv",
        _BY_ID,
    ),
)


def _spend(s: Source) -> DataFrame:
    return revenue.monthly_revenue(s.star).select(
        F.col("order_month").alias("month"), (F.col("revenue") * 0.05).alias("spend")
    )


check(
    "c25_cac",
    lambda s: customers.cac(s.star, _spend(s)),
    oracle(
        f"SELECT month, n AS new_customers, {r4('revenue * 0.05::double')} AS spend, {r4('revenue * 0.05::double / n')} AS cac FROM "
        "(SELECT strftime(first, '%Y-%m') AS month, count(*) AS n FROM cv GROUP BY 1) JOIN mr ON month = order_month",
        _VALUE,
        _MONTH_R1,
    ),
)
check(
    "c26_ltv_simple",
    lambda s: customers.ltv_simple(s.star),
    oracle(
        f"SELECT n AS total_orders, k AS total_customers, {r4('a / n')} AS avg_order_value, {r4('n::double / k')} AS orders_per_customer, "
        f"{r4('(a / n) * (n::double / k)')} AS ltv FROM (SELECT {_R1} AS a, count(DISTINCT order_id) AS n, count(DISTINCT customer_unique_id) AS k FROM m)"
    ),
)

# --- sellers ------------------------------------------------------------------

_RATE = "(sum(CASE WHEN on_time THEN 1 ELSE 0 END)::double / count(*) * 100)"
_SELLER = (
    f"sp AS (SELECT seller_id, {money('payment_value')} AS revenue, count(DISTINCT order_id) AS orders, {mean('review_score')} AS rev, "
    f"{mean('delivery_time')} AS dt, {_RATE} AS ot FROM m WHERE seller_id IS NOT NULL GROUP BY 1)"
)
check(
    "l1_seller_kpis",
    lambda s: sellers.seller_kpis(s.star),
    oracle(
        f"SELECT count(*) AS total_sellers, {r4(money('revenue') + ' / count(*)')} AS avg_seller_revenue, max(revenue) AS top_seller_revenue, "
        f"{r4('sum(orders)::double / count(*)')} AS avg_orders_per_seller FROM sp",
        _SELLER,
    ),
)
check(
    "l1_seller_kpis_scoped",
    lambda s: sellers.seller_kpis(s.scoped),
    oracle(
        f"SELECT count(*) AS total_sellers, {r4(money('revenue') + ' / count(*)')} AS avg_seller_revenue, max(revenue) AS top_seller_revenue, "
        f"{r4('sum(orders)::double / count(*)')} AS avg_orders_per_seller FROM sp",
        *MF,
        _SELLER.replace("FROM m ", "FROM mf "),
    ),
)
check(
    "l2_top_sellers",
    lambda s: sellers.top_sellers(s.star),
    oracle(f"SELECT seller_id, revenue, orders, {r4('rev')} AS avg_review FROM sp " + TOP.format("revenue", "seller_id", 10), _SELLER),
)
check(
    "l3_sellers_by_state",
    lambda s: sellers.sellers_by_state(s.star),
    oracle("SELECT seller_state, sellers FROM (SELECT state AS seller_state, sellers FROM sup) " + TOP.format("sellers", "seller_state", 10), _SUPPLY[0]),
)
_MATRIX = f"SELECT seller_id, revenue, orders, {r4('rev')} AS avg_review, {r4('dt')} AS avg_delivery_time FROM sp WHERE rev IS NOT NULL AND dt IS NOT NULL AND revenue > 0 "
check("l4_seller_matrix", lambda s: sellers.seller_matrix(s.star), oracle(_MATRIX + "ORDER BY seller_id LIMIT 100", _SELLER))
check(
    "l4_seller_matrix_best",
    lambda s: sellers.seller_matrix(s.star, "revenue", 50),
    oracle(_MATRIX + TOP.format("revenue", "seller_id", 50), _SELLER),
)
check(
    "l5_seller_performance",
    lambda s: sellers.seller_performance(s.star),
    oracle(
        f"SELECT seller_id, revenue, orders, {r4('rev')} AS avg_review, {r4('dt')} AS avg_delivery_time, {r4('ot')} AS on_time_pct FROM sp", _SELLER
    ),
)
_SEGMENTED = (
    _SELLER,
    "sr AS (SELECT *, (rank() OVER (ORDER BY revenue) + (count(*) OVER (PARTITION BY revenue) + 1) / 2.0::double - 1) / count(*) OVER () AS pr FROM sp)",
    "ss AS (SELECT *, CASE WHEN pr <= 0.25 THEN 0 WHEN pr <= 0.75 THEN 1 WHEN pr <= 0.95 THEN 2 ELSE 3 END::bigint AS level FROM sr)",
)
_SEG_NAMES = "['Bottom 25%', 'Middle 50%', 'Top 25%', 'Top 5%'][level + 1]"
check(
    "l6_seller_segments",
    lambda s: sellers.seller_segments(s.star).select("seller_id", "revenue", "revenue_percentile", "segment", "level"),
    oracle(f"SELECT seller_id, revenue, {r4('pr')} AS revenue_percentile, {_SEG_NAMES} AS segment, level FROM ss", *_SEGMENTED),
)
check(
    "l7_segment_summary",
    lambda s: sellers.segment_summary(s.star),
    oracle(
        f"SELECT level, {_SEG_NAMES} AS segment, count(*) AS sellers, {money('revenue')} AS revenue, {r4('avg(rev)')} AS avg_review FROM ss GROUP BY 1, 2",
        *_SEGMENTED,
    ),
)
check(
    "l8_segment_delivery",
    lambda s: sellers.segment_delivery(s.star),
    oracle(
        f"SELECT level, {_SEG_NAMES} AS segment, {r4('avg(dt)')} AS avg_delivery_time, {r4('avg(ot)')} AS on_time_pct, {r4('avg(rev)')} AS avg_review "
        "FROM ss GROUP BY 1, 2",
        *_SEGMENTED,
    ),
)
check(
    "l9_category_opportunity",
    lambda s: sellers.category_opportunity(s.star),
    oracle(
        f"SELECT category, revenue, orders, sellers, {r4('rev')} AS avg_review, {r4('revenue / sellers')} AS revenue_per_seller FROM "
        f"(SELECT category, {money('payment_value')} AS revenue, count(DISTINCT order_id) AS orders, count(DISTINCT seller_id) AS sellers, "
        f"{mean('review_score')} AS rev FROM m WHERE category IS NOT NULL GROUP BY 1) " + TOP.format("revenue", "category", 15)
    ),
)
check(
    "l10_seller_size_adjusted",
    lambda s: sellers.seller_size_adjusted(s.star),
    oracle(
        f"SELECT seller_id, revenue, n AS rows, k AS products, d AS days_active, {r4('revenue / nullif(k, 0)')} AS revenue_per_product, "
        f"{r4('revenue / nullif(d, 0)')} AS revenue_per_day FROM (SELECT seller_id, {money('payment_value')} AS revenue, count(*) AS n, "
        "count(DISTINCT product_id) AS k, floor((epoch(max(ts)) - epoch(min(ts))) / 86400)::bigint AS d FROM m WHERE seller_id IS NOT NULL GROUP BY 1)"
    ),
)
check(
    "l11_category_mix_adjust",
    lambda s: sellers.category_mix_adjust(s.star),
    oracle(
        f"SELECT seller_id, category, revenue, {r4('d')} AS difficulty, {r4('revenue * d')} AS adjusted_revenue FROM "
        f"(SELECT seller_id, category, {money('payment_value')} AS revenue FROM m WHERE category IS NOT NULL AND seller_id IS NOT NULL GROUP BY 1, 2) "
        f"JOIN (SELECT category, 1.0::double / ((v - a - b) / v) * ln(n) AS d FROM (SELECT category, {money('payment_value')} AS v, {money('price')} AS a, "
        f"{money('freight_value')} AS b, count(DISTINCT seller_id) AS n FROM m WHERE category IS NOT NULL GROUP BY 1)) USING (category)"
    ),
)

# --- logistics ----------------------------------------------------------------

for _suffix, _rows, _ctes, _pick in (("", "m", (), "star"), ("_scoped", "mf", MF, "scoped")):
    check(
        f"d1_logistics_kpis{_suffix}",
        lambda s, p=_pick: logistics.logistics_kpis(getattr(s, p)),
        oracle(
            f"SELECT d AS delivered_orders, n AS total_orders, {r4(pct('d', 'n'))} AS delivery_rate, {r4('a')} AS avg_delivery_time, "
            f"{r4(pct('t', 'd'))} AS on_time_rate, {r4('l')} AS avg_delay FROM (SELECT {n_orders(_DELIVERED)} AS d, {n_orders()} AS n, "
            f"{n_orders('on_time')} AS t, {mean('delivery_time')} AS a, sum(delivery_delay) FILTER (WHERE delivery_delay > 0)::double / "
            f"count(*) FILTER (WHERE delivery_delay > 0) AS l FROM {_rows})",
            *_ctes,
        ),
    )
_FLOW = (
    "fl AS (SELECT *, row_number() OVER (ORDER BY orders DESC, order_status, customer_state) AS rank FROM "
    "(SELECT order_status, customer_state, count(DISTINCT order_id) AS orders FROM m WHERE customer_state IS NOT NULL GROUP BY 1, 2 "
    "ORDER BY orders DESC, order_status, customer_state LIMIT 30))",
    "fs AS (SELECT *, min(rank) OVER (PARTITION BY order_status) AS a, min(rank) OVER (PARTITION BY customer_state) AS b FROM fl)",
    "fd AS (SELECT *, dense_rank() OVER (ORDER BY a) - 1 AS source FROM fs)",
    "fn AS (SELECT rank, order_status, customer_state, orders, source, "
    "(SELECT count(DISTINCT order_status) FROM fl) + dense_rank() OVER (ORDER BY b) - 1 AS target FROM fd)",
)
check("d2_status_flow", lambda s: logistics.status_flow(s.star), oracle("SELECT * FROM fn", *_FLOW))
check(
    "d2_flow_nodes",
    lambda s: logistics.flow_nodes(s.star),
    oracle("SELECT source AS node, order_status AS label FROM fn UNION SELECT target, customer_state FROM fn", *_FLOW),
)
check(
    "d3_status_distribution",
    lambda s: logistics.status_dist(s.star),
    oracle("SELECT order_status, count(DISTINCT order_id) AS orders FROM m GROUP BY 1"),
)


def _hist_sql(column: str, bins: int, low: str, high: str) -> str:
    return oracle(
        f"SELECT bin, {r4('lo + w * bin')} AS bin_start, {r4('lo + w * (bin + 1)')} AS bin_end, count(*) AS rows FROM "
        f"(SELECT lo, (hi - lo) / {bins} AS w, least(floor(({column} - lo) / ((hi - lo) / {bins})), {bins - 1})::bigint AS bin "
        f"FROM m, (SELECT ({low})::double AS lo, ({high})::double AS hi FROM m) WHERE {column} BETWEEN lo AND hi) GROUP BY 1, lo, w"
    ).replace("FROM m) WHERE", "FROM (SELECT max(delivery_time) AS xd, min(delivery_time) AS nd, max(processing_time) AS xp, min(processing_time) AS np FROM m)) WHERE")


check("d4_delivery_histogram", lambda s: logistics.delivery_histogram(s.star), _hist_sql("delivery_time", 30, "0", "60"))
check("d9_delivery_distribution", lambda s: logistics.delivery_distribution(s.star), _hist_sql("delivery_time", 20, "nd", "xd"))
check("d9_processing_distribution", lambda s: logistics.processing_distribution(s.star), _hist_sql("processing_time", 15, "np", "xp"))
_FAST = "count(*) FILTER (WHERE delivery_time <= 7)"
check(
    "d9_fast_share",
    lambda s: logistics.fast_share(s.star),
    oracle(
        f"SELECT a AS fast_rows, b AS delivered_rows, {r4(pct('a', 'b'))} AS fast_pct FROM (SELECT {_FAST} AS a, count(delivery_time) AS b FROM m)"
    ),
)
check(
    "d5_state_delivery",
    lambda s: logistics.state_delivery(s.star),
    oracle(
        f"SELECT customer_state, {r4(mean('delivery_time'))} AS avg_delivery_time, {r4(_RATE)} AS on_time_pct, {n_orders()} AS orders "
        "FROM m WHERE delivery_time IS NOT NULL AND customer_state IS NOT NULL GROUP BY 1 " + TOP.format("orders", "customer_state", 15)
    ),
)
_CANCELED = n_orders("order_status = 'canceled'")
for _grain, _rows in (("row", "m"), ("order", "oc")):
    check(
        f"d6_ops_kpis_{_grain}",
        lambda s, g=_grain: logistics.ops_kpis(s.star, g),
        oracle(
            f"SELECT n AS total_orders, {r4(pct('d', 'n'))} AS delivery_rate, {r4(pct('t', 'd'))} AS on_time_rate, {r4('a')} AS avg_delivery_time, "
            f"{r4(pct('x', 'n'))} AS cancellation_rate FROM (SELECT {n_orders()} AS n, count(delivered) AS d, "
            f"count(*) FILTER (WHERE on_time AND delivered IS NOT NULL) AS t, {mean('delivery_time')} AS a, {_CANCELED} AS x FROM {_rows})"
        ),
    )
_STATE_PERF = (
    f"sf AS (SELECT customer_state, {mean('delivery_time')} AS a, {_RATE} AS t, count(*) AS volume FROM m "
    "WHERE delivered IS NOT NULL AND customer_state IS NOT NULL GROUP BY 1)"
)
_PERF_COLS = f"SELECT customer_state, {r4('a')} AS avg_delivery_time, {r4('t')} AS on_time_pct, volume FROM sf"
check("d7_state_performance", lambda s: logistics.state_performance(s.star), oracle(_PERF_COLS, _STATE_PERF))
check(
    "d8_problem_states",
    lambda s: logistics.problem_states(s.star, 68.0, 0.5),
    oracle(_PERF_COLS + f" WHERE t < 68.0 OR a > (SELECT {mean('delivery_time')} FROM m) + 0.5", _STATE_PERF),
)
_HOURS = "hr AS (SELECT order_hour, count(*) AS rows FROM m GROUP BY 1)"
check("d10_hourly_rows", lambda s: logistics.hourly_rows(s.star), oracle("SELECT * FROM hr", _HOURS))
check(
    "d10_peak_hours",
    lambda s: logistics.peak_hours(s.star),
    oracle(
        f"SELECT h AS peak_hour, v AS peak_rows, {r4('x')} AS off_peak_avg, {r4('v / x')} AS peak_ratio FROM (SELECT h, v, (t - v)::double / (n - 1) AS x "
        "FROM (SELECT order_hour AS h, rows AS v FROM hr ORDER BY rows DESC, order_hour LIMIT 1), (SELECT sum(rows) AS t, count(*) AS n FROM hr))",
        _HOURS,
    ),
)
_DAYS = "dl AS (SELECT list_sort(list(delivery_time)) AS l, count(*) AS n FROM m WHERE delivery_time IS NOT NULL)"
_MEDIAN, _IQR = quantile("l", "n", 0.5), f"({quantile('l', 'n', 0.75)} - {quantile('l', 'n', 0.25)})"
check(
    "d11_sla",
    lambda s: logistics.sla_stats(s.star),
    oracle(f"SELECT n AS rows, {r4(quantile('l', 'n', 0.95))} AS p95, {r4(_MEDIAN)} AS median, {r4(_IQR)} AS iqr FROM dl", _DAYS),
)
check(
    "d12_spread",
    lambda s: logistics.spread_summary(s.star),
    oracle(
        f"SELECT n, {r4('jb')} AS jarque_bera, {r4('exp(-jb / 2)')} AS p_value, exp(-jb / 2) >= 0.05 AS is_normal, "
        f"{r4('CASE WHEN exp(-jb / 2) >= 0.05 THEN mu ELSE (SELECT ' + _MEDIAN + ' FROM dl) END')} AS center, "
        f"{r4('CASE WHEN exp(-jb / 2) >= 0.05 THEN sd ELSE (SELECT ' + _IQR + ' FROM dl) END')} AS spread FROM "
        "(SELECT n, mu, sqrt(s2 / (n - 1)) AS sd, n / 6.0::double * ((s3 / n / pow(s2 / n, 1.5)) ** 2 + (s4 / n / (s2 / n) ** 2 - 3) ** 2 / 4) AS jb FROM "
        "(SELECT count(*) AS n, any_value(mu) AS mu, sum((delivery_time - mu) ** 2) AS s2, sum((delivery_time - mu) ** 3) AS s3, sum((delivery_time - mu) ** 4) AS s4 "
        f"FROM m, (SELECT {mean('delivery_time')} AS mu FROM m) WHERE delivery_time IS NOT NULL))",
        _DAYS,
    ),
)
check(
    "d13_on_time_share",
    lambda s: s.star.orders().agg(F.sum(F.when(F.col("on_time_delivery"), F.col("rows")).otherwise(0)).alias("on_time"), F.sum("rows").alias("rows"))
    .withColumn("on_time_share", F.col("on_time") / F.col("rows") * 100),
    oracle(f"SELECT count(*) FILTER (WHERE on_time) AS on_time, count(*) AS rows, {r4(_RATE)} AS on_time_share FROM m"),
)

# --- geography ----------------------------------------------------------------

_GEO = (
    f"sm AS (SELECT state, revenue, orders, customers, population FROM (SELECT customer_state AS state, {money('payment_value')} AS revenue, "
    "count(DISTINCT order_id) AS orders, count(DISTINCT customer_unique_id) AS customers FROM m WHERE customer_state IS NOT NULL GROUP BY 1) JOIN pop USING (state))",
    "pn AS (SELECT state, customers, population, customers::double / population * 10000 AS pen FROM (SELECT customer_state AS state, "
    "count(DISTINCT customer_unique_id) AS customers FROM m WHERE customer_state IS NOT NULL GROUP BY 1) LEFT JOIN pop USING (state))",
)
_CAPITA = (
    f"SELECT state, revenue, orders, customers, population, {r4('revenue / population')} AS revenue_per_capita, "
    f"{r4('orders::double / population * 1000')} AS orders_per_1000 FROM sm "
)
check("g1_per_capita", lambda s: geo.per_capita(s.star, s.pop), oracle(_CAPITA, *_GEO))
check(
    "g1_top_raw", lambda s: geo.per_capita(s.star, s.pop, 10, "revenue"), oracle(_CAPITA + TOP.format("sm.revenue", "state", 10), *_GEO)
)
check(
    "g1_top_adjusted",
    lambda s: geo.per_capita(s.star, s.pop, 10),
    oracle(_CAPITA + TOP.format("sm.revenue / sm.population", "state", 10), *_GEO),
)
_PEN = f"SELECT state, customers, population, {r4('pen')} AS penetration FROM "
check("g2_penetration", lambda s: geo.penetration(s.star, s.pop), oracle(_PEN + "pn " + TOP.format("pen", "state", 10), *_GEO))
_TOP10 = "pt AS (SELECT * FROM pn ORDER BY pen DESC NULLS LAST, state LIMIT 10)"
check(
    "g2_low_penetration",
    lambda s: geo.low_penetration(s.star, s.pop),
    oracle(_PEN + "pt WHERE pen < (SELECT avg(pen) FROM pt) / 2", *_GEO, _TOP10),
)
check(
    "g3_penetration_per_1000",
    lambda s: geo.penetration(s.star, s.pop, 1000, None),
    oracle(_PEN.replace("(pen)", "(customers::double / population * 1000)") + "pn", *_GEO),
)
for _by, _order in (("penetration", "pen"), ("customers", "customers")):
    check(
        f"g4_market_coverage_{_by}",
        lambda s, b=_by: geo.market_coverage(s.star, s.pop, b),
        oracle(
            f"SELECT a AS active_states, {r4('g')} AS avg_penetration, k AS total_states, {r4('a::double / k * 100')} AS coverage_pct, t AS top3_customers, "
            f"n AS total_customers, {r4('t::double / n * 100')} AS concentration_pct FROM (SELECT count(*) AS a, avg(pen) AS g, (SELECT count(*) FROM pop) AS k, "
            f"(SELECT sum(customers)::bigint FROM (SELECT customers FROM pn ORDER BY {_order} DESC NULLS LAST, state LIMIT 3)) AS t, "
            "(SELECT count(DISTINCT customer_unique_id) FROM m) AS n FROM pn)",
            *_GEO,
        ),
    )
check(
    "g5_untapped",
    lambda s: geo.untapped(filters.apply_filters(s.star, states=SOME_STATES), s.pop),
    oracle(f"SELECT state, population FROM pop WHERE state NOT IN (SELECT customer_state FROM m WHERE customer_state IN ({STATE_IN}))"),
)
check(
    "g5_untapped_all",
    lambda s: geo.untapped(s.star, s.more_pop),
    oracle("SELECT state, population FROM popx WHERE state NOT IN (SELECT customer_state FROM m WHERE customer_state IS NOT NULL)", _NOWHERE),
)
_EXPAND = (
    *_GEO,
    "ex AS (SELECT state, population, coalesce(customers, 0) AS cur, greatest(0.0::double, (SELECT avg(pen) FROM pn) / 10000 * population - coalesce(customers, 0)) AS gap "
    "FROM pop LEFT JOIN (SELECT state, customers FROM pn) USING (state))",
    "ey AS (SELECT state, cur, floor(gap)::bigint AS pot, population, gap * (population / 1000000.0::double) AS score FROM ex ORDER BY score DESC, state LIMIT 10)",
)
check(
    "g6_expansion",
    lambda s: geo.expansion(s.star, s.pop),
    oracle(
        f"SELECT state, cur AS current_customers, pot AS potential_customers, population, {r4('score')} AS opportunity_score FROM ey", *_EXPAND
    ),
)
check(
    "g6_expansion_value",
    lambda s: geo.expansion_value(s.star, s.pop),
    oracle(
        f"SELECT t AS total_opportunity, {r4('v')} AS revenue_per_customer, {r4('t * v')} AS revenue_opportunity FROM (SELECT sum(pot)::bigint AS t, "
        f"{_R1} / (SELECT count(DISTINCT customer_unique_id) FROM m) AS v FROM ey)",
        *_EXPAND,
    ),
)
_SD = f"SELECT state, sellers, orders, CASE WHEN isinf(ratio) THEN ratio ELSE {r4('CASE WHEN isinf(ratio) THEN 0 ELSE ratio END')} END AS supply_demand_ratio FROM "
check("g7_supply_demand", lambda s: geo.supply_demand(s.star), oracle(_SD + "sdr", *_SUPPLY))
check(
    "g7_supply_demand_scoped",
    lambda s: geo.supply_demand(s.scoped),
    oracle(_SD + "sdr", *MF, *[c.replace("FROM m ", "FROM mf ") for c in _SUPPLY]),
)
check(
    "g7_imbalanced",
    lambda s: geo.imbalanced_states(s.star, 0.006, 100),
    oracle(_SD + "sdr WHERE ratio < 0.006 AND orders > 100", *_SUPPLY),
)
check(
    "g8_supply_demand_matched",
    lambda s: geo.supply_demand(s.scoped, "inner"),
    oracle(_SD + "sdr WHERE sellers > 0 AND orders > 0", *MF, *[c.replace("FROM m ", "FROM mf ") for c in _SUPPLY]),
)
check(
    "g8_supply_demand_matched_all",
    lambda s: geo.supply_demand(s.star, "inner"),
    oracle(_SD + "sdr WHERE sellers > 0 AND orders > 0", *_SUPPLY),
)
check(
    "g9_high_potential",
    lambda s: geo.high_potential(s.star, s.pop),
    oracle(_PEN + "pn WHERE population > 5000000 AND pen < (SELECT avg(pen) FROM pn)", *_GEO),
)
check(
    "g10_market_maturity",
    lambda s: geo.market_maturity(s.star, s.pop),
    oracle(
        "SELECT 'Mature Markets' AS market, count(*) AS states FROM pn WHERE pen > (SELECT avg(pen) FROM pn) * 1.2::double UNION ALL "
        "SELECT 'Emerging Markets', count(*) FROM pn WHERE pen < (SELECT avg(pen) FROM pn) * 0.8::double AND population > 1000000 UNION ALL "
        "SELECT 'Untapped Markets', count(*) FROM pop WHERE state NOT IN (SELECT state FROM pn)",
        *_GEO,
    ),
)
_EXPECT = (*_GEO, f"ep AS (SELECT state, revenue, population, population * (SELECT {money('revenue')} / sum(population)::double FROM sm) AS e FROM sm)")
check(
    "g11_opportunity_relative",
    lambda s: geo.opportunity_rel(s.star, s.pop),
    oracle(
        f"SELECT state, revenue, population, {r4('e')} AS expected_revenue, {r4('(e - revenue) / e')} AS opportunity_score FROM ep", *_EXPECT
    ),
)
check(
    "g12_opportunity_absolute",
    lambda s: geo.opportunity_abs(s.star, s.pop),
    oracle(
        f"SELECT state, revenue, population, {r4('e')} AS expected_revenue, {r4('revenue / e')} AS penetration_rate, "
        f"{r4('(1 - revenue / e) * e')} AS opportunity_score FROM ep",
        *_EXPECT,
    ),
)
check(
    "g13_bias_reduction",
    lambda s: geo.bias_reduction(s.star, s.pop),
    oracle(
        f"SELECT {r4('a')} AS raw_correlation, {r4('b')} AS adjusted_correlation, {r4('abs(a) - abs(b)')} AS bias_reduction, "
        f"{r4('(abs(a) - abs(b)) / abs(a) * 100')} AS effectiveness_pct, abs(a) - abs(b) > 0 AS reduced FROM "
        "(SELECT corr(population, revenue) AS a, corr(population, revenue / population) AS b FROM sm)",
        *_GEO,
    ),
)

# --- portfolio ----------------------------------------------------------------

_PRODUCT = (
    f"ps AS (SELECT product_id, count(DISTINCT order_id) AS units, {money('payment_value')} AS revenue, {mean('review_score')} AS rating "
    "FROM m WHERE product_id IS NOT NULL GROUP BY 1)"
)
check(
    "p1_product_kpis",
    lambda s: portfolio.product_kpis(s.star),
    oracle(
        f"SELECT count(*) AS total_products, (SELECT count(DISTINCT category) FROM m) AS total_categories, {r4('avg(rating)')} AS avg_product_rating FROM ps",
        _PRODUCT,
    ),
)
check(
    "p2_product_sales",
    lambda s: portfolio.product_sales(s.star),
    oracle(f"SELECT product_id, units AS units_sold, revenue, {r4('rating')} AS avg_rating FROM ps", _PRODUCT),
)
check(
    "p3_slow_movers",
    lambda s: portfolio.slow_movers(s.star, SLOW_BELOW),
    oracle(
        f"SELECT n AS total_products, k AS slow_movers, {r4(pct('k', 'n'))} AS slow_pct, CASE WHEN {pct('k', 'n')} > 30 THEN 'red' "
        f"WHEN {pct('k', 'n')} > 20 THEN 'yellow' ELSE 'green' END AS level FROM "
        f"(SELECT count(*) AS n, count(*) FILTER (WHERE units < {SLOW_BELOW}) AS k FROM ps)",
        _PRODUCT,
    ),
)
_CATEGORY = (
    f"cg AS (SELECT category, {money('payment_value')} AS revenue, count(DISTINCT order_id) AS orders, {mean('review_score')} AS rating, "
    "count(DISTINCT product_id) AS skus FROM m WHERE category IS NOT NULL GROUP BY 1 ORDER BY revenue DESC, category LIMIT 15)"
)
_CAT_COLS = f"category, revenue, orders, {r4('rating')} AS avg_rating, skus AS sku_count, {r4('revenue / skus')} AS revenue_per_sku"
check("p4_category_metrics", lambda s: portfolio.category_metrics(s.star), oracle(f"SELECT {_CAT_COLS} FROM cg", _CATEGORY))
check(
    "p5_portfolio_matrix",
    lambda s: portfolio.bcg(s.star),
    oracle(
        f"SELECT {_CAT_COLS}, CASE WHEN revenue > mr AND orders > mo THEN 'Stars' WHEN revenue > mr THEN 'Cash Cows' "
        "WHEN orders > mo THEN 'Question Marks' ELSE 'Dogs' END AS position FROM cg, (SELECT median(revenue) AS mr, median(orders) AS mo FROM cg)",
        _CATEGORY,
    ),
)
check(
    "p6_quality_tiers",
    lambda s: portfolio.quality_tiers(s.star),
    oracle(
        f"SELECT category, revenue, {r4('rating')} AS avg_rating, CASE WHEN rating <= 0 THEN NULL WHEN rating <= 3.5 THEN 'Poor' WHEN rating <= 4 THEN 'Fair' "
        "WHEN rating <= 4.5 THEN 'Good' WHEN rating <= 5 THEN 'Excellent' END AS quality_tier, rating < 3.5 AS low_quality, rating > 4.5 AS high_quality FROM cg",
        _CATEGORY,
    ),
)
for _grain, _sql in (
    ("row", "SELECT order_id, count(product_id) AS products FROM m GROUP BY 1"),
    ("item", "SELECT order_id, count(product_id) AS products FROM o LEFT JOIN i USING (order_id) GROUP BY 1"),
):
    check(
        f"p7_products_per_order_{_grain}",
        lambda s, g=_grain: portfolio.products_per_order(s.star, g),
        oracle(f"SELECT products, count(*) AS orders FROM ({_sql}) GROUP BY 1"),
    )
    check(
        f"p7_cross_sell_{_grain}",
        lambda s, g=_grain: portfolio.cross_sell(s.star, g),
        oracle(
            f"SELECT count(*) AS orders, count(*) FILTER (WHERE products > 1) AS multi_product_orders, "
            f"{r4(pct('count(*) FILTER (WHERE products > 1)', 'count(*)'))} AS cross_sell_rate FROM ({_sql})"
        ),
    )
_PRICE_LABELS = ["Very Low", "Low", "Medium", "High", "Premium"]
_PRICES = f"pp AS (SELECT product_id, {money('price')} / count(price) AS v, count(DISTINCT order_id) AS orders FROM m WHERE product_id IS NOT NULL GROUP BY 1)"
check(
    "p8_price_tiers",
    lambda s: portfolio.price_tiers(s.star),
    oracle(
        f"SELECT level, label AS tier, n AS products, q AS orders, {r4('v')} AS avg_price, "
        "row_number() OVER (ORDER BY q DESC, level) = 1 AS is_best FROM (SELECT level, label, count(*) AS n, sum(orders)::bigint AS q, avg(v) AS v FROM qb GROUP BY 1, 2)",
        _PRICES,
        *_binned("pp", "v", 5, _PRICE_LABELS),
    ),
)
check(
    "p9_price_ranges",
    lambda s: portfolio.price_ranges(s.star),
    oracle(
        "SELECT level, label AS tier, count(*) AS rows, min(price) AS min_price, max(price) AS max_price FROM qb GROUP BY 1, 2",
        *_binned("m", "price", 5, _PRICE_LABELS),
    ),
)
check(
    "p10_revenue_per_product",
    lambda s: portfolio.revenue_per_product(s.star),
    oracle(
        f"SELECT v AS product_revenue, n AS products_sold, k AS distinct_products, {r4('v / n')} AS revenue_per_product, {r4('v / k')} AS revenue_per_sku FROM "
        f"(SELECT {money('price')} AS v, count(product_id) AS n, count(DISTINCT product_id) AS k FROM i)"
    ),
)

# --- quality ------------------------------------------------------------------

_PROFILED = ("order_id", "product_id", "payment_value", "review_score", "delivery_time", CATEGORY, "order_delivered_customer_date")
_PROFILED_SQL = ("order_id", "product_id", "payment_value", "review_score", "delivery_time", "category", "delivered")
check(
    "q1_null_profile",
    lambda s: quality.null_profile(master(s.t).select(*_PROFILED)),
    oracle(
        " UNION ALL ".join(
            f"SELECT '{n}' AS \"column\", {r4(f'avg(CASE WHEN {c} IS NULL THEN 100.0::double ELSE 0.0 END)')} AS null_pct FROM m"
            for n, c in zip(_PROFILED, _PROFILED_SQL)
        )
    ),
)
# All joined columns; the view of the SQL side has some under other names, and some that are null with another one.
_SAME_NULLS = {
    "order_purchase_timestamp": "ts", "order_approved_at": "approved", "order_delivered_carrier_date": "carrier",
    "order_delivered_customer_date": "delivered", "order_estimated_delivery_date": "estimated", CATEGORY: "category", "on_time_delivery": "on_time",
    "order_item_id": "price", "shipping_limit_date": "price", "payment_sequential": "payment_value", "review_creation_date": "review_score",
    "review_answer_timestamp": "review_score",
}
_JOINED = (
    "order_id", "customer_id", "seller_id", "product_id", "order_status", "order_item_id", "shipping_limit_date", "price", "freight_value",
    "product_category_name", "seller_state", "customer_unique_id", "customer_state", "payment_sequential", "payment_type", "payment_value",
    "review_score", "review_creation_date", "review_answer_timestamp", "delivery_time", "estimated_delivery_time", "delivery_delay",
    "order_month", "order_week", "order_date", "order_hour", "order_dayofweek", "order_year", "order_quarter", "processing_time", "fulfilment_time",
    *(c for c in _SAME_NULLS if c.startswith(("order_purchase", "order_approved", "order_delivered", "order_estimated", CATEGORY, "on_time"))),
)
check(
    "q1_null_profile_all",
    lambda s: quality.null_profile(master(s.t)),
    oracle(
        " UNION ALL ".join(
            f"SELECT '{n}' AS \"column\", {r4(f'avg(CASE WHEN {_SAME_NULLS.get(n, n)} IS NULL THEN 100.0::double ELSE 0.0 END)')} AS null_pct FROM m"
            for n in _JOINED
        )
    ),
)
check(
    "q2_duplicates",
    lambda s: quality.joined_duplicates(s.star),
    oracle("SELECT count(*) AS rows, count(DISTINCT order_id) AS distinct_keys, count(*) - count(DISTINCT order_id) AS duplicates FROM m"),
)
check(
    "q2_duplicate_products",
    lambda s: quality.dup_count(s.t.orders, "order_delivered_customer_date"),
    oracle(
        "SELECT count(*) AS rows, k AS distinct_keys, count(*) - k AS duplicates FROM o, "
        "(SELECT count(*) AS k FROM (SELECT DISTINCT delivered FROM o)) GROUP BY k"
    ),
)
check(
    "q3_revenue_check",
    lambda s: quality.revenue_check(s.star),
    oracle(f"SELECT {money('price + freight_value')} AS item_revenue FROM m"),
)
check(
    "q4_reconcile",
    lambda s: quality.reconcile(s.star),
    oracle(
        f"SELECT a AS product_revenue, b AS freight_revenue, t AS total_revenue, {r4('t - (a + b)')} AS other_charges, t AS calculated_total, true AS balanced FROM "
        f"(SELECT (SELECT {money('price')} FROM i) AS a, (SELECT {money('freight_value')} FROM i) AS b, {_R1} AS t)"
    ),
)
check(
    "q5_required_columns",
    lambda s: quality.require_columns(s.t.orders, ["order_id", "order_status"]).groupBy("order_status").agg(
        F.count(F.lit(1)).alias("orders")
    ),
    oracle("SELECT order_status, count(*) AS orders FROM o GROUP BY 1"),
)
check(
    "q6_fanout",
    lambda s: quality.fanout_report(s.star),
    oracle(
        f"SELECT step::bigint AS step, stage, rows, f AS fanned_revenue, s1 AS source_revenue, {r4('f / s1')} AS inflation FROM ("
        "SELECT 1 AS step, 'orders' AS stage, count(*) AS rows FROM o UNION ALL SELECT 2, 'items', count(*) FROM o LEFT JOIN i USING (order_id) "
        "UNION ALL SELECT 3, 'payments', count(*) FROM o LEFT JOIN i USING (order_id) LEFT JOIN p USING (order_id) "
        f"UNION ALL SELECT 4, 'reviews', count(*) FROM m), (SELECT {_R2} AS f, {_R1} AS s1)"
    ),
)

# --- alerts -------------------------------------------------------------------


def _metric_sql(*pairs: tuple[str, str]) -> str:
    return "mt AS (" + " UNION ALL ".join(f"SELECT '{n}' AS metric, ({q})::double AS value" for n, q in pairs) + ")"


def _sql_number(x: float) -> str:
    return f"'{'-' if x < 0 else ''}Infinity'::double" if x in (float("inf"), float("-inf")) else f"{x}::double"


_RULES = "rl AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{p}', '{m_}', {_sql_number(lo)}, {op}, {_sql_number(hi)}, '{lv}', '{al}')"
    for p, m_, lo, op, hi, lv, al in [(p, m_, lo, "false", hi, lv, al) for p, m_, lo, hi, lv, al in alerts.RULES]
    + [(p, m_, lo, "true", float("inf"), lv, al) for p, m_, lo, lv, al in alerts.RULES_ABOVE]
) + ") AS v(page, metric, low, low_open, high, level, alert))"
_FIRED = (
    f"SELECT page, metric, {r4('value')} AS value, level, alert FROM mt JOIN rl USING (metric) WHERE value IS NOT NULL AND "
    "(CASE WHEN low_open THEN value > low ELSE value >= low END) AND (high = 'Infinity'::double OR value < high)"
)
_ROW_RATE = f"SELECT {pct('count(*) FILTER (WHERE on_time)', 'count(delivered)')} FROM m"
_REVIEW = f"SELECT {mean('first_score')} FROM o LEFT JOIN r1 USING (order_id)"
_METRICS = {
    "executive": (
        ("avg_review_score", _REVIEW),
        ("row_on_time_rate", _ROW_RATE),
        ("operations_healthy", f"SELECT CASE WHEN ({_ROW_RATE}) >= 90 AND ({_REVIEW}) >= 4.2 THEN 1 ELSE 0 END"),
        ("on_time_rate", f"SELECT {pct(n_orders('on_time'), n_orders('delivered IS NOT NULL'))} FROM m"),
        ("delivery_rate", f"SELECT {pct(n_orders(_DELIVERED), n_orders())} FROM m"),
        (
            "last_growth_pct",
            "SELECT (revenue - pr) / pr * 100 FROM (SELECT *, lag(revenue) OVER (ORDER BY order_month) AS pr FROM mr) ORDER BY order_month DESC LIMIT 1",
        ),
        ("top_state_pct", f"SELECT max(revenue) / {_R1} * 100 FROM st"),
    ),
    "finance": (
        ("dominant_payment_pct", "SELECT share FROM pm WHERE rank = 1"),
        ("low_margin_categories", "SELECT count(*) FROM cm10 WHERE margin < 10"),
    ),
    "marketing": (
        ("repeat_rate", f"SELECT {pct('count(*) FILTER (WHERE n > 1)', 'count(*)')} FROM rc"),
        ("ltv_cac", f"SELECT {_LTV} / 45 FROM cv"),
        ("at_risk_pct", "SELECT nullif(count(*) FILTER (WHERE segment = 'At Risk'), 0)::double / count(*) * 100 FROM sg"),
        ("champion_pct", "SELECT nullif(count(*) FILTER (WHERE segment = 'Champions'), 0)::double / count(*) * 100 FROM sg"),
        ("avg_days_to_second", f"SELECT {mean('d')} FROM td"),
        ("low_penetration_states", "SELECT count(*) FROM pt WHERE pen < (SELECT avg(pen) FROM pt) / 2"),
    ),
    "operations": (
        ("cancellation_rate", f"SELECT {pct(_CANCELED, n_orders())} FROM m"),
        ("avg_delivery_time", f"SELECT {mean('delivery_time')} FROM m"),
        ("problem_states", f"SELECT count(*) FROM sf WHERE t < 80 OR a > (SELECT {mean('delivery_time')} FROM m) + 5"),
        ("fast_pct", f"SELECT {pct(_FAST, 'count(delivery_time)')} FROM m"),
        ("avg_processing_time", f"SELECT {mean('processing_time')} FROM m"),
    ),
    "portfolio": (
        ("slow_pct", f"SELECT {pct(f'count(*) FILTER (WHERE units < {SLOW_BELOW})', 'count(*)')} FROM ps"),
        ("avg_product_rating", "SELECT avg(rating) FROM ps"),
        ("dog_categories", "SELECT count(*) FROM cg, (SELECT median(revenue) AS a, median(orders) AS b FROM cg) WHERE revenue <= a AND orders <= b"),
        ("low_quality_categories", "SELECT count(*) FROM cg WHERE rating < 3.5"),
        ("high_quality_categories", "SELECT count(*) FROM cg WHERE rating > 4.5"),
        ("cross_sell_rate", f"SELECT {pct('count(*) FILTER (WHERE k > 1)', 'count(*)')} FROM (SELECT count(product_id) AS k FROM m GROUP BY order_id)"),
    ),
    "growth": (
        ("emerging_states", "SELECT count(*) FROM pn WHERE pen < (SELECT avg(pen) FROM pn) * 0.8::double AND population > 1000000"),
        ("untapped_states", "SELECT count(*) FROM pop WHERE state NOT IN (SELECT state FROM pn)"),
        (
            "concentration_pct",
            "SELECT sum(customers)::double / (SELECT count(DISTINCT customer_unique_id) FROM m) * 100 FROM (SELECT customers FROM pn ORDER BY pen DESC NULLS LAST, state LIMIT 3)",
        ),
        ("high_potential_states", "SELECT count(*) FROM pn WHERE population > 5000000 AND pen < (SELECT avg(pen) FROM pn)"),
        ("imbalanced_states", "SELECT count(*) FROM sdr WHERE ratio < 0.001 AND orders > 100"),
    ),
}
_METRIC_VIEWS = {
    "executive": (_STATES, _MONTH_R1),
    "finance": (*_MIX, *_MARGIN),
    "marketing": (_REPEAT.format("m"), *_segments(TEST_RULES), *_second("m"), *_GEO, _TOP10),
    "operations": (_STATE_PERF,),
    "portfolio": (_PRODUCT, _CATEGORY),
    "growth": (*_GEO, *_SUPPLY),
}
_METRIC_BUILDERS = {
    "executive": lambda s: alerts.executive_metrics(s.star),
    "finance": lambda s: alerts.finance_metrics(s.star),
    "marketing": lambda s: alerts.marketing_metrics(s.star, s.pop, TEST_RULES),
    "operations": lambda s: alerts.operations_metrics(s.star),
    "portfolio": lambda s: alerts.portfolio_metrics(s.star, SLOW_BELOW),
    "growth": lambda s: alerts.growth_metrics(s.star, s.pop),
}
for _page, _build in _METRIC_BUILDERS.items():
    check(
        f"q7_alerts_{_page}",
        lambda s, b=_build: alerts.alerts(b(s), alerts.default_rules(s.spark)),
        oracle(_FIRED, *_METRIC_VIEWS[_page], _metric_sql(*_METRICS[_page]), _RULES),
    )

# --- scenarios ----------------------------------------------------------------


def _plan_sql(source: str, rows: list[tuple[str, str, int, str]], *ctes: str) -> str:
    """Four initiatives with invested amount and return, and their total."""
    parts = [
        f"SELECT {i}::bigint AS position, '{n}' AS initiative, '{t}' AS timeline, {v}::double AS inv, ({x})::double AS ret FROM ({source})"
        for i, (n, t, v, x) in enumerate(rows, 1)
    ]
    return oracle(
        f"SELECT position, initiative, timeline, inv AS investment, {r4('ret')} AS expected_return, {r4('(ret - inv) / inv * 100')} AS roi_pct "
        "FROM (SELECT * FROM pl UNION ALL SELECT 5, 'Total', NULL, sum(inv), sum(ret) FROM pl)",
        *ctes,
        "pl AS (" + " UNION ALL ".join(parts) + ")",
    )


check(
    "q8_roi_marketing",
    lambda s: scenarios.roi_marketing(s.star, rules=TEST_RULES),
    _plan_sql(
        f"SELECT count(*) AS n, {_LTV} AS ltv, count(*) FILTER (WHERE segment = 'At Risk') AS k FROM sg",
        [
            ("Loyalty Program", "6 months", 500000,
             "floor(n * 0.30::double) * (ltv * (1.8::double - 1)) - floor(n * 0.30::double) * 25 + 500000"),
            ("Geographic Expansion", "4 months", 300000, "10000 * (ltv * 0.85::double) - 10000 * 45 * (1 - 0.15::double)"),
            ("Customer Segmentation Platform", "3 months", 200000,
             "floor(k * 0.20::double) * ltv + n * ltv * 0.15::double + 50000"),
            ("Retention Campaigns", "2 months", 150000, "n * 0.12::double * 85 * 12 - n * 2.5::double * 12"),
        ],
        *_segments(TEST_RULES),
    ),
)
check(
    "q9_roi_operations",
    lambda s: scenarios.roi_operations(s.star),
    _plan_sql(
        f"SELECT {n_orders()} * 4.0::double AS y FROM m",
        [
            ("Regional Distribution Centers", "12 months", 2000000, "y * 8.5::double + y * 2.5::double + 800000"),
            ("Warehouse Automation", "8 months", 800000,
             "400000 + y * 1.8::double * 0.3::double + y * 0.5::double * 0.4::double - 50000"),
            ("Logistics Partnership Optimization", "4 months", 200000, "y * 3.2::double + y * 1.2::double * (10.0::double / 100) - 30000"),
            ("Process Digitization", "6 months", 300000, "2.0::double * 25 * 250 * 8 + y * 0.75::double - 40000"),
        ],
    ),
)
check(
    "q10_roi_inventory",
    lambda s: scenarios.roi_inventory(s.star, slow_below=SLOW_BELOW),
    _plan_sql(
        f"SELECT (SELECT count(*) FROM ps WHERE units < {SLOW_BELOW}) AS k, {_R2} * 4 AS y",
        [
            ("SKU Rationalization Program", "6 months", 300000,
             "floor(k * 0.60::double) * 150 * 0.25::double + y * 0.02::double * 0.15::double"),
            ("Quality Improvement Initiative", "8 months", 400000, "y * 0.12::double + y * 0.03::double * 0.40::double"),
            ("Product Bundle Strategy", "4 months", 250000,
             "y * 0.15::double * (1.35::double - 1) + y * 0.15::double * (1.35::double - 1) * 0.18::double"),
            ("Category Expansion Plan", "12 months", 500000, "3 * 800000 * 0.05::double"),
        ],
        _PRODUCT,
    ),
)
check(
    "q11_roi_growth",
    lambda s: scenarios.roi_growth(s.star),
    _plan_sql(
        f"SELECT count(DISTINCT customer_unique_id) AS n, {money('payment_value')} * 4 AS y FROM m",
        [
            ("State Expansion Program", "12 months", 1500000, "10000 * 165.0::double - 10000 * 35"),
            ("Seller Partnership Network", "8 months", 800000, "150 * 50000 * 0.75::double * 0.08::double - 150 * 2500"),
            ("Digital Marketing Campaigns", "6 months", 600000, "15000 * 120 * (1 + 0.30::double)"),
            ("Logistics Infrastructure", "18 months", 2000000, "y * 0.12::double * 0.15::double + n * 15 * 0.18::double"),
        ],
    ),
)
