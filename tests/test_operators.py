"""Hand-worked answers on small tables."""

import pytest
from pyspark.sql import functions as F

from conftest import order, review
from mercato import Star, population
from mercato.operators import (
    alerts,
    customers,
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


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- executive and revenue


def test_exec_kpis(star, one):
    got = one(kpi.exec_kpis(star))
    assert got == dict(total_revenue=125.0, total_orders=5, total_customers=3, total_sellers=3, avg_order_value=25.0)
    # A: 33 x 2 items x 2 reviews, B: 50, D: 18 x 2 items, E: 24
    assert one(kpi.exec_kpis(star, "fanned"))["total_revenue"] == 132 + 50 + 36 + 24


def test_empty_catalog(build, one):
    empty = Star(build())
    assert one(kpi.exec_kpis(empty))["avg_order_value"] == 0.0
    assert one(kpi.avg_review(empty))["avg_review_score"] == 0.0
    assert one(kpi.on_time_rate(empty))["on_time_rate"] == 0.0
    assert rows(revenue.monthly_revenue(empty)) == []
    assert rows(revenue.mom_growth(empty)) == []
    assert one(kpi.median_order_value(empty))["median_order_value"] is None


def test_on_time_bases(star, one):
    assert one(kpi.on_time_rate(star))["on_time_rate"] == pytest.approx(200 / 3)
    assert one(kpi.on_time_rate(star, "row"))["on_time_rate"] == pytest.approx(900 / 13)
    assert one(kpi.on_time_rate(star, "row", "all"))["on_time_rate"] == pytest.approx(60.0)


def test_monthly_revenue(star):
    assert rows(revenue.monthly_revenue(star)) == [("2018-01", 33.0), ("2018-02", 50.0), ("2018-03", 42.0)]
    assert rows(revenue.monthly_revenue(star, "first")) == [("2018-01", 20.0), ("2018-02", 50.0), ("2018-03", 24.0)]


def test_mom_growth_uses_the_calendar_month(build, one):
    t = build(
        orders=[order("1", "a", day=0), order("2", "a", day=70)],
        order_payments=[("1", 1, "x", 10.0), ("2", 1, "x", 30.0)],
    )
    got = one(revenue.mom_growth(Star(t)))
    assert (got["current_month"], got["previous_month"], got["growth_pct"]) == ("2018-03", "2018-02", 0.0)
    assert one(revenue.last_growth(Star(t)))["growth_pct"] == pytest.approx(200.0)


def test_waterfall_adds_up(star):
    parts = {r.component: r.amount for r in revenue.waterfall(star).collect()}
    total = parts.pop("Total Revenue")
    assert total == 125.0 and sum(parts.values()) == pytest.approx(total)


def test_fanned_payment_types_drop_null(star):
    assert sorted(rows(revenue.revenue_by_payment_type(star))) == [("card", 116.0), ("slip", 50.0), ("voucher", 52.0)]


def test_payment_mix(star, one, toy):
    mix = rows(revenue.payment_mix(toy).select("payment_type", "revenue", "transactions", "rank"))
    assert mix == [("slip", 50.0, 1, 1), ("card", 38.0, 2, 2), ("voucher", 13.0, 1, 3)]
    got = one(revenue.payment_leaders(toy))
    assert (got["dominant_type"], got["dominant_pct"], got["highest_avg_type"]) == ("slip", 40.0, "slip")


def test_category_margin(star):
    got = {r.category: r.margin_pct for r in revenue.category_margin(star).collect()}
    # books: payments 33 x 2 + 18, price (10 x 4 + 12 x 2), freight (1 x 4 + 1 x 2)
    assert got["books"] == pytest.approx((84 - 64 - 6) / 84 * 100)


def test_moving_average_needs_a_full_window(spark):
    df = spark.createDataFrame([("1", 3.0), ("2", 6.0), ("3", 9.0), ("4", 0.0)], "order_month string, revenue double")
    got = trends.moving_average(df).orderBy("order_month").collect()
    assert [r.moving_avg for r in got] == [None, None, 6.0, 5.0]
    assert got[2].ratio_to_avg == 1.5


def test_seasonal_factors(spark):
    df = spark.createDataFrame([("2017-01", 10.0), ("2018-01", 30.0), ("2018-02", 20.0)], "order_month string, revenue double")
    got = {r.order_month: (r.seasonal_factor, r.adjusted_revenue) for r in trends.seasonal_adjust(df).collect()}
    assert got == {"2017-01": (1.0, 10.0), "2018-01": (1.0, 30.0), "2018-02": (1.0, 20.0)}


# --- customers


def test_repeat_rate_drops_unknown_customers(star, one):
    assert one(customers.repeat_rate(star)) == dict(total_customers=3, repeat_customers=1, repeat_rate=pytest.approx(100 / 3))


def test_nps_bases_differ(star, one):
    got = {b: one(customers.nps(star, b)) for b in ("order", "first", "row")}
    assert [got[b]["nps"] for b in ("order", "first", "row")] == pytest.approx([50.0, 0.0, 100 * (4 + 4 - 4) / 12])
    assert got["order"]["band"] == "Excellent"
    with pytest.raises(ValueError):
        customers.nps(star, "else")


def test_cohorts(build):
    t = build(
        orders=[order("1", "a", day=0), order("2", "b", day=5), order("3", "b", day=65), order("4", "b", day=66), order("5", "c", day=40)],
        customers=[(c, c, "SP") for c in "abc"],
    )
    star = Star(t)
    assert rows(customers.cohorts(star)) == [("2018-01", 0, 2), ("2018-01", 2, 1), ("2018-02", 0, 1)]
    long = customers.retention(star).collect()
    assert {(r.cohort, r.cohort_index): r.retention_pct for r in long} == {
        ("2018-01", 0): 100.0, ("2018-01", 2): 50.0, ("2018-02", 0): 100.0,
    }
    assert rows(customers.retention_matrix(star, [0, 1, 2])) == [("2018-01", 100.0, None, 50.0), ("2018-02", 100.0, None, None)]
    assert set(customers.retention_matrix(star).columns) == {"cohort", "m0", "m2"}
    assert sum(r.customers for r in customers.cohorts(star, "day").collect() if r.cohort_index == 0) == 3


def _shopper(name, orders, last_day, spent):
    days = [last_day - i for i in range(orders)]
    return [(f"{name}{i}", name, d, spent / orders) for i, d in enumerate(days)]


def test_rfm_rules_on_their_edges(build):
    people = {
        "champion": (3, 100, 501.0), "not_champion": (3, 100, 500.0), "loyal": (2, 241, 10.0), "not_loyal": (2, 240, 10.0),
        "potential": (1, 211, 301.0), "new": (1, 210, 301.0), "risk": (1, 119, 10.0), "edge": (1, 120, 10.0), "newest": (1, 300, 1.0),
    }
    bought = [b for name, (n, day, spent) in people.items() for b in _shopper(name, n, day, spent)]
    t = build(
        orders=[order(k, name, day=d) for k, name, d, _ in bought],
        order_payments=[(k, 1, "x", v) for k, _, _, v in bought],
        customers=[(name, name, "SP") for name in people],
    )
    got = {r.customer_unique_id: (r.recency_days, r.segment) for r in customers.rfm_segments(Star(t)).collect()}
    assert got == {
        "champion": (200, "Champions"), "not_champion": (200, "At Risk"), "loyal": (59, "Loyal Customers"),
        "not_loyal": (60, "Need Attention"), "potential": (89, "Potential Loyalists"), "new": (90, "New Customers"),
        "risk": (181, "At Risk"), "edge": (180, "New Customers"), "newest": (0, "New Customers"),
    }
    counts = customers.segment_counts(Star(t)).collect()
    assert sum(r.customers for r in counts) == len(people) and sum(r.share_pct for r in counts) == pytest.approx(100)


def test_second_purchase(build, one):
    gaps = {"a": 0, "b": 30, "c": 31, "d": 365, "e": 366}
    t = build(
        orders=[order(f"{c}{i}", c, day=i * g) for c, g in gaps.items() for i in (0, 1)]
        + [order("f0", "f", day=3), order("g0", "g", day=1), order("c9", "c", day=500)],
        order_items=[("g0", "p", "s", None, 1.0, 1.0)] * 2,
        customers=[(c, c, "SP") for c in "abcdefg"],
    )
    star = Star(t)
    by_order = {r.customer_unique_id: r.days_to_second for r in customers.time_to_second(star, "order").collect()}
    assert by_order == gaps
    by_row = {r.customer_unique_id: r.days_to_second for r in customers.time_to_second(star).collect()}
    assert by_row == {**gaps, "g": 0}
    bins = {r.bin: r.customers for r in customers.second_purchase_bins(star, "order").collect()}
    assert bins == {"0-30 days": 2, "31-60 days": 1, "181-365 days": 1, "365+ days": 1}
    assert one(customers.second_purchase_summary(star, "order")) == dict(
        repeat_customers=5, avg_days=pytest.approx(792 / 5), quick_customers=2, quick_pct=40.0
    )


def test_value_bands_leave_out_zero(star):
    got = {r.segment: r.customers for r in customers.value_bands(star, (0, 40, 60, 100, float("inf"))).collect()}
    # ca 132, ca2 36, cb 50, cc 0, nobody 24
    assert got == {"Low": 2, "Medium": 1, "VIP": 1}


def test_ltv_cac_status(star, one):
    assert one(customers.ltv_cac(star, 20))["status"] == "Good performance"
    assert one(customers.ltv_cac(star))["status"] == "Below target"


# --- sellers, logistics


def test_seller_table(star):
    got = {r.seller_id: (r.revenue, r.orders, r.avg_review, r.on_time_pct) for r in sellers.seller_performance(star).collect()}
    # s1 sells in A (4 joined rows per item), C and D (2 joined rows per item)
    assert got["s1"] == (33 * 2 + 0 + 18, 3, pytest.approx((2 * 6 + 2 * 4) / 6), pytest.approx(400 / 7))
    assert set(got) == {"s1", "s2", "s3"}


def test_seller_segments(build):
    keys = [f"s{i:02d}" for i in range(20)]
    t = build(
        orders=[order(k, "c") for k in keys],
        order_items=[(k, "p", k, None, 1.0, 0.0) for k in keys],
        order_payments=[(k, 1, "x", float(i)) for i, k in enumerate(keys)],
    )
    got = {r.segment: r.sellers for r in sellers.segment_summary(Star(t)).collect()}
    assert got == {"Bottom 25%": 5, "Middle 50%": 10, "Top 25%": 4, "Top 5%": 1}


def test_delivery_rate_may_pass_one_hundred(star, one):
    assert one(logistics.ops_kpis(star))["delivery_rate"] == 260.0
    assert one(logistics.ops_kpis(star, "order"))["delivery_rate"] == 60.0


def test_logistics_kpis(star, one):
    got = one(logistics.logistics_kpis(star))
    assert got["delivery_rate"] == 60.0 and got["avg_delay"] == 2.0
    assert got["on_time_rate"] == pytest.approx(200 / 3)
    assert got["avg_delivery_time"] == pytest.approx((8 * 5 + 4 * 12 + 10) / 13)


def test_status_flow_nodes(star):
    flow = logistics.status_flow(star).collect()
    assert [(r.order_status, r.customer_state, r.orders) for r in flow] == [("delivered", "SP", 2), ("shipped", "AC", 1)]
    assert [(r.source, r.target) for r in flow] == [(0, 2), (1, 3)]
    assert rows(logistics.flow_nodes(star)) == [(0, "delivered"), (1, "shipped"), (2, "SP"), (3, "AC")]


def test_normal_spread_uses_mean(build, one):
    # A symmetric, bell-like spread of days passes; a two-pointed one does not.
    bell = [d for d, n in ((1, 1), (2, 4), (3, 6), (4, 4), (5, 1)) for _ in range(n)]
    odd = [1] * 30 + [50]
    for days, normal in ((bell, True), (odd, False)):
        t = build(orders=[order(str(i), "c", day=0, delivered=float(d)) for i, d in enumerate(days)])
        got = one(logistics.spread_summary(Star(t)))
        assert got["is_normal"] is normal
        assert got["center"] == (3.0 if normal else 1.0)


# --- geography


@pytest.fixture(scope="module")
def places(build):
    t = build(
        orders=[order("1", "a"), order("2", "b"), order("3", "c"), order("4", "d")],
        order_items=[("1", "p", "s1", None, 1.0, 1.0), ("2", "p", "s2", None, 1.0, 1.0), ("3", "p", "s1", None, 1.0, 1.0)],
        order_payments=[(str(i), 1, "x", 10.0 * i) for i in (1, 2, 3, 4)],
        customers=[("a", "a", "AA"), ("b", "b", "AA"), ("c", "c", "BB"), ("d", "d", "XX")],
        sellers=[("s1", "AA"), ("s2", "CC")],
    )
    return Star(t)


@pytest.fixture(scope="module")
def pop(spark):
    return population(spark, {"AA": 10_000, "BB": 20_000, "CC": 6_000_000})


def test_supply_and_demand(places):
    full = {r.state: (r.sellers, r.orders, r.supply_demand_ratio) for r in geo.supply_demand(places).collect()}
    assert full == {"AA": (1, 2, 0.5), "BB": (0, 1, 0.0), "CC": (1, 0, float("inf")), "XX": (0, 1, 0.0)}
    assert [r.state for r in geo.supply_demand(places, "inner").collect()] == ["AA"]
    assert [r.state for r in geo.imbalanced_states(places, 0.1, 0).collect()] == ["BB", "XX"]


def test_penetration_and_untapped(places, pop, one):
    assert rows(geo.penetration(places, pop)) == [("AA", 2, 10_000, 2.0), ("BB", 1, 20_000, 0.5), ("XX", 1, None, None)]
    assert [r.state for r in geo.untapped(places, pop).collect()] == ["CC"]
    got = one(geo.market_coverage(places, pop))
    assert (got["active_states"], got["total_states"], got["avg_penetration"]) == (3, 3, 1.25)
    assert got["concentration_pct"] == 100.0
    assert rows(geo.low_penetration(places, pop)) == [("BB", 1, 20_000, 0.5)]
    assert rows(geo.market_maturity(places, pop)) == [("Mature Markets", 1), ("Emerging Markets", 0), ("Untapped Markets", 1)]


def test_expansion(places, pop, one):
    got = {r.state: (r.current_customers, r.potential_customers) for r in geo.expansion(places, pop).collect()}
    assert got == {"AA": (2, 0), "BB": (1, 1), "CC": (0, 750)}
    value = one(geo.expansion_value(places, pop))
    assert value["total_opportunity"] == 751 and value["revenue_opportunity"] == pytest.approx(751 * 25.0)


def test_unknown_population_is_dropped_per_capita(places, pop):
    assert [(r.state, r.revenue_per_capita) for r in geo.per_capita(places, pop).collect()] == [("AA", 0.003), ("BB", 0.0015)]


# --- portfolio, quality


def test_cross_sell_counts_joined_rows(star, one):
    assert one(portfolio.cross_sell(star))["cross_sell_rate"] == 40.0
    assert rows(portfolio.products_per_order(star)) == [(0, 1), (1, 2), (4, 1), (8, 1)]
    assert rows(portfolio.products_per_order(star, "item")) == [(0, 1), (1, 2), (2, 2)]


def test_slow_movers(star, one):
    assert one(portfolio.slow_movers(star)) == dict(total_products=4, slow_movers=2, slow_pct=50.0, level="red")


def test_quality_flags(star):
    got = {r.category: (r.quality_tier, r.low_quality) for r in portfolio.quality_tiers(star).collect()}
    assert got == {"books": ("Poor", True), "furniture": ("Poor", True)}


def test_nulls_and_duplicates(toy, star, one):
    got = {r.column: r.null_pct for r in quality.null_profile(toy.order_reviews).collect()}
    assert got == {"order_id": 0.0, "review_score": 25.0, "review_creation_date": 0.0, "review_answer_timestamp": 0.0}
    assert one(quality.dup_count(toy.order_payments, "payment_type")) == dict(rows=6, distinct_keys=4, duplicates=2)
    assert one(quality.reconcile(star))["balanced"] is True


def test_fanout_report(star):
    report = quality.fanout_report(star).collect()
    assert [(r.stage, r.rows) for r in report] == [("orders", 5), ("items", 7), ("payments", 11), ("reviews", 15)]
    assert report[0].inflation == pytest.approx(242 / 125)


# --- alerts, scenarios


def test_alert_bands(spark):
    metrics = spark.createDataFrame(
        [("row_on_time_rate", 85.0), ("last_growth_pct", -0.1), ("cancellation_rate", 5.0), ("slow_pct", 30.1),
         ("avg_review_score", None), ("operations_healthy", 1.0), ("unknown", 1.0)],
        "metric string, value double",
    )
    got = {(r.page, r.alert, r.level) for r in alerts.alerts(metrics, alerts.default_rules(spark)).collect()}
    assert got == {
        ("delivery", "improving", "warning"), ("executive", "revenue_declining", "critical"),
        ("portfolio", "inventory_risk", "critical"), ("overview", "operations_healthy", "good"),
    }


def test_marketing_scenario_by_hand(build):
    people = [f"c{i}" for i in range(10)]
    t = build(
        orders=[order(c, c) for c in people],
        order_payments=[(c, 1, "x", 100.0) for c in people],
        customers=[(c, c, "SP") for c in people],
    )
    got = {r.initiative: r.expected_return for r in scenarios.roi_marketing(Star(t), {"platform_savings": 0}).collect()}
    assert got["Loyalty Program"] == pytest.approx(3 * 80 - 3 * 25 + 500000)
    assert got["Geographic Expansion"] == pytest.approx(10000 * 85 - 10000 * 45 * 0.85)
    assert got["Customer Segmentation Platform"] == pytest.approx(10 * 100 * 0.15)
    assert got["Retention Campaigns"] == pytest.approx(10 * 12 * (0.12 * 85 - 2.5))
    assert got["Total"] == pytest.approx(sum(v for k, v in got.items() if k != "Total"))
    with pytest.raises(ValueError, match="unknown"):
        scenarios.roi_marketing(Star(t), {"typo": 1})


def test_operations_scenario_by_hand(star):
    got = {r.initiative: r.expected_return for r in scenarios.roi_operations(star).collect()}
    assert got["Regional Distribution Centers"] == pytest.approx(20 * 11 + 800000)
    assert got["Process Digitization"] == pytest.approx(100000 + 15 - 40000)


def test_custom_rules_feed_the_counts(star):
    easy = RfmRules(champion_frequency=1, champion_monetary=0.0)
    assert {r.segment for r in customers.segment_counts(star, easy).collect()} >= {"Champions"}
