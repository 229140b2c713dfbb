import random

import pytest
from pyspark.sql import functions as F

from conftest import order, review
from mercato import Star, master, products_en, store
from mercato.operators import filters, kpi, portfolio, quality, revenue, sellers
from mercato.plans.star import CATEGORY, STATE


def test_golden_revenue(build, one):
    t = build(
        orders=[order(k, k) for k in "123"],
        order_payments=[(k, 1, "card", v) for k, v in zip("123", (100.0, 200.0, 150.0))],
    )
    assert one(kpi.exec_kpis(Star(t)))["total_revenue"] == 450.0


def test_categories_follow_the_product(toy):
    assert {(r.product_id, r[CATEGORY]) for r in products_en(toy).collect()} == {
        ("p1", "books"), ("p2", "furniture"), ("p3", None),
    }


def test_fan_out_counts(star):
    rows = {r.order_id: (r.item_rows, r.pay_rows, r.review_rows, r.rows) for r in star.orders().collect()}
    assert rows == {"A": (2, 2, 2, 8), "B": (1, 1, 1, 1), "C": (1, 1, 1, 1), "D": (2, 2, 1, 4), "E": (1, 1, 1, 1)}


def test_first_values(star):
    got = {r.order_id: (r.first_payment, r.first_score) for r in star.orders().collect()}
    assert got["A"] == (20.0, 1)
    assert got["C"] == (None, None)
    assert got["E"] == (24.0, None)


def test_on_time_is_never_null(star):
    got = {r.order_id: (r.delivery_delay, r.on_time_delivery) for r in star.orders().collect()}
    assert got == {"A": (-5, True), "B": (None, False), "C": (None, False), "D": (2, False), "E": (0, True)}


@pytest.fixture(scope="module")
def random_tables(build):
    rng = random.Random(5)
    keys = [f"o{i}" for i in range(60)]
    pick = lambda: rng.choice(keys + ["gone"])
    return build(
        orders=[order(k, f"c{rng.randint(0, 25)}", rng.choice(["delivered", "shipped", "canceled"]), rng.uniform(0, 300),
                      delivered=rng.choice([None, 3.0, 9.6, 10.2, 14.0])) for k in keys],
        order_items=[(pick(), f"p{rng.randint(0, 9)}", rng.choice([None, "s1", "s2", "s3"]), None,
                      rng.choice([None, 1.0, 2.5]), rng.choice([None, 0.5])) for _ in range(150)],
        order_payments=[(pick(), i, rng.choice(["x", "y", None]), rng.choice([None, 4.0, 7.25])) for i in range(120)],
        order_reviews=[review(pick(), rng.choice([None, 1, 2, 3, 4, 5]), rng.uniform(0, 50)) for _ in range(80)],
        products=[(f"p{i}", rng.choice(["a", "b", None])) for i in range(8)],
        sellers=[("s1", "SP"), ("s2", "RJ")],
        customers=[(f"c{i}", f"u{i % 9}", rng.choice(["SP", "AC", None])) for i in range(20)],
        category_translation=[("a", "alpha")],
    )


SUMS = (
    "count(*)", "round(coalesce(sum(payment_value), 0), 4)", "coalesce(sum(review_score), 0)", "count(review_score)",
)
FANNED = ("sum(rows)", "round(coalesce(sum(revenue), 0), 4)", "coalesce(sum(scores), 0)", "sum(scored)")


def _grouped(df, key, aggs):
    out = df.groupBy(key).agg(*[F.expr(c) for c in aggs])
    return {r[key]: tuple(r)[1:] for r in out.collect() if r[key] is not None}


@pytest.mark.parametrize("key", ["order_id", STATE, "order_month", "order_status"])
def test_order_grain_equals_joined_rows(random_tables, key):
    wide, star = master(random_tables), Star(random_tables)
    assert _grouped(star.orders(customer=True), key, FANNED) == _grouped(wide, key, SUMS)


@pytest.mark.parametrize("key", ["seller_id", "product_id", CATEGORY, "seller_state"])
def test_item_grain_equals_joined_rows(random_tables, key):
    wide, star = master(random_tables), Star(random_tables)
    assert _grouped(star.lines(product=True, seller=True), key, FANNED) == _grouped(wide, key, SUMS)


def test_wide_join_keeps_every_row(random_tables):
    t = random_tables
    rows = [
        df.collect()
        for df in (t.orders.join(t.customers, "customer_id", "left"),
                   t.order_items.join(products_en(t), "product_id", "left").join(t.sellers, "seller_id", "left"), t.order_payments, t.order_reviews)
    ]
    orders, *children = [[r.asDict() for r in part] for part in rows]
    want = []
    for o in orders:
        mine = [[c for c in part if c["order_id"] == o["order_id"]] or [{}] for part in children]
        want += [(o, i, p, r) for i in mine[0] for p in mine[1] for r in mine[2]]
    names = ("order_id", "customer_state", "product_id", CATEGORY, "seller_state", "price", "payment_value", "review_score")
    merged = [{**i, **p, **r, **o} for o, i, p, r in want]
    expected = sorted(repr(tuple(row.get(c) for c in names)) for row in merged)
    wide = master(t)
    assert sorted(repr(tuple(r)) for r in wide.select(*names).collect()) == expected
    assert wide.columns[:4] == ["order_id", "customer_id", "seller_id", "product_id"] and len(set(wide.columns)) == len(wide.columns)


def test_repeated_orders_equal_those_of_the_wide_join(random_tables):
    assert quality.joined_duplicates(Star(random_tables)).first() == quality.dup_count(master(random_tables), "order_id").first()


def test_wide_join_keeps_an_order_without_an_id(build):
    t = build(orders=[order(None, "c"), order("a", "c")], order_items=[(None, "p", "s", None, 1.0, 1.0), ("a", "p", "s", None, 2.0, 1.0)])
    assert {(r.order_id, r.price) for r in master(t).collect()} == {(None, None), ("a", 2.0)}


@pytest.mark.parametrize("scope", [{}, dict(states=["SP"]), dict(categories=["alpha"]), dict(window_days=1)])
def test_pages_equal_their_operators(random_tables, tmp_path, scope):
    star = filters.apply_filters(Star(random_tables), **scope)
    for star in (star, store(star, str(tmp_path / "star"))):
        page = portfolio.portfolio_summary(star, 5, 2).first()
        tiers = portfolio.quality_tiers(star, 2).collect()
        assert page.slow_pct == pytest.approx(portfolio.slow_movers(star, 5).first().slow_pct)
        assert page.avg_product_rating == pytest.approx(portfolio.product_kpis(star).first().avg_product_rating)
        assert page.dog_categories == sum(r.position == "Dogs" for r in portfolio.bcg(star, 2).collect())
        assert (page.low_quality_categories, page.high_quality_categories) == (sum(bool(r.low_quality) for r in tiers), sum(bool(r.high_quality) for r in tiers))
        assert page.cross_sell_rate == pytest.approx(portfolio.cross_sell(star).first().cross_sell_rate)
        health = kpi.executive_health(star).first()
        assert health.avg_review_score == pytest.approx(kpi.avg_review(star).first().avg_review_score)
        assert health.delivery_rate == pytest.approx(kpi.delivery_rate(star).first().delivery_rate)
        assert health.on_time_rate == pytest.approx(kpi.on_time_rate(star).first().on_time_rate)
        assert health.row_on_time_rate == pytest.approx(kpi.on_time_rate(star, "row").first().on_time_rate)
        best = revenue.top_states(star, 1, share_of="source").first()
        assert health.top_state_pct == (pytest.approx(best.share_pct) if best else None)


def test_other_fanned_sums(random_tables):
    wide = master(random_tables).agg(
        F.sum("price"), F.sum("freight_value"), F.sum(F.col("price") + F.col("freight_value")), F.count("product_id"),
        F.count("payment_value"), F.count(F.when(F.col("review_score") >= 4, 1)),
    ).first()
    ours = Star(random_tables).orders().agg(
        F.sum("price_fanned"), F.sum("freight_fanned"), F.sum("line_fanned"), F.sum("product_rows"), F.sum("paid_rows"),
        F.sum("promoter_rows"),
    ).first()
    assert tuple(ours) == pytest.approx(tuple(wide))


@pytest.mark.parametrize(
    "scope",
    [dict(states=["SP"]), dict(categories=["alpha"]), dict(window_days=90), dict(states=["AC"], categories=["alpha"], window_days=120)],
)
def test_filters_equal_filtered_rows(random_tables, scope):
    wide = master(random_tables)
    if "states" in scope:
        wide = wide.where(F.col(STATE).isin(scope["states"]))
    if "categories" in scope:
        wide = wide.where(F.col(CATEGORY).isin(scope["categories"]))
    if "window_days" in scope:
        newest = wide.agg(F.max("order_purchase_timestamp")).first()[0]
        wide = wide.where(F.col("order_purchase_timestamp") >= F.lit(newest) - F.expr(f"INTERVAL {scope['window_days']} DAY"))
    star = filters.apply_filters(Star(random_tables), **scope)
    assert _grouped(star.orders(), "order_id", FANNED) == _grouped(wide, "order_id", SUMS)
    assert _grouped(star.lines(), "seller_id", FANNED) == _grouped(wide, "seller_id", SUMS)
    assert {r.order_id for r in star.keys().collect()} == {r.order_id for r in wide.select("order_id").distinct().collect()}


def test_no_filter_keeps_everything(star):
    assert filters.apply_filters(star, [], []).keys().count() == 5


def test_filter_values_are_sorted_without_nulls(star):
    assert [r[0] for r in filters.filter_values(star, STATE).collect()] == ["AC", "SP"]
    assert [r[0] for r in filters.filter_values(star, CATEGORY).collect()] == ["books", "furniture"]
    assert [r[0] for r in filters.filter_values(star, "order_status").collect()] == ["canceled", "delivered", "shipped"]


def test_stored_star_gives_the_same_answers(spark, random_tables, tmp_path):
    star = filters.apply_filters(Star(random_tables), states=["SP", "AC"])
    stored = store(star, str(tmp_path / "star"))
    for operator in (
        kpi.dataset_overview, revenue.waterfall, revenue.top_categories, sellers.seller_performance,
        portfolio.category_metrics, sellers.sellers_by_state, revenue.revenue_by_payment_type,
    ):
        assert sorted(map(str, operator(stored).collect())) == sorted(map(str, operator(star).collect())), operator


def test_store_goes_to_the_shared_folder(spark, star):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            store(star)
        return
    stored = store(star)
    assert all(shared.rstrip("/") + "/star-" in f for f in stored.orders().inputFiles())
    assert stored.orders().count() == 5


def test_filters_on_a_stored_star_keep_its_scope(spark, random_tables, tmp_path):
    star = filters.apply_filters(Star(random_tables), states=["SP"])
    narrower = filters.apply_filters(store(star, str(tmp_path / "star")), categories=["alpha"])
    assert (narrower.states, narrower.categories) == (("SP",), ("alpha",))


@pytest.mark.parametrize(
    "first, then",
    [
        (dict(states=["SP"]), dict(states=["AC"])),
        (dict(states=["SP", "AC"]), dict(states=["AC", "nowhere"], categories=["alpha"])),
        (dict(categories=["alpha", "beta"]), dict(categories=["beta"], window_days=200)),
        (dict(window_days=30), dict(window_days=365)),
        (dict(window_days=300), dict(states=["SP"], window_days=60)),
        (dict(states=["SP"], window_days=200), dict(categories=["alpha"])),
    ],
)
def test_a_second_filter_narrows_the_first(random_tables, tmp_path, first, then):
    def rows(wide, scope):
        if "states" in scope:
            wide = wide.where(F.col(STATE).isin(scope["states"]))
        if "categories" in scope:
            wide = wide.where(F.col(CATEGORY).isin(scope["categories"]))
        if "window_days" in scope:
            newest = wide.agg(F.max("order_purchase_timestamp").alias("m")).first()["m"]
            if newest:
                wide = wide.where(F.col("order_purchase_timestamp") >= F.lit(newest) - F.expr(f"INTERVAL {scope['window_days']} DAY"))
        return wide

    want = rows(rows(master(random_tables), first), then)
    plain = filters.apply_filters(Star(random_tables), **first)
    stored = store(plain, str(tmp_path / "star"))
    for star in (filters.apply_filters(plain, **then), filters.apply_filters(stored, **then)):
        assert _grouped(star.orders(), "order_id", FANNED) == _grouped(want, "order_id", SUMS)
        assert _grouped(star.lines(), "seller_id", FANNED) == _grouped(want, "seller_id", SUMS)
        assert star.is_filtered
    assert type(filters.apply_filters(stored, **then)) is type(stored)


def test_lists_that_share_nothing_keep_nothing(star):
    narrowed = filters.apply_filters(filters.apply_filters(star, states=["SP"]), states=["AC"])
    assert narrowed.states == () and narrowed.orders().count() == 0 and narrowed.lines().count() == 0
    assert filters.apply_filters(narrowed).orders().count() == 0
