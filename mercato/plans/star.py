"""The order star: joins, features and the fan-out arithmetic.

Joining orders to items, payments and reviews repeats every payment once per
item and review of its order.  Many indicators are *defined* on those repeated
rows ("fanned" sums), but the rows need not exist.  Each child table is rolled
up to one row per order, and the repetition becomes multiplication::

    at order grain   rows    = item_rows * pay_rows * review_rows
                     revenue = pay_sum   * item_rows * review_rows
                     scores  = score_sum * item_rows * pay_rows
    at item grain    rows    = pay_rows  * review_rows
                     revenue = pay_sum   * review_rows
                     scores  = score_sum * pay_rows

where an absent child counts as one row, as in a left join.  So a fact table
is shuffled once, on the order, after map-side pre-aggregation, and an order
with very many children costs one row per task.

Five meanings of revenue are used, named in every operator:

R1  payments as in the source table
R2  grand total over the joined rows (fanned)
R3  one payment per order, the first
R4  payments of the orders in scope
R5  sum over the joined rows by some key (fanned)

A :class:`Star` builds only what is asked for.  Roll-ups of which no column is
used are dropped by Catalyst, since their keys are known to be unique;
dimension joins are added on request.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import floor_days, month_label, week_label
from mercato.plans.tables import Tables

CATEGORY = "product_category_name_english"
CUSTOMER = "customer_unique_id"
STATE = "customer_state"


# --- plain joins and features -------------------------------------------------


def products_en(t: Tables) -> DataFrame:
    """Products with the English category name; unknown categories get null."""
    return t.products.join(t.category_translation, "product_category_name", "left")


def master(t: Tables) -> DataFrame:
    """The wide joined table, one row per order x item x payment x review.

    For inspection and for profiling rows; the operators use :class:`Star`.
    The dimensions are joined first, with the facts on the left.  A left join
    cannot divide a hot key on its right side, so each child table gets a row
    of nulls for every order it lacks, and the children meet by inner joins,
    each behind shuffles of its own: an order with a third of the items,
    payments or reviews is split in each.  Items, the widest, are shuffled by
    order once.
    """
    orders = t.orders.join(t.customers, "customer_id", "left")
    items = t.order_items.join(products_en(t), "product_id", "left").join(t.sellers, "seller_id", "left")
    paid, reviewed = (_for_every_order(child, t.orders) for child in (t.order_payments, t.order_reviews))
    wide = _on_order(orders, _on_order(paid, reviewed, 1), 2)
    wide = _on_order(_for_every_order(items, t.orders), wide, 3)
    keys = ["order_id", "customer_id", "seller_id", "product_id"]
    parts = (t.orders, t.order_items, products_en(t), t.sellers, t.customers, t.order_payments, t.order_reviews)
    wide = wide.select(*keys, *[c for part in parts for c in part.columns if c not in keys])
    return add_processing(add_time(add_delivery(wide)))


def _for_every_order(children: DataFrame, orders: DataFrame) -> DataFrame:
    """``children`` of known orders and a row of nulls for each of ``orders`` without one; ids alone are compared."""
    children = children.where(F.col("order_id").isNotNull())
    lone = orders.select("order_id").join(children.select("order_id").distinct(), "order_id", "left_anti")
    return children.unionByName(lone, allowMissingColumns=True)


def _on_order(left: DataFrame, right: DataFrame, salt: int) -> DataFrame:
    """Inner join by order, null meeting null; ``salt`` makes both sides be shuffled for this join, so that a hot order is split."""
    hashed = F.xxhash64("order_id", F.lit(salt))
    right = right.withColumn("__hash", hashed).withColumnRenamed("order_id", "__order")
    same = (F.col("order_hash") == F.col("__hash")) & F.col("order_id").eqNullSafe(F.col("__order"))
    return left.withColumn("order_hash", hashed).join(right, same).drop("order_hash", "__hash", "__order")


def add_delivery(df: DataFrame) -> DataFrame:
    """Delivery, estimated and delay days, and the on-time flag.

    The flag is never null: an order without delivery date is not on time.
    """
    bought, promised = "order_purchase_timestamp", "order_estimated_delivery_date"
    arrived = "order_delivered_customer_date"
    return df.select(
        "*",
        floor_days(arrived, bought).alias("delivery_time"),
        floor_days(promised, bought).alias("estimated_delivery_time"),
        floor_days(arrived, promised).alias("delivery_delay"),
    ).selectExpr("*", "coalesce(delivery_delay <= 0, false) AS on_time_delivery")


def add_time(df: DataFrame, ts: str = "order_purchase_timestamp") -> DataFrame:
    """Month, week, date, hour, weekday (Monday 0), year and quarter of ``ts``."""
    return df.select(
        "*",
        month_label(ts).alias("order_month"),
        week_label(ts).alias("order_week"),
        F.to_date(ts).alias("order_date"),
        F.hour(ts).alias("order_hour"),
        F.weekday(ts).alias("order_dayofweek"),
        F.year(ts).alias("order_year"),
        F.quarter(ts).alias("order_quarter"),
    )


def add_processing(df: DataFrame) -> DataFrame:
    """Days from approval to hand-over, and from purchase to hand-over."""
    handed = "order_delivered_carrier_date"
    return df.select(
        "*",
        floor_days(handed, "order_approved_at").alias("processing_time"),
        floor_days(handed, "order_purchase_timestamp").alias("fulfilment_time"),
    )


def order_payments(t: Tables) -> DataFrame:
    """Payments with the month of their order (inner join, R1)."""
    return (
        t.orders.select("order_id", month_label("order_purchase_timestamp").alias("order_month"))
        .join(t.order_payments.select("order_id", "payment_type", "payment_value"), "order_id")
    )


def join_orders(df: DataFrame, orders: DataFrame, how: str = "inner") -> DataFrame:
    """Join child rows to one-row-per-order ``orders`` such that a hot order is split.

    The adaptive skew join splits a hot key only if both sides come straight
    from a shuffle.  ``orders`` mostly lies by order already, from its own
    joins, so there would be none; a hash of the key as a second join column
    makes Spark shuffle that side once more, which is narrow, one row per
    order.  The children are shuffled once either way.
    """
    hashed = F.xxhash64("order_id")
    return df.withColumn("order_hash", hashed).join(
        orders.withColumn("order_hash", hashed), ["order_id", "order_hash"], how
    )


def scope_to(df: DataFrame, orders: DataFrame) -> DataFrame:
    """Rows of ``df`` that belong to one of ``orders``."""
    return join_orders(df, orders.select("order_id"), "left_semi").drop("order_hash")


# --- per-order roll-ups -------------------------------------------------------


def payment_rollup(payments: DataFrame) -> DataFrame:
    """Payments per order: rows, sum, non-null values and the first value.

    "First" is by payment sequence when the source has one, then by type and
    value, so it does not depend on file order.
    """
    order = [c for c in ("payment_sequential", "payment_type", "payment_value") if c in payments.columns]
    return payments.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_pay"),
        F.sum("payment_value").alias("pay_total"),
        F.count("payment_value").alias("pay_values"),
        F.min_by("payment_value", F.struct(*order)).alias("first_payment"),
    )


def review_rollup(reviews: DataFrame) -> DataFrame:
    """Reviews per order: rows, score sum and count, first score, NPS sides.

    "First" is the earliest scored review by creation, answer, then score.
    """
    scored = F.col("review_score").isNotNull()
    key = F.struct("review_creation_date", "review_answer_timestamp", "review_score")
    return reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_rev"),
        F.sum("review_score").alias("score_total"),
        F.count("review_score").alias("score_count"),
        F.min_by("review_score", F.when(scored, key)).alias("first_score"),
        F.count(F.when(F.col("review_score") >= 4, 1)).alias("promoters"),
        F.count(F.when(F.col("review_score") <= 2, 1)).alias("detractors"),
    )


def item_rollup(items: DataFrame) -> DataFrame:
    """Items per order: rows, rows with a product, price and freight sums."""
    return items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count("product_id").alias("n_products"),
        F.sum("price").alias("price_total"),
        F.sum("freight_value").alias("freight_total"),
        F.sum(F.col("price") + F.col("freight_value")).alias("line_total"),
    )


ITEM_COUNTS = {"item_rows": "greatest(coalesce(n_items, 0), 1)", "items": "coalesce(n_items, 0)"}
# Sums over the joined rows, from the roll-ups of one order.
ORDER_FAN_OUT = {
    "rows": "item_rows * pay_rows * review_rows",
    "revenue": "pay_total * item_rows * review_rows",
    "paid_rows": "coalesce(pay_values, 0) * item_rows * review_rows",
    "scores": "score_total * item_rows * pay_rows",
    "scored": "coalesce(score_count, 0) * item_rows * pay_rows",
    "promoter_rows": "coalesce(promoters, 0) * item_rows * pay_rows",
    "detractor_rows": "coalesce(detractors, 0) * item_rows * pay_rows",
    "product_rows": "coalesce(n_products, 0) * pay_rows * review_rows",
    "price_fanned": "price_total * pay_rows * review_rows",
    "freight_fanned": "freight_total * pay_rows * review_rows",
    "line_fanned": "line_total * pay_rows * review_rows",
}
# The same for one item of the order.
LINE_FAN_OUT = {
    "rows": "pay_rows * review_rows",
    "revenue": "pay_total * review_rows",
    "scores": "score_total * pay_rows",
    "scored": "coalesce(score_count, 0) * pay_rows",
}


def _meet(names: Sequence[str] | None, others: tuple[str, ...] | None) -> tuple[str, ...] | None:
    """The names of a list (empty: all) that are among ``others`` (None: all), None for all."""
    if not names:
        return others
    return tuple(names) if others is None else tuple(name for name in names if name in others)


class Star:
    """The joined model of a catalog, optionally narrowed by filters.

    ``states`` and ``categories`` are IN-lists (None or empty means all);
    ``window_days`` keeps the last days before the newest order that passes
    the other filters.  ``outer`` is a star of the same tables whose filters
    hold, too: lists meet in what both name, and a window counts back from the
    newest order that passes them as well.
    """

    def __init__(
        self,
        tables: Tables,
        states: Sequence[str] | None = (),
        categories: Sequence[str] | None = (),
        window_days: int | None = None,
        outer: Star | None = None,
    ):
        self.tables = tables
        # None keeps all; an empty meeting of two lists keeps nothing.
        self.states = _meet(states, outer.states if outer else None)
        self.categories = _meet(categories, outer.categories if outer else None)
        self.window_days = window_days
        self.outer = outer
        # Plans already built; a star never changes, and analysing its wide
        # frames anew for every operator would cost more than small queries.
        self._built: dict[tuple, DataFrame] = {}

    # -- scope

    @property
    def is_filtered(self) -> bool:
        own = self.states is not None or self.categories is not None or bool(self.window_days)
        return own or bool(self.outer and self.outer.is_filtered)

    def narrow(self, states: Sequence[str] = (), categories: Sequence[str] = (), window_days: int | None = None) -> Star:
        """This star under further filters."""
        return Star(self.tables, states, categories, window_days, self)

    def _starts(self) -> list[Column]:
        """The first moments of the windows of this star and the ones around it."""
        starts = self.outer._starts() if self.outer else []
        if self.window_days:
            newest = self._scoped_orders(window=False).agg(F.max("order_purchase_timestamp")).scalar()
            starts.append(newest - F.make_dt_interval(days=F.lit(self.window_days)))
        return starts

    def items(self, product: bool = False) -> DataFrame:
        """Items of the chosen categories; ``product`` adds the category names."""
        items = self.tables.order_items
        if not product and self.categories is None:
            return items
        names = products_en(self.tables).select("product_id", "product_category_name", CATEGORY)
        if self.categories is None:
            return items.join(names, "product_id", "left")
        names = names.where(F.col(CATEGORY).isin(list(self.categories)))
        return items.join(names if product else names.select("product_id"), "product_id")

    def _scoped_orders(
        self, customer: bool = False, window: bool = True, category: bool = True
    ) -> DataFrame:
        """Orders in scope, joined to nothing but what is needed.

        ``category=False`` leaves the category filter to a later inner join.
        """
        orders = self.tables.orders
        if self.states is not None or customer:
            dims = self.tables.customers.select("customer_id", CUSTOMER, STATE)
            if self.states is not None:
                dims = dims.where(F.col(STATE).isin(list(self.states)))
            orders = orders.join(
                dims if customer else dims.select("customer_id"),
                "customer_id",
                "left" if self.states is None else "inner",
            )
        if self.categories is not None and category:
            orders = scope_to(orders, self.items().select("order_id").distinct())
        starts = self._starts() if window else self.outer._starts() if self.outer else []
        for start in starts:
            orders = orders.where(F.col("order_purchase_timestamp") >= start)
        return orders

    def keys(self) -> DataFrame:
        """The ids of the orders in scope."""
        return self._scoped_orders().select("order_id")

    def scoped(self, df: DataFrame) -> DataFrame:
        """Rows of a child table that belong to orders in scope."""
        return scope_to(df, self.keys())

    # -- order grain

    def orders(self, customer: bool = False) -> DataFrame:
        """One row per order in scope with roll-ups, features and fan-out sums.

        ``customer`` adds ``customer_unique_id`` and ``customer_state``.
        """
        return self._once(("orders", customer), lambda: self._build_orders(customer))

    def _once(self, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
        if key not in self._built:
            self._built[key] = build()
        return self._built[key]

    def _build_orders(self, customer: bool) -> DataFrame:
        t = self.tables
        df = (
            self._scoped_orders(customer, category=False)
            .join(item_rollup(self.items()), "order_id", "left" if self.categories is None else "inner")
            .join(payment_rollup(t.order_payments), "order_id", "left")
            .join(review_rollup(t.order_reviews), "order_id", "left")
            .selectExpr(
                "*",
                *[f"{sql} AS {name}" for name, sql in ITEM_COUNTS.items()],
                "greatest(coalesce(n_pay, 0), 1) AS pay_rows",
                "greatest(coalesce(n_rev, 0), 1) AS review_rows",
                "coalesce(n_pay, 0) AS payments",
                "coalesce(n_rev, 0) AS reviews",
            )
            .selectExpr("*", *[f"{sql} AS {name}" for name, sql in ORDER_FAN_OUT.items()])
        )
        return add_processing(add_time(add_delivery(df)))

    # -- item grain

    def lines(self, product: bool = False, seller: bool = False, customer: bool = False) -> DataFrame:
        """One row per item of the orders in scope, with its fan-out weights.

        Orders without items are absent: every item-level key drops null keys.
        ``product`` adds the category names, ``seller`` the seller state.  The
        dimensions are joined first and the orders last, so the rows end up
        lying by order.  The items are always the left side, so a hot product,
        seller or order is split by the adaptive skew join.
        """
        key = ("lines", product, seller, customer)
        return self._once(key, lambda: self._build_lines(product, seller, customer))

    def _build_lines(self, product: bool, seller: bool, customer: bool) -> DataFrame:
        order = self.orders(customer=customer).drop(*ORDER_FAN_OUT)
        items = self.items(product)
        if seller:
            items = items.join(self.tables.sellers.select("seller_id", "seller_state"), "seller_id", "left")
        return join_orders(items, order).selectExpr(
            "*", *[f"{sql} AS {name}" for name, sql in LINE_FAN_OUT.items()]
        )

    def per_order(self, *keys: str, extra: Sequence[Column] = (), **dims: bool) -> DataFrame:
        """Lines collapsed to one row per order and key (null keys dropped).

        Counting orders by key is then a plain row count with map-side
        combine, where ``count(distinct)`` would ship every order id once more.
        The lines lie by order, so the collapse needs no shuffle, unless a hot
        order was split.
        """
        lines = self.lines(**dims)
        for key in keys:
            lines = lines.where(F.col(key).isNotNull())
        same = ("delivery_time", "on_time_delivery", "order_month", "order_purchase_timestamp")
        return lines.groupBy("order_id", "order_hash", *keys).agg(
            F.sum("rows").alias("rows"),
            F.sum("revenue").alias("revenue"),
            F.sum("scores").alias("scores"),
            F.sum("scored").alias("scored"),
            F.sum(F.col("price") * F.col("rows")).alias("price_fanned"),
            F.sum(F.col("freight_value") * F.col("rows")).alias("freight_fanned"),
            F.count(F.lit(1)).alias("lines"),
            *[F.max(c).alias(c) for c in same],
            *extra,
        )


class StoredStar(Star):
    """A star whose order and item tables were written once and are read back.

    Made by :func:`store`; answers every operator like the star it came from,
    without joining the sources again.
    """

    def __init__(self, origin: Star, orders: DataFrame, lines: DataFrame):
        super().__init__(origin.tables, window_days=origin.window_days, outer=origin.outer)
        self.states, self.categories = origin.states, origin.categories
        self._orders, self._lines = orders, lines

    def narrow(self, states: Sequence[str] = (), categories: Sequence[str] = (), window_days: int | None = None) -> StoredStar:
        """The stored rows under further filters; only a list of categories rolls items up anew, from the stored lines."""
        orders, lines = self._orders, self._lines
        if states:
            orders, lines = (df.where(F.col(STATE).isin(list(states))) for df in (orders, lines))
        if categories:
            lines = lines.where(F.col(CATEGORY).isin(list(categories)))
            items = item_rollup(lines)
            same = [c for c in orders.columns if c not in {*items.columns, *ITEM_COUNTS, *ORDER_FAN_OUT} or c == "order_id"]
            kept = orders.select(same).join(items, "order_id").selectExpr("*", *[f"{sql} AS {name}" for name, sql in ITEM_COUNTS.items()])
            fanned = kept.selectExpr("*", *[f"{sql} AS {name}" for name, sql in ORDER_FAN_OUT.items()])
            orders = fanned.select(orders.columns)
            # The lines carry the counts of their order's items.
            counts = [c for c in lines.columns if c in {*items.columns, *ITEM_COUNTS} - {"order_id"}]
            lines = join_orders(lines.drop(*counts, "order_hash"), orders.select("order_id", *counts)).select(lines.columns)
        if window_days:
            newest = orders.agg(F.max("order_purchase_timestamp")).scalar()
            start = newest - F.make_dt_interval(days=F.lit(window_days))
            orders, lines = (df.where(F.col("order_purchase_timestamp") >= start) for df in (orders, lines))
        return StoredStar(Star(self.tables, states, categories, window_days, self), orders, lines)

    def keys(self) -> DataFrame:
        return self._orders.select("order_id")

    def items(self, product: bool = False) -> DataFrame:
        return self._lines

    def orders(self, customer: bool = False) -> DataFrame:
        return self._orders

    def lines(self, product: bool = False, seller: bool = False, customer: bool = False) -> DataFrame:
        return self._lines


def store(star: Star, path: str | None = None) -> StoredStar:
    """Write the order and item tables of ``star`` and return a star reading them.

    Worth it when several operators follow: the sources are then joined once.
    ``path`` defaults to a new folder in ``spark.checkpoint.dir``, the shared
    folder of the cluster; written tables survive the loss of executors.
    """
    spark = star.tables.orders.sparkSession
    if path is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            raise ValueError("give a path or set spark.checkpoint.dir")
        path = f"{shared.rstrip('/')}/star-{uuid.uuid4().hex}"
    star.orders(customer=True).write.parquet(f"{path}/orders")
    star.lines(product=True, seller=True, customer=True).write.parquet(f"{path}/lines")
    return StoredStar(star, spark.read.parquet(f"{path}/orders"), spark.read.parquet(f"{path}/lines"))


def mean_score() -> Column:
    """Aggregate: mean review score over the joined rows."""
    return F.try_divide(F.sum("scores").cast("double"), F.sum("scored"))


def mean_over_rows(value: str) -> Column:
    """Aggregate: mean of an order-level number over the joined rows."""
    known = F.col(value).isNotNull()
    return F.try_divide(
        F.sum(F.col(value) * F.col("rows")).cast("double"), F.sum(F.when(known, F.col("rows")))
    )


def share_of_rows(flag: Column | str, base: Column | None = None) -> Column:
    """Aggregate: percentage of joined rows (of ``base``) on which ``flag`` is true."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    rows = F.col("rows")
    hit = flag if base is None else flag & base
    of = F.sum(rows) if base is None else F.sum(F.when(base, rows))
    return F.try_divide(F.sum(F.when(hit, rows).otherwise(0)).cast("double"), of) * 100
