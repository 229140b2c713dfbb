"""Revenue breakdowns.  Each docstring names its meaning of revenue (R1-R5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.columns import percent, ratio, safe_div, total, weekday_name
from mercato.operators.kpi import source_revenue
from mercato.plans.star import CATEGORY, STATE, Star, join_orders, order_payments
from mercato.plans.tables import Tables


def top_k(df: DataFrame, by: str, k: int | None, *ties: str) -> DataFrame:
    """The ``k`` largest rows by ``by``, ties by key; each task keeps its own k."""
    ordered = df.orderBy(F.col(by).desc_nulls_last(), *[F.col(c).asc() for c in ties])
    return ordered if k is None else ordered.limit(k)


def monthly_revenue(star: Star, revenue: str = "source") -> DataFrame:
    """Revenue by purchase month: R1 (``'source'``), R5 (``'fanned'``) or R3 (``'first'``)."""
    if revenue == "source":
        rows, amount = order_payments(star.tables), "payment_value"
    else:
        rows, amount = star.orders(), {"fanned": "revenue", "first": "first_payment"}[revenue]
    return (
        rows.where(F.col("order_month").isNotNull())
        .groupBy("order_month")
        .agg(total(amount).alias("revenue"))
        .orderBy("order_month")
    )


def monthly_peak(star: Star) -> DataFrame:
    """Best month, its revenue and the monthly mean (R5); first month on ties."""
    return monthly_revenue(star, "fanned").agg(
        F.max_by("order_month", F.struct("revenue", -_month_number("order_month"))).alias("peak_month"),
        F.max("revenue").alias("peak_revenue"),
        ratio(total("revenue"), F.count("revenue")).alias("avg_monthly_revenue"),
        F.count(F.lit(1)).alias("months"),
    )


def _month_number(label: str) -> Column:
    return F.replace(F.col(label), F.lit("-"), F.lit("")).cast("int")


def state_revenue(star: Star) -> DataFrame:
    """Revenue by customer state (R5)."""
    return (
        star.orders(customer=True)
        .where(F.col(STATE).isNotNull())
        .groupBy(STATE)
        .agg(total("revenue").alias("revenue"))
    )


def _revenue_total(star: Star, of: str) -> Column:
    if of == "source":
        return source_revenue(star)
    return star.orders().agg(total("revenue")).scalar()


def top_states(star: Star, n: int | None = 10, share_of: str = "fanned") -> DataFrame:
    """Best states by revenue (R5) with their share of the R2 (or ``'source'`` R1) total."""
    best = top_k(state_revenue(star), "revenue", n, STATE)
    return best.withColumn("share_pct", ratio("revenue", _revenue_total(star, share_of)) * 100)


def state_concentration(star: Star, n: int = 3, share_of: str = "fanned") -> DataFrame:
    """Share of revenue held by the ``n`` best states."""
    return (
        top_k(state_revenue(star), "revenue", n, STATE)
        .agg(total("revenue").alias("top_revenue"))
        .withColumn("total_revenue", _revenue_total(star, share_of))
        .withColumn("concentration_pct", ratio("top_revenue", "total_revenue") * 100)
    )


def scoped_kpis(star: Star) -> DataFrame:
    """Revenue (R3), orders and average order value of the orders in scope."""
    return star.orders().agg(
        total("first_payment").alias("total_revenue"), F.count(F.lit(1)).alias("total_orders")
    ).withColumn("avg_order_value", safe_div("total_revenue", "total_orders"))


def mom_growth(star: Star) -> DataFrame:
    """Last month against the calendar month before it (R3); 0 without a base.

    Sums every month once and reads the two from that small table.
    """
    monthly = monthly_revenue(star, "first")
    last = F.max("order_month").over(Window.partitionBy())
    before = F.date_format(F.add_months(F.to_date(F.concat("current_month", F.lit("-01"))), -1), "yyyy-MM")

    def of(month: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("order_month") == F.col(month), F.col("revenue"))), F.lit(0.0))

    return (
        monthly.withColumn("current_month", last)
        .withColumn("previous_month", before)
        .groupBy("current_month", "previous_month")
        .agg(of("current_month").alias("current_revenue"), of("previous_month").alias("previous_revenue"))
        .withColumn(
            "growth_pct",
            F.when(
                F.col("previous_revenue") > 0,
                ratio(F.col("current_revenue") - F.col("previous_revenue"), "previous_revenue") * 100,
            ).otherwise(F.lit(0.0)),
        )
    )


def revenue_components(star: Star) -> DataFrame:
    """Product, freight and payment sums of the orders in scope (R4), one row."""
    t = star.tables
    items, payments = t.order_items, t.order_payments
    if star.is_filtered:
        items, payments = star.scoped(items), star.scoped(payments)
    paid = payments.agg(total("payment_value")).scalar()
    return (
        items.agg(total("price").alias("product_revenue"), total("freight_value").alias("freight_revenue"))
        .withColumn("total_revenue", paid)
        .withColumn(
            "other_charges",
            F.round(F.col("total_revenue") - (F.col("product_revenue") + F.col("freight_revenue")), 4),
        )
    )


def waterfall(star: Star) -> DataFrame:
    """Product, freight, other charges and total as four ordered rows (R4)."""
    parts = (
        ("Product Sales", "product_revenue"),
        ("Freight Charges", "freight_revenue"),
        ("Other Charges (Taxes/Fees)", "other_charges"),
        ("Total Revenue", "total_revenue"),
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("step"), F.lit(name).alias("component"), F.col(c).alias("amount"))
            for i, (name, c) in enumerate(parts, 1)
        ]
    )
    return revenue_components(star).select(F.inline(rows))


def processing_margin(star: Star) -> DataFrame:
    """Payments not explained by products and freight, as a share of payments."""
    return revenue_components(star).select(
        "total_revenue",
        "other_charges",
        (ratio("other_charges", "total_revenue") * 100).alias("processing_margin_pct"),
    )


def revenue_by_payment_type(star: Star) -> DataFrame:
    """Revenue by payment type over joined rows (R5)."""
    weights = star.orders().select("order_id", (F.col("item_rows") * F.col("review_rows")).alias("times"))
    return (
        join_orders(star.tables.order_payments.where(F.col("payment_type").isNotNull()), weights)
        .groupBy("payment_type")
        .agg(total(F.col("payment_value") * F.col("times")).alias("revenue"))
    )


def payment_mix(t: Tables) -> DataFrame:
    """Payment types by source revenue (R1): transactions, average, share, rank."""
    everything = Window.partitionBy()
    best_first = Window.orderBy(F.col("revenue").desc(), "payment_type")
    mix = (
        t.order_payments.groupBy("payment_type")
        .agg(total("payment_value").alias("revenue"), F.count("payment_value").alias("transactions"))
        .withColumn("share_pct", ratio("revenue", F.sum("revenue").over(everything)) * 100)
        .where(F.col("payment_type").isNotNull())
    )
    return mix.select(
        "payment_type",
        "revenue",
        "transactions",
        ratio("revenue", "transactions").alias("avg_transaction"),
        "share_pct",
        F.row_number().over(best_first).alias("rank"),
    ).orderBy("rank")


def payment_leaders(t: Tables) -> DataFrame:
    """The type with most revenue and its share; the type with the best average."""
    return payment_mix(t).agg(
        F.min_by("payment_type", "rank").alias("dominant_type"),
        F.min_by("share_pct", "rank").alias("dominant_pct"),
        F.max_by("payment_type", F.struct("avg_transaction", -F.col("rank"))).alias("highest_avg_type"),
        F.max("avg_transaction").alias("highest_avg"),
    )


def category_revenue(star: Star) -> DataFrame:
    """Revenue by category (R5)."""
    return (
        star.lines(product=True)
        .where(F.col(CATEGORY).isNotNull())
        .groupBy(F.col(CATEGORY).alias("category"))
        .agg(total("revenue").alias("revenue"))
    )


def top_categories(star: Star, n: int | None = 10) -> DataFrame:
    """Best categories by revenue (R5)."""
    return top_k(category_revenue(star), "revenue", n, "category")


def revenue_by_hour(star: Star, how: str = "avg", top: int | None = None) -> DataFrame:
    """Mean (``'avg'``) or summed (``'sum'``) payment over joined rows by hour (R5).

    ``top`` keeps the best hours, best first; otherwise hours are in order.
    """
    by_hour = star.orders().where(F.col("order_hour").isNotNull()).groupBy("order_hour").agg(
        total("revenue").alias("total"), F.sum("paid_rows").alias("paid_rows")
    )
    value = ratio("total", "paid_rows") if how == "avg" else F.col("total")
    out = by_hour.select("order_hour", value.alias("revenue"))
    return out.orderBy("order_hour") if top is None else top_k(out, "revenue", top, "order_hour")


def revenue_by_weekday(star: Star, long_names: bool = False) -> DataFrame:
    """Revenue over joined rows by weekday (R5), best day first."""
    by_day = (
        star.orders()
        .where(F.col("order_dayofweek").isNotNull())
        .groupBy("order_dayofweek")
        .agg(total("revenue").alias("revenue"))
        .withColumn("day_name", weekday_name("order_dayofweek", long_names))
    )
    return top_k(by_day, "revenue", None, "order_dayofweek")


def category_margin(star: Star, n: int | None = 10) -> DataFrame:
    """Margin per category over joined rows: (payment - price - freight) / payment.

    The ``n`` categories with most revenue (R5).
    """
    r, p, f = F.col("revenue"), F.col("price"), F.col("freight")
    sums = (
        star.lines(product=True)
        .where(F.col(CATEGORY).isNotNull())
        .groupBy(F.col(CATEGORY).alias("category"))
        .agg(
            total("revenue").alias("revenue"),
            total(F.col("price") * F.col("rows")).alias("price"),
            total(F.col("freight_value") * F.col("rows")).alias("freight"),
        )
        .withColumn("margin_pct", ratio(r - p - f, r) * 100)
    )
    return top_k(sums, "revenue", n, "category")


def low_margin_count(star: Star, below: float = 10.0, n: int | None = 10) -> DataFrame:
    """How many of the ``n`` best categories have a margin under ``below`` percent."""
    low = F.col("margin_pct") < below
    return category_margin(star, n).agg(
        F.count(F.when(low, 1)).alias("low_margin"), F.count(F.lit(1)).alias("categories")
    )


def last_growth(star: Star) -> DataFrame:
    """Growth between the last two months that have revenue (R1)."""
    in_order = Window.orderBy("order_month")
    return (
        monthly_revenue(star, "source")
        .withColumn("previous_revenue", F.lag("revenue").over(in_order))
        .orderBy(F.col("order_month").desc())
        .limit(1)
        .select(
            "order_month",
            "revenue",
            "previous_revenue",
            (ratio(F.col("revenue") - F.col("previous_revenue"), "previous_revenue") * 100).alias("growth_pct"),
        )
    )
