"""Month-by-month trends.

The ordered windows below run over one row per month (or per month and
category), never over raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.columns import ratio, total
from mercato.operators.revenue import monthly_revenue, top_k
from mercato.plans.star import CATEGORY, CUSTOMER, Star


def pct_change(value: str, order: str = "order_month") -> Column:
    """Percentage change to the previous row; nulls carry the last value forward.

    Null for the first row and where the previous value is 0.
    """
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    until = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    now, before = F.last(value, ignorenulls=True).over(upto), F.last(value, ignorenulls=True).over(until)
    return F.try_divide((now - before).cast("double"), before.cast("double")) * 100


def monthly_growth(star: Star, revenue: str = "fanned") -> DataFrame:
    """Revenue, orders and customers by month with month-over-month percentages.

    ``'fanned'`` is R5; ``'first'`` is R3, one payment per order.
    """
    amount = {"fanned": "revenue", "first": "first_payment"}[revenue]
    return (
        star.orders(customer=True)
        .where(F.col("order_month").isNotNull())
        .groupBy("order_month")
        .agg(
            total(amount).alias("revenue"),
            F.count(F.lit(1)).alias("orders"),
            F.count_distinct(CUSTOMER).alias("customers"),
        )
        .withColumn("revenue_growth", pct_change("revenue"))
        .withColumn("order_growth", pct_change("orders"))
        .orderBy("order_month")
    )


def category_trends(star: Star, n: int = 5) -> DataFrame:
    """Revenue by month and category (R5) for the ``n`` best categories.

    Categories are ranked on the small (month, category) table.
    """
    monthly = (
        star.lines(product=True)
        .where(F.col(CATEGORY).isNotNull() & F.col("order_month").isNotNull())
        .groupBy("order_month", F.col(CATEGORY).alias("category"))
        .agg(total("revenue").alias("revenue"))
    )
    best = top_k(monthly.groupBy("category").agg(total("revenue").alias("all")), "all", n, "category")
    return monthly.join(best.select("category"), "category", "left_semi").select(
        "order_month", "category", "revenue"
    ).orderBy("order_month", "category")


def moving_average(
    df: DataFrame, value: str = "revenue", order: str = "order_month", window: int = 3
) -> DataFrame:
    """Trailing mean of ``window`` rows and the ratio to it; null until the window is full."""
    frame = Window.orderBy(order).rowsBetween(-(window - 1), 0)
    full = F.count(value).over(frame) == window
    return df.withColumn("moving_avg", F.when(full, F.avg(value).over(frame))).withColumn(
        "ratio_to_avg", ratio(value, "moving_avg")
    )


def seasonal_adjust(df: DataFrame, value: str = "revenue", label: str = "order_month") -> DataFrame:
    """Calendar-month factor (its mean / overall mean) and the adjusted value."""
    month = F.substring(label, 6, 2).cast("int")
    by_month, overall = Window.partitionBy("month"), Window.partitionBy()
    return (
        df.withColumn("month", month)
        .withColumn("seasonal_factor", ratio(F.avg(value).over(by_month), F.avg(value).over(overall)))
        .withColumn("adjusted_revenue", ratio(value, "seasonal_factor"))
    )


def monthly_moving_average(star: Star, window: int = 3) -> DataFrame:
    """Monthly revenue (R3) with its trailing mean."""
    return moving_average(monthly_revenue(star, "first"), window=window)


def monthly_seasonal(star: Star) -> DataFrame:
    """Monthly revenue (R5) with seasonal factors."""
    return seasonal_adjust(monthly_revenue(star, "fanned"))


def monthly_sellers(star: Star) -> DataFrame:
    """Active sellers by purchase month."""
    return (
        star.lines()
        .where(F.col("order_month").isNotNull() & F.col("seller_id").isNotNull())
        .groupBy("order_month")
        .agg(F.count_distinct("seller_id").alias("sellers"))
        .orderBy("order_month")
    )
