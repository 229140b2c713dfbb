"""Narrowing the star: state, category and time filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.plans.star import CATEGORY, STATE, Star, products_en

# The offered periods and their length in days.
PERIODS = {"Last 30 Days": 30, "Last 90 Days": 90, "Last Year": 365, "All Time": None}


def apply_filters(
    star: Star,
    states: Sequence[str] = (),
    categories: Sequence[str] = (),
    window_days: int | None = None,
) -> Star:
    """A star narrowed to states, categories and the last ``window_days`` days.

    An empty list keeps everything.  The window counts back from the newest
    order that passes the two other filters.  A star that is filtered already
    is narrowed further: lists keep what both name (none, if they share
    nothing), and the window lies within the rows that are left.  A stored star
    stays one.
    """
    return star.narrow(states, categories, window_days)


def filter_values(star: Star, column: str) -> DataFrame:
    """Sorted distinct values to choose from: ``customer_state`` or a category name."""
    if column == STATE:
        source = star.tables.customers.join(star.orders().select("customer_id").distinct(), "customer_id", "left_semi")
    elif column in (CATEGORY, "product_category_name"):
        sold = star.scoped(star.items()).select("product_id").distinct()
        source = products_en(star.tables).join(sold, "product_id", "left_semi")
    else:
        source = star.orders()
    return source.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def scope_counts(star: Star) -> DataFrame:
    """Joined rows and orders in scope."""
    return star.orders().agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("orders")
    )


def between(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows with a known value of ``column`` in the closed range."""
    return df.where(F.col(column).between(low, high))
