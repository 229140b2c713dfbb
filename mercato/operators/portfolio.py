"""Product and category portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.columns import count_when, cut, exact_sum, merged_sum, part_sums, percent, ratio, total
from mercato.functions.stats import qcut
from mercato.operators.revenue import top_k
from mercato.operators.sellers import category_members
from mercato.plans.star import CATEGORY, Star, mean_score

# Edges and names of the quality tiers and of the price tiers.
QUALITY_EDGES = (0, 3.5, 4.0, 4.5, 5.0)
QUALITY_LABELS = ("Poor", "Fair", "Good", "Excellent")
PRICE_LABELS = ("Very Low", "Low", "Medium", "High", "Premium")


def product_sales(star: Star, category: bool = False) -> DataFrame:
    """Orders ("units sold"), revenue (R5) and mean score per product; ``category`` adds its category."""
    named = [F.max(CATEGORY).alias("category")] if category else []
    return (
        star.per_order("product_id", extra=named, product=category)
        .groupBy("product_id")
        .agg(
            F.count(F.lit(1)).alias("units_sold"),
            total("revenue").alias("revenue"),
            mean_score().alias("avg_rating"),
            *([F.max("category").alias("category")] if category else []),
        )
    )


def product_kpis(star: Star) -> DataFrame:
    """Products, categories and the mean of the products' mean scores, from one table of products."""
    return product_sales(star, category=True).agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_distinct("category").alias("total_categories"),
        F.try_divide(exact_sum("avg_rating"), F.count("avg_rating")).alias("avg_product_rating"),
    )


def slow_movers(star: Star, below: int = 2) -> DataFrame:
    """Products with fewer than ``below`` orders, their share and its light (20 / 30 %)."""
    share = F.col("slow_pct")
    return (
        product_sales(star)
        .agg(
            F.count(F.lit(1)).alias("total_products"),
            count_when(F.col("units_sold") < below).alias("slow_movers"),
        )
        .withColumn("slow_pct", percent("slow_movers", "total_products"))
        .withColumn("level", F.when(share > 30, "red").when(share > 20, "yellow").otherwise("green"))
    )


def category_metrics(star: Star, n: int | None = 15) -> DataFrame:
    """Revenue (R5), orders, score, products and revenue per product of the best categories."""
    table = category_members(star, "product_id", "sku_count").withColumnRenamed("avg_review", "avg_rating")
    table = table.withColumn("revenue_per_sku", ratio("revenue", "sku_count"))
    return top_k(table.select("category", "revenue", "orders", "avg_rating", "sku_count", "revenue_per_sku"), "revenue", n, "category")


def bcg(star: Star, n: int = 15) -> DataFrame:
    """Portfolio quadrant of the ``n`` best categories, split at their medians."""
    listed = Window.partitionBy()  # the n kept categories
    middle = (F.median(c).over(listed) for c in ("revenue", "orders"))
    return category_metrics(star, n).withColumn("position", _position(*middle))


def _position(revenue: Column, orders: Column) -> Column:
    """Quadrant of a category against the middle revenue and number of orders."""
    rich, busy = F.col("revenue") > revenue, F.col("orders") > orders
    return F.when(rich & busy, "Stars").when(rich, "Cash Cows").when(busy, "Question Marks").otherwise("Dogs")


def quality_tiers(star: Star, n: int | None = 15) -> DataFrame:
    """Quality tier of the ``n`` best categories, with low (< 3.5) and high (> 4.5) flags."""
    low, high = _quality_flags()
    return category_metrics(star, n).select(
        "category",
        "revenue",
        "avg_rating",
        cut("avg_rating", QUALITY_EDGES, QUALITY_LABELS).alias("quality_tier"),
        low.alias("low_quality"),
        high.alias("high_quality"),
    )


def _quality_flags() -> tuple[Column, Column]:
    """Whether a category's mean score is low (< 3.5) or high (> 4.5)."""
    return F.col("avg_rating") < 3.5, F.col("avg_rating") > 4.5


def products_per_order(star: Star, grain: str = "row") -> DataFrame:
    """Orders by number of products: joined rows (``'row'``) or items (``'item'``)."""
    size = F.col("product_rows") if grain == "row" else F.coalesce("n_products", F.lit(0))
    return (
        star.orders()
        .groupBy(size.alias("products"))
        .agg(F.count(F.lit(1)).alias("orders"))
        .orderBy("products")
    )


def cross_sell(star: Star, grain: str = "row") -> DataFrame:
    """Orders with more than one product, and their share of all orders."""
    return products_per_order(star, grain).agg(
        F.sum("orders").alias("orders"),
        F.coalesce(F.sum(F.when(F.col("products") > 1, F.col("orders"))), F.lit(0)).alias("multi_product_orders"),
    ).withColumn("cross_sell_rate", percent("multi_product_orders", "orders"))


def product_prices(star: Star) -> DataFrame:
    """Mean price over joined rows, and orders, per product."""
    priced = F.sum(F.when(F.col("price").isNotNull(), F.col("rows"))).alias("priced_rows")
    return (
        star.per_order("product_id", extra=[priced])
        .groupBy("product_id")
        .agg(
            ratio(total("price_fanned"), F.sum("priced_rows")).alias("price"),
            F.count(F.lit(1)).alias("orders"),
        )
    )


def price_tiers(star: Star) -> DataFrame:
    """Products, orders and mean price per quintile of the products' mean price.

    ``is_best`` marks the tier with most orders, the cheaper one on ties.
    """
    priced = product_prices(star).where(F.col("price").isNotNull())
    tiers = (
        qcut(priced, "price", PRICE_LABELS, "tier", ordinal="level")
        .groupBy("level", "tier")
        .agg(
            F.count(F.lit(1)).alias("products"),
            F.sum("orders").alias("orders"),
            F.avg("price").alias("avg_price"),
        )
    )
    best = F.max_by("level", F.struct("orders", -F.col("level"))).over(Window.partitionBy())
    return tiers.withColumn("is_best", F.col("level") == best).orderBy("level")


def price_ranges(star: Star) -> DataFrame:
    """Joined rows, lowest and highest item price per quintile over joined rows.

    Counting the rows makes the table of prices the same one the quintiles
    are computed from, so it is shuffled once.
    """
    prices = (
        star.lines().where(F.col("price").isNotNull()).groupBy("price").agg(F.sum("rows").alias("rows"))
    )
    return (
        qcut(prices, "price", PRICE_LABELS, "tier", weight="rows", ordinal="level")
        .groupBy("level", "tier")
        .agg(
            F.sum("rows").alias("rows"),
            F.min("price").alias("min_price"),
            F.max("price").alias("max_price"),
        )
        .orderBy("level")
    )


def revenue_per_product(star: Star) -> DataFrame:
    """Item revenue (sum of prices, R4) per item sold and per distinct product."""
    items = star.items().select("order_id", "product_id", "price")
    return star.scoped(items).agg(
        total("price").alias("product_revenue"),
        F.count("product_id").alias("products_sold"),
        F.count_distinct("product_id").alias("distinct_products"),
    ).withColumn("revenue_per_product", ratio("product_revenue", "products_sold")).withColumn(
        "revenue_per_sku", ratio("product_revenue", "distinct_products")
    )


def portfolio_summary(star: Star, slow_below: int = 2, n: int = 15) -> DataFrame:
    """The indicators of the product page in one row, from one reading of the items.

    ``slow_pct`` (of :func:`slow_movers`), ``avg_product_rating``
    (:func:`product_kpis`), ``dog_categories`` (:func:`bcg`),
    ``low_quality_categories`` and ``high_quality_categories``
    (:func:`quality_tiers`) and ``cross_sell_rate`` (:func:`cross_sell`), each
    equal to that of its operator.  Rows of an order lie together, where its
    first row, and its first one of each category, is marked; the marks are
    summed per product, the products per category.  Only the categories, a row
    each, are ranked in one place.
    """
    lines = star.per_order("product_id", extra=[F.max(CATEGORY).alias("category")], product=True)
    order, by = ("order_id", "order_hash"), ("category", "product_id")
    whole = Window.partitionBy(*order).orderBy(*by)
    several = (F.col("rows") > 1) | F.lead("product_id").over(whole).isNotNull()
    marked = lines.withColumn("several", several & (F.row_number().over(whole) == 1)).withColumn(
        "first", F.row_number().over(Window.partitionBy(*order, "category").orderBy("product_id")) == 1
    )
    products = (
        marked.groupBy("category", "product_id")
        .agg(
            F.count(F.lit(1)).alias("units_sold"),
            *part_sums("revenue", "revenue"),
            F.count_if("first").alias("orders"),
            F.count_if("several").alias("several"),
            F.sum("scores").alias("scores"),
            F.sum("scored").alias("scored"),
        )
        .withColumn("rating", F.try_divide(F.col("scores").cast("double"), F.col("scored")))
    )
    categories = products.groupBy("category").agg(
        merged_sum("revenue").alias("revenue"),
        F.sum("orders").alias("orders"),
        mean_score().alias("avg_rating"),
        F.count(F.lit(1)).alias("products"),
        count_when(F.col("units_sold") < slow_below).alias("slow"),
        F.sum("several").alias("several"),
        *part_sums("rating", "rating"),
        F.count("rating").alias("rated"),
    )
    best = Window.orderBy(F.col("category").isNull(), F.col("revenue").desc_nulls_last(), "category")
    listed = (F.row_number().over(best) <= n) & F.col("category").isNotNull()
    ranked = categories.withColumn("listed", listed)
    middle = (F.median(F.when(F.col("listed"), F.col(c))).over(Window.partitionBy()) for c in ("revenue", "orders"))
    low, high = _quality_flags()
    return (
        ranked.withColumn("position", _position(*middle))
        .agg(
            F.coalesce(F.sum("products"), F.lit(0)).alias("products"),
            F.coalesce(F.sum("slow"), F.lit(0)).alias("slow"),
            F.coalesce(F.sum("several"), F.lit(0)).alias("several"),
            F.try_divide(merged_sum("rating"), F.sum("rated")).alias("avg_product_rating"),
            F.count_if(F.col("listed") & (F.col("position") == "Dogs")).alias("dog_categories"),
            F.count_if(F.col("listed") & low).alias("low_quality_categories"),
            F.count_if(F.col("listed") & high).alias("high_quality_categories"),
        )
        .withColumn("all_orders", star.orders().agg(F.count(F.lit(1))).scalar())
        .select(
            percent("slow", "products").alias("slow_pct"),
            "avg_product_rating",
            "dog_categories",
            "low_quality_categories",
            "high_quality_categories",
            percent("several", "all_orders").alias("cross_sell_rate"),
        )
    )
