"""Columns of the nine marketplace tables and their Spark types.

Only columns the operators use are typed; further columns of a source are kept
as read.  Sources are matched by column *name*, so their order is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_COLUMNS: dict[str, dict[str, str]] = {
    "orders": {
        "order_id": "string",
        "customer_id": "string",
        "order_status": "string",
        "order_purchase_timestamp": "timestamp",
        "order_approved_at": "timestamp",
        "order_delivered_carrier_date": "timestamp",
        "order_delivered_customer_date": "timestamp",
        "order_estimated_delivery_date": "timestamp",
    },
    "order_items": {
        "order_id": "string",
        "product_id": "string",
        "seller_id": "string",
        "shipping_limit_date": "timestamp",
        "price": "double",
        "freight_value": "double",
    },
    "order_payments": {
        "order_id": "string",
        "payment_type": "string",
        "payment_value": "double",
    },
    "order_reviews": {
        "order_id": "string",
        "review_score": "int",
        "review_creation_date": "timestamp",
        "review_answer_timestamp": "timestamp",
    },
    "products": {"product_id": "string", "product_category_name": "string"},
    "sellers": {"seller_id": "string", "seller_state": "string"},
    "customers": {
        "customer_id": "string",
        "customer_unique_id": "string",
        "customer_state": "string",
    },
    "geolocation": {},
    "category_translation": {
        "product_category_name": "string",
        "product_category_name_english": "string",
    },
}


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise naming the columns it lacks.

    Looks at the schema only, so a wrong input fails before any job starts.
    """
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df


def coerce_ts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Turn the named columns into timestamps, unreadable text into null.

    Columns the frame does not have are skipped.
    """
    return _retype(df, {c: "timestamp" for c in columns if c in df.columns})


def conform(df: DataFrame, table: str) -> DataFrame:
    """Check and type the known columns of ``table``; bad values become null."""
    types = TABLE_COLUMNS[table]
    return _retype(require_columns(df, list(types)), types)


def _retype(df: DataFrame, types: dict[str, str]) -> DataFrame:
    present = dict(df.dtypes)

    def typed(name: str) -> Column:
        wanted, have = types.get(name), present[name]
        if wanted is None or wanted == have:
            return F.col(name)
        if wanted == "timestamp" and have == "string":
            return F.try_to_timestamp(F.col(name)).alias(name)
        if wanted == "int":  # "4.0" is a valid whole score
            return F.col(name).try_cast("double").try_cast("int").alias(name)
        return F.col(name).try_cast(wanted).alias(name)

    return df.select(*[typed(c) for c in df.columns])
