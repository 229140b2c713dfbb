"""The table catalog handed to every operator."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tables:
    """The marketplace tables.

    ``order_id`` is unique in orders, and ``customer_id``, ``product_id``,
    ``seller_id`` and ``product_category_name`` are unique in their tables;
    items, payments and reviews have any number of rows per order.
    """

    orders: DataFrame
    order_items: DataFrame
    order_payments: DataFrame
    order_reviews: DataFrame
    products: DataFrame
    sellers: DataFrame
    customers: DataFrame
    category_translation: DataFrame
    geolocation: DataFrame | None = None

    def replace(self, **frames: DataFrame) -> "Tables":
        """A copy with some tables exchanged."""
        return dataclasses.replace(self, **frames)

    def register(self, prefix: str = "") -> None:
        """Make every table a temporary view for use from Spark SQL."""
        for field in dataclasses.fields(self):
            frame = getattr(self, field.name)
            if frame is not None:
                frame.createOrReplaceTempView(prefix + field.name)
