from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mercato import Star, Tables, configure  # noqa: E402

START = datetime(2018, 1, 1, 10)
SCHEMAS = {
    "orders": "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp, "
    "order_approved_at timestamp, order_delivered_carrier_date timestamp, "
    "order_delivered_customer_date timestamp, order_estimated_delivery_date timestamp",
    "order_items": "order_id string, product_id string, seller_id string, shipping_limit_date timestamp, "
    "price double, freight_value double",
    "order_payments": "order_id string, payment_sequential int, payment_type string, payment_value double",
    "order_reviews": "order_id string, review_score int, review_creation_date timestamp, "
    "review_answer_timestamp timestamp",
    "products": "product_id string, product_category_name string",
    "sellers": "seller_id string, seller_state string",
    "customers": "customer_id string, customer_unique_id string, customer_state string",
    "category_translation": "product_category_name string, product_category_name_english string",
}


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


def order(key, customer, status="delivered", day=0.0, approved=0.5, carrier=2.0, delivered=5.0, promised=10.0):
    """An order bought ``day`` days after the start; the rest counts from the purchase."""
    bought = None if day is None else START + timedelta(days=day)

    def at(offset):
        return None if bought is None or offset is None else bought + timedelta(days=offset)

    return (key, customer, status, bought, at(approved), at(carrier), at(delivered), at(promised))


def review(key, score, day=20.0):
    made = START + timedelta(days=day)
    return (key, score, made, made + timedelta(days=1))


@pytest.fixture(scope="session")
def build(spark):
    """Make a catalog from rows per table; tables not given are empty."""

    def make(**rows) -> Tables:
        return Tables(**{n: spark.createDataFrame(rows.get(n, []), s) for n, s in SCHEMAS.items()})

    return make


@pytest.fixture(scope="session")
def toy(build) -> Tables:
    """Fan-out in all directions, missing children, unknown keys."""
    return build(
        orders=[
            order("A", "ca", day=0),
            order("B", "cb", status="shipped", day=31, delivered=None),
            order("C", "cc", status="canceled", day=40, carrier=None, delivered=None),
            order("D", "ca2", day=65, delivered=12.0),
            order("E", "nobody", day=70, delivered=10.0),
        ],
        order_items=[
            ("A", "p1", "s1", None, 10.0, 1.0),
            ("A", "p2", "s2", None, 20.0, 2.0),
            ("C", "p3", "s1", None, 30.0, None),
            ("D", "p1", "s1", None, 12.0, 1.0),
            ("D", "p9", None, None, 5.0, 0.5),
            ("E", "p2", "s3", None, 22.0, 2.0),
            ("ghost", "p1", "s4", None, 99.0, 9.0),
        ],
        order_payments=[
            ("A", 1, "card", 20.0),
            ("A", 2, "voucher", 13.0),
            ("B", 1, "slip", 50.0),
            ("D", 1, "card", None),
            ("D", 2, "card", 18.0),
            ("E", 1, None, 24.0),
        ],
        order_reviews=[
            review("A", 5, 21),
            review("A", 1, 20),
            review("D", 4, 80),
            review("E", None, 81),
        ],
        products=[("p1", "livros"), ("p2", "moveis"), ("p3", None)],
        sellers=[("s1", "SP"), ("s2", "RJ"), ("s3", None)],
        customers=[("ca", "u1", "SP"), ("ca2", "u1", "SP"), ("cb", "u2", "AC"), ("cc", "u3", None)],
        category_translation=[("livros", "books"), ("moveis", "furniture")],
    )


@pytest.fixture(scope="session")
def star(toy) -> Star:
    return Star(toy)


@pytest.fixture
def one():
    """The only row of a frame as a dict."""

    def get(df) -> dict:
        rows = df.collect()
        assert len(rows) == 1
        return rows[0].asDict()

    return get
