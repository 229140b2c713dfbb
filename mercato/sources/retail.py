"""A TPC-H-like retail schema seen as the nine marketplace tables.

Orders become marketplace orders, line items their items, customers and
suppliers the buyers and sellers, part brands the categories, nations the
states.  What the retail schema lacks (payments, reviews, delivery dates) is
derived from the order key by whole-number arithmetic, so every engine derives
the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mercato.plans.tables import Tables

# Columns used, with their types: a known schema spares a footer-reading job per table.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_nationkey int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_brand string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_extendedprice double, l_tax double, l_shipdate timestamp_ntz",
}
UNTRANSLATED_BRAND = "Brand#7"
UNKNOWN_POPULATION_NATION = "NATION_24"


def read_retail(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One retail table, limited to the columns used here."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{directory.rstrip('/')}/{name}.parquet")


def retail_tables(spark: SparkSession, directory: str) -> Tables:
    """Read the retail parquet files and conform them.

    Money goes through whole cents: the freight is the taxed price rounded to
    the cent, and every fifth order is paid 60 : 40, the rest by voucher.
    """

    def read(name: str) -> DataFrame:
        return read_retail(spark, directory, name)

    nation, source = read("nation"), read("orders")
    k, day = "o_orderkey", "unix_seconds(cast(o_orderdate AS timestamp))"
    bought = f"({day} + ({k} * 7) % 24 * 3600)"
    approved = f"({bought} + {k} % 3 * 3600)"
    orders = source.selectExpr(
        f"{k} AS order_id",
        "o_custkey AS customer_id",
        "CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' WHEN 'P' THEN 'canceled' END"
        " AS order_status",
        f"timestamp_seconds({bought}) AS order_purchase_timestamp",
        f"timestamp_seconds({approved}) AS order_approved_at",
        f"timestamp_seconds({approved} + ({k} * 13) % 10 * 86400) AS order_delivered_carrier_date",
        f"CASE WHEN o_orderstatus = 'F' AND {k} % 50 <> 0 THEN"
        f" timestamp_seconds({bought} + ({k} * 17) % 60 * 86400 + ({k} * 11) % 24 * 3600) END"
        " AS order_delivered_customer_date",
        f"timestamp_seconds({day} + (40 * 24 + 12) * 3600) AS order_estimated_delivery_date",
    )
    cents, tax = "cast(round(l_extendedprice * 100) AS bigint)", "cast(round(l_tax * 100) AS bigint)"
    items = read("lineitem").selectExpr(
        "l_orderkey AS order_id",
        "l_linenumber AS order_item_id",
        "l_partkey AS product_id",
        "l_suppkey AS seller_id",
        "cast(l_shipdate AS timestamp) AS shipping_limit_date",
        f"{cents} / 100 AS price",
        f"floor(({cents} * {tax} + 50) / 100) / 100 AS freight_value",
    )
    due = "cast(round(o_totalprice * 100) AS bigint)"
    main = f"(CASE WHEN {k} % 5 = 0 THEN floor({due} * 6 / 10) ELSE {due} END)"
    payments = source.selectExpr(
        f"{k} AS order_id",
        f"explode(CASE WHEN {k} % 5 = 0 THEN array(1, 2) ELSE array(1) END) AS payment_sequential",
        "o_orderpriority",
        f"{main} AS main",
        f"{due} AS due",
    ).selectExpr(
        "order_id",
        "payment_sequential",
        "if(payment_sequential = 1, o_orderpriority, 'voucher') AS payment_type",
        "if(payment_sequential = 1, main, due - main) / 100 AS payment_value",
    )
    reviews = (
        source.where(f"{k} % 10 < 9")
        .selectExpr(k, f"{day} AS day", f"explode(sequence(0, if({k} % 50 = 0, 1, 0))) AS n")
        .selectExpr(
            f"{k} AS order_id",
            f"cast(1 + ({k} * 31 + n) % 5 AS int) AS review_score",
            "timestamp_seconds(day + (45 + n) * 86400) AS review_creation_date",
            "timestamp_seconds(day + (47 + n) * 86400) AS review_answer_timestamp",
        )
    )
    products = read("part").selectExpr("p_partkey AS product_id", "p_brand AS product_category_name")
    translation = (
        products.select("product_category_name")
        .where(f"product_category_name <> '{UNTRANSLATED_BRAND}'")
        .distinct()
        .selectExpr(
            "product_category_name",
            "concat('cat_', product_category_name) AS product_category_name_english",
        )
    )
    buyer, vendor = read("customer"), read("supplier")
    customers = buyer.join(nation, buyer["c_nationkey"] == nation["n_nationkey"], "left").selectExpr(
        "c_custkey AS customer_id", "c_custkey AS customer_unique_id", "n_name AS customer_state"
    )
    sellers = vendor.join(nation, vendor["s_nationkey"] == nation["n_nationkey"], "left").selectExpr(
        "s_suppkey AS seller_id", "n_name AS seller_state"
    )
    return Tables(
        orders=orders,
        order_items=items,
        order_payments=payments,
        order_reviews=reviews,
        products=products,
        sellers=sellers,
        customers=customers,
        category_translation=translation,
    )


def retail_population(spark: SparkSession, directory: str) -> DataFrame:
    """An invented population per nation, one nation left out."""
    return (
        read_retail(spark, directory, "nation")
        .where(f"n_name <> '{UNKNOWN_POPULATION_NATION}'")
        .selectExpr("n_name AS state", "cast((n_nationkey + 1) * 500000 AS bigint) AS population")
    )
