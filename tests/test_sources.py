import pytest
from pyspark.sql import functions as F

from mercato import export_csv, load_jdbc, load_subset, load_tables, population, sample_cap
from mercato.sources.inline import inline_table
from mercato.sources.csv_files import read_csv
from mercato.sources.readers import read_table
from mercato.sources.schema import coerce_ts, require_columns

FILES = {
    "shop_customers_dataset.csv": "customer_id,customer_unique_id,customer_zip,customer_state\nc1,u1,01000,SP\n",
    "shop_order_items_dataset.csv": "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
    'o1,1,p1,s1,2018-01-05 10:00:00,"10.50",1.5\no1,2,p1,s1,never,x,2.5\n',
    "shop_order_payments_dataset.csv": "order_id,payment_sequential,payment_type,payment_installments,payment_value\no1,1,card,2,14.5\n",
    "shop_order_reviews_dataset.csv": "review_id,order_id,review_score,review_creation_date,review_answer_timestamp\n"
    "r1,o1,5,2018-01-20,2018-01-21 08:00:00\n",
    "shop_orders_dataset.csv": "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
    "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
    "o1,c1,delivered,2018-01-01 10:00:00,2018-01-01 11:00:00,,bad,2018-01-15 00:00:00\n",
    "shop_products_dataset.csv": "product_id,product_category_name\np1,livros\n",
    "shop_sellers_dataset.csv": "seller_id,seller_zip,seller_state\ns1,02000,RJ\n",
    "product_category_name_translation.csv": "﻿product_category_name,product_category_name_english\r\nlivros,books\r\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_bytes(text.encode("utf-8"))
    return str(tmp_path)


def test_load_csv_tables(spark, folder):
    t = load_tables(spark, folder)
    assert t.category_translation.columns == ["product_category_name", "product_category_name_english"]
    assert [tuple(r) for r in t.category_translation.collect()] == [("livros", "books")]
    assert dict(t.orders.dtypes)["order_purchase_timestamp"] == "timestamp"
    row = t.orders.first()
    assert row.order_delivered_customer_date is None and row.order_delivered_carrier_date is None
    items = t.order_items.orderBy("order_item_id").collect()
    assert [(r.price, r.freight_value) for r in items] == [(10.5, 1.5), (None, 2.5)]
    assert items[1].shipping_limit_date is None
    assert t.order_reviews.first().review_score == 5
    assert t.geolocation is None


def test_parquet_and_uri(spark, folder, tmp_path):
    load_tables(spark, folder).orders.write.parquet(str(tmp_path / "pq" / "orders"))
    df = read_table(spark, f"file://{tmp_path}/pq/orders", "orders", "parquet")
    assert df.count() == 1 and dict(df.dtypes)["order_approved_at"] == "timestamp"


def test_coerce_skips_absent_columns(spark):
    df = spark.createDataFrame([("2018-01-01 00:00:00",), ("bad",), (None,)], "t string")
    assert [r.t is None for r in coerce_ts(df, ["t", "gone"]).collect()] == [False, True, True]


def test_required_columns(spark):
    df = spark.range(1)
    assert require_columns(df, ["id"]) is df
    with pytest.raises(ValueError, match=r"\['a', 'b'\]"):
        require_columns(df, ["b", "id", "a"])


def test_population(spark):
    df = population(spark)
    assert df.count() == 27
    assert df.where("state = 'SP'").first().population == 46649132
    assert [tuple(r) for r in population(spark, {"O'X": 5}).collect()] == [("O'X", 5)]


def test_inline_table(spark):
    rows = [("it's \\ here", None, True, 1.5), ("b", 2, False, None)]
    df = inline_table(spark, {"a": "string", "b": "bigint", "c": "boolean", "d": "double"}, rows)
    assert [tuple(r) for r in df.collect()] == rows


def test_subset(spark, toy):
    part = load_subset(toy, ("2018-01-01", "2018-03-01"), ["SP", "AC"])
    assert sorted(r.order_id for r in part.orders.collect()) == ["A", "B"]
    assert part.order_items.count() == 2 and part.order_payments.count() == 3 and part.order_reviews.count() == 2
    assert load_subset(toy) is toy


def test_subset_filter_reaches_the_scan(spark, toy, tmp_path):
    toy.orders.write.parquet(str(tmp_path / "o"))
    stored = toy.replace(orders=spark.read.parquet(str(tmp_path / "o")))
    plan = load_subset(stored, ("2018-01-01", "2018-02-01")).orders._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(order_purchase_timestamp" in plan


@pytest.mark.parametrize("n", [0, 1, 10, 999, 1000, 2000])
def test_sample_cap(spark, n):
    df = spark.range(1000).repartition(4)
    assert sample_cap(df, n).distinct().count() == min(n, 1000)


def test_sample_cap_keeps_a_large_sample_spread_out(spark):
    df = spark.range(0, 100_000, 1, 8).selectExpr("id", "id % 2 AS `odd one`")
    sample = sample_cap(df, 60_000)
    sizes = [r["count"] for r in sample.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 60_000 and len(sizes) == 8 and max(sizes) < 8_000
    assert sample.columns == ["id", "odd one"] and sample.distinct().count() == 60_000
    assert abs(sample.agg(F.avg("id")).first()[0] - 50_000) < 1_000


def test_export_csv(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1.5), (None, 2.0)], "k string, v double")
    export_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert {(r.k, r.v) for r in back.collect()} == {("a,b", "1.5"), (None, "2.0")}


def test_jdbc_needs_bounds(spark):
    with pytest.raises(ValueError, match="bounds"):
        load_jdbc(spark, "jdbc:none:x", "SELECT 1", partition_column="id")


def test_views(spark, toy):
    toy.register("toy_")
    assert spark.sql("SELECT count(*) FROM toy_orders").first()[0] == 5


def test_csv_records_across_lines_and_headers_by_file(spark, tmp_path):
    (tmp_path / "a_reviews.csv").write_text(
        'review_id,order_id,review_score,comment,review_creation_date,review_answer_timestamp\nr1,o1,5,"two\nlines, a ""quote""",2018-01-20,\nr2,o2,4,,2018-01-21,\n'
    )
    (tmp_path / "b_reviews.csv").write_text("order_id,review_answer_timestamp,review_creation_date,review_score\no3,,2018-02-01,1\n")
    got = read_table(spark, f"{tmp_path}/*reviews*", "order_reviews")
    rows = {r["order_id"]: (r["review_score"], str(r["review_creation_date"])[:10]) for r in got.collect()}
    assert rows == {"o1": (5, "2018-01-20"), "o2": (4, "2018-01-21"), "o3": (1, "2018-02-01")}


def _csv_text(rows, end="\n"):
    def field(value):
        return "" if value is None else '"' + value.replace('"', '""') + '"' if any(c in value for c in ',"\n') else value

    return end.join(",".join(map(field, row)) for row in rows) + end


def test_csv_of_many_files_and_headers(spark, tmp_path):
    want = []
    for i in range(12):
        names = ["a", "b", "c"] if i % 3 else ["c", "a"]
        rows = [[f"{n}{i}-{k}" + ("\nnext, line\n" if (i, k % 5) == (4, 0) else "") + ('"q"' if k % 7 == 0 else "") for n in names] for k in range(30)]
        (tmp_path / f"part {i}.csv").write_text(("\ufeff" if i == 5 else "") + _csv_text([names, *rows], "\r\n" if i == 7 else "\n"), newline="")
        want += [tuple(dict(zip(names, row)).get(n) for n in "abc") for row in rows]
    (tmp_path / "part empty.csv").write_text("")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    got = read_csv(spark, str(tmp_path))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(jobs) <= 4  # not one per file
    assert sorted(tuple(r[n] for n in "abc") for r in got.collect()) == sorted(want, key=lambda r: (r[0], r[1] or "", r[2]))


def test_csv_file_is_read_by_many_tasks(spark, tmp_path):
    rows = [[str(i), "x" * (i % 50) + ("\n\n a, \"b\"\n" if i % 11 == 0 else ""), "end"] for i in range(4000)]
    (tmp_path / "large.csv").write_text(_csv_text([["id", "note", "end"], *rows]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = read_csv(spark, f"{tmp_path}/large.csv")
        assert spark.read.text(f"{tmp_path}/large.csv").rdd.getNumPartitions() > 8
        assert sorted((r["id"], r["note"] or "", r["end"]) for r in got.collect()) == sorted(map(tuple, rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
