"""Reading the marketplace tables from files, object stores and databases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.plans.tables import Tables
from mercato.sources.csv_files import read_csv
from mercato.sources.schema import TABLE_COLUMNS, conform

# Part of the file or folder name by which a table is found.
TABLE_STEMS = {name: name for name in TABLE_COLUMNS} | {
    "category_translation": "category*translation",
}
OPTIONAL_TABLES = frozenset({"geolocation"})


def read_table(spark: SparkSession, path: str, table: str, fmt: str = "csv", multiline: bool = True) -> DataFrame:
    """Read one table and give its known columns their types.

    ``path`` may be any URI Spark reads (local, ``hdfs:``, ``s3a:``, ``gs:``,
    ``abfss:``), a folder or a pattern.  CSV is read as text by header name,
    without a pass over the data to guess types; a byte-order mark in front of
    the first header is removed, or the join key below it would never match.
    """
    if fmt == "csv":
        raw = read_csv(spark, path, multiline)
    else:
        raw = spark.read.format(fmt).load(path)
    return conform(raw, table)


def load_tables(
    spark: SparkSession,
    directory: str,
    fmt: str = "csv",
    paths: Mapping[str, str] | None = None,
) -> Tables:
    """Read the nine tables below ``directory``.

    A table is the files or the folder whose name contains the table name;
    ``paths`` overrides that per table.  Geolocation, which no operator uses,
    is read only when ``paths`` names it.
    """
    paths = dict(paths or {})
    frames = {}
    for table, stem in TABLE_STEMS.items():
        if table in OPTIONAL_TABLES and table not in paths:
            continue
        where = paths.get(table, f"{directory.rstrip('/')}/*{stem}*")
        frames[table] = read_table(spark, where, table, fmt)
    return Tables(**frames)


def load_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    *,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int = 16,
    fetch_size: int = 10_000,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read the result of ``query`` from a SQL database.

    With ``partition_column`` and ``bounds`` the read is cut into
    ``partitions`` ranges, each fetched by its own task ``fetch_size`` rows at
    a time; the bounds place the cuts only, no row is lost outside them.
    """
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=f"({query}) src", fetchsize=str(fetch_size), **dict(properties or {})
    )
    if partition_column is not None:
        if bounds is None:
            raise ValueError("partition_column needs bounds")
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return reader.load()


def load_subset(
    tables: Tables,
    date_range: tuple[str, str] | None = None,
    states: Sequence[str] = (),
) -> Tables:
    """Narrow the catalog to orders of a date range and of customer states.

    Both ends of the range count.  The date filter reaches the scan of the
    orders; the other fact tables follow by semi-join on the order.
    """
    if date_range is None and not states:
        return tables
    orders, customers = tables.orders, tables.customers
    if date_range is not None:
        low, high = (F.lit(d).cast("timestamp") for d in date_range)
        orders = orders.where(F.col("order_purchase_timestamp").between(low, high))
    if states:
        customers = customers.where(F.col("customer_state").isin(list(states)))
        orders = orders.join(customers.select("customer_id"), "customer_id", "left_semi")
    keys = orders.select("order_id")
    return tables.replace(
        orders=orders,
        customers=customers,
        order_items=tables.order_items.join(keys, "order_id", "left_semi"),
        order_payments=tables.order_payments.join(keys, "order_id", "left_semi"),
        order_reviews=tables.order_reviews.join(keys, "order_id", "left_semi"),
    )


#: Buckets of the random key in each of the two counts that place a sample's cut.
SAMPLE_BUCKETS = 4096


def sample_cap(df: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """A uniform random sample of at most ``n`` rows.

    Rows get a random key, and those below a cut stay, in whatever task they
    are.  The cut is the key after the ``n`` smallest: counts per bucket of the
    key find the bucket it falls in, counts within that one a bucket 4096 times
    as narrow, whose few keys are looked at.  Fewer rows come only if keys tie
    at the cut.  ``df`` must give the same rows in the same partitions each
    time it is read, as stored tables do.
    """
    if n <= 0:
        return df.limit(0)
    keys = df.select(F.rand(seed).alias("key"))
    target = F.lit(n).cast("bigint")

    def crossing(counts: DataFrame, ahead: Column) -> DataFrame:
        """The first bucket up to which more than ``n`` rows lie, and how many lie before it."""
        upto = F.sum("rows").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) + ahead
        placed = counts.withColumn("upto", upto).filter(F.col("upto") > target)
        before = F.min_by(F.col("upto") - F.col("rows"), "bucket")
        return placed.agg(F.struct(F.min("bucket").alias("bucket"), before.alias("before")).alias("at"))

    def bucket(width: int) -> Column:
        return F.floor(F.col("key") * width).cast("bigint")

    # At most 4096 rows in each of the two windows; the tables of one row are scalar subqueries.
    wide = crossing(keys.groupBy(bucket(SAMPLE_BUCKETS).alias("bucket")).agg(F.count(F.lit(1)).alias("rows")), F.lit(0))
    inside = keys.withColumn("at", wide.scalar()).filter(bucket(SAMPLE_BUCKETS) == F.col("at.bucket"))
    counts = inside.groupBy(bucket(SAMPLE_BUCKETS**2).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.first("at.before").alias("ahead"))
    narrow = crossing(counts, F.col("ahead"))
    few = keys.withColumn("at", narrow.scalar()).filter(bucket(SAMPLE_BUCKETS**2) == F.col("at.bucket"))
    cut = few.agg(F.get(F.array_sort(F.collect_list("key")), (target - F.first("at.before")).cast("int")))
    marked = df.withColumn("__sample_key", F.rand(seed)).withColumn("__sample_cut", cut.scalar())
    return marked.filter("__sample_cut is null or __sample_key < __sample_cut").select(*(f"`{c}`" for c in df.columns))


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a result as CSV with a header line, one file per partition; quotes within values are doubled."""
    df.write.mode(mode).options(header=True, escape='"').csv(path)
