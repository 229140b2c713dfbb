"""CSV files as text columns, read in parallel within a file, too.

One pass over the lines finds each file's header and whether quotes stay open
at the end of a line.  Files are then read together with all others of the same
header: by Spark's CSV reader, which splits large files, if every line is a
record, and else by joining the lines of a record first.  A line belongs to the
record before it if the number of quotes ahead of it in its file is odd; that
number is the sum over earlier splits of the file and earlier lines of its own.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BYTE_ORDER_MARK = "﻿"
OPTIONS = {"quote": '"', "escape": '"'}


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``value``, its ``file``, the start of its split (``block``), its ``place`` in it, and whether its quotes are ``odd``."""
    text = spark.read.option("lineSep", "\n").text(paths)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return text.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        (quotes % 2).alias("odd"),
    )


def _names(header: str) -> list[str]:
    found = next(csv.reader([header.lstrip(BYTE_ORDER_MARK).rstrip("\r")]), [])
    return [name.strip().lstrip(BYTE_ORDER_MARK) for name in found]


def _schema(names: Sequence[str]) -> StructType:
    return StructType([StructField(name, StringType()) for name in names])


def _spanning(spark: SparkSession, files: list[str], schema: StructType) -> DataFrame:
    """Records of files in which some have line breaks.

    Lines meet by split, not by file.  Only records of several lines are
    grouped; the others go straight to the parser.
    """
    lines = _lines(spark, files)
    by_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg(F.sum("odd").alias("odds"))
    splits = splits.select("file", "block", F.coalesce(F.sum("odds").over(by_file), F.lit(0)).alias("earlier"))
    by_split = Window.partitionBy("file", "block").orderBy("place")
    inside = F.coalesce(F.sum("odd").over(by_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = lines.withColumns({"inside": inside, "number": F.row_number().over(by_split)})
    counted = counted.filter((F.col("block") > 0) | (F.col("number") > 1))  # not the header
    counted = counted.join(splits, ["file", "block"]).withColumn("ahead", F.col("earlier") + F.col("inside"))
    alone = (F.col("ahead") % 2 == 0) & (F.col("odd") == 0)
    parts = counted.filter(~alone).groupBy("file", F.floor(F.col("ahead") / 2).alias("record"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "place", "value")))
    joined = parts.agg(F.array_join(F.transform(ordered, lambda line: line["value"]), "\n").alias("value"))
    records = counted.filter(alone).select("value").unionByName(joined.select("value"))
    records = records.select(F.regexp_replace("value", "\r$", "").alias("value")).filter("value <> ''")
    ddl = ", ".join(f"`{name}` string" for name in schema.names)
    return records.select(F.from_csv("value", ddl, OPTIONS).alias("record")).select("record.*")


def read_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """CSV files as text columns by the names in each file's own header.

    A quoted line break is part of its record, as is a doubled quote; quotes
    must be balanced.  ``multiline=False`` says that no record holds a line
    break.  Files may order their columns differently or lack some; files
    without a line are left out, and if there is none, so are all columns.
    """
    # One row per file, as many as Spark lists itself, and one job for all of them.
    first = F.min_by("value", F.struct("block", "place"))
    files = _lines(spark, path).groupBy("file").agg(first.alias("header"), F.max("odd").alias("odd")).collect()
    groups: dict[tuple, list[str]] = {}
    for file in files:
        spans = bool(file["odd"]) and multiline
        groups.setdefault((tuple(_names(file["header"])), spans), []).append(unquote(file["file"]))
    out = None
    for (names, spans), paths in sorted(groups.items()):
        schema = _schema(names)
        if spans:
            frame = _spanning(spark, sorted(paths), schema)
        else:
            frame = spark.read.schema(schema).options(header=True, **OPTIONS).csv(sorted(paths))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return spark.createDataFrame([], StructType()) if out is None else out
