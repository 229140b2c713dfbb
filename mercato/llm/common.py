"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Whitespace and words of the contracts: ASCII only, in Java and Python syntax.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the cluster's shared folder.

    ``spark.checkpoint.dir`` names that folder.  Only where it is unset, as in
    tests on one machine, a temporary folder is made and set.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = "file://" + tempfile.mkdtemp(prefix="mercato-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written as a table in the shared folder and read back.

    Later steps then read files that outlive executors instead of running the
    steps before again.  The schema is kept as it is, so nothing is inferred.
    """
    spark = frame.sparkSession
    path = scratch(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(StructType.fromJson(frame.schema.jsonValue())).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def one_space(text: str):
    """Column: null as empty, each run of ASCII whitespace as one space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def hand_back() -> None:
    """Give memory that this process has freed back to the system, as far as its allocators can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def frugal(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``run`` for ``mapInArrow``, with memory handed back at the end of a task: workers stay for later tasks and steps, beside an executor that grows."""

    def frugal_run(batches):
        try:
            yield from run(batches)
        finally:
            hand_back()

    return frugal_run


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, behind as many underscores as no column of ``frame`` has, whatever its case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
