"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import written


def _mark(edges: DataFrame):
    """Number of edges and a sum over their hashes; equal marks mean equal edges."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for all nodes of ``links`` (columns ``a`` and ``b``).

    Large star: each node's larger neighbours are tied to its smallest one.
    Small star: each node's smaller neighbours and itself are.  Both keep the
    components; they are repeated until nothing changes, when every component
    is one star.  Rows of a node with very many links are combined before
    shuffles and stand on the side of joins that Spark may split.  Each round
    is a table in the shared folder.
    """
    links = links.filter("a <> b and a is not null and b is not null")
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "star")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "star")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(centres)
