"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, save


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that can be reached) for all nodes of edges (a, b), any order, repeats allowed.

    Alternating large-star and small-star steps: each node's neighbours are pointed at the smallest of them, until
    nothing changes. A step is one aggregation and one join; each round is written to the shared folder. Nodes with very
    many neighbours are split by adaptive execution. An empty table gives an empty table.
    """

    def smallest(both: DataFrame) -> DataFrame:
        return both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = mark(e)
    while seen[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        large = smallest(both).where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        small = smallest(large.select(F.col("a").alias("u"), F.col("b").alias("v")))  # all v < u
        new = save(small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select("u", "m")).where("a <> b").distinct(), "edges")
        now = mark(new)
        forget(e)
        e = new
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
