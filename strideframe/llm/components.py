"""Connected components of a table of edges by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.session import cut_lineage


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r.n, r.x


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node of the edges (u, v), for any orderable type.

    A large step ties a node's larger neighbours to its least neighbour, a small step its smaller ones; edges only get
    fewer or shorter, and the rounds are about the logarithm of the longest path. Only counts reach the driver.
    """
    stars, before = cut_lineage(edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()), None
    while (now := _state(stars)) != before:
        before = now
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("x"), F.least("u", "w").alias("w"))
        large = both.join(least, F.col("u") == F.col("x")).where("v > u").select(F.col("w").alias("u"), "v").distinct()
        # Each node with its smaller neighbours: the least of them takes all.
        down = large.groupBy("v").agg(F.min("u").alias("w")).select(F.col("v").alias("x"), "w")
        linked = large.join(down, F.col("v") == F.col("x"))
        small = linked.where("u != w").select(F.col("w").alias("u"), F.col("u").alias("v")).union(down.select(F.col("w").alias("u"), F.col("x").alias("v")))
        stars = cut_lineage(small.distinct())
    return stars.select(F.col("v").alias("node"), F.col("u").alias("component")).union(stars.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
