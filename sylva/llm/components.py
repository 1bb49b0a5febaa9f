"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours of each node (the larger ones, or the smaller ones and itself) to the smallest of them.

    The minimum is pre-aggregated before the shuffle and written; a join of two plain shuffles is one whose skewed
    partitions Spark splits, so the edges of a node of any degree are shared by tasks.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = materialize(out.where("u != v").distinct())
    discard(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node with an edge; edges has long columns u, v."""
    edges = materialize(edges.where("u != v").distinct())
    before = None
    while True:
        large = _star(edges, True)
        small = _star(large, False)
        discard(edges, large)
        edges = small
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
