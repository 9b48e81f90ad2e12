"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation and a join (partial aggregation and skew-split
joins take hot nodes); the edges stay distributed and are written to the shared
folder after each round. Rounds grow with the logarithm of the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # neighbours of u: all of them, or only the smaller ones
    near = both if large else both.filter("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = near.join(least, "u")
    if large:
        moved = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return moved.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (u, v); component is the smallest node.

    Loops are ignored; an empty edge table gives no rows.
    """
    edges = scratch(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .filter("u != v").distinct(), "edges")
    state = None
    while True:
        edges = scratch(_star(_star(edges, True), False), "edges")
        # a fixed point is reached when the set of edges stays the same
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if now == state:
            break
        state = now
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
