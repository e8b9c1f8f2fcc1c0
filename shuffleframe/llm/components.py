"""Connected components of links, by alternating large-star and small-star steps.

Each step takes the smallest neighbour of every node (an aggregation with partial results) and joins it
back to the links (a shuffle join, whose skewed partitions adaptive execution splits), so a node with a
great many links is never gathered in one task and nothing is collected. The smallest neighbours and each
round's links are written to the shared folder, so that lineage stays short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(links: DataFrame) -> DataFrame:
    """links(u, v) both ways joined with the smallest of u and its neighbours: (u, v, m)."""
    low = materialise(links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    return links.join(low, "u")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for all nodes of the links; component is the smallest node that can be reached.

    Links may be repeated, in either direction, and join a node with itself; rows with a null are no links. Nodes are of a type with an order, such as long. No links give no rows.
    """
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    now = materialise(links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    said = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == said or not state.n:
            break
        said = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(_star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        small = _star(large)
        now = materialise(small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
