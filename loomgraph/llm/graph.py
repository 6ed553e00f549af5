"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import stored

MAX_ROUNDS = 64


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v) rows: links to the smallest neighbour."""
    if large:
        edges = edges.union(edges.select("v", "u"))
    # written first, so that the join has plain exchanges on both sides and a hot star can be split
    least = stored(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "stars")
    linked = edges.join(least, "u")
    if large:
        return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def settled(edges: DataFrame) -> bool:
    """Whether every node points at one root, and no root points on: then the (u, v) edges are stars."""
    roots = edges.select(F.col("v").alias("node"), F.lit(1).alias("as_root"), F.lit(0).alias("as_node"))
    nodes = edges.select(F.col("u").alias("node"), F.lit(0).alias("as_root"), F.lit(1).alias("as_node"))
    seen = roots.unionByName(nodes).groupBy("node").agg(F.max("as_root").alias("roots"), F.sum("as_node").alias("links"))
    return not seen.filter("links > 1 or (links > 0 and roots > 0)").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the (u, v) edges except roots; root is the smallest node reached.

    Each step is written to the shared folder. The number of steps grows with the
    logarithm of the longest path.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    for _ in range(MAX_ROUNDS):
        if settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = stored(_stars(stored(_stars(now, True), "large-stars"), False), "small-stars")
    raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
