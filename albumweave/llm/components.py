"""Connected components by alternating large and small stars: every pass is a join and an aggregation over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumweave.llm.common import materialise

PASSES = 60


def _stars(edges: DataFrame) -> bool:
    """Whether every node is tied to one lesser node at most, and to none if another is tied to it."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of a table (a, b) of edges between longs; the root is the smallest node reached.
    Self edges are dropped; an empty table gives an empty result."""
    ordered = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(ordered(edges), "edges")
    for _ in range(PASSES):
        if _stars(now):
            break
        # Large star: a node's greater neighbours are tied to the least of its neighbours and itself.
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its lesser neighbours are tied to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = materialise(ordered(small), "edges")
    else:
        raise RuntimeError(f"components did not settle in {PASSES} passes")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
