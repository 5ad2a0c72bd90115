"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import common


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node of the neighbourhood."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).toDF("a", "b").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge in edges(a, b); self-links and nulls are ignored.

    Each round's edges are written to the shared folder, counted and hashed by the job that writes them, and rounds go on
    until the edges stay the same. Only the last round's table is kept.
    """

    def settled(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        table = common.written(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "edges")
        return table, (seen.get.get("n"), seen.get.get("h"))

    now, was = settled(edges.select("a", "b").filter("a <> b").distinct())
    for _ in range(most):
        after, got = settled(_small(_large(now)))
        common.dropped(now)
        now = after
        if got == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        was = got
    raise RuntimeError(f"components did not settle in {most} rounds")
