"""Connected components of an edge table, in rounds that stay tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankloom.staging import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` from ``a, b``: the smallest node that can be reached; nodes without an edge are left out.

    Large-star and small-star rounds: every node hands its larger neighbours to its smallest one, then its smaller
    ones. Edges become stars in about log(n) rounds. Minima are pre-aggregated, every round is a written table, and only
    whether it is done reaches the driver.
    """
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = stage(current, "edges")
    while not _is_stars(current):
        both = current.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            current.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stage(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node, which hangs on none."""
    roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    sums = roles.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return sums.where("hangs + holds > 1").isEmpty()
