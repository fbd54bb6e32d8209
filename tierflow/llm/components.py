"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with m, the least of u and its v's. A hub is a skewed equi-join, which AQE splits."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = _least_neighbour(large)
    hang = small.select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m"))
    return hang.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component.

    `edges`: longs u and v in any direction, repeats and loops allowed. Each
    round is cut off by a reliable checkpoint; rounds grow with the logarithm
    of the longest path, and their sum is compared until nothing changes.
    """
    now = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state or not found[0]:
            break
        state, now = found, checkpoint(_round(now))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
