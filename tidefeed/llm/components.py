"""Connected components of an edge table, by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges ``(high, low)`` with low < high."""
    both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(
        edges.select(F.col("low").alias("u"), F.col("high").alias("v")))
    nearest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(nearest, "u").select(F.col("v").alias("high"), F.col("m").alias("low"))
    large = large.unionByName(nearest.where("m < u").select(F.col("u").alias("high"), F.col("m").alias("low"))).distinct()
    lowest = large.groupBy("high").agg(F.min("low").alias("m"))
    small = large.join(lowest, "high").where("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
    return small.unionByName(lowest.select("high", F.col("m").alias("low"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every id on an edge ``(a, b)``; the component is its smallest id.

    Star steps repeat until nothing changes (a few rounds; at most about the square
    of the logarithm of the largest component).  Each round is written to the shared
    folder; only a row count and a checksum reach the driver.  Loops, repeated edges
    and an empty table are allowed.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        now = saved(_stars(now), "stars")
    leaves = now.select(F.col("high").alias("id"), F.col("low").alias("component"))
    return leaves.unionByName(now.select(F.col("low").alias("id"), F.col("low").alias("component")).distinct())
