"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, m): of every node the smallest of itself and its neighbours; written, so that joins on u can split a hot u."""
    return materialize(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star")


def _stars(pairs: DataFrame) -> bool:
    """Whether every edge leads from a node with no other edge to the root of its star."""
    ends = pairs.select("u", F.lit(1).alias("n")).union(pairs.select(F.col("v").alias("u"), F.lit(0).alias("n")))
    return ends.groupBy("u").agg(F.sum("n").alias("up"), F.min("n").alias("low")).where("up > 1 or up = 1 and low = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Each step contracts stars; the number of steps grows with the logarithm of the longest path. All state is in
    written tables, none on the driver. Self-links and repeated links are allowed; no edges give no rows.
    """
    pairs = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(pairs):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _smallest(both)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        release(pairs, low)
        low = _smallest(large)
        moved = large.join(low, "u")
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        pairs = materialize(small, "small")
        release(large, low)
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
