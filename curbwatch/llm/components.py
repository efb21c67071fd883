"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (partial sums first, so a node with a third of
all edges costs one row per task) and a join of the edges with those minima.
Each round is written to the shared folder, which cuts the lineage; the rounds
grow with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b of one type);
    a component is named by its smallest node. Nulls and loops are no edges."""
    a, b = F.col("a"), F.col("b")
    stars = edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    stars = written(stars)
    seen = None
    while (state := _state(stars)) != seen:
        seen = state
        stars = written(_small_star(_large_star(stars)))
    leaves = stars.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return leaves.union(stars.select("lo", "lo").distinct())


def _state(stars: DataFrame) -> tuple:
    """Number of edges and a checksum of them: unchanged stars are finished ones."""
    key = F.xxhash64("hi", "lo")
    row = stars.agg(F.count("*").alias("n"), F.bit_xor(key).alias("x"), F.sum(F.shiftright(key, 32)).alias("s")).first()
    return row["n"], row["x"], row["s"]


def _large_star(stars: DataFrame) -> DataFrame:
    """Larger neighbours of a node are tied to the smallest of its neighbourhood."""
    both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(stars.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, are tied to the smallest of them."""
    least = stars.groupBy("hi").agg(F.min("lo").alias("m"))
    tied = stars.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return tied.union(least.select("hi", F.col("m").alias("lo"))).distinct()
