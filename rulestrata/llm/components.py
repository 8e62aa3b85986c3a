"""Connected components of an undirected graph of long ids, on the cluster only.

Alternates the large-star and small-star steps (Kiveris et al., "Connected Components
in MapReduce and Beyond", 2014): every step moves edges towards the smallest id that
an end knows, and the fixed point is one star per component. Each step shuffles edges
alone; ids and edges are never collected. A hub's edges meet its minimum in a join, so
that adaptive skew handling can split them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _both(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    both = _both(e)
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    leaf = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return leaf.union(low.select("u", F.col("m").alias("v"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges``: two long columns. Returns (id, component): every id that has an edge
    to another, with the smallest id of its component. Null ends, loops and repeated
    edges count for nothing."""
    a, b = edges.columns[:2]
    e = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    before = _state(e)
    while before[0]:
        e = written(_small_star(_large_star(e)), drop=[e])
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
