"""Connected components of a table of links, by alternating large and small stars.

Each round is two joins and two aggregations with map-side combine; a node with very many links is a skewed join key,
which adaptive execution splits. Every round is written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v): each u's neighbours hang on the least of them and u; large: only neighbours above u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    joined = pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    own = least.filter("m < u").select("u", F.col("m").alias("v"))
    return joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (u, v) of longs -> node, root (the least node of its component); only nodes with a link to another."""
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "links")
    state = None
    for _ in range(most_rounds):
        large = _star(_both_ways(edges), True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
        edges = materialize(_star(large, False).filter("u <> v"), "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        state = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
