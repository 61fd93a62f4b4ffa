"""Connected components of an edge table, in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, held, spread_join


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node that ``node`` reaches by edges.

    Alternates the two star operations of Kiveris et al. (2014): every node's
    larger neighbours, then its smaller ones, are tied to its smallest
    neighbour, until all that is left are stars. Each round is two grouped minima (partial
    aggregates come first, so a node with very many neighbours is no hot group)
    and two joins, in which such a node's edges are dealt to several tasks.
    Nodes without an edge to another node are absent; null ends are ignored.
    """
    e = held(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    while not _is_stars(e):
        n = e.count()
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = spread_join(both.where("v > u"), least, "u", "v", narrow=True, rows=n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large if n <= BROADCAST_ROWS else held(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, "u", "v", narrow=True, rows=n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = held(small.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _is_stars(e: DataFrame) -> bool:
    """Whether every larger end has one edge and is no smaller end: then nothing is left to do."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("larger"), F.lit(0).alias("smaller")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("larger").alias("larger"), F.max("smaller").alias("smaller")).where("larger > 1 or (larger = 1 and smaller = 1)").limit(1).count() == 0
