"""Connected components of an edge table by alternating star contractions, all as shuffles of edges.

Each step replaces a node's edges by edges to the least node near it, so the number of edges never grows and the least
node of a component is reached in about log^2 steps. Hubs are ordinary rows: minima are pre-aggregated, and the join that
hands a minimum to a hub's edges is one that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftrank.tables import park, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    lower = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """node, component for each node of edges (a, b; long, not null): the least node that it reaches. Nodes without an edge are absent; loops are ignored."""
    edges = park(edges.where("a <> b").select("a", "b").distinct(), "edges")
    seen = None
    for _ in range(most_steps):
        last, edges = edges, park(_small_star(_large_star(edges)), "stars")
        release(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
