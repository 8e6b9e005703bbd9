"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._shared import salted, stored


def _toward_least(edges: DataFrame, both: bool) -> DataFrame:
    """One star step. ``edges``: distinct (a, b) with a > b. Large (both): a node's greater neighbours move to its least; small: a node and its lesser neighbours do."""
    if both:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = salted(near.filter("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = salted(edges, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
    return moved.filter("a > b").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Rows (node, component): the least node that each node of ``edges`` (a, b) reaches.

    Minima are pre-aggregated before each shuffle and the joins that follow are
    salted, so a node with very many edges is no bottleneck. Every round is
    written to the shared folder. Nodes without an edge to another have no row. If
    ``rounds`` rounds are not enough an error is raised; their number grows with the
    logarithm of the nodes.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = stored(now, "edges"), None
    for _ in range(rounds):
        now = stored(_toward_least(_toward_least(now, True), False), "star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
