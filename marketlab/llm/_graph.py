"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm._store import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every node's larger (or no larger) neighbours to the least node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # The least neighbour comes from an aggregation with partial sums, so a hub's edges never meet in one task.
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u"), F.col("m")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, component) for every node that has an edge; a component is named by its least node.

    Ends when a round changes nothing; after ``rounds`` rounds without that it raises, as components may still be split.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        now = materialize(_star(_star(now, True), False), "edges")
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
