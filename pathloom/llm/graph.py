"""Connected components by alternating large-star and small-star.

Edges are pairs of ids. Each half step takes the least neighbour of every node (pre-aggregated before the
shuffle) and joins it back to the edges. Both sides of such a join are read from tables in the shared folder,
so a node with very many edges is a skewed join that adaptive execution splits; tables of a step go when the next is written. Ends when a whole step leaves
the edges as they were: each node then points at the least id of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm._shared import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    """Tells sets of edges apart: count, and sums of two hashes (as decimals, which don't overflow)."""
    sums = [F.sum(F.xxhash64(F.lit(seed), "high", "low").cast("decimal(20,0)")) for seed in (1, 2)]
    return tuple(edges.agg(F.count("*"), *sums).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of its neighbours and itself."""
    both = edges.select(F.col("low").alias("node"), F.col("low").alias("near")).unionByName(edges.select(F.col("high").alias("node"), F.col("low").alias("near")))
    least = materialize(both.groupBy("node").agg(F.min("near").alias("least")), "large-star")
    moved = edges.join(least, F.col("low") == F.col("node"))
    out = materialize(moved.select("high", F.col("least").alias("low")).distinct(), "edges")
    discard(least, edges)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of these."""
    least = materialize(edges.groupBy("high").agg(F.min("low").alias("least")).withColumnRenamed("high", "node"), "small-star")
    others = edges.join(least, F.col("high") == F.col("node")).where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    out = materialize(others.unionByName(least.select(F.col("node").alias("high"), F.col("least").alias("low"))).distinct(), "edges")
    discard(least, edges)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least id of its component) of all nodes of the edges (a, b) but those least ids.

    Edges with a null end and loops say nothing; repeated edges are as one. No edges give no rows.
    """
    tied = edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    tied = materialize(tied, "edges")
    mark = _mark(tied)
    while mark[0]:
        tied = _small_star(_large_star(tied))
        before, mark = mark, _mark(tied)
        if mark == before:
            break
    return tied.select(F.col("high").alias("node"), F.col("low").alias("component"))
