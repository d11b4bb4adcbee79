"""Distributed connected components: alternating large-star and small-star rounds over an edge table.

A round is two shuffles of narrow rows by node and one that drops repeats; nothing is gathered on the driver but the
number of edges at the start and, after each round, whether every node has come to one edge to a root.

A node's least neighbour is pre-aggregated and written, and joined back: both sides of the join are then plain shuffles,
whose skewed partitions (a hub with a third of all edges) adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findloom.llm.common import discard, written


def _with_least(edges: DataFrame) -> DataFrame:
    """edges(u, v) with m, the least v of each u."""
    return edges.join(written(edges.groupBy("u").agg(F.min("v").alias("m")), "least"), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour, or to the node itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = _with_least(both).where("v > u")
    return moved.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the least of them."""
    ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    moved = _with_least(edges).select(F.explode(ends).alias("e")).select("e.u", "e.v")
    return moved.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    return ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) edges of any orderable type -> (node, component), component the smallest node reachable.

    Self-loops and repeated edges are allowed, null ends are dropped; nodes without an edge to another
    node are not in the result. An empty edge table gives an empty result.
    """
    current = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc")
    n = current.count()
    for _ in range(max_rounds if n else 0):
        following = written(_small_star(_large_star(current)), "cc")
        discard(current)
        current = following
        if _settled(current):
            break
    else:
        if n:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
