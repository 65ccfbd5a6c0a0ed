"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours.

    The least ones are written, so that the join's sides are shuffled apart: a node with very many neighbours is then
    split by AQE's skew join, or the small side is broadcast by AQE's own check.
    """
    near = _both(edges)
    least = common.written(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    return near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of these; here b is the smaller end."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return down.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of the edges (a, b: long): the label is the component's least node.

    Each round is written to the shared folder, so an executor's loss costs one round at most.
    """
    star = common.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        # Done if every node has one parent and no parent has a parent.
        bad = star.groupBy("a").count().filter("count > 1").select("a").unionByName(star.select(F.col("b").alias("a")).join(star.select("a"), "a", "left_semi"))
        if bad.isEmpty():
            break
        star = common.written(_small(common.written(_large(star), "edges")), "edges")
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    return star.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
