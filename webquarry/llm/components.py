"""Connected components of an edge table, by alternating star operations on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = _downwards(edges)
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _downwards(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _settled(edges: DataFrame) -> bool:
    """Does every node have one smaller neighbour at most, and none if it has larger ones?"""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for every id that has an edge; component_id is the smallest id reachable.

    `edges` has longs a and b; direction, repeats and loops do not matter.  Each round leaves
    every node linked to a smaller one of its component, until all hang on the smallest.  A round is
    two aggregates that combine before the shuffle and two equi-joins that Spark can split, so a node
    with very many edges is no single task.  The number of rounds grows with the logarithm of the
    largest component; each ends in a table in the shared folder.
    """
    now = written(_downwards(edges.where("a <> b")).distinct(), "edges")
    while not _settled(now):
        now = written(_small_star(_large_star(now)), "stars")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots)
