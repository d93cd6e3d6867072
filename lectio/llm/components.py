"""Distributed union-find: alternating large-star and small-star over an edge table.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every step is an
aggregation with a map-side part or an equi-join of two written tables, so that a node with very
many neighbours is one hot join key whose partition the adaptive planner splits; no node's
neighbours are ever gathered. An edge table of at most ONE_TASK rows is a task's work and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import discard, written


#: Edges (two keys of 8 or 16 bytes each) that a task takes whole; a larger table is shuffled. The bound doesn't grow with the input.
ONE_TASK = 1 << 17


def _dealt(table: DataFrame, few: bool) -> DataFrame:
    return table.coalesce(1) if few else table


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = _dealt(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), few)
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    out = both.join(_dealt(least, few), "u").where("v > u and v != m")
    moved = written(out.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
    discard(least)
    return moved


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    down = _dealt(edges, few).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(_dealt(least, few), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = written(_dealt(moved.union(least.select("u", F.col("m").alias("v"))), few).distinct(), "edges")
    discard(least)
    return out


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge leads from a node of one edge to a node that no edge leaves: nothing is left to do."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("of")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("of")))).alias("e"))
    roles = ends.groupBy("e.node").agg(F.sum("e.out").alias("out"), F.max("e.of").alias("of"))
    return roles.where("out > 1 OR (out > 0 AND of > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of any ordered type to (node, component): the smallest node reachable.

    Nodes without an edge to another node are absent. Loops and nulls are ignored; repeated and
    reversed edges are harmless. An empty table gives an empty table.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    few = edges.count() <= ONE_TASK
    while not _are_stars(_dealt(edges, few)):
        large = _large_star(edges, few)
        small = _small_star(large, few)
        discard(edges, large)
        edges = small
    edges = _dealt(edges, few)
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
