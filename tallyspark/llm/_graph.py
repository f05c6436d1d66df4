"""Connected components of a large graph by alternating stars.

Each round rewires every edge to the smallest neighbour of its ends (first for
larger neighbours, then for smaller ones), until the edges are stars around the
smallest node of each component. Rounds are written to the shared folder; the
driver learns only whether another is needed. The smallest neighbours are
written too, so that both sides of their join are shuffled for it and a node with
very many edges is split over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import staged


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = staged(e.groupBy("u").agg(F.min("v").alias("m")), "lowest")
    rewired = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rewired.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _is_star(e: DataFrame) -> bool:
    """Every node but the roots has one edge, to a node that has none itself."""
    twice = e.groupBy("u").count().where("count > 1").select("u")
    chained = e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
    return twice.unionByName(chained).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; ``edges``: u, v as long; root is
    the smallest node of the component."""
    e = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _is_star(e):
        e = staged(_small_star(_large_star(e)), "edges")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
