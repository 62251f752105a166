"""Connected components by alternating stars over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.session import stage


def _toward_least(edges: DataFrame) -> DataFrame:
    """Per node, its neighbours ``v`` with the least of the node and them: ``u, v, m``."""
    least = edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
    joined = edges.join(least, F.col("u") == F.col("_u"))
    return joined.select("u", "v", F.least("u", "_m").alias("m"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with no other edge to a centre that no edge leads from."""
    ends = edges.select("u", F.lit(1).alias("leaf")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("leaf")))
    nodes = ends.groupBy("u").agg(F.sum("leaf").alias("out"), F.min("leaf").alias("least"))
    return nodes.where((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("least") == 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of an edge list ``u, v``; a component is named by its least node.

    Each round hangs a node's larger neighbours, then its smaller ones, under the least of them; the number
    of rounds grows with the logarithm of the longest chain, and no neighbourhood is gathered. Edges
    shrink to stars, which are written each round.
    """
    current = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _are_stars(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _toward_least(large.where("u <> v").distinct())
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        current = stage(small.where("u <> v").distinct(), "edges")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
