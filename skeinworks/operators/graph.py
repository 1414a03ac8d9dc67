"""Integrity of node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_ids(nodes: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one node has, with their number."""
    return nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def dangling(edges: DataFrame, nodes: DataFrame, child: str, node: str) -> DataFrame:
    """Edges whose ``child`` is no ``node``. Null children point nowhere and are left out."""
    return edges.filter(F.col(child).isNotNull()).join(nodes.select(F.col(node).alias(child)).distinct(), child, "left_anti")


def first_violation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each source: the smallest duplicate id, else the first dangling edge in the order of parent and ordinal."""
    twice = duplicate_ids(nodes, "source", "node_id").groupBy("source").agg(F.min("node_id").alias("parent")).select("source", F.lit(0).alias("rank"), "parent", F.lit(None).cast("long").alias("child"))
    lost = edges.join(nodes.select("source", F.col("node_id").alias("child")).distinct(), ["source", "child"], "left_anti")
    first = lost.groupBy("source").agg(F.min(F.struct("parent", "ordinal", "child")).alias("x")).select("source", F.lit(1).alias("rank"), "x.parent", "x.child")
    return twice.unionByName(first).groupBy("source").agg(F.min(F.struct("rank", "parent", "child")).alias("x")).select("source", F.when(F.col("x.rank") == 0, "duplicate").otherwise("dangling").alias("violation"), "x.parent", "x.child")


def summary(visits: DataFrame) -> DataFrame:
    """By source: its functions, and the nodes that they reach."""
    nodes = F.count_if(~F.col("kind").isin("type", "error", "empty"))
    return visits.groupBy("source").agg(nodes.alias("nodes"), F.count_if(F.col("kind") == "function").alias("functions"))


def span_length(start, end):
    """Never below zero."""
    return F.greatest(F.col(end) - F.col(start), F.lit(0))
