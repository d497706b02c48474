"""Disjoint sets of nodes: find, union and members over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components


class DisjointSets:
    """Sets of nodes, each named by its least node. ``union`` gives new sets and leaves these as they are."""

    def __init__(self, labels: DataFrame) -> None:
        """labels: (node, component)."""
        self.labels = labels.select("node", "component")

    @classmethod
    def of(cls, edges: DataFrame, u: str, v: str) -> DisjointSets:
        return cls(components(edges, u, v))

    def find(self, nodes: DataFrame, node: str = "node") -> DataFrame:
        """nodes with component; a node of no set is its own."""
        own = self.labels.select(F.col("node").alias("_node"), "component")
        return nodes.join(own, F.col(node) == F.col("_node"), "left").withColumn("component", F.coalesce("component", node)).drop("_node")

    def union(self, edges: DataFrame, u: str, v: str) -> DisjointSets:
        """The sets with those joined that the edges touch."""
        own = self.labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        return DisjointSets.of(own.unionByName(edges.select(F.col(u).alias("a"), F.col(v).alias("b"))), "a", "b")

    def nodes(self) -> DataFrame:
        return self.labels.select("node")

    def members(self) -> DataFrame:
        """(component, size, members): a set of many nodes is one long row; use ``labels`` for the rows."""
        return self.labels.groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members"))
