"""A property graph held in two DataFrames, and the operations that read or change it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PropertyGraph:
    """nodes(id, label, name, file_path, ..., ordinal) and edges(id, source_id, target_id, edge_type, confidence, ...).

    Edges may lack an end node. A change gives a new graph; nothing is changed in place. by_target
    are the same edges kept by their target, where a graph is stored so (see plans.stored).
    """

    nodes: DataFrame
    edges: DataFrame
    by_target: DataFrame | None = None

    def edges_by(self, end: str) -> DataFrame:
        """The edges, kept by source_id or target_id if there is such a copy."""
        return self.by_target if end == "target_id" and self.by_target is not None else self.edges

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def edge(self, edge_id: str) -> DataFrame:
        return self.edges.where(F.col("id") == edge_id)

    def edges_from(self, node_id: str) -> DataFrame:
        return self.edges.where(F.col("source_id") == node_id)

    def edges_to(self, node_id: str) -> DataFrame:
        return self.edges_by("target_id").where(F.col("target_id") == node_id)

    def by_label(self, label: str) -> DataFrame:
        return self.nodes.where(F.col("label") == label)

    def by_file(self, path: str) -> DataFrame:
        return self.nodes.where(F.col("file_path") == path)

    def counts(self) -> DataFrame:
        """One row: node_count, edge_count."""
        return self.nodes.agg(F.count("*").alias("node_count")).crossJoin(self.edges.agg(F.count("*").alias("edge_count")))

    def upsert_nodes(self, rows: DataFrame) -> PropertyGraph:
        """Rows take the place of nodes of the same id, at the ordinal of the first; of several rows for an id the last stays."""
        return PropertyGraph(upserted(self.nodes, rows), self.edges)

    def upsert_edges(self, rows: DataFrame) -> PropertyGraph:
        """Edges are replaced by id; their ends aren't checked."""
        order = "ordinal" if "ordinal" in self.edges.columns else None
        return PropertyGraph(self.nodes, upserted(self.edges, rows, order))

    def without_nodes(self, gone: Column) -> PropertyGraph:
        """Without the nodes for which the condition holds, and without their edges."""
        dropped = self.nodes.where(gone).select(F.col("id").alias("__gone"))
        edges = self.edges
        for end in ("source_id", "target_id"):
            edges = edges.join(dropped, edges[end] == F.col("__gone"), "left_anti")
        return PropertyGraph(self.nodes.where(~F.coalesce(gone, F.lit(False))), edges)

    def without_node(self, node_id: str) -> PropertyGraph:
        return self.without_nodes(F.col("id") == node_id)

    def without_file(self, path: str) -> PropertyGraph:
        return self.without_nodes(F.col("file_path") == path)

    def without_edge(self, edge_id: str) -> PropertyGraph:
        return PropertyGraph(self.nodes, self.edges.where(F.col("id") != edge_id))


def upserted(old: DataFrame, new: DataFrame, order: str | None = "ordinal") -> DataFrame:
    """Union of both with one row an id: the values of the newest and, where `order` names a column, the position of the oldest."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rank = [F.desc("__new")] + ([F.desc(order)] if order else [])
    out = both.withColumn("__rank", F.row_number().over(Window.partitionBy("id").orderBy(*rank)))
    if order:
        out = out.withColumn(order, F.min(order).over(Window.partitionBy("id")))
    return out.where("__rank = 1").drop("__rank", "__new")


def first_named(nodes: DataFrame, name: str, labels: tuple[str, ...] = ("Function", "Method", "Class")) -> DataFrame:
    """The first node of the name in the graph's order: one row at most."""
    return nodes.where((F.col("name") == name) & F.col("label").isin(*labels)).orderBy("ordinal").limit(1)
