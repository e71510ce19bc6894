"""Neighbourhoods and bounded expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import saved
from .graph import Graph


def children(graph: Graph, ids: DataFrame, edge_label: str | None = None) -> DataFrame:
    """(id, edge_label, neighbor) of the nodes that the given ones point at."""
    return _near(graph, ids, "src_id", "dst_id", edge_label)


def parents(graph: Graph, ids: DataFrame, edge_label: str | None = None) -> DataFrame:
    """(id, edge_label, neighbor) of the nodes that point at the given ones."""
    return _near(graph, ids, "dst_id", "src_id", edge_label)


def _near(graph: Graph, ids: DataFrame, at: str, to: str, edge_label: str | None) -> DataFrame:
    rows = graph.edges if edge_label is None else graph.edges.where(F.col("label") == edge_label)
    rows = rows.select(F.col(at).alias("id"), F.col("label").alias("edge_label"), F.col(to).alias("neighbor"))
    return rows.join(ids.select("id").distinct(), "id", "left_semi").join(graph.nodes.select(F.col("id").alias("neighbor")), "neighbor", "left_semi").select("id", "edge_label", "neighbor")


def undirected(graph: Graph, left: str, right: str, edge_label: str | None = None) -> DataFrame:
    """Distinct pairs (left_id, right_id) of nodes with these labels that an edge joins in either direction."""
    rows = graph.edges if edge_label is None else graph.edges.where(F.col("label") == edge_label)
    both = rows.select(F.col("src_id").alias("left_id"), F.col("dst_id").alias("right_id")).unionByName(rows.select(F.col("dst_id").alias("left_id"), F.col("src_id").alias("right_id")))
    of = lambda label, name: graph.nodes.where(F.col("label") == label).select(F.col("id").alias(name))
    return both.join(of(left, "left_id"), "left_id", "left_semi").join(of(right, "right_id"), "right_id", "left_semi").select("left_id", "right_id").distinct()


def expand(graph: Graph, roots: DataFrame, allowed: dict[str, tuple[bool, bool]], max_depth: int = 3, materialize: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth) within max_depth of the roots and the edges met on the way.

    allowed: by label, whether children and parents are followed; nodes of other labels are leaves.  A node has its shortest depth.  One round of joins per
    level, whose frontier is written to the shared folder, so the plan stays short and lost executors cost a level at most.  materialize: write the graph's ids and
    those edges first that can be followed, for a graph that is computed rather than read.
    """
    down = [k for k, (child, _) in allowed.items() if child]
    up = [k for k, (_, parent) in allowed.items() if parent]
    if materialize:
        # an id begins with its label, so edges from or to other labels are never followed
        starts = [F.startswith(c, F.lit(f"{label}/")) for c, labels in (("src_id", down), ("dst_id", up)) for label in labels]
        graph = Graph(saved(graph.nodes.select("id", "label")), saved(graph.edges.where(reduce(Column.__or__, starts, F.lit(False)))))
    labels = graph.nodes.select("id", "label")
    seen = saved(roots.select("id").distinct().join(labels.select("id"), "id", "left_semi").withColumn("depth", F.lit(0)))
    frontier, met = seen, []
    for depth in range(1, max_depth + 1):
        at = frontier.join(labels, "id").select("id", "label")
        out = graph.edges.join(at.where(F.col("label").isin(down)).select(F.col("id").alias("src_id")), "src_id", "left_semi").withColumn("_to", F.col("dst_id"))
        back = graph.edges.join(at.where(F.col("label").isin(up)).select(F.col("id").alias("dst_id")), "dst_id", "left_semi").withColumn("_to", F.col("src_id"))
        step = saved(out.select(*graph.edges.columns, "_to").unionByName(back.select(*graph.edges.columns, "_to")))
        met.append(step.drop("_to"))
        frontier = saved(step.select(F.col("_to").alias("id")).distinct().join(labels.select("id"), "id", "left_semi").join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    every = met[0] if met else graph.edges.limit(0)
    for m in met[1:]:
        every = every.unionByName(m)
    return seen, every.dropDuplicates(["id"])
