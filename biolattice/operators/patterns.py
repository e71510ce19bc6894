"""Patterns of nodes and edges over several hops, put together from steps and run as joins; steps of variable length are a loop over frontiers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import saved
from .graph import Graph

OUT, IN, BOTH = "out", "in", "both"


@dataclass(frozen=True)
class Hop:
    """One step of a pattern: an edge (any label if none is given) in a direction, to a node (any label likewise), taken at least and at most so many times.

    Only the node at the end needs the label. Taken several times, nodes between may be any.
    """

    edge: str | None = None
    to: str | None = None
    direction: str = OUT
    least: int = 1
    most: int = 1

    def __post_init__(self):
        if self.direction not in (OUT, IN, BOTH) or not 0 <= self.least <= self.most:
            raise ValueError(f"no such hop: {self}")


def _arcs(graph: Graph, hop: Hop) -> DataFrame:
    """Distinct (_from, _to) of the edges that a hop can take."""
    rows = graph.edges if hop.edge is None else graph.edges.where(F.col("label") == hop.edge)
    out = rows.select(F.col("src_id").alias("_from"), F.col("dst_id").alias("_to"))
    back = rows.select(F.col("dst_id").alias("_from"), F.col("src_id").alias("_to"))
    return {OUT: lambda: out, IN: lambda: back, BOTH: lambda: out.unionByName(back)}[hop.direction]().distinct()


def reach(graph: Graph, starts: DataFrame, hop: Hop) -> DataFrame:
    """(_from, _to, hops) of the distinct ends of walks from the starts (column _from) of hop.least to hop.most edges; hops is the fewest of such a walk.

    One round of joins a hop.  Up to `least` hops a level has all pairs; from there on pairs that were found are left out, since what lies beyond them was found by the shorter walk.
    """
    arcs = _arcs(graph, hop).select(F.col("_from").alias("_mid"), F.col("_to").alias("_next"))
    if hop.most > 1:
        arcs = saved(arcs, "pattern-arcs")
    level = starts.select("_from").distinct().select("_from", F.col("_from").alias("_to"))
    found = [level.withColumn("hops", F.lit(0))] if hop.least == 0 else []
    for length in range(1, hop.most + 1):
        level = level.join(arcs, F.col("_to") == F.col("_mid")).select("_from", F.col("_next").alias("_to")).distinct()
        if length >= hop.least:
            if found:
                level = level.join(reduce(DataFrame.unionByName, found).select("_from", "_to"), ["_from", "_to"], "left_anti")
            if hop.most > 1:
                level = saved(level, "pattern-level")
            found.append(level.withColumn("hops", F.lit(length)))
    return reduce(DataFrame.unionByName, found)


def match(graph: Graph, start: str | DataFrame, *hops: Hop) -> DataFrame:
    """A row for each match of the pattern: n0, n1, ... are the ids of its nodes, h1, ... the edges taken by each hop of variable length; matches of equal nodes are one.

    start: a label, or a table with the ids of the first nodes.  Ends that aren't nodes of the graph match nothing.
    """
    nodes = graph.nodes.select("id", "label")
    first = nodes.where(F.col("label") == start) if isinstance(start, str) else nodes.join(start.select("id").distinct(), "id", "left_semi")
    rows = first.select(F.col("id").alias("n0")).distinct()
    for k, hop in enumerate(hops, 1):
        here = rows.select(F.col(f"n{k - 1}").alias("_from"))
        pairs = _arcs(graph, hop).withColumn("hops", F.lit(1)) if hop.least == hop.most == 1 else reach(graph, here, hop)
        ends = nodes if hop.to is None else nodes.where(F.col("label") == hop.to)
        pairs = pairs.join(ends.select(F.col("id").alias("_to")).distinct(), "_to", "left_semi")
        rows = rows.join(pairs, F.col(f"n{k - 1}") == F.col("_from")).withColumnsRenamed({"_to": f"n{k}", "hops": f"h{k}"}).drop("_from")
        if hop.least == hop.most:
            rows = rows.drop(f"h{k}")
    return rows
