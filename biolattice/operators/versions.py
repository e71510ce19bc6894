"""Graph stores whose loads appear whole or not at all: segments of rows, and manifests that name the segments of a version."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .expansion import Folder
from .graph import EDGE, NODE, Graph
from .store import checked, eid, endpoints, missing

NODES, EDGES = f"{NODE}, eid string", f"{EDGE}, src_eid string, dst_eid string, eid string"


class LoadConflict(RuntimeError):
    """Another load was committed since this one read the store."""


class VersionedStore:
    """Nodes and edges at a path, in versions from 1; version 0 is the empty store.

    A load writes its new nodes and edges as a segment each and then, last, the next version's manifest, by renaming a finished file to a name that must be free.  Readers take the segments
    that a manifest names, so they see a load's nodes and edges together or none of them; what a failed load has left is named by no manifest and is removed by `vacuum`.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    @property
    def version(self) -> int:
        """The newest committed version."""
        numbers = [int(name.removesuffix(".json")) for name in self.folder.names("manifests") if name.endswith(".json")]
        return max(numbers, default=0)

    def _segments(self, version: int) -> list[str]:
        return json.loads(self.folder.text(f"manifests/{version:012d}.json"))["segments"] if version else []

    def _read(self, kind: str, schema: str, version: int) -> DataFrame:
        paths = [f"{self.folder.path}/{kind}/{s}" for s in self._segments(version)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def nodes(self, version: int | None = None) -> DataFrame:
        return self._read("nodes", NODES, self.version if version is None else version)

    def edges(self, version: int | None = None) -> DataFrame:
        return self._read("edges", EDGES, self.version if version is None else version)

    def graph(self, version: int | None = None) -> Graph:
        """The graph as of a version, the newest if none is given."""
        version = self.version if version is None else version
        return Graph(self.nodes(version), self.edges(version))

    def load(self, graph: Graph, strict: bool = False, between: Callable[[], None] | None = None) -> int:
        """Adds what the store lacks of a graph and returns the version that holds it; a load that adds nothing makes no version.

        strict: ids that repeat in the graph, or that the store has already, are an error, and nothing is added.  between: called after the nodes are written and before the edges are.
        LoadConflict if another load was committed meanwhile: the same load may be tried again.
        """
        base = self.version
        nodes, edges = self.nodes(base), self.edges(base)
        if strict:
            graph = Graph(checked(graph.nodes), checked(graph.edges))
            known = graph.nodes.join(nodes.select("id"), "id", "left_semi").limit(1).collect()
            if known:
                raise ValueError(f"the store has the node {known[0].id} already")
        new_nodes = missing(graph.nodes, nodes).withColumn("eid", eid())
        segment = uuid.uuid4().hex
        write = lambda rows, kind, schema: rows.select(*self.spark.createDataFrame([], schema).columns).write.parquet(f"{self.folder.path}/{kind}/{segment}")
        write(new_nodes, "nodes", NODES)
        if between:
            between()
        # ends are resolved by the nodes as they were written
        written = self.spark.read.schema(NODES).parquet(f"{self.folder.path}/nodes/{segment}")
        ends = endpoints(graph.edges, nodes.select("id", "eid").unionByName(written.select("id", "eid")), strict)
        write(missing(ends, edges).withColumn("eid", eid()), "edges", EDGES)
        added = [self.spark.read.schema(s).parquet(f"{self.folder.path}/{kind}/{segment}").limit(1).count() for kind, s in (("nodes", NODES), ("edges", EDGES))]
        if not any(added):
            for kind in ("nodes", "edges"):
                self.folder.delete(f"{kind}/{segment}")
            return base
        manifest = json.dumps({"segments": [*self._segments(base), segment]})
        if not self.folder.publish(f"manifests/{base + 1:012d}.json", manifest):
            raise LoadConflict(f"version {base + 1} of {self.folder.path} was committed by another load")
        return base + 1

    def vacuum(self) -> int:
        """Removes segments that no version names, and says how many; no load may be under way."""
        kept = {s for v in range(1, self.version + 1) for s in self._segments(v)}
        lost = [(kind, s) for kind in ("nodes", "edges") for s in self.folder.names(kind) if s not in kept]
        for kind, s in lost:
            self.folder.delete(f"{kind}/{s}")
        return len(lost)

    def history(self) -> DataFrame:
        """(version, nodes, edges): rows in all as of each version."""
        rows = [(v, self.nodes(v).count(), self.edges(v).count()) for v in range(1, self.version + 1)]
        return self.spark.createDataFrame(rows, "version int, nodes bigint, edges bigint")


def constrained(store: VersionedStore, label: str, *properties: str) -> DataFrame:
    """Values of these properties that several stored nodes of a label share, with how many: what breaks a uniqueness constraint."""
    values = [F.col("props")[p].alias(p) for p in properties]
    return store.nodes().where(F.col("label") == label).groupBy(*values).agg(F.count("*").alias("n")).where("n > 1")
