"""Stored expansion of a graph's neighbourhood: level by level, resumable, with the graph laid out for it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import node_id, normalize_key
from .graph import Graph


class Folder:
    """A folder of a file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def names(self, name: str) -> list[str]:
        """Names of what lies in a folder; none if it isn't there."""
        fs, path = self._at(name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def text(self, name: str) -> str:
        """A small file's text."""
        return "\n".join(r.value for r in self.spark.read.text(f"{self.path}/{name}").collect())

    def publish(self, name: str, text: str) -> bool:
        """Makes a small file appear whole under a name that must be free; false if it isn't."""
        fs, path = self._at(name)
        _, draft = self._at(f"{name}.{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.exists(path) and fs.rename(draft, path):
            return True
        fs.delete(draft, False)
        return False


class Adjacency:
    """A graph's edges by the label of their source and again by that of their target, and its nodes' ids by label: a level of an expansion reads only the labels that it can meet."""

    def __init__(self, out: DataFrame, back: DataFrame, nodes: DataFrame):
        self.out, self.back, self.nodes = out, back, nodes

    @staticmethod
    def write(graph: Graph, path: str) -> Adjacency:
        """Edges without both ends are left out; of nodes only id and label are kept."""
        path = path.rstrip("/")
        nodes = graph.nodes.select("id", "label").distinct()
        nodes.write.partitionBy("label").parquet(f"{path}/nodes")
        spark = graph.nodes.sparkSession
        nodes = spark.read.parquet(f"{path}/nodes")
        end = lambda name: nodes.select(F.col("id").alias(f"{name}_id"), F.col("label").alias(f"{name}_label"))
        rows = graph.edges.select("src_id", "label", "dst_id", "id").join(end("src"), "src_id").join(end("dst"), "dst_id")
        rows.write.partitionBy("src_label").parquet(f"{path}/out")
        spark.read.parquet(f"{path}/out").write.partitionBy("dst_label").parquet(f"{path}/back")
        return Adjacency.read(spark, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Adjacency:
        return Adjacency(*(spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in ("out", "back", "nodes")))


class Expansion:
    """Nodes and edges around roots, stored by depth, so that a later call goes on where an earlier one ended.

    allowed: by label, whether children and parents are followed; nodes of other labels are leaves.  A node has its shortest depth; the edges of a depth are those met from the nodes of the depth
    before, each stored once.  A depth counts only when its last file, `done`, is there: a call that failed midway leaves nothing that is read, and the next one writes that depth anew.
    """

    def __init__(self, adjacency: Adjacency, path: str, allowed: dict[str, tuple[bool, bool]]):
        self.graph, self.allowed = adjacency, allowed
        self.spark = adjacency.nodes.sparkSession
        self.folder = Folder(self.spark, path)

    @property
    def depth(self) -> int | None:
        """The last depth that is stored; None before a start."""
        found = -1
        while self.folder.exists(f"done/{found + 1}/_SUCCESS"):
            found += 1
        return None if found < 0 else found

    def _commit(self, depth: int, labels: list[str]) -> None:
        told = self.spark.range(1).select(F.lit(json.dumps({"labels": labels})).alias("value"))
        told.coalesce(1).write.mode("overwrite").text(f"{self.folder.path}/done/{depth}")

    def start(self, roots: DataFrame) -> Expansion:
        """Begins at the roots (label, key) that are nodes of the graph; keys are normalised. A start on a stored expansion is an error: reset it first."""
        if self.depth is not None:
            raise ValueError(f"{self.folder.path} holds an expansion; reset it or let it grow")
        ids = roots.select(node_id(F.col("label"), normalize_key("key")).alias("id")).distinct()
        self._store(0, self.graph.nodes.join(ids, "id", "left_semi"))
        return self

    def start_at(self, label: str, key: str) -> Expansion:
        """Begins at one node, named by label and key."""
        return self.start(self.spark.createDataFrame([(label, key)], "label string, key string"))

    def reset(self) -> Expansion:
        """Forgets all that is stored, the marks of finished depths first."""
        for name in ("done", "nodes", "edges"):
            self.folder.delete(name)
        return self

    def _store(self, depth: int, nodes: DataFrame) -> None:
        at = f"{self.folder.path}/nodes/depth={depth}"
        nodes.select("id", F.col("label").alias("node_label")).write.mode("overwrite").parquet(at)
        labels = [r.node_label for r in self.spark.read.parquet(at).select("node_label").distinct().collect()]
        self._commit(depth, sorted(labels))

    def _labels(self, depth: int) -> list[str]:
        return json.loads(self.spark.read.text(f"{self.folder.path}/done/{depth}").first().value)["labels"]

    def _read(self, name: str, schema: str, upto: int) -> DataFrame:
        """What finished depths hold; a depth that was cut short isn't read."""
        rows = self.spark.read.schema(schema).parquet(f"{self.folder.path}/{name}") if self.folder.exists(name) else self.spark.createDataFrame([], schema)
        return rows.where(F.col("depth") <= upto)

    def nodes(self) -> DataFrame:
        """id, label and depth of each node."""
        found = self._read("nodes", "id string, node_label string, depth int", -1 if self.depth is None else self.depth)
        return found.select("id", F.col("node_label").alias("label"), "depth")

    def edges(self) -> DataFrame:
        """src_id, label, dst_id, id of each edge met, and the depth at which it was first."""
        found = self._read("edges", "src_id string, edge_label string, dst_id string, id string, depth int", -1 if self.depth is None else self.depth)
        return found.select("src_id", F.col("edge_label").alias("label"), "dst_id", "id", "depth")

    def grow(self, levels: int = 1) -> Expansion:
        """Goes on by this many levels from the last stored one; those before aren't gone over again. A frontier without nodes that can be followed ends it early."""
        for _ in range(levels):
            depth = self.depth
            if depth is None:
                raise ValueError("start the expansion first")
            here = self._labels(depth)
            down = [k for k in here if self.allowed.get(k, (False, False))[0]]
            up = [k for k in here if self.allowed.get(k, (False, False))[1]]
            if not down and not up:
                return self
            frontier = self.nodes().where(F.col("depth") == depth).select("id", "label")
            met = []
            for rows, labels, own, side, other in ((self.graph.out, down, "src_label", "src", "dst"), (self.graph.back, up, "dst_label", "dst", "src")):
                if labels:
                    ends = frontier.where(F.col("label").isin(labels)).select(F.col("id").alias(f"{side}_id"))
                    step = rows.where(F.col(own).isin(labels)).join(ends, f"{side}_id", "left_semi")
                    met.append(step.select("src_id", F.col("label").alias("edge_label"), "dst_id", "id", F.col(f"{other}_id").alias("_to"), F.col(f"{other}_label").alias("_label")))
            step = met[0] if len(met) == 1 else met[0].unionByName(met[1])
            at = f"{self.folder.path}/edges/depth={depth + 1}"
            # an edge that both its ends lead to is met twice; the ends beyond it are kept for the next level
            fresh = step.groupBy("src_id", "edge_label", "dst_id", "id").agg(F.collect_set(F.struct("_to", "_label")).alias("_ends"))
            fresh.join(self.edges().select("id"), "id", "left_anti").write.mode("overwrite").parquet(at)
            ends = self.spark.read.parquet(at).select(F.explode("_ends").alias("e")).select(F.col("e._to").alias("id"), F.col("e._label").alias("label")).distinct()
            self._store(depth + 1, ends.join(self.nodes().select("id"), "id", "left_anti"))
        return self
