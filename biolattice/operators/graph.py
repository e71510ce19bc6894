"""Property graphs as two DataFrames.

Nodes have label, key, id, labels, props (map<string,string>), value (raw value of a content-addressed node) and ord; edges have src_id, label, dst_id, id,
props and ord.  ord is the order of insertion, which decides between duplicates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import col, edge_id, normalize_key

NODE = "label string, key string, id string, labels array<string>, props map<string,string>, value string, ord bigint"
EDGE = "src_id string, label string, dst_id string, id string, props map<string,string>, ord bigint"


def props(**values: Column) -> Column:
    """A map of the values as text, without nulls; numbers keep Spark's notation."""
    full = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]) if values else F.create_map().cast("map<string,string>")
    return F.map_filter(full, lambda _, v: v.isNotNull())


def nodes(df: DataFrame, label: str | Column, key: Column | str, data: Column | None = None, order: Column | str = "ord", value: Column | None = None, more: Column | None = None, normal: bool = False) -> DataFrame:
    """Node rows; rows whose key is null or empty are left out. Values of content-addressed nodes are kept beside the digest that is their key. normal: keys are normalised already, and none is null."""
    name = F.lit(label) if isinstance(label, str) else label
    # one step after another, so that no expression is repeated inside another: code that grows so isn't compiled by the JVM
    out = df.select(
        name.alias("label"),
        col(key).alias("key"),
        (F.array().cast("array<string>") if more is None else more).alias("labels"),
        (props() if data is None else data).alias("props"),
        (F.lit(None).cast("string") if value is None else value).alias("value"),
        col(order).cast("long").alias("ord"),
    )
    if not normal:
        out = out.where("length(label) > 0 and length(key) > 0").withColumn("key", normalize_key("key"))
    return out.select("label", "key", F.concat("label", F.lit("/"), "key").alias("id"), "labels", "props", "value", "ord")


def edges(df: DataFrame, src: Column | str, label: str | Column, dst: Column | str, data: Column | None = None, order: Column | str = "ord") -> DataFrame:
    name = F.lit(label) if isinstance(label, str) else label
    out = df.select(col(src).alias("src_id"), name.alias("label"), col(dst).alias("dst_id"), (props() if data is None else data).alias("props"), col(order).cast("long").alias("ord"))
    return out.where("src_id is not null and dst_id is not null").select("src_id", "label", "dst_id", edge_id("src_id", "label", "dst_id").alias("id"), "props", "ord")


def firsts(df: DataFrame, label: str, key: Column | str, data: Column, order: Column | str = "ord") -> DataFrame:
    """Nodes of one label, of each key the first: only keys, properties and ord move."""
    rows = df.select(col(key).alias("key"), data.alias("props"), col(order).cast("long").alias("ord")).where("length(key) > 0").withColumn("key", normalize_key("key"))
    return nodes(rows.groupBy("key").agg(F.min_by("props", "ord").alias("props"), F.min("ord").alias("ord")), label, "key", F.col("props"), normal=True)


def links(df: DataFrame, src: Column | str, label: str, dst: Column | str, order: Column | str = "ord") -> DataFrame:
    """Rows of edges without properties: src_id, label, dst_id, ord. Rows whose ends may be null are for the caller to leave out, by what the ends are made of."""
    return df.select(col(src).alias("src_id"), F.lit(label).alias("label"), col(dst).alias("dst_id"), col(order).cast("long").alias("ord"))


def distinct_edges(df: DataFrame, src: Column | str, label: str | Column, dst: Column | str, data: Column | None = None) -> DataFrame:
    """Edges from rows of which each is one already."""
    ends = df.select(col(src).alias("src_id"), (F.lit(label) if isinstance(label, str) else label).alias("label"), col(dst).alias("dst_id"), (props() if data is None else data).alias("props"), "ord")
    return ends.select("src_id", "label", "dst_id", edge_id("src_id", "label", "dst_id").alias("id"), "props", "ord")


def linked(parts: list[DataFrame]) -> DataFrame:
    """The edges of such rows, each once, the last's ord. Ends aren't looked up: whoever makes the rows makes their nodes too.

    Only ord is aggregated, so this is by hash, and ids and properties are made after the rows have moved.
    """
    return distinct_edges(reduce(DataFrame.unionByName, parts).groupBy("src_id", "label", "dst_id").agg(F.max("ord").alias("ord")), "src_id", F.col("label"), "dst_id")


def _one(df: DataFrame, pick) -> DataFrame:
    """One row per id by an aggregate, which combines before it shuffles, so that an id with many rows is no one's task.

    Nodes are grouped by label and key, edges by source, label and target, and ids are made afterwards: filters on any of these then reach the rows before they are grouped.
    Each column is picked by itself: the picks see the rows in one order and so take the same row, and columns that no one reads are pruned.
    """
    of_node, of_edge = ("label", "key"), ("src_id", "label", "dst_id")
    by, made = ("id",), F.col("id")
    if {*of_node} <= {*df.columns}:
        by, made = of_node, F.concat("label", F.lit("/"), "key")
    elif {*of_edge} <= {*df.columns}:
        by, made = of_edge, edge_id(*of_edge)
    rest = [c for c in df.columns if c not in (*by, "id")]
    return df.groupBy(*by).agg(*[pick(F.col(c), F.col("ord")).alias(c) for c in rest]).select(*[made.alias(c) if c == "id" else c for c in df.columns])


def first_wins(df: DataFrame) -> DataFrame:
    """Of rows with one id the one with the smallest ord."""
    return _one(df, F.min_by)


def last_wins(df: DataFrame) -> DataFrame:
    """Of rows with one id the one with the largest ord."""
    return _one(df, F.max_by)


def guarded(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes; nodes may repeat."""
    ids = node_rows.select("id").distinct()
    return edge_rows.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select(*edge_rows.columns)


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def build(node_parts: list[DataFrame], edge_parts: list[DataFrame], keep_all_edges: bool = False) -> Graph:
        """Nodes first-wins, edges last-wins (or all of them), edges without both ends left out."""
        node_rows = reduce(DataFrame.unionByName, node_parts)
        edge_rows = reduce(DataFrame.unionByName, edge_parts)
        return Graph(first_wins(node_rows), guarded(edge_rows if keep_all_edges else last_wins(edge_rows), node_rows))

    def query(self, text: str, args: dict | None = None) -> DataFrame:
        """The result of a SQL query in which {nodes} and {edges} are the graph's tables; args: values of its :named parameters."""
        return self.nodes.sparkSession.sql(text, args=args, nodes=self.nodes, edges=self.edges)

    def concat(self, other: Graph) -> Graph:
        """Union in which the other graph's nodes and edges win."""
        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            rows = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
            return _one(rows, lambda c, _: F.max_by(c, F.struct("_side", "ord"))).select(*a.columns)

        return Graph(both(self.nodes, other.nodes), both(self.edges, other.edges))

    def summary(self) -> DataFrame:
        """Count of nodes and edges by label."""
        count = lambda df, kind: df.groupBy("label").count().select(F.lit(kind).alias("kind"), "label", F.col("count").alias("n"))
        return count(self.nodes, "node").unionByName(count(self.edges, "edge"))

    def node(self, label: str, key: str) -> DataFrame:
        """The node with this label and (already normalised) key."""
        return self.nodes.where((F.col("label") == label) & (F.col("key") == key))

    def of_label(self, label: str) -> DataFrame:
        return self.nodes.where(F.col("label") == label)

    def write(self, path: str) -> None:
        """Parquet by label, so that reads of a label skip the rest."""
        self.nodes.write.partitionBy("label").parquet(f"{path}/nodes")
        self.edges.write.partitionBy("label").parquet(f"{path}/edges")

    @staticmethod
    def read(spark, path: str) -> Graph:
        return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))
