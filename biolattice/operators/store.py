"""Graph and sequence stores: resolving, idempotent loads, upserts, deletes.

A store is a set of Parquet tables; every function returns the rows to append or the table's next state.  An element id is derived from the id, so
loading a graph again finds the same elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import digest
from ..functions.sequences import bad_letters
from .graph import Graph

STORED = "id string, eid string, created_at bigint, updated_at bigint"


def eid(c: Column | str = "id") -> Column:
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def resolve(refs: DataFrame, existing: DataFrame) -> DataFrame:
    """refs with the element id of each, null where the store has none."""
    return refs.join(existing.select("id", "eid"), "id", "left")


def missing(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose id the store doesn't have yet."""
    return rows.join(existing.select("id"), "id", "left_anti").select(*rows.columns)


def endpoints(edge_rows: DataFrame, stored: DataFrame, strict: bool = False) -> DataFrame:
    """Edges with src_eid and dst_eid. Edges without both are left out; strict: they are an error."""
    ends = stored.select("id", "eid")
    how = "left" if strict else "inner"
    out = edge_rows.join(ends.select(F.col("id").alias("src_id"), F.col("eid").alias("src_eid")), "src_id", how)
    out = out.join(ends.select(F.col("id").alias("dst_id"), F.col("eid").alias("dst_eid")), "dst_id", how)
    if strict:
        lost = F.raise_error(F.concat(F.lit("edge end not found: "), F.col("src_id"), F.lit(" or "), F.col("dst_id"))).cast("string")
        out = out.withColumn("src_eid", F.when(F.col("src_eid").isNull() | F.col("dst_eid").isNull(), lost).otherwise(F.col("src_eid")))
    return out


def load(graph: Graph, node_store: DataFrame, edge_store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows that the stores lack, with element ids; nothing the second time. One anti join and two joins, whatever the size."""
    new = missing(graph.nodes, node_store).withColumn("eid", eid())
    known = node_store.select("id", "eid").unionByName(new.select("id", "eid"))
    return new, missing(endpoints(graph.edges, known), edge_store).withColumn("eid", eid())


def checked(rows: DataFrame) -> DataFrame:
    """rows if no id repeats; else the query fails and names one."""
    repeated = rows.groupBy("id").agg(F.count("*").alias("_n"))
    bad = F.raise_error(F.concat(F.lit("duplicate id "), F.col("id"))).cast("boolean")
    return rows.join(repeated, "id").where(F.when(F.col("_n") > 1, bad).otherwise(F.lit(True))).drop("_n")


def upsert(old: DataFrame, new: DataFrame, at: Column | int, update_props: bool = False) -> DataFrame:
    """The table after a merge: id, created_at (kept), updated_at (of whatever came again), and the other columns, the old ones unless update_props."""
    now = at if isinstance(at, Column) else F.lit(at).cast("long")
    rest = [c for c in new.columns if c not in ("id", "created_at", "updated_at")]
    rows = old.select("id", *rest, "created_at", "updated_at", F.lit(0).alias("_side")).unionByName(
        new.select("id", *rest, now.alias("created_at"), now.alias("updated_at"), F.lit(1).alias("_side"))
    )
    pick = F.max_by if update_props else F.min_by
    merged = rows.groupBy("id").agg(*([pick(F.struct(*rest), F.col("_side")).alias("_row")] if rest else []), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
    return merged.select("id", *[F.col(f"_row.{c}").alias(c) for c in rest], "created_at", "updated_at")


def upsert_edges(old: DataFrame, new: DataFrame, node_store: DataFrame, at: Column | int) -> DataFrame:
    """Merge of edges whose both ends are stored; properties are set when an edge is made only."""
    ids = node_store.select("id")
    both = new.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    return upsert(old, both.select(*[c for c in old.columns if c not in ("created_at", "updated_at")]), at)


def delete(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id"), "id", "left_anti").select(*table.columns)


def unique(table: DataFrame, *columns: str) -> DataFrame:
    """Values that break a uniqueness constraint, and how often they occur."""
    return table.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def store_sequences(sequences: DataFrame, existing: DataFrame, alphabet: str | None = None, mode: str = "upper") -> tuple[DataFrame, DataFrame]:
    """(rows with the hash of each input, rows to append).  From (seq): repeats each get their hash, only new distinct sequences are appended.

    With an alphabet, sequences with other letters fail the query; so do null and empty ones.
    """
    bad = F.lit(False) if alphabet is None else F.size(bad_letters("seq", alphabet, upper=mode == "upper")) > 0
    fail = F.raise_error(F.concat(F.lit("invalid sequence: "), F.coalesce(F.left("seq", F.lit(40)), F.lit("null")))).cast("string")
    good = F.when(F.col("seq").isNull() | (F.length("seq") == 0) | bad, fail).otherwise(F.col("seq"))
    hashed = sequences.withColumn("seq", good).withColumn("hash", digest("seq", mode))
    canonical = F.upper("seq") if mode == "upper" else F.col("seq")
    new = hashed.groupBy("hash").agg(F.min(canonical).alias("seq")).join(existing.select("hash"), "hash", "left_anti")
    return hashed, new


def sequence(store: DataFrame, hashes: DataFrame) -> DataFrame:
    """The sequence of each hash, null where there is none."""
    return hashes.join(store.select("hash", "seq"), "hash", "left")


def annotation(results: DataFrame, method: str) -> tuple[DataFrame, DataFrame]:
    """From (hash, function, quality): protein and function nodes (label, key), and has_annotation edges; results without a function say NONE."""
    rows = results.withColumn("function", F.coalesce(F.nullif(F.trim("function"), F.lit("")), F.lit("NONE")))
    nodes = rows.select(F.lit("ProteinSequence").alias("label"), F.col("hash").alias("key")).unionByName(
        rows.select(F.lit("ProteinAnnotation").alias("label"), F.col("function").alias("key"))
    )
    edges = rows.select(
        F.concat(F.lit("ProteinSequence/"), F.col("hash")).alias("src_id"),
        F.lit("has_annotation").alias("label"),
        F.concat(F.lit("ProteinAnnotation/"), F.replace("function", F.lit(" "), F.lit("_"))).alias("dst_id"),
        "quality",
        F.lit(method).alias("method"),
    )
    return nodes.distinct(), edges.distinct()


def execution(runs: DataFrame) -> DataFrame:
    """From (batch, host, parameters array, step, ord): one record per batch with its host, parameters joined by spaces and steps as JSON; more than one host fails."""
    one = runs.groupBy("batch").agg(F.count_distinct("host").alias("_hosts"), F.min("host").alias("host"), F.array_sort(F.collect_list(F.struct("ord", "step", "parameters"))).alias("_steps"))
    fail = F.raise_error(F.concat(F.lit("several hosts in batch "), F.col("batch").cast("string"))).cast("string")
    steps = F.transform("_steps", lambda s: F.struct(s["step"].alias("step"), F.array_join(s["parameters"], " ").alias("parameters")))
    return one.select("batch", F.when(F.col("_hosts") > 1, fail).otherwise(F.col("host")).alias("host"), F.to_json(steps).alias("execs"))
