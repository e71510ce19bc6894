"""Curation as an append-only log of events; documents are views of it.

An event is (collection, doc_id, pos, timestamp, user_id, action, target, comment, kind, value).  doc_id is `item@template`.  kind says what the event sets: functions, genes,
mapping, ko, attributes, comments or annotation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import split_composite

#: What a document's maps are made of: where the log first names a target, the target, and its last action.
_SET = "array<struct<_first:struct<pos:bigint,timestamp:bigint,user_id:string,action:string,comment:string>,target:string,action:string>>"

EVENT = (
    "collection string, doc_id string, pos bigint, timestamp bigint, user_id string, action string, target string, comment string, kind string"
)
#: Collections, and the map that their events set.
COLLECTIONS = {
    "template_reactions": "functions",
    "reaction_gene_annotation": "genes",
    "model_reaction_mapping": "mapping",
    "model_compound_mapping": "mapping",
    "template_reactions_ko": "ko",
    "template_reactions_function": "functions",
}


def event(rows: DataFrame, collection: str, item: Column, template: Column, target: Column, action: Column, user_id: Column, timestamp: Column, comment: Column | None = None, kind: str | None = None, order: Column | None = None) -> DataFrame:
    """Events to append: setting a function, gene annotation, reference, knock-out or attribute, or adding a comment. Targets of the form id@set keep their dots."""
    return rows.select(
        F.lit(collection).alias("collection"),
        F.concat(item, F.lit("@"), template).alias("doc_id"),
        (F.lit(0) if order is None else order).cast("long").alias("pos"),
        timestamp.cast("long").alias("timestamp"),
        user_id.alias("user_id"),
        action.alias("action"),
        target.alias("target"),
        (F.lit("") if comment is None else comment).alias("comment"),
        F.lit(kind or COLLECTIONS[collection]).alias("kind"),
    )


def latest(events: DataFrame, *by: str) -> DataFrame:
    """The latest action of each (by..., target): of equal timestamps the first in the log. An aggregate, so a target with many events is combined before it moves."""
    by = by or ("doc_id",)
    newest = F.max_by(F.struct("action", "user_id", "timestamp"), F.struct("timestamp", F.bitwise_not(F.col("pos"))))
    return events.groupBy(*by, "target").agg(newest.alias("_e")).select(*by, "target", "_e.action", "_e.user_id", "_e.timestamp")


def template_rollup(events: DataFrame, template: str) -> DataFrame:
    """item, target and latest action of one template's reactions."""
    item, of = split_composite("doc_id")
    rows = events.where((F.col("collection") == "template_reactions") & (F.col("kind") == "functions") & (of == template))
    return latest(rows.withColumn("item", item), "item")


def from_seed(documents: DataFrame, order: str = "ord") -> DataFrame:
    """The last document of each seed id, from (seed_id, doc_id, ord)."""
    return documents.groupBy("seed_id").agg(F.max_by("doc_id", F.col(order)).alias("doc_id"))


def documents(events: DataFrame, collection: str, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, fields (map of the current actions), log, comments and attributes of a collection's documents.

    wanted (doc_id) adds empty documents for ids without events: empty maps and lists.  The maps are made by an aggregate over each target, so a long log is walked once;
    their keys stand in the order in which the log first names them, and events without a target set nothing.
    """
    rows = events.where(F.col("collection") == collection)
    place = F.struct("pos", "timestamp", "user_id", "action", "comment")
    current = rows.where(F.col("kind").isin(COLLECTIONS[collection], "attributes") & F.col("target").isNotNull())
    current = current.groupBy("doc_id", "kind", "target").agg(F.max_by("action", place).alias("action"), F.min(place).alias("_first"))
    set_by = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("_first", "target", "action"))))
    current = current.groupBy("doc_id").agg(set_by(COLLECTIONS[collection]).alias("_fields"), set_by("attributes").alias("_set"))
    pairs = lambda c: F.map_from_entries(F.transform(F.coalesce(c, F.array().cast(_SET)), lambda e: F.struct(e["target"], e["action"])))
    entry = F.struct("pos", "timestamp", "user_id", "action", "target", "comment")
    listed = lambda cond: F.array_sort(F.collect_list(F.when(cond, entry)))
    kind = F.col("kind")
    grouped = rows.groupBy("doc_id").agg(listed(kind == COLLECTIONS[collection]).alias("log"), listed(kind == "comments").alias("_comments")).join(current, "doc_id", "left")
    if wanted is not None:
        grouped = wanted.select("doc_id").distinct().join(grouped, "doc_id", "left")
    none = F.array().cast("array<struct<pos:bigint,timestamp:bigint,user_id:string,action:string,target:string,comment:string>>")
    grouped = grouped.withColumns({c: F.coalesce(c, none) for c in ("log", "_comments")})
    return grouped.select(
        "doc_id",
        pairs("_fields").alias("fields"),
        "log",
        F.transform("_comments", lambda e: F.struct(e["timestamp"].alias("timestamp"), e["user_id"].alias("user_id"), e["comment"].alias("comment"))).alias("comments"),
        pairs("_set").alias("attributes"),
    )
