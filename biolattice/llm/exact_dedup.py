"""Exact deduplication by content-defined chunk recipes.

A text without white space is cut where its content says so, and a chunk's hash is its identifier.  One shuffle of the distinct chunks verifies them: chunks that share
an identifier are told apart by numbers.  A document is then the ordered list of its identifiers, and only these short lists are grouped and joined, never the long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, saved

#: Bytes (of UTF-8) a chunk has at least and at most.
MIN_CHUNK, MAX_CHUNK = 192, 2048
#: A group is hot if it holds more than one in so many rows.
HOT = 1000
SPACE = r"[\x20\x09-\x0D]"


def _boundary() -> str:
    """A chunk ends with three characters of which each one's last byte is in a quarter of them picked by a multiplicative hash; the bytes before hardly vary within a script."""
    picked = "".join(f"\\x{c:02x}" for c in range(0xC0) if c * 37 % 64 < 16)
    return rf"[{picked}]" + rf"(?:[\xc2-\xf4][\x80-\xbf]{{0,2}})?[{picked}]" * 2


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def chunks(norm: Column, smallest: int = MIN_CHUNK, largest: int = MAX_CHUNK) -> Column:
    """Content-defined chunks in order, of the text's UTF-8 bytes, each as the character of that number, so that texts of all scripts are cut alike; a cut can fall inside a character.

    Joined together they give the bytes again. No chunk for an empty text.
    """
    data = F.decode(F.encode(norm, "UTF-8"), "ISO-8859-1")
    return F.regexp_extract_all(data, F.lit(rf"(?s).{{{smallest - 9},{largest - 9}}}?(?:{_boundary()}|\z)|.{{1,{largest}}}"), F.lit(0))


def recipes(docs: DataFrame, hash_bits: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """A written row for each row: doc_id, the columns in keep, n_points, text_sha256, recipe (ordered chunk identifiers) and ranks (see below).

    Texts are cut once, and written once as chunks, which are dropped when the recipes are written.  The distinct chunks tell which identifiers stand for several chunks.  Only those are numbered, and only documents that have one
    get ranks: the numbers of their shared identifiers, in order.  So two texts are equal if and only if both recipe and ranks are; a collision costs no more than the rows of its chunks.
    hash_bits under 64 makes identifiers collide, for tests.
    """
    code = (lambda c: F.xxhash64(c)) if hash_bits == 64 else (lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - hash_bits))
    base = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("_text"))
    # rows of their own for the normalised text and for its chunks, so that each is made once
    base = base.select("doc_id", *keep, F.length("_text").cast("long").alias("n_points"), F.explode(F.array(normalized(F.col("_text")))).alias("_norm"))
    cut = base.select("doc_id", *keep, "n_points", F.sha2("_norm", 256).alias("text_sha256"), F.explode(F.array(chunks(F.col("_norm")))).alias("_chunks"))
    cut = saved(cut.withColumns({"recipe": F.transform("_chunks", code), "_id": F.monotonically_increasing_id()}), "exact-dedup-chunks")
    distinct = cut.select(F.explode("_chunks").alias("_chunk")).select(code(F.col("_chunk")).alias("_h"), "_chunk").distinct()
    shared = saved(distinct.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h"), "exact-dedup-shared")
    none = F.array().cast("array<int>")
    if shared.isEmpty():
        listed = saved(cut.select("doc_id", *keep, "n_points", "text_sha256", "recipe", none.alias("ranks")), "exact-dedup-recipes")
        drop(cut)
        return listed
    numbered = distinct.join(shared, "_h").withColumn("_rank", F.row_number().over(W.partitionBy("_h").orderBy("_chunk")))
    hit = cut.select("_id", F.posexplode("_chunks").alias("_pos", "_chunk")).withColumn("_h", code(F.col("_chunk"))).join(shared, "_h", "left_semi")
    ranks = hit.join(saved(numbered, "exact-dedup-numbers"), ["_h", "_chunk"]).groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_pos", "_rank"))).alias("_ranks"))
    listed = cut.join(ranks, "_id", "left").select("doc_id", *keep, "n_points", "text_sha256", "recipe", F.coalesce("_ranks._rank", none).alias("ranks"))
    listed = saved(listed, "exact-dedup-recipes")
    drop(cut)
    return listed


def exact_dedup(docs: DataFrame, hash_bits: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, the columns in keep, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; all empty texts are one group.  Of equal texts the one with most code points, then the smallest
    doc_id stays; a null doc_id comes after all others.  Rows that repeat both doc_id and text are one document: each is
    marked as its document is.  Columns that aren't named are not read, so their names can't clash.
    """
    listed = recipes(docs, hash_bits, keep)
    key = ["recipe", "ranks"]
    best = F.max(F.struct("n_points", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("down")))
    groups = listed.groupBy(*key).agg(F.count("*").alias("group_size"), best.alias("_best"))
    # fewer than HOT groups can hold more than a HOT-th of the rows each: these are broadcast, and their rows, dealt out by doc_id, don't meet in one task
    hot = groups.where(F.col("group_size") * HOT > groups.agg(F.sum("group_size")).scalar()).select(*key, F.struct("group_size", "_best").alias("_hot"))
    marked = listed.join(F.broadcast(hot), key, "left")
    marked = marked.withColumn("_key", F.when(F.col("_hot").isNotNull(), F.array(F.xxhash64("doc_id"), F.lit(None))).otherwise(F.col("recipe"))).drop("recipe")
    found = marked.join(groups.withColumnRenamed("recipe", "_key"), ["_key", "ranks"], "left")
    found = found.withColumns({"group_size": F.coalesce("_hot.group_size", "group_size"), "_best": F.coalesce("_hot._best", "_best")})
    return found.select(
        "doc_id",
        *keep,
        F.bitwise_not("_best.down").alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(F.bitwise_not("_best.down")) & (F.col("n_points") == F.col("_best.n_points"))).alias("kept"),
        "text_sha256",
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
g AS (
  SELECT *, count(*) OVER (PARTITION BY h) AS group_size,
    first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""
