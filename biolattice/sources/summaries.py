"""Search, summaries and links of sequence databases, from saved responses; and a read-through cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import DECIMALS, INTEGERS
from ..functions.keys import last_wins


def search(rows: DataFrame, term: Column, order: str, page: int = 10, start: int = 0) -> DataFrame:
    """One page of the rows that fit, in a total order."""
    return rows.where(term).orderBy(order).offset(start).limit(page)


def summaries(spark: SparkSession, path: str, schema: str | None = None, row_tag: str = "DocumentSummary") -> DataFrame:
    """Document summaries; known numeric fields are cast, null where the text is no number."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False)
    rows = (reader.schema(schema) if schema else reader).load(path)
    kinds = {**dict.fromkeys(INTEGERS, "bigint"), **dict.fromkeys(DECIMALS, "double")}
    flat = {f.name for f in rows.schema if f.dataType.simpleString() in ("string", "bigint", "double")}
    return rows.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items() if c in flat})


def doc_sums(spark: SparkSession, path: str) -> DataFrame:
    """id and items (map of name to text) of the older summaries; of equal names the last stays."""
    schema = "Id string, Item array<struct<_Name:string,_Type:string,_VALUE:string>>"
    rows = spark.read.format("xml").option("rowTag", "DocSum").schema(schema).load(path)
    pairs = F.transform("Item", lambda i: F.struct(i["_Name"].alias("key"), i["_VALUE"].alias("value")))
    return rows.select(F.col("Id").alias("id"), last_wins(pairs).alias("items"))


def links(responses: DataFrame, xml: str = "xml") -> DataFrame:
    """Distinct (db, id) that the link sets name; ids are numbers."""
    ids = F.explode(F.array_distinct(F.xpath(xml, F.lit("//LinkSetDb/Link/Id/text()")))).alias("id")
    rest = [c for c in responses.columns if c != xml]
    return responses.select(*rest, ids).withColumn("id", F.col("id").try_cast("bigint")).where("id is not null").distinct()


def link_sets(spark: SparkSession, path: str) -> DataFrame:
    return links(spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("xml")))


def read_through(wanted: DataFrame, cache: DataFrame, fetch: Callable[[DataFrame], DataFrame], key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(rows for the wanted keys, rows to append to the cache): only keys that the cache lacks are fetched, each once."""
    misses = wanted.select(key).distinct().join(cache.select(key), key, "left_anti")
    fetched = fetch(misses)
    return wanted.select(key).distinct().join(cache.unionByName(fetched), key), fetched


def preferred_path(refseq: Column, genbank: Column) -> Column:
    """The first path that isn't empty."""
    return F.coalesce(F.nullif(refseq, F.lit("")), F.nullif(genbank, F.lit("")))
