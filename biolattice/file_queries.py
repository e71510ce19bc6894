"""Registered queries that write a table in a source's format into the shared folder and read it back: order of records, source lines and nested captures."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.tables import shared_dir
from .queries import _t, query
from .sources import fasta, gff, proteins


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex[:12]}"


def _written(lines: DataFrame, order: str) -> str:
    """The lines in this order, as files whose paths follow it."""
    path = _folder(lines.sparkSession)
    lines.repartitionByRange(8, order).sortWithinPartitions(order).select("value").write.text(path)
    return path


@query("""
SELECT 'n' || c_nationkey AS id, count(*) AS n, arg_max(upper(c_name), c_custkey) AS last_seq, arg_max(c_mktsegment || ' x', c_custkey) AS last_description, max(ord) AS last_ord
FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS ord FROM customer) GROUP BY c_nationkey
""")
def fasta_last_wins(spark, sf):
    """Customers as records in the order of their keys, whose accession is the nation's: the last of each accession."""
    c = _t(spark, sf, "customer")
    half = F.substr("c_name", F.lit(1), F.lit(6)), F.substr("c_name", F.lit(7))
    record = F.concat(F.lit(">n"), F.col("c_nationkey"), F.lit(" "), "c_mktsegment", F.lit(" x\n"), F.upper(half[0]), F.lit("\r\n"), F.upper(half[1]))
    rows = fasta.fasta(spark, _written(c.select("c_custkey", record.alias("value")), "c_custkey"))
    last = lambda name: F.max_by(name, "ord")
    return rows.groupBy("id").agg(F.count("*").alias("n"), last("seq").alias("last_seq"), last("description").alias("last_description"), F.max("ord").alias("last_ord"))


@query("""
SELECT 'c' || o_custkey AS contig_id, arg_max(o_orderkey, o_orderkey) AS last_start, arg_max(o_orderpriority, o_orderkey) AS last_tag, max(ord) AS last_ord, min(ord) AS first_ord
FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord FROM orders) GROUP BY o_custkey
""")
def gff_last_wins(spark, sf):
    """Orders as features in the order of their keys: the first and the last of each contig, with the last tag where one is given twice."""
    o = _t(spark, sf, "orders")
    attrs = F.concat(F.lit("locus_tag=none; locus_tag = "), "o_orderpriority", F.lit(";flag"))
    key = F.col("o_orderkey").cast("string")
    line = F.concat_ws("\t", F.concat(F.lit("c"), F.col("o_custkey")), F.lit("src"), F.lit("gene"), key, key, F.lit("."), F.lit("+"), F.lit("."), attrs)
    rows = gff.gff(spark, _written(o.select("o_orderkey", line.alias("value")), "o_orderkey"))
    tag = F.max_by(F.col("attrs")["locus_tag"], "ord")
    return rows.groupBy("contig_id").agg(F.max_by("start", "ord").alias("last_start"), tag.alias("last_tag"), F.max("ord").alias("last_ord"), F.min("ord").alias("first_ord"))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as entries, one file for each size, in the order of their keys: p_size % 4 references, a comment of two lines, a feature and an evidence."""
    p = _t(spark, sf, "part").withColumn("_size", F.col("p_size"))
    refs = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 4), lambda k: F.when(k > 0, F.concat(F.lit('<dbReference type="GO" id="GO:'), k, F.lit('"/>\n')))), "")
    key = F.col("p_partkey").cast("string")
    entry = F.concat(
        F.lit('<entry dataset="S">\n<accession>A'), key, F.lit("</accession>\n"), refs, F.lit('<comment type="function"><text>'), "p_brand", F.lit("\n</text></comment>\n"),
        F.lit('<feature type="chain"><location><begin position="'), F.col("p_size"), F.lit('"/><end position="'), F.col("p_size") + 9, F.lit('"/></location></feature>'),
        F.lit('<evidence key="1" type="ECO:1"><source><dbReference type="DB" id="'), key, F.lit('"/></source></evidence>\n</entry>'),
    )
    path = _folder(spark)
    dealt = p.select("_size", "p_partkey", entry.alias("value")).repartition("_size").sortWithinPartitions("_size", "p_partkey")
    dealt.select("_size", "value").write.partitionBy("_size").text(path)
    return proteins.entries(spark, path)


@query("""
WITH sized AS (SELECT *, p_size % 4 AS refs, sum(6 + p_size % 4) OVER (PARTITION BY p_size ORDER BY p_partkey) - (6 + p_size % 4) AS total FROM part), placed AS (SELECT *, total::BIGINT AS before FROM sized)
SELECT 'A' || p_partkey AS accession, 1 + before AS entry_line, 3 + before + refs AS comment_line, array_to_string(list_transform(range(refs::BIGINT), lambda k: 3 + before + k), ',') AS reference_lines,
       row_number() OVER (ORDER BY '_size=' || p_size || '/', p_partkey) - 1 AS place
FROM placed
""")
def entry_source_lines(spark, sf):
    """The lines of entries, comments and references in their files, and the entries' order over all files."""
    rows = _entries(spark, sf)
    lines = F.array_join(F.transform(F.coalesce("dbReference", F.array().cast(rows.schema["dbReference"].dataType)), lambda d: d["_xml_sourceline"].cast("string")), ",")
    kept = rows.select(
        F.col("accession")[0].alias("accession"), F.col("_xml_sourceline").alias("entry_line"), F.col("comment")[0]["_xml_sourceline"].alias("comment_line"), lines.alias("reference_lines"), "ord"
    )
    # every file ends with a piece without an entry, which has its place too
    size = F.dense_rank().over(_by_size())
    files = _t(spark, sf, "part").select(F.concat(F.lit("A"), F.col("p_partkey")).alias("accession"), (size - 1).alias("files"))
    return kept.join(files, "accession").select("accession", "entry_line", "comment_line", "reference_lines", (F.col("ord") - F.col("files")).alias("place"))


def _by_size():
    from pyspark.sql import Window

    return Window.orderBy(F.concat(F.lit("_size="), F.col("p_size"), F.lit("/")))


@query("""
SELECT 'A' || p_partkey AS accession, p_size::BIGINT AS begin_at, p_size::BIGINT + 9 AS end_at, 'DB' AS db, p_partkey::VARCHAR AS id FROM part
""")
def entry_captures(spark, sf):
    """Positions of features and sources of evidence of the same entries."""
    rows = _entries(spark, sf)
    places = proteins.features(rows).select("accession", F.col("begin").alias("begin_at"), F.col("end").alias("end_at"))
    return places.join(proteins.evidence_sources(rows).select("accession", "db", "id"), "accession")
