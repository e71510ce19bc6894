"""GFF3."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import last_wins
from .places import numbered, placed


def attributes(c: Column) -> Column:
    """Map of `key=value` parts between semicolons, trimmed, cut at the first `=`; parts without `=` are left out, of equal keys the last stays."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda p: F.contains(p, F.lit("=")))
    pair = lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.substr(p, F.instr(p, F.lit("=")) + 1)).alias("value"))
    return last_wins(F.transform(parts, pair))


def gff(spark: SparkSession, path: str) -> DataFrame:
    """contig_id, source, feature_type, start, end, score, strand, phase, attrs, ord of each line with nine fields or more; comments are left out, types aren't filtered.

    ord is the line's number over all files in the order of their paths, comments counted.
    """
    lines = numbered(placed(spark.read.text(path), "value")).where(~F.startswith("value", F.lit("#")))
    f = F.split(F.regexp_replace("value", r"[\r\n]+\z", ""), "\t")
    rows = lines.select(f.alias("f"), "ord").where(F.size("f") >= 9)
    text = lambda k, name: F.get("f", F.lit(k)).alias(name)
    return rows.select(
        text(0, "contig_id"),
        text(1, "source"),
        text(2, "feature_type"),
        F.get("f", F.lit(3)).cast("bigint").alias("start"),
        F.get("f", F.lit(4)).cast("bigint").alias("end"),
        text(5, "score"),
        text(6, "strand"),
        text(7, "phase"),
        attributes(F.get("f", F.lit(8))).alias("attrs"),
        "ord",
    )
