"""FASTA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .places import numbered, placed


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """id (header up to the first space), description, seq, ord of each record; plain or gzip.

    Records are split by the reader, at `>` that begins a line, so a file's records go to several tasks (not of a gzip file).  ord follows the files' paths and the records in them.
    """
    raw = numbered(placed(spark.read.option("lineSep", "\n>").text(path), F.regexp_replace("value", r"\A>|\r", "").alias("r")))
    header = F.substring_index("r", "\n", 1)
    return raw.where(F.length(F.trim("r")) > 0).select(
        F.substring_index(header, " ", 1).alias("id"),
        F.when(F.contains(header, F.lit(" ")), F.substr(header, F.length(F.substring_index(header, " ", 1)) + 2)).otherwise(F.lit("")).alias("description"),
        F.regexp_replace(F.substr("r", F.length(header) + 1), r"\s", "").alias("seq"),
        "ord",
    )
