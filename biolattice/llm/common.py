"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import drop as drop
from ..plans.tables import saved as saved

#: White space as all operators here understand it: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def id_text(c: str = "doc_id") -> Column:
    """An id as text: pandas would make integers beside nulls floating-point numbers, which large ids don't survive."""
    return F.col(c).cast("string").alias(c)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal digits, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
