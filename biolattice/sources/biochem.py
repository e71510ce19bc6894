"""Biochemistry database shards: JSON arrays of compounds and reactions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shards(spark: SparkSession, root: str, kind: str) -> DataFrame:
    try:
        whole = spark.read.option("wholetext", True).text(f"{root}/Biochemistry/{kind}_*.json")
    except AnalysisException as error:
        raise ValueError(f"no {kind} shards under {root}/Biochemistry") from error
    rows = whole.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "array<map<string,string>>").alias("a"))
    # order: file name, then place in the file
    return rows.select("file", F.posexplode("a").alias("pos", "props")).select("props", F.struct("file", "pos").alias("ord"))


def biochem(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(compounds, reactions), each (props, ord): fields as text, nested values as JSON. ValueError if root has none."""
    return _shards(spark, root, "compound"), _shards(spark, root, "reaction")
