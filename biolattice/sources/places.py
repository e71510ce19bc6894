"""The order of records in their files, whatever splits they are read in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.tables import saved

#: Where a record stands: its file, where its split begins, and its place among the split's records.
PLACE = ("_file", "_start", "_at")


def placed(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """Columns of rows just read from files, and each row's place.

    A split is read by one task from its beginning to its end, so the generated ids follow the file within a split; between splits they mean nothing.
    """
    return rows.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))


def numbered(rows: DataFrame, size: str | None = None) -> DataFrame:
    """rows (with their places) with ord, the number of the record among those of all files in the order of their paths, from 0.

    ord depends on neither splits nor sizes of files, nor on the order in which files are listed.  size: a column that is added up over the splits before in the same file, as _before.
    The rows are written once, so that counts and rows are of one reading; what is summed up in order has a row for each split.
    """
    read = saved(rows, "placed")
    splits = read.groupBy("_file", "_start").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"), F.sum(size or F.lit(0)).alias("_size"))
    every, own = W.orderBy("_file", "_start"), W.partitionBy("_file").orderBy("_start")
    ahead = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("_file", "_start", (ahead("_rows", every) - F.col("_first")).alias("_shift"), ahead("_size", own).alias("_before"))
    out = read.join(splits, ["_file", "_start"]).withColumn("ord", F.col("_shift") + F.col("_at"))
    return out.drop(*PLACE, "_shift", *([] if size else ["_before"]))
