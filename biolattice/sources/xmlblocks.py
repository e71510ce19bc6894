"""Large XML files in blocks of a fixed number of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.tables import saved

#: Entries of a block.
BLOCK = 2500


def blocks(rows: DataFrame, order: str, size: int = BLOCK) -> DataFrame:
    """rows with block, the number of the block of `size` rows in this order (a column without ties).

    Runs of the order's hash would lose it; so rows are dealt out by range into a written table, numbered within each range and offset by the
    counts of the ranges before.
    """
    spark = rows.sparkSession
    dealt = saved(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.select("_p", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    number = F.row_number().over(W.partitionBy("_p").orderBy(order)) - 1
    return dealt.withColumn("_n", number).join(before, "_p").withColumn("block", F.floor((F.col("_b") + F.col("_n")) / size)).drop("_p", "_n", "_b")


def split(rows: DataFrame, path: str, size: int = BLOCK) -> None:
    """Writes XML files of at most `size` entries."""
    rows.write.format("xml").option("rowTag", "entry").option("rootTag", "entries").option("maxRecordsPerFile", size).save(path)
