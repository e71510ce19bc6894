"""Content-addressed sequences, laid out by the first digits of their hash with Bloom filters, so that a batch reads only the files that it can hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import saved
from .expansion import Folder
from .store import store_sequences

#: Hexadecimal digits of the hash that name a partition: 256 of them; distinct hashes of a batch up to which they are given to the scan themselves.
DIGITS, FEW = 2, 1000
SCHEMA = "hash string, seq string, prefix string"


def _prefix(c: Column | str = "hash") -> Column:
    return F.left(F.col(c) if isinstance(c, str) else c, F.lit(DIGITS))


class HashStore:
    """A table (hash, seq) at a path. Prefixes of SHA-256 are even, so no partition is hot."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame:
        if not Folder(self.spark, self.path).exists("_SUCCESS"):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        """Adds (hash, seq) as they are; each partition gets one sorted file, whose row groups have narrow ranges and a Bloom filter of hashes."""
        dealt = rows.select("hash", "seq", _prefix().alias("prefix")).repartition("prefix").sortWithinPartitions("prefix", "hash")
        dealt.write.mode("append").option("parquet.bloom.filter.enabled#hash", "true").partitionBy("prefix").parquet(self.path)

    def touched(self, hashes: DataFrame) -> DataFrame:
        """The stored rows that a batch of hashes can hit: partitions by prefix always, and for small batches row groups by range and Bloom filter."""
        prefixes = [r[0] for r in hashes.select(_prefix()).distinct().collect() if r[0] is not None]
        rows = self.rows().where(F.col("prefix").isin(prefixes))
        few = [r.hash for r in hashes.select("hash").where("hash is not null").distinct().limit(FEW + 1).collect()]
        return rows.where(F.col("hash").isin(few)) if len(few) <= FEW else rows

    def lookup(self, hashes: DataFrame) -> DataFrame:
        """The rows of hashes with the sequence of each, null where there is none; repeats stay."""
        return hashes.join(self.touched(hashes).select("hash", "seq"), "hash", "left")

    def insert(self, sequences: DataFrame, alphabet: str | None = None, mode: str = "upper") -> DataFrame:
        """Stores the sequences (column seq) that are new and returns all rows with their hashes; the batch is compared with the partitions that it touches only."""
        wanted, _ = store_sequences(sequences, self.spark.createDataFrame([], SCHEMA), alphabet, mode)
        wanted = saved(wanted, "hash-batch")
        _, new = store_sequences(sequences, self.touched(wanted), alphabet, mode)
        self.append(saved(new, "hash-new"))
        return wanted
