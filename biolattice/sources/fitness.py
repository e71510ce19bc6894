"""Fitness experiments: downloaded tables by dataset and organism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fasta import fasta
from .places import numbered, placed

#: Datasets that are tables, and those that are sequences.
TABLES = ("fitness_values", "t_scores", "cofitness", "specific_phenotypes", "experiments", "reannotations", "genes")
SEQUENCES = ("genome", "proteins")


def dataset(spark: SparkSession, root: str, name: str, organism: str, organisms: tuple[str, ...] = ()) -> DataFrame:
    """A dataset of an organism from root/name/organism.tsv (or .fasta), all columns text, with the organism's id. ValueError for what isn't known."""
    if name not in TABLES + SEQUENCES or organisms and organism not in organisms:
        raise ValueError(f"unknown dataset or organism: {name}, {organism}")
    if name in SEQUENCES:
        rows = fasta(spark, f"{root}/{name}/{organism}.fasta")
    else:
        rows = spark.read.csv(f"{root}/{name}/{organism}.tsv", sep="\t", header=True, inferSchema=False)
    return rows.withColumn("organism", F.lit(organism))


def matrices(spark: SparkSession, path: str, keys: tuple[str, ...], organism: Column | None = None) -> DataFrame:
    """(organism, the key columns, experiment, value) of each cell of wide tab-separated tables, each with its own experiments as columns; one plan for files of any widths.

    A file's first line names its columns: those in keys describe the gene (null where a file lacks one), all others are experiments.  value is a number, null where the text is none.  Fields beyond the
    named columns are left out; a short line's missing cells are null.  organism: from the column file, the file's path; else the name of the file up to its first dot.
    """
    lines = numbered(placed(spark.read.text(path), F.regexp_replace("value", r"\r\z", "").alias("line"), F.col("_metadata.file_path").alias("file")))
    heads = lines.groupBy("file").agg(F.min_by(F.split("line", "\t"), "ord").alias("names"), F.min("ord").alias("head"))
    named = organism if organism is not None else F.substring_index(F.element_at(F.split("file", "/"), -1), ".", 1)
    rows = lines.join(heads, "file").where("ord > head and line <> ''").withColumn("fields", F.split("line", "\t"))
    key = [F.get("fields", (F.array_position("names", k) - 1).cast("int")).alias(k) for k in keys]
    cells = F.filter(F.arrays_zip("names", "fields"), lambda c: c["names"].isNotNull() & ~c["names"].isin(*keys))
    each = rows.select(named.alias("organism"), *[F.when(F.array_position("names", k) > 0, c).alias(k) for k, c in zip(keys, key)], F.explode(cells).alias("c"))
    return each.select("organism", *keys, F.col("c.names").alias("experiment"), F.col("c.fields").try_cast("double").alias("value"))


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """(organism, dataset, path, bytes) of every downloaded table and sequence file below root; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{tsv,fasta}").load(root).select("path", F.col("length").alias("bytes"))
    parts = F.split("path", "/")
    found = files.select(F.substring_index(F.element_at(parts, -1), ".", 1).alias("organism"), F.element_at(parts, -2).alias("dataset"), "path", "bytes")
    return found.where(F.col("dataset").isin(*TABLES, *SEQUENCES))


def complete(catalogued: DataFrame) -> DataFrame:
    """Organisms with the number of their datasets and the names of those that lack."""
    every = F.array(*[F.lit(x) for x in TABLES + SEQUENCES])
    return catalogued.groupBy("organism").agg(F.collect_set("dataset").alias("d")).select("organism", F.size("d").alias("datasets"), F.array_except(every, "d").alias("lacking"))
