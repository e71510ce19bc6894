"""Corpus preparation: language identification, exact and near dedup, benchmark decontamination, mixing.

Each stage takes the documents that the one before kept, works on all of them, and is written and read again before the next.  Stages decide by row: where rows repeat a doc_id with
other texts, each has its own fate, and of rows that repeat as a whole one stays.  Nulls and empty texts follow the operators' docstrings: texts without a letter go in the first stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biolattice.llm import decontam, exact_dedup, langid, minhash, mixing
from biolattice.llm.common import saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language is accepted if its entropy is by this part at least below the next one's, that is, if there is no tie.
LEAD = 1e-9
#: Jaccard similarity of shingles, in per cent, from which two documents are near duplicates.
NEAR = 80


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with _row, which names a row: its file and its place there. Documents that aren't read from files are written first."""
    try:
        return docs.select(*COLUMNS, F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias("_row"))
    except AnalysisException:
        return _keyed(saved(docs.select(*COLUMNS), "pipeline-docs"))


def _chosen(rows: DataFrame, kept: DataFrame, how: str) -> DataFrame:
    return rows.join(kept.select("_row").distinct(), "_row", how).select(*COLUMNS)


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; those without letters or without a clear winner go. A null lang becomes the recognised one."""
    seen = langid.identify(docs, *COLUMNS[1:]).where((F.col("lang_pred") != "und") & (F.col("lead") >= LEAD))
    return seen.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    rows = _keyed(docs)
    kept = exact_dedup.exact_dedup(rows, keep=("_row",)).where("kept")
    return _chosen(rows, kept.groupBy("text_sha256").agg(F.min("_row").alias("_row")), "left_semi")


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; all without words."""
    rows = _keyed(docs)
    kept = minhash.near_duplicates(rows, NEAR, keep=("_row",)).where("kept")
    return _chosen(rows, kept.groupBy(F.coalesce("component", "_row")).agg(F.min("_row").alias("_row")), "left_semi")


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows = _keyed(docs)
    return _chosen(rows, decontam.contaminated(rows, table(spark, sf_dir, "benchmark"), keep=("_row",)), "left_anti")


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per part of a document in a slot of an output shard."""
    return mixing.mix(docs)


STAGES = [
    ("language", stage_language),
    ("exact_dedup", stage_exact_dedup),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("mix", stage_mix),
]
#: The stages' models have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
