"""Structured Streaming forms of the latest-action roll-up and of the idempotent graph load."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.curation import latest
from ..operators.expansion import Folder
from ..operators.store import eid


def latest_actions(events: DataFrame, *by: str) -> DataFrame:
    """The latest action of each target over a stream of events; in update or complete mode. State is one row per target."""
    return latest(events, *by)


def activity(events: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Events by window and key, with a watermark: rows later than `late` are left out and state is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def load_stream(nodes: DataFrame, path: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends nodes that the store at path lacks, batch by batch. A batch that runs again after a failure adds nothing, as its ids are there already."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        new = rows.dropDuplicates(["id"]).withColumn("eid", eid())
        if any(not name.startswith(("_", ".")) for name in Folder(spark, path).names("")):
            new = new.join(spark.read.parquet(path).select("id"), "id", "left_anti").select(*new.columns)
        new.write.mode("append").parquet(path)
        if after:
            after(new, number)

    return nodes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
