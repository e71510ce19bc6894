"""The latest action of each target of a stream, in keyed state that expires."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that processors with timers need; set it in the session before a query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_STATE = "action string, user_id string, timestamp bigint, pos bigint, until bigint"
OUT = "doc_id string, target string, action string, user_id string, timestamp bigint, expired boolean"


class LatestAction(StatefulProcessor):
    """One row of state for a (document, target): its newest event so far, and when that expires.

    Of equal timestamps the event that stands first in the log counts, in whatever order they arrive.  A timer is set to the newest event's time and the span; it is moved when a newer one comes.
    """

    def __init__(self, span_ms: int):
        self.span_ms = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.newest.get() if self.newest.exists() else None
        best = None if kept is None else (kept[2], -kept[3], kept[0], kept[1])
        for r in rows:
            one = (r.timestamp, -r.pos, r.action, r.user_id)
            if best is None or one[:2] > best[:2]:
                best = one
        if best is None or kept is not None and best[:2] == (kept[2], -kept[3]):
            return iter(())
        until = best[0] * 1000 + self.span_ms
        if kept is not None and kept[4] != until:
            self.handle.deleteTimer(kept[4])
        self.handle.registerTimer(until)
        self.newest.update((best[2], best[3], best[0], -best[1], until))
        return iter((Row(doc_id=key[0], target=key[1], action=best[2], user_id=best[3], timestamp=best[0], expired=False),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.newest.exists():
            return iter(())
        action, user, at, _, _ = self.newest.get()
        self.newest.clear()
        return iter((Row(doc_id=key[0], target=key[1], action=action, user_id=user, timestamp=at, expired=True),))

    def close(self) -> None:
        pass


def latest_with_expiry(events: DataFrame, late: str, span_seconds: int) -> DataFrame:
    """A row whenever a target's latest action changes, and one with `expired` when no newer one has come within the span: its state is dropped then.

    events: doc_id, pos, timestamp (seconds), user_id, action, target.  Events that come later than `late` behind the newest seen are left out; null timestamps, documents or targets too.  As long as no
    event is that late, and none of a target comes after its expiry, the last row of each target is what the batch aggregate gives, however the events are dealt into batches.
    For the append mode, with the state store of STATE_STORE.
    """
    timed = events.where("timestamp is not null and doc_id is not null and target is not null").withColumn("_time", F.timestamp_seconds("timestamp")).withWatermark("_time", late)
    rows = timed.select("doc_id", "target", F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), F.col("timestamp").cast("long").alias("timestamp"), "user_id", "action", "_time")
    return rows.groupBy("doc_id", "target").transformWithState(LatestAction(span_seconds * 1000), OUT, "Append", "EventTime")
