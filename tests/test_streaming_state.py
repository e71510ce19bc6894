"""Keyed state of the latest action: the batch result for any batches, late events left out, state dropped after expiry."""

import random

import pytest

from biolattice.operators import curation
from biolattice.streaming import latest as stream

SCHEMA = "doc_id string, pos bigint, timestamp bigint, user_id string, action string, target string"


@pytest.fixture
def run(spark, tmp_path):
    """Runs the operator over lists of events, each list one micro-batch; rows as emitted, in order, and the rows of state that are left."""
    old = {k: spark.conf.get(k, None) for k in (stream.STATE_STORE[0], "spark.sql.shuffle.partitions")}
    spark.conf.set(*stream.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def go(name, batches, late="1 hour", span=3600):
        folder, rows = tmp_path / name, []
        for k, batch in enumerate(batches):
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{k:03d}")
            source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{folder}/in")
            q = stream.latest_with_expiry(source, late, span).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
            q = q.foreachBatch(lambda df, n: rows.extend(df.collect())).trigger(availableNow=True).start()
            q.awaitTermination(120)
            if q.exception():
                raise q.exception()
        return rows, q.lastProgress["stateOperators"][0]["numRowsTotal"]

    yield go
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def events(n, seed):
    rng = random.Random(seed)
    return [(f"r{rng.randrange(3)}@t", k, 1000 + rng.randrange(40), f"u{k % 4}", rng.choice("ABC"), f"f{rng.randrange(3)}") for k in range(n)]


def test_any_batches_give_the_batch_result(spark, run):
    log = events(80, 1)
    want = {tuple(r) for r in curation.latest(spark.createDataFrame(log, SCHEMA), "doc_id").collect()}
    for seed in (0, 1):
        mixed = log[:]
        random.Random(seed).shuffle(mixed)
        rows, state = run(f"s{seed}", [mixed[:50], mixed[50:55], mixed[55:]])
        last = {(r.doc_id, r.target): tuple(r)[:5] for r in rows}
        assert set(last.values()) == want and not any(r.expired for r in rows) and state >= len(want)


def test_late_events_are_left_out_and_state_is_dropped(run):
    at = lambda t, action, target="f": ("r@t", 0, t, "u", action, target)
    batches = [
        [at(1000, "A"), at(1010, "B"), at(1005, "C")],
        [at(1400, "x", "other")],  # the watermark is 1340 from here on, so f expires at 1010 + 100
        [at(1401, "y", "other"), at(1001, "late")],  # later than allowed
        [at(1402, "z", "other"), ("r@t", 0, None, "u", "n", "f"), (None, 0, 1402, "u", "n", "f")],
    ]
    rows, state = run("late", batches, "60 seconds", 100)
    assert [(r.action, r.expired) for r in rows if r.target == "f"] == [("B", False), ("B", True)]
    assert [(r.action, r.expired) for r in rows if r.target == "other"] == [("x", False), ("y", False), ("z", False)]
    before, left = run("one", [[at(1402, "z", "other")]], "60 seconds", 100)
    assert state == left
