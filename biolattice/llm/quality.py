"""Quality scores: random Fourier features of document statistics, ridge regression by summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, remainder, saved
from .walk import batches

#: Labelled rows used at most; random features; width of the kernel in standard deviations times the root of the number of statistics; ridge.
MOST_LABELLED, FEATURES, WIDTH, RIDGE = 200_000, 256, 1.0, 1.0
PARTS, SEED = 8, 11

_CLASSES = 7  # lower, upper, digit, space, common punctuation, other letter, the rest


def _class(c: str) -> int:
    if c.islower():
        return 0
    if c.isupper():
        return 1
    if c.isdigit():
        return 2
    if c in " \t\n\v\f\r":
        return 3
    if c in ".,;:!?'\"()-":
        return 4
    return 5 if c.isalpha() else 6


_TABLE = np.array([_class(chr(i)) for i in range(1 << 16)], np.uint8)
NAMES = [*(f"c{k}" for k in range(_CLASSES)), "chars", "words", "word_length", "distinct", "top_line", "lines", "capitals", "stops", "repeats"]


def statistics(texts: list[str]) -> np.ndarray:
    """A row of len(NAMES) statistics for each text; work is linear in the texts' length."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    counts = np.bincount(owner * _CLASSES + _TABLE[np.minimum(points, 0xFFFF)], minlength=len(texts) * _CLASSES).reshape(-1, _CLASSES)
    rest = np.empty((len(texts), len(NAMES) - _CLASSES))
    for k, t in enumerate(texts):
        words, lines = t.split(), t.split("\n")
        n, kinds = max(1, len(words)), len(set(words))
        # distinct words fall off with length whatever the quality; the square root takes most of that out
        rest[k] = (
            np.log1p(len(t)),
            np.log1p(len(words)),
            len(t) / n,
            kinds / n,
            1 - len(set(lines)) / len(lines),
            np.log1p(len(lines)) - np.log1p(len(words)),
            sum(map(str.isupper, words)) / n,
            (t.count(".") + t.count(",")) / n,
            np.log((kinds + 1) / (np.sqrt(len(words)) + 1)),
        )
    return np.hstack([counts / np.maximum(1, sizes)[:, None], rest])


def _described(docs: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "stats": list(statistics(frame["text"].tolist()))})

    rows = docs.select(id_text(), (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    out = rows.mapInPandas(run, "doc_id string, held_out boolean, stats array<double>")
    return saved(out.withColumn("doc_id", F.col("doc_id").cast("long")), "quality-statistics")


class Model:
    """Scores rows of statistics; fitted from sums alone."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(size=(len(mean), FEATURES)) / (WIDTH * np.sqrt(len(mean)))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.coef = np.zeros(FEATURES + 1)
        self.x, self.y = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        """Rounded, so that equal texts tie whatever batch they come in."""
        return np.round(self.features(stats) @ self.coef, 9)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.x, self.y), 0, 1)


def pooled(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: mean raw score and mean label of each pool.

    Rows of equal raw score are one block from the start, so their order can't matter.
    """
    value, at = np.unique(raw, return_inverse=True)
    hits, rows = np.bincount(at, label, len(value)), np.bincount(at, minlength=len(value))
    blocks: list[list[float]] = []
    for one in zip(hits.tolist(), (value * rows).tolist(), rows.tolist()):
        blocks.append(list(one))
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[1] / b[2] for b in blocks]), np.array([b[0] / b[2] for b in blocks])


def fitted(described: DataFrame, labels: DataFrame) -> Model | None:
    """The model from the labelled rows that aren't held out; None without any.

    Of labelled rows about MOST_LABELLED are used, picked by hash; a fifth of them calibrate and aren't fitted on.  Each of PARTS partitions sums its normal equations.
    """
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    h = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000))
    rows = described.where(~F.col("held_out")).join(marks, "doc_id").select("stats", "y", h.alias("h"))
    n = rows.count()
    if not n:
        return None
    rows = saved(rows.where(F.col("h") < int(1_000_000 * min(1.0, MOST_LABELLED / n))).repartition(PARTS), "quality-labelled")
    one = [F.get("stats", F.lit(k)) for k in range(len(NAMES))]
    sums = rows.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(one)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(one)]).first()
    model = Model(np.array(sums[: len(NAMES)], float), np.array(sums[len(NAMES) :], float))

    def equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for frame in frames:
            if len(frame):
                z = model.features(np.stack(frame["stats"]))
                total += z.T @ np.hstack([z, frame["y"].to_numpy()[:, None]])
        yield pd.DataFrame({"sums": [total.tobytes()]})

    parts = rows.where("h % 5 != 0").mapInPandas(equations, "sums binary").collect()
    total = sum(np.frombuffer(p["sums"]).reshape(FEATURES + 1, FEATURES + 2) for p in parts)
    model.coef = np.linalg.solve(total[:, :-1] + RIDGE * np.diag([1.0] * FEATURES + [1e-6]), total[:, -1])
    kept = rows.where("h % 5 = 0").select("stats", "y").toPandas()
    if len(kept):
        model.x, model.y = pooled(model.raw(np.stack(kept["stats"])), kept["y"].to_numpy())
    return model


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts are scored by their statistics like any other; without labelled rows all scores are 0.5.  Repeated labels of a document count as
    their mean, null labels not at all.  Other columns of either table aren't read.
    """
    described = _described(docs)
    model = fitted(described, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                m = shared.value
                score = m.score(np.stack(frame["stats"])) if m else np.full(len(frame), 0.5)
                yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "score": score, "predicted": (score >= 0.5).astype("int32")})

    out = described.withColumn("doc_id", id_text()).mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
