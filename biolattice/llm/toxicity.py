"""Toxicity: a factorization machine over hashed terms, fitted on labelled documents by rounds of local descent whose parameters are averaged.

Terms are whole words and the character 5-grams of words with their ends marked, so that inflected and compounded insults share terms.  The machine scores a document's distinct
terms as bias + sum of weights + sum over pairs of the products of their factors: an insult and a group mention can count for more together than their weights add up to.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, id_text, remainder, saved
from .walk import batches
from .words import mixed

#: Labelled documents used at most (about; picked by hash of the id); bits of a term's hash; code points of a term.
MOST_LABELLED, BITS, GRAM = 20_000, 20, 5
#: A term counts if this many fitted documents have it and its share of toxic ones is this many standard errors off the whole's; at most so many do, the surest.
LEAST_DOCS, ERRORS, MOST_TERMS = 3, 4.5, 1 << 16
#: Factors of a term; rounds of averaging, epochs in each, documents in a step, step size, ridge; partitions that fit side by side.
FACTORS, ROUNDS, EPOCHS, STEP_DOCS, RATE, RIDGE, PARTS = 8, 5, 4, 32, 0.2, 1e-5, 8
#: Score from which a document is predicted toxic.
LIMIT = 0.7

_PLACES = np.random.default_rng(13).integers(1, 1 << 63, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.array([chr(i).isalnum() for i in range(1 << 16)])


def term_places(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed terms of all texts with the number of the text that each stands in; work is linear in the texts' length."""
    low = [t.lower() for t in texts]
    points = np.frombuffer(" ".join(["", *low, ""]).encode("utf-32-le", "replace"), np.uint32)
    letter = np.where(points < 1 << 16, _LETTER[np.minimum(points, 0xFFFF)], True)
    symbols = np.where(letter, points, 1).astype(np.uint64)
    owner = np.minimum(np.repeat(np.arange(len(low) + 1), [1, *(len(t) + 1 for t in low)])[: len(points)], len(low))
    starts = letter & ~np.concatenate([[False], letter[:-1]])
    first = np.flatnonzero(starts)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    within = np.arange(len(points)) - np.maximum.accumulate(np.where(starts, np.arange(len(points)), 0))
    powers = np.cumprod(np.full(int(within[letter].max()) + 1, _STEP, np.uint64))
    spelt = np.where(letter, mixed(symbols) * powers[np.minimum(within, len(powers) - 1)], np.uint64(0))
    words = np.add.reduceat(spelt, first)
    size = max(0, len(symbols) - GRAM + 1)
    inner = np.ones(size, bool)
    for k in range(1, GRAM - 1):
        inner &= letter[k : k + size]
    at = np.flatnonzero(inner)
    grams = np.zeros(len(at), np.uint64)
    for k in range(GRAM):
        grams += symbols[at + k] * _PLACES[k]
    terms = mixed(np.concatenate([words, grams])) & np.uint64((1 << BITS) - 1)
    return terms.astype(np.int64), owner[np.concatenate([first, at + 1])] - 1


def distinct_terms(texts: list[str], index: np.ndarray | None = None) -> list[np.ndarray]:
    """Each text's distinct terms in order: hashes or, given an index of them, the numbers of those that it knows (not -1)."""
    terms, owner = term_places(texts)
    if index is not None:
        terms = index[terms]
        known = terms >= 0
        terms, owner = terms[known], owner[known]
    keys = np.unique(owner << BITS | terms)
    cuts = np.searchsorted(keys >> BITS, np.arange(1, len(texts)))
    return np.split(keys & ((1 << BITS) - 1), cuts)


def _flat(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All documents' terms one after another, and whose each is."""
    return np.concatenate([*docs, np.zeros(0, np.int64)]), np.repeat(np.arange(len(docs)), [len(d) for d in docs])


def _sums(rows: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """The rows, one for each term of each document, added up by document."""
    out, sizes = np.zeros((len(docs), rows.shape[1])), np.array([len(d) for d in docs], np.int64)
    if len(rows):
        out[sizes > 0] = np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[sizes > 0])
    return out


class Machine:
    """Bias, weights and factors; index gives the number of a term's hash, -1 for terms that don't count."""

    def __init__(self, index: np.ndarray, terms: int, odds: float):
        self.index = index
        self.bias, self.weight = odds, np.zeros(terms)
        self.factor = np.random.default_rng(7).normal(scale=0.05, size=(terms, FACTORS))

    def raw(self, docs: list[np.ndarray]) -> np.ndarray:
        ids, at = _flat(docs)
        total, squares = _sums(self.factor[ids], docs), _sums((self.factor[ids] ** 2).sum(axis=1, keepdims=True), docs)[:, 0]
        return self.bias + np.bincount(at, self.weight[ids], len(docs)) + 0.5 * ((total**2).sum(axis=1) - squares)

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(docs), -30, 30)))

    def descend(self, docs: list[np.ndarray], y: np.ndarray, seed: int) -> None:
        """EPOCHS of stochastic descent on the logistic loss, each parameter's step by its own past gradients."""
        rng = np.random.default_rng(seed)
        past_b, past_w, past_v = 1e-8, np.full(len(self.weight), 1e-8), np.full(self.factor.shape, 1e-8)
        for _ in range(EPOCHS):
            order = rng.permutation(len(docs))
            for low in range(0, len(order), STEP_DOCS):
                some = [docs[i] for i in order[low : low + STEP_DOCS]]
                off = (self.score(some) - y[order[low : low + STEP_DOCS]]) / len(some)
                ids, at = _flat(some)
                total = _sums(self.factor[ids], some)
                by = np.argsort(ids, kind="stable")
                used, first = np.unique(ids[by], return_index=True)
                slope = off[at, None] * np.hstack([np.ones((len(ids), 1)), total[at] - self.factor[ids]])
                slope = np.add.reduceat(slope[by], first) if len(ids) else np.zeros((0, FACTORS + 1))
                gw, gv = slope[:, 0] + RIDGE * self.weight[used], slope[:, 1:]
                gv = gv + RIDGE * self.factor[used]
                gb = float(off.sum())
                past_b += gb * gb
                past_w[used] += gw**2
                past_v[used] += gv**2
                self.bias -= RATE * gb / np.sqrt(past_b)
                self.weight[used] -= RATE * gw / np.sqrt(past_w[used])
                self.factor[used] -= RATE * gv / np.sqrt(past_v[used])


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame | None:
    """Rows (y, terms) of about MOST_LABELLED labelled documents that aren't held out; None without any.  Only their ids and labels are broadcast."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    marks = marks.where(remainder(F.col("doc_id"), 3) != 1)
    n = marks.count()
    if not n:
        return None
    part = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, MOST_LABELLED / n))
    marks = marks.where(part).select(F.col("doc_id").alias("_id"), "y")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            terms = distinct_terms(frame["text"].tolist())
            yield pd.DataFrame({"y": frame["y"], "terms": [t.astype(np.int32).tobytes() for t in terms]})

    rows = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("_id")).select("text", "y")
    return saved(rows.mapInPandas(run, "y int, terms binary").repartition(PARTS), "toxicity-labelled")


def _terms_that_count(rows: DataFrame) -> tuple[np.ndarray, int, float] | None:
    """The index of terms, how many there are, and the log odds of a toxic document, from counts that the partitions sum up by term hash."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = np.zeros(2, np.int64)
        seen = np.zeros((2, 1 << BITS), np.int64)
        for frame in frames:
            for y, raw in zip(frame["y"], frame["terms"]):
                size[y] += 1
                seen[y, np.frombuffer(raw, np.int32)] += 1
        yield pd.DataFrame({"size": [size.tobytes()], "seen": [zlib.compress(seen.tobytes(), 1)]})

    size, seen = np.zeros(2), np.zeros((2, 1 << BITS))
    for part in rows.mapInPandas(counted, "size binary, seen binary").collect():
        size += np.frombuffer(part["size"], np.int64)
        seen += np.frombuffer(zlib.decompress(part["seen"]), np.int64).reshape(2, -1)
    n = size.sum()
    if not n:
        return None
    rate = (size[1] + 0.5) / (n + 1)
    both = seen.sum(axis=0)
    error = np.sqrt(np.maximum(1e-12, both * rate * (1 - rate) * (1 - np.minimum(1, both / (n + 1)))))
    sure = np.where(both >= LEAST_DOCS, np.abs(seen[1] - both * rate) / error, 0)
    keep = np.argsort(-sure, kind="stable")[:MOST_TERMS]
    keep = np.sort(keep[sure[keep] >= ERRORS])
    index = np.full(1 << BITS, -1, np.int64)
    index[keep] = np.arange(len(keep))
    return index, len(keep), float(np.log(rate / (1 - rate)))


def fitted(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """The machine; None without labelled rows.

    In each round every partition descends from the same parameters over its own rows, and the results are averaged by rows; only parameters move.
    """
    rows = _labelled(docs, labels)
    start = _terms_that_count(rows) if rows is not None else None
    if start is None:
        return None
    machine = Machine(*start)

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, y = [], []
        for frame in frames:
            for label, raw in zip(frame["y"], frame["terms"]):
                numbers = machine.index[np.frombuffer(raw, np.int32)]
                own.append(numbers[numbers >= 0])
                y.append(label)
        if own:
            machine.descend(own, np.array(y, float), len(own))
        yield pd.DataFrame({"n": [len(own)], "bias": [machine.bias], "weight": [machine.weight.tobytes()], "factor": [machine.factor.tobytes()]})

    for _ in range(ROUNDS):
        n, bias, weight, factor = 0, 0.0, np.zeros_like(machine.weight), np.zeros_like(machine.factor)
        for part in rows.mapInPandas(local, "n long, bias double, weight binary, factor binary").collect():
            n, bias = n + part["n"], bias + part["n"] * part["bias"]
            weight += part["n"] * np.frombuffer(part["weight"])
            factor += part["n"] * np.frombuffer(part["factor"]).reshape(factor.shape)
        machine.bias, machine.weight, machine.factor = bias / n, weight / n, factor / n
    drop(rows)
    return machine


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts have no terms, so the bias is their score; without labelled rows all scores are 0.5.  Repeated labels of a document count as their mean,
    null labels not at all.  Other columns of either table aren't read.  Terms that alone tell nothing about the labels (see ERRORS) don't count, in pairs neither.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            m = shared.value
            score = m.score(distinct_terms(frame["text"].tolist(), m.index)) if m else np.full(len(frame), 0.5)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "score": score, "predicted": (score >= LIMIT).astype("int32")})

    rows = docs.select(id_text(), (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    out = rows.mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
