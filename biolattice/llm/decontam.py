"""Benchmark decontamination by latent semantic retrieval.

Terms are the benchmark's words, weighted by how few documents have them.  A randomised SVD of TF-IDF passages (the benchmark's, and those of all documents) gives the latent space;
what it needs of the documents are the counts of pairs of terms that meet in a passage, whole numbers that one pass sums in a tree.  Every window of every document is projected and compared with every item, and also compared with the items' own
TF-IDF passages, since the space can't hold the passages of more than RANK items; windows near an item either way are candidates, for which the longest common subsequence with the item and the item's answer are checked, so passages with changed,
added or dropped words are found too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, saved
from .walk import batches
from .words import word_hashes

#: A document's windows are two BLOCKs of words long and start at every BLOCK; items are compared in passages of at most PASSAGE words.
BLOCK, PASSAGE = 16, 64
#: Latent dimensions at most, more columns in the random sketch, power iterations.
RANK, EXTRA, POWERS, SEED = 256, 16, 2, 5
#: Weight of a benchmark passage against a document's; all documents together weigh at most as much as so many would.
EMPHASIS, WHOLE = 20.0, 2000
#: Cosine that makes a candidate; share of an item's words in common order that is enough alone, or with enough of the answer (an item's last words).
COSINE, ALONE, WITH_ANSWER, ANSWER, ANSWER_SHARE = 0.3, 0.75, 0.55, 0.25, 0.5
#: Items, and words of items, matched in one pass over the documents; more are taken in blocks.
ITEMS, ITEM_WORDS = 4096, 1 << 18
#: Products, and cells of windows by passages, that are held at a time.
_CELLS = 1 << 20
#: Rows that are added up at a time.
_ADDED = 8192
#: Pairs that a task sorts at a time, and distinct ones that it holds; cells of a slice of the table of pairs; tasks whose counts are summed at the first level of the tree; parts that it is read in.
_PAIRS, _SLICE, _FAN, _PARTS = 1 << 21, 1 << 21, 32, 64


class Terms:
    """Index of the benchmark's words by a direct table on hash bits; bounded by the items of a block."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bits = max(16, int(len(self.hashes) * 8).bit_length())
        # of words that share a slot the table names the first; the rest is looked up
        slot = self._slot(self.hashes)
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.table[slot[::-1]] = np.arange(len(self.hashes), dtype=np.int32)[::-1]
        self.crowded = np.zeros(1 << self.bits, bool)
        self.crowded[slot[self.table[slot] != np.arange(len(slot))]] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each word, -1 for words that no item has."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        slot = self._slot(h)
        got = self.table[slot]
        got = np.where((got >= 0) & (self.hashes[got] == h), got, -1)
        again = np.flatnonzero((got < 0) & self.crowded[slot])
        if len(again):
            at = np.minimum(np.searchsorted(self.hashes, h[again]), len(self.hashes) - 1)
            got[again] = np.where(self.hashes[at] == h[again], at, -1)
        return got


def common_length(text: list[int], masks: dict[int, int], size: int) -> int:
    """Length of the longest common subsequence of text with the sequence of `size` words whose places by word are in masks (one bit a place)."""
    full = (1 << size) - 1
    v = full
    for w in text:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def masks_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def _passages(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each passage of at most PASSAGE words, and its text."""
    starts, owner, low = [], [], 0
    for k, high in enumerate(ends.tolist()):
        n = max(1, -(-(high - low) // PASSAGE))
        size = -(-(high - low) // n) or 1
        for s in range(low, high, size):
            starts.append(s)
            owner.append(k)
        low = high
    return np.array(starts, np.int64), np.array(owner, np.int64)


def _rows(found: np.ndarray, starts: np.ndarray, weight: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """TF-IDF rows of passages (terms `found`, passages begin at starts) times matrix, without the rows themselves."""
    hit = np.flatnonzero(found >= 0)
    out = np.zeros((len(starts), matrix.shape[1]), np.float32)
    _add(out, np.searchsorted(starts, hit, side="right") - 1, found[hit], weight, matrix)
    return out


def _add(out: np.ndarray, to: np.ndarray, term: np.ndarray, weight: np.ndarray, matrix: np.ndarray, of: np.ndarray | None = None) -> None:
    """Add row of[k] (term[k] unless given) of matrix, times the weight of term[k], to row to[k] of out; `to` ascends."""
    of = term if of is None else of
    for low in range(0, len(to), _ADDED):
        at = slice(low, low + _ADDED)
        first = np.flatnonzero(np.diff(to[at], prepend=-1))
        out[to[at][first]] += np.add.reduceat(matrix[of[at]] * weight[term[at], None], first, dtype=out.dtype)


class Space:
    """Everything that a scan of the documents needs; bounded by ITEMS."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        words, ends = word_hashes([t for _, t in items])
        self.words, self.ends = words, ends
        self.terms = Terms(words)
        self.item_terms = self.terms.find(words)
        self.starts, self.owner = _passages(words, ends)
        self.weight = np.ones(len(self.terms.hashes), np.float32)
        self.other = np.float32(1)

    def weigh(self, counts: dict[int, int], docs: int) -> None:
        n = np.array([counts.get(k, 0) for k in range(len(self.terms.hashes))], float)
        self.weight = np.log((docs + 1) / (n + 0.5)).clip(0.05).astype(np.float32)
        self.other = np.float32(self.weight.mean() if len(n) else 1)  # of words that no item has

    def settle(self, basis: np.ndarray) -> None:
        """Items in the latent space, unit length."""
        self.latent = (basis * self.weight[:, None]).astype(np.float32)
        q = _rows(self.item_terms, self.starts, self.weight, basis.astype(np.float32))
        self.queries = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)).T.astype(np.float32)
        self.best = np.zeros(len(self.latent), np.float32)
        for low in range(0, len(self.best), 4096):
            self.best[low : low + 4096] = (self.latent[low : low + 4096] @ self.queries).max(1, initial=0)
        # the passages as they are, unit length, by term: what the space leaves out of an item is found here
        passage = np.searchsorted(self.starts, np.arange(len(self.item_terms)), side="right") - 1
        cell, times = np.unique(self.item_terms * len(self.starts) + passage, return_counts=True)
        term, self.holder = np.divmod(cell, max(1, len(self.starts)))
        self.product = times * self.weight[term].astype(float) ** 2
        self.lengths = np.sqrt(np.bincount(self.holder, self.product * times, len(self.starts)))
        self.product /= self.lengths[self.holder]
        self.first = np.searchsorted(term, np.arange(len(self.weight) + 1))
        self.part = np.zeros(len(self.weight))
        if len(term):  # every term has a passage
            self.best = np.maximum(self.best, np.maximum.reduceat(self.product, self.first[:-1])).astype(np.float32)
            self.part = np.maximum.reduceat(self.product / self.lengths[self.holder], self.first[:-1])
        self.latent = np.vstack([self.latent, np.zeros((1, self.latent.shape[1]), np.float32)])  # index -1: no term
        low = 0
        self.sequences = []
        for high in self.ends.tolist():
            seq = self.item_terms[low:high].tolist()
            tail = seq[-max(3, round(len(seq) * ANSWER)) :]
            self.sequences.append((len(seq), masks_of(seq), len(tail), masks_of(tail)))
            low = high

    def _products(self, terms: np.ndarray) -> np.ndarray:
        """Products of windows (rows of terms, -1 for none) with all passages of unit length."""
        out = np.zeros(len(terms) * len(self.lengths))
        row, place = np.nonzero(terms >= 0)
        begin = self.first[terms[row, place]]
        count = self.first[terms[row, place] + 1] - begin
        ends, low = np.cumsum(count), 0
        while low < len(row):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _CELLS, side="right")))
            n = count[low:high]
            at = np.repeat(begin[low:high] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out += np.bincount(np.repeat(row[low:high] * len(self.lengths), n) + self.holder[at], self.product[at], len(out))
            low = high
        return out.reshape(len(terms), len(self.lengths))

    def matches(self, texts: list[str]) -> list[dict[int, tuple[float, int, int]]]:
        """For each text, of the items found in it: cosine of the best window, length of the common subsequence, words of the answer."""
        out: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]
        words, ends = word_hashes(texts)
        found = self.terms.find(words)
        if not len(words) or not self.ids:
            return out
        squares = np.where(found >= 0, self.weight[found], self.other) ** 2
        begins = np.concatenate([[0], ends[:-1]])
        counts = -(-(ends - begins) // BLOCK)
        owner = np.repeat(np.arange(len(texts)), counts)
        starts = begins[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * BLOCK
        norms = np.add.reduceat(squares, starts)
        pair = np.flatnonzero(np.append(owner[1:] == owner[:-1], False))  # blocks followed by one of the same text
        norms[pair] += norms[pair + 1]
        # a window's cosine with any item is at most the sum of its terms' best products; few windows can reach COSINE
        best = np.add.reduceat(np.append(self.best, np.float32(0))[found], starts)
        best[pair] += best[pair + 1]
        part = np.add.reduceat(np.append(self.part, 0.0)[found], starts)
        part[pair] += part[pair + 1]
        live = np.flatnonzero((best >= COSINE * np.sqrt(norms)) | (part >= COSINE))
        size = np.where(np.append(owner[1:] == owner[:-1], False), 2, 1)[live]
        stop = np.minimum(starts[live] + size * BLOCK, ends[owner[live]])
        step = max(1, min(512, _CELLS // max(1, len(self.lengths))))
        for low in range(0, len(live), step):
            w = live[low : low + step]
            at = starts[w][:, None] + np.arange(2 * BLOCK)
            terms = np.where(at < stop[low : low + step][:, None], found[np.minimum(at, len(found) - 1)], -1)
            products, norm = self._products(terms), np.sqrt(np.maximum(norms[w], 1e-9))[:, None]
            cosine = np.maximum(self.latent[terms].sum(1) @ self.queries, products) / norm
            # a copy lies in three windows that don't overlap at most, so one of them holds a third of the passage's square at least, which is more than COSINE of it
            for r, c in zip(*np.nonzero((cosine >= COSINE) | (products >= COSINE * self.lengths))):
                self._check(out[owner[w[r]]], int(self.owner[c]), float(cosine[r, c]), int(starts[w[r]]), int(begins[owner[w[r]]]), int(ends[owner[w[r]]]), found)
        return out

    def _check(self, of: dict, item: int, cosine: float, start: int, begin: int, end: int, found: np.ndarray) -> None:
        size, masks, tail, tail_masks = self.sequences[item]
        best = of.get(self.ids[item])
        if best is not None and best[1] == size and best[0] >= cosine:
            return  # already found as a whole
        reach = size + size // 2
        region = found[max(begin, start - reach) : min(end, start + 2 * BLOCK + reach)].tolist()
        got = common_length(region, masks, size)
        answer = common_length(region, tail_masks, tail)
        if got >= ALONE * size or (got >= WITH_ANSWER * size and answer >= ANSWER_SHARE * tail):
            if best is None or (got, cosine) > (best[1], best[0]):
                of[self.ids[item]] = (cosine, got, answer)


def _pairs(found: np.ndarray, starts: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Cells (term * size + term, the smaller one first) of all terms that meet in a passage, each as often as the product of both terms' numbers there."""
    hit = np.flatnonzero(found >= 0)
    cell, times = np.unique((np.searchsorted(starts, hit, side="right") - 1) * size + found[hit], return_counts=True)
    passage, term = np.divmod(cell, size)
    count = np.searchsorted(passage, passage, side="right") - np.arange(len(passage))  # itself and those behind it
    ends, low = np.cumsum(times * PASSAGE), 0
    while low < len(term):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _CELLS, side="right")))
        n = count[low:high]
        one = np.repeat(np.arange(low, high), n)
        other = one + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(term[one] * size + term[other], times[one] * times[other])
        low = high


class _Tally:
    """How often each cell was added, as sorted arrays."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.cells, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.n = 0

    def add(self, cells: np.ndarray) -> None:
        self.waiting.append(cells)
        self.n += len(cells)
        if self.n >= self.most:
            self.settle()

    def settle(self) -> None:
        new = np.sort(np.concatenate([np.zeros(0, np.int64), *self.waiting]))
        first = np.flatnonzero(np.diff(new, prepend=-1))
        both = np.concatenate([self.cells, new[first]])
        order = np.argsort(both, kind="stable")
        both, counts = both[order], np.concatenate([self.counts, np.diff(np.append(first, len(new)))])[order]
        first = np.flatnonzero(np.diff(both, prepend=-1))
        self.cells, self.counts = both[first], np.add.reduceat(counts, first) if len(first) else counts
        self.waiting, self.n = [], 0


def _packed(cells: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    return zlib.compress(np.diff(cells, prepend=0).astype(np.int32).tobytes(), 1), zlib.compress(counts.astype(np.int64).tobytes(), 1)


def _unpacked(cells: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(zlib.decompress(cells), np.int32), dtype=np.int64), np.frombuffer(zlib.decompress(counts), np.int64)


def _counted(docs: DataFrame, terms: Terms) -> tuple[DataFrame, int]:
    """Of all documents, a written table of slices, and the terms that a slice has: its cells (term - slice * terms a slice) * number of terms + term, and how often both terms meet in a passage.

    Both orders of a pair are there.  Slice -1 has the number of documents with each term and, after the last term, that of all documents.
    """
    shared, size = docs.sparkSession.sparkContext.broadcast(terms), len(terms.hashes)
    tall, most = max(1, _SLICE // max(1, size)), _PAIRS

    def sliced(tally: _Tally) -> pd.DataFrame:
        one, other = np.divmod(tally.cells, max(1, size))
        mirror = one != other
        cells = np.concatenate([tally.cells, (other * size + one)[mirror]])
        order = np.argsort(cells)
        cells, counts = cells[order], np.concatenate([tally.counts, tally.counts[mirror]])[order]
        numbers = np.unique(cells // (tall * size)) if size else cells
        bounds = np.searchsorted(cells, np.append(numbers, numbers[-1:] + 1) * tall * size)
        rows = [(int(k), *_packed(cells[low:high] - k * tall * size, counts[low:high])) for k, low, high in zip(numbers, bounds, bounds[1:])]
        return pd.DataFrame(rows, columns=["slice", "cells", "counts"]).astype({"slice": "int64"})

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, tally = np.zeros(size + 1, np.int64), _Tally(most)
        for frame in batches(frames):
            words, ends = word_hashes(frame["text"].tolist())
            found = shared.value.find(words)
            owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            pairs = np.unique(owner[found >= 0] * (size + 1) + found[found >= 0])
            total += np.bincount(pairs % (size + 1), minlength=size + 1)
            total[size] += len(frame)
            for cells in _pairs(found, _passages(words, ends)[0], size):
                tally.add(cells)
                if len(tally.cells) > most:
                    tally.settle()
                    yield sliced(tally)
                    tally = _Tally(most)
        tally.settle()
        yield sliced(tally)
        used = np.flatnonzero(total)
        yield pd.DataFrame([(-1, *_packed(used, total[used]))], columns=["slice", "cells", "counts"])

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(max(tall * size, size + 1), np.int64)
        for packed in zip(frame["cells"], frame["counts"]):
            cells, counts = _unpacked(*packed)
            total[cells] += counts
        used = np.flatnonzero(total)
        return pd.DataFrame([(frame["slice"].iloc[0], *_packed(used, total[used]))], columns=["slice", "cells", "counts"])

    schema = "slice long, cells binary, counts binary"
    leaves = docs.select("text").mapInPandas(count, schema).withColumn("branch", F.expr(f"spark_partition_id() div {_FAN}"))
    middle = leaves.groupBy("slice", "branch").applyInPandas(summed, schema)
    top = middle.groupBy("slice").applyInPandas(summed, schema).repartition(max(1, min(_PARTS, -(-size // tall))), "slice")
    return saved(top, "decontam-counts"), tall


def _fitted(docs: DataFrame, space: Space) -> Space:
    """Weights, and the latent space from the passages of the benchmark and of all documents."""
    spark = docs.sparkSession
    size = len(space.terms.hashes)
    counted, tall = _counted(docs, space.terms)
    counts: dict[int, int] = {}
    for r in counted.where("slice < 0").collect():
        counts = dict(zip(*(x.tolist() for x in _unpacked(r["cells"], r["counts"]))))
    n = counts.pop(size, 0)
    space.weigh(counts, n)
    pairs = counted.where("slice >= 0")
    weight, share = space.weight, min(1.0, WHOLE / max(1, n))
    basis = np.random.default_rng(SEED).normal(size=(size, min(RANK + EXTRA, max(1, size)))).astype(np.float32)

    def product(found: np.ndarray, starts: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Transposed TF-IDF matrix times TF-IDF matrix times q."""
        y = _rows(found, starts, weight, q)
        out = np.zeros((len(weight), q.shape[1]), np.float64)
        hit = np.flatnonzero(found >= 0)
        hit = hit[np.argsort(found[hit], kind="stable")]
        _add(out, found[hit], found[hit], weight, y, np.searchsorted(starts, hit, side="right") - 1)
        return out

    def times(basis: np.ndarray) -> np.ndarray:
        """The passages' product matrix times basis, summed over the benchmark and the documents."""
        shared = spark.sparkContext.broadcast(basis * weight[:, None])

        def multiplied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for k, *packed in frame.itertuples(index=False, name=None):
                    cells, counts = _unpacked(*packed)
                    row, term = np.divmod(cells, size)
                    used, at = np.unique(term, return_inverse=True)
                    table = np.zeros((min(tall, size - k * tall), len(used)), np.float32)
                    table[row, at] = counts
                    yield pd.DataFrame({"low": [k * tall], "sums": [(table @ shared.value[used]).tobytes()]})

        got = EMPHASIS**2 * product(space.item_terms, space.starts, basis)
        # the shuffle lets the slices be multiplied side by side; the driver takes them one after another
        for r in pairs.mapInPandas(multiplied, "low long, sums binary").repartition(4, "low").toLocalIterator():
            sums = np.frombuffer(r["sums"], np.float32).reshape(-1, basis.shape[1])
            part = slice(r["low"], r["low"] + len(sums))
            got[part] += share * weight[part, None] * sums
        shared.unpersist()
        return got

    for _ in range(POWERS):
        basis = np.linalg.qr(times(basis))[0].astype(np.float32)
    space.singular, basis = ritz(basis, times(basis))
    space.settle(basis)
    return space


def ritz(basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From an orthonormal basis and the passages' product matrix times it: the RANK largest singular values and their right singular vectors."""
    small = basis.T.astype(float) @ product
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-values)[:RANK]
    return np.sqrt(np.maximum(values[top], 0)), (basis @ vectors[:, top]).astype(np.float32)


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document and item found in it: doc_id, the columns in keep (text columns), item_id, cosine (of the best window), lcs (words in common order), item_words, answer_words.

    Clean documents have no row.  Null or empty texts, on either side, match nothing; an empty benchmark gives no rows; repeated rows of docs give repeated rows; items that repeat
    are each named.  All texts are read whole.  Items are matched in blocks of ITEMS, so what is broadcast is bounded.  Other columns aren't read.
    """
    spark = docs.sparkSession
    schema = "doc_id string, " + "".join(f"`{c}` string, " for c in keep) + "item_id long, cosine double, lcs int, item_words int, answer_words int"
    items = benchmark.where("text is not null and item_id is not null").select("item_id", "text").orderBy("item_id", "text")
    out = None
    block: list[tuple[int, str]] = []

    def scan(some: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(_fitted(docs, Space(some)))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            space = shared.value
            size = dict(zip(space.ids, np.diff(space.ends, prepend=0).tolist()))
            for frame in batches(frames):
                names = frame[["doc_id", *keep]].itertuples(index=False, name=None)
                rows = [(*d, i, c, n, size[i], a) for d, m in zip(names, space.matches(frame["text"].tolist())) for i, (c, n, a) in m.items()]
                yield pd.DataFrame(rows, columns=["doc_id", *keep, "item_id", "cosine", "lcs", "item_words", "answer_words"]).astype({"item_id": "int64"})

        return docs.select(id_text(), *keep, "text").mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))

    held = 0
    for r in items.toLocalIterator():
        n = len(r["text"].split())
        if block and n and (len(block) == ITEMS or held + n > ITEM_WORDS):
            out, block, held = scan(block) if out is None else out.unionByName(scan(block)), [], 0
        if n:
            block.append((r["item_id"], r["text"]))
            held += n
    if block or out is None:
        last = scan(block) if block else spark.createDataFrame([], schema.replace("doc_id string", "doc_id long"))
        out = last if out is None else out.unionByName(last)
    return out
