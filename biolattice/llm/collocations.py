"""Collocations: phrases of two to four words scored against the counts of their parts, by weighted acyclic automata.

An automaton here has words as labels and a phrase's count as the weight of the arc that ends it; arcs are laid out by level (the phrase's length), in order of source and label, and states
without arcs out are one and the same.  Each shard of the corpus builds one from its sorted phrases, level upon level.  Shards' automata are cut at common phrases into prefix ranges;
each range unites its pieces and adds up weights, keeping the phrases that are frequent enough.  The parts of candidates are then looked up by composing, range by range, the automaton
of the wanted parts with that of the counts.

A phrase is as rare as its rarest part at least, so shards leave out phrases of which a word or a pair of words is too rare.  A table of fixed size (`CELLS` hashed counters, summed over
the corpus beforehand) gives upper bounds of those counts: what it leaves out is rare for certain, and what it lets through is counted exactly.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, saved
from .walk import batches
from .words import mixed

#: Fewest occurrences of a candidate, words of the longest, rows returned for a language.
LEAST, LONGEST, TOP = 30, 4, 2000
#: A candidate goes if a longer one around it has this many per cent of its occurrences; factor of a score.
COVERED, SCALE = 80, 2_000_000
#: Hashed counters of the table of upper bounds, counters of a slice; words of a shard; arcs (before union) of a prefix range; phrases that a shard names for the ranges' bounds.
CELLS, SLICE, SHARD_WORDS, RANGE_ARCS, SAMPLES = 1 << 24, 1 << 20, 2_000_000, 1 << 20, 256
#: Sampled phrases that bounds are chosen from, at most (about); parts of a language that are ranked on their own first.
MOST_SAMPLES, RANKED = 200_000, 32

_FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\n\v\f\r", bytes(range(97, 123)) + b" " + b"\n" * 10)
_BREAK, _NOTHING = -1, -2
_I = np.int64


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 2
        return n


class Shard:
    """The words of some documents of one language as numbers, with breaks between pieces."""

    def __init__(self):
        self.numbers = _Numbers({b"": _NOTHING, b"\n": _BREAK})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: Iterable[str]) -> None:
        tokens = ("\n".join([*texts, ""])).encode("utf-8", "replace").translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
        numbers = np.fromiter(map(self.numbers.__getitem__, tokens), _I, len(tokens))
        self.parts.append(numbers[numbers != _NOTHING])
        self.size += int((self.parts[-1] >= 0).sum())

    def words(self) -> list[bytes]:
        return [w for w, n in self.numbers.items() if n >= 0]

    def sequence(self) -> np.ndarray:
        return np.concatenate([*self.parts, np.array([_BREAK], _I)])


def shards(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Shard]]:
    """Shards of about SHARD_WORDS words each over all languages of a task's rows."""
    open_: dict[str, Shard] = {}
    for frame in batches(frames):
        for lang, texts in frame.groupby("lang", sort=False)["text"]:
            open_.setdefault(lang, Shard()).add(texts.tolist())
        if sum(s.size for s in open_.values()) >= SHARD_WORDS:
            yield from open_.items()
            open_ = {}
    yield from open_.items()


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _cells(one: np.ndarray, two: np.ndarray | None = None) -> np.ndarray:
    value = one if two is None else mixed(one) * np.uint64(3) + two
    return (mixed(value) & np.uint64(CELLS - 1)).astype(_I)


def _pairs(s: np.ndarray) -> np.ndarray:
    """Places of s where two words of a piece follow each other."""
    return np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))


def upper_bounds(docs: DataFrame) -> np.ndarray:
    """The table of counters over all words and pairs of words, each counter at most LEAST."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(CELLS, np.uint8)

        def add(cells: np.ndarray, counts: np.ndarray) -> None:
            at, inverse = np.unique(cells, return_inverse=True)
            more = np.bincount(inverse, counts, len(at)).astype(_I)
            table[at] = np.minimum(LEAST, table[at] + more)

        for lang, shard in shards(frames):
            s, h = shard.sequence(), _word_hashes(lang, shard.words())
            if len(h):
                add(_cells(h), np.bincount(s[s >= 0], minlength=len(h)))
                at = _pairs(s)
                add(_cells(h[s[at]], h[s[at + 1]]), np.ones(len(at)))
        slices = [(k, table[k * SLICE : (k + 1) * SLICE]) for k in range(CELLS // SLICE)]
        slices = [(k, x) for k, x in slices if x.any()]
        yield pd.DataFrame({"slice": [k for k, _ in slices], "cells": [zlib.compress(x.tobytes(), 1) for _, x in slices]})

    def summed(packed: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, np.uint16)
        for x in packed["cells"]:
            total = np.minimum(LEAST, total + np.frombuffer(zlib.decompress(x), np.uint8))
        return pd.DataFrame({"slice": [int(packed["slice"].iloc[0])], "cells": [zlib.compress(total.astype(np.uint8).tobytes(), 1)]})

    table = np.zeros(CELLS, np.uint8)
    for row in docs.mapInPandas(run, "slice long, cells binary").groupBy("slice").applyInPandas(summed, "slice long, cells binary").collect():
        table[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(zlib.decompress(row["cells"]), np.uint8)
    return table


def _packed(a: np.ndarray) -> bytes:
    """The array of whole numbers from 0, in as many bytes each as the largest needs."""
    kind = next(k for k, t in enumerate((np.uint8, np.uint16, np.uint32, np.uint64)) if not len(a) or int(a.max()) <= np.iinfo(t).max)
    return bytes([kind]) + len(a).to_bytes(8, "little") + a.astype((np.uint8, np.uint16, np.uint32, np.uint64)[kind]).tobytes()


def _texts(values: Iterable[str]) -> pd.Series:
    return pd.Series(list(values), dtype=object)


class Automaton:
    """Sorted words; for each level the arcs' source (an arc of the level before), label (a word's number) and weight, in order; how many arcs at a level's front are only context.

    Context arcs lie before the range's lower bound: they are that bound's own prefixes, whose weights the range needs for the phrases that start with them.
    """

    def __init__(self, words: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], skip: list[int] | None = None):
        self.words, self.levels = words, levels
        self.skip = skip or [0] * LONGEST

    @property
    def arcs(self) -> int:
        return sum(len(label) for _, label, _ in self.levels)

    @classmethod
    def of_shard(cls, lang: str, shard: Shard, bounds: np.ndarray) -> Automaton:
        """All phrases of the shard whose words and pairs can be frequent."""
        s, words = shard.sequence(), shard.words()
        h = _word_hashes(lang, words)
        keep = bounds[_cells(h)] >= LEAST
        order = sorted(np.flatnonzero(keep).tolist(), key=words.__getitem__)
        rank = np.full(len(words) + 1, -1, _I)  # breaks, -1, have the last place
        rank[order] = np.arange(len(order))
        r = rank[s]
        levels = []
        ok = r >= 0
        pair = np.zeros(len(s), bool)
        at = np.flatnonzero(ok[:-1] & ok[1:])
        pair[at] = bounds[_cells(h[s[at]], h[s[at + 1]])] >= LEAST
        source, n = np.zeros(len(s), _I), len(order)
        for k in range(LONGEST):
            if k:
                ok = ok[:-1] & pair[k - 1 : len(s) - 1]
            at = np.flatnonzero(ok)
            keys, arc, weight = np.unique(source[at] * (n + 1) + r[at + k], return_inverse=True, return_counts=True)
            levels.append((keys // (n + 1), keys % (n + 1), weight.astype(_I)))
            source[at] = arc
        return cls([words[i] for i in order], levels)

    @classmethod
    def of_phrases(cls, phrases: list[tuple[bytes, ...]], weights: np.ndarray) -> Automaton:
        """Of distinct phrases; arcs that end none weigh 0."""
        words = sorted({w for p in phrases for w in p})
        number = {w: i for i, w in enumerate(words)}
        table = np.full((len(phrases), LONGEST), -1, _I)
        for i, p in enumerate(phrases):
            table[i, : len(p)] = [number[w] for w in p]
        size = (table >= 0).sum(axis=1)
        levels, source, n = [], np.zeros(len(phrases), _I), len(words)
        for k in range(LONGEST):
            at = np.flatnonzero(size > k)
            keys, arc = np.unique(source[at] * (n + 1) + table[at, k], return_inverse=True)
            weight = np.zeros(len(keys), _I)
            ends = size[at] == k + 1
            weight[arc[ends]] = weights[at[ends]]
            levels.append((keys // (n + 1), keys % (n + 1), weight))
            source[at] = arc
        return cls(words, levels)

    def pack(self) -> bytes:
        raw = b" ".join(self.words)
        arrays = [np.array(self.skip, _I)] + [x for source, label, weight in self.levels for x in (np.diff(source, prepend=0), label, weight)]
        return zlib.compress(len(raw).to_bytes(8, "little") + raw + b"".join(map(_packed, arrays)), 1)

    @classmethod
    def unpack(cls, blob: bytes) -> Automaton:
        data = zlib.decompress(blob)
        at = 8 + int.from_bytes(data[:8], "little")
        words, arrays = data[8:at].split(b" ") if at > 8 else [], []
        while at < len(data):
            kind, n = (np.uint8, np.uint16, np.uint32, np.uint64)[data[at]], int.from_bytes(data[at + 1 : at + 9], "little")
            arrays.append(np.frombuffer(data, kind, n, at + 9).astype(_I))
            at += 9 + n * np.dtype(kind).itemsize
        return cls(words, [(np.cumsum(arrays[i]), arrays[i + 1], arrays[i + 2]) for i in range(1, len(arrays), 3)], arrays[0].tolist())

    def table(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Labels and weights along the paths to the arcs `at` of a level: a row for each arc, a column for each level up to it."""
        labels, weights = np.empty((len(at), level + 1), _I), np.empty((len(at), level + 1), _I)
        for k in range(level, -1, -1):
            source, label, weight = self.levels[k]
            labels[:, k], weights[:, k] = label[at], weight[at]
            at = source[at]
        return labels, weights

    def phrases(self, level: int, at: np.ndarray) -> list[tuple[bytes, ...]]:
        return [tuple(self.words[i] for i in row) for row in self.table(level, at)[0].tolist()]

    def samples(self) -> list[tuple[bytes, ...]]:
        """Phrases at even distances over all levels."""
        step = max(1, -(-self.arcs // SAMPLES))
        return [p for k in range(LONGEST) for p in self.phrases(k, np.arange(step // 2, len(self.levels[k][1]), step))]

    def places(self, bound: tuple[bytes, ...]) -> tuple[list[int], list[bool]]:
        """For each level how many arcs end phrases before the bound, and whether the last of those is a prefix of the bound."""
        cuts, inside = [], []
        low, high, whole = 0, len(self.levels[0][1]), True  # arcs from the path's state; whole: the path so far is the bound's own
        for k in range(LONGEST):
            source, label, _ = self.levels[k]
            if k:
                low, high = (int(x) for x in np.searchsorted(source, [low, high]))
            if whole and k < len(bound):
                word = bisect.bisect_left(self.words, bound[k])
                found = word < len(self.words) and self.words[word] == bound[k]
                at = low + int(np.searchsorted(label[low:high], word))
                whole = found and at < high and int(label[at]) == word
                prefix = whole and k + 1 < len(bound)
                cuts.append(at + prefix)
                inside.append(prefix)
                low, high = (at, at + 1) if whole else (at, at)
            else:
                cuts.append(low)
                inside.append(False)
                low, high = low, low
                whole = False
        return cuts, inside

    def piece(self, low: list[int], context: list[bool], high: list[int]) -> Automaton:
        """The arcs between two cuts, and the lower bound's prefixes as context."""
        start = [a - c for a, c in zip(low, context)]
        used = np.unique(np.concatenate([label[a:b] for (_, label, _), a, b in zip(self.levels, start, high)]))
        levels = []
        for k, (source, label, weight) in enumerate(self.levels):
            part = slice(start[k], high[k])
            levels.append((source[part] - (start[k - 1] if k else 0), np.searchsorted(used, label[part]), weight[part]))
        return Automaton([self.words[i] for i in used.tolist()], levels, [int(c) for c in context])

    @classmethod
    def union(cls, parts: list[Automaton]) -> Automaton:
        """All arcs of the parts, weights of equal ones added up."""
        words = sorted({w for p in parts for w in p.words})
        number = {w: i for i, w in enumerate(words)}
        names = [np.array([number[w] for w in p.words], _I) for p in parts]
        levels, n = [], len(words)
        arc_of = [np.zeros(1, _I) for _ in parts]
        for k in range(LONGEST):
            keys = [arc_of[i][p.levels[k][0]] * (n + 1) + names[i][p.levels[k][1]] for i, p in enumerate(parts)]
            found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            weight = np.zeros(len(found), _I)
            np.add.at(weight, inverse, np.concatenate([p.levels[k][2] for p in parts]))
            levels.append((found // (n + 1), found % (n + 1), weight))
            arc_of = np.split(inverse, np.cumsum([len(x) for x in keys])[:-1])
        return cls(words, levels, [max(p.skip[k] for p in parts) for k in range(LONGEST)])

    def frequent(self) -> Automaton:
        """The arcs of weight LEAST and more; a prefix weighs no less than what it starts."""
        levels, skip, new = [], [], np.zeros(1, _I)
        for k, (source, label, weight) in enumerate(self.levels):
            keep = weight >= LEAST
            levels.append((new[source[keep]], label[keep], weight[keep]))
            skip.append(int(keep[: self.skip[k]].sum()))
            new = np.cumsum(keep) - 1
        used = np.unique(np.concatenate([label for _, label, _ in levels]))
        return Automaton([self.words[i] for i in used.tolist()], [(s, np.searchsorted(used, label), w) for s, label, w in levels], skip)

    def compose(self, wanted: Automaton) -> list[np.ndarray]:
        """For each level the weights here of the other's arcs (0 where there is none): both are walked together, level by level."""
        number = {w: i for i, w in enumerate(self.words)}
        names = np.array([number.get(w, -1) for w in wanted.words], _I)
        out, arc, n = [], np.zeros(1, _I), len(self.words)
        for (source, label, weight), (w_source, w_label, _) in zip(self.levels, wanted.levels):
            here = source * (n + 1) + label
            mine, name = arc[w_source], names[w_label]
            sought = mine * (n + 1) + name
            at = np.minimum(np.searchsorted(here, sought), max(0, len(here) - 1))
            hit = (mine >= 0) & (name >= 0) & (here[at] == sought) if len(here) else np.zeros(len(sought), bool)
            out.append(np.where(hit, weight[at], 0) if len(here) else np.zeros(len(sought), _I))
            arc = np.where(hit, at, -1)
        return out


def _shard_automata(docs: DataFrame, bounds: np.ndarray) -> DataFrame:
    """A row for each shard and language: lang, words in all, arcs, the packed automaton and its samples."""
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, shard in shards(frames):
            built = Automaton.of_shard(lang, shard, shared.value)
            yield pd.DataFrame(
                {"lang": [lang], "words": [shard.size], "arcs": [built.arcs], "automaton": [built.pack()], "samples": [[b" ".join(p) for p in built.samples()]]}
            )

    return saved(docs.mapInPandas(run, "lang string, words long, arcs long, automaton binary, samples array<binary>"), "collocation-shards")


def range_bounds(built: DataFrame) -> dict[str, list[tuple[bytes, ...]]]:
    """The lower bounds of each language's prefix ranges but the first: quantiles of the shards' samples, so that a range has about RANGE_ARCS arcs."""
    sizes = built.groupBy("lang").agg(F.sum("arcs").alias("arcs"), F.sum(F.size("samples")).alias("n")).where(F.col("arcs") > RANGE_ARCS).collect()
    total, out = sum(r["n"] for r in sizes), {}
    if not total:
        return out
    rows = built.join(F.broadcast(built.sparkSession.createDataFrame([(r["lang"],) for r in sizes], "lang string")), "lang", "left_semi")
    named = rows.select("lang", F.explode("samples").alias("phrase"))
    chosen = named.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, MOST_SAMPLES / total)) + 1)
    found: dict[str, list[tuple[bytes, ...]]] = {}
    for row in chosen.groupBy("lang", "phrase").count().collect():
        found.setdefault(row["lang"], []).extend([tuple(bytes(row["phrase"]).split(b" "))] * row["count"])
    for r in sizes:
        phrases = sorted(found.get(r["lang"], []))
        n = -(-r["arcs"] // RANGE_ARCS)
        out[r["lang"]] = sorted({phrases[len(phrases) * k // n] for k in range(1, n)}) if phrases else []
    return out


def counted(docs: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, list[tuple[bytes, ...]]]]:
    """The frequent phrases as automata (range, lang, automaton), every language's words (lang, n), and the ranges' bounds."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    built = _shard_automata(rows, upper_bounds(rows))
    cuts = range_bounds(built)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, blob in zip(frame["lang"], frame["automaton"]):
                one = Automaton.unpack(blob)
                ends = [len(label) for _, label, _ in one.levels]
                places = [([0] * LONGEST, [False] * LONGEST), *(one.places(b) for b in cuts.get(lang, []))]
                found = []
                for k, (low, context) in enumerate(places):
                    high = places[k + 1][0] if k + 1 < len(places) else ends
                    piece = one.piece(low, context, high)
                    if piece.arcs:
                        found.append((k, piece.pack()))
                yield pd.DataFrame({"range": [k for k, _ in found], "lang": lang, "automaton": [x for _, x in found]})

    def united(packed: pd.DataFrame) -> pd.DataFrame:
        whole = Automaton.union([Automaton.unpack(x) for x in packed["automaton"]]).frequent()
        return pd.DataFrame({"range": packed["range"].iloc[:1], "lang": packed["lang"].iloc[:1], "automaton": [whole.pack()]})

    pieces = built.select("lang", "automaton").mapInPandas(cut, "range long, lang string, automaton binary")
    counts = saved(pieces.groupBy("range", "lang").applyInPandas(united, "range long, lang string, automaton binary"), "collocation-counts")
    totals = saved(built.groupBy("lang").agg(F.sum("words").alias("n")), "collocation-words")
    drop(built)
    return counts, totals, cuts


def candidates(counts: DataFrame) -> DataFrame:
    """The phrases of two words and more: lang, words, a (their count) and l, the counts of their first one to three words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, blob in zip(frame["lang"], frame["automaton"]):
                one = Automaton.unpack(blob)
                for k in range(1, LONGEST):
                    at = np.arange(one.skip[k], len(one.levels[k][1]))
                    if not len(at):
                        continue
                    labels, weights = one.table(k, at)
                    words = [[one.words[i].decode() for i in row] for row in labels.tolist()]
                    yield pd.DataFrame({"lang": lang, "words": words, "a": weights[:, k], "l": list(weights[:, :k])})

    return counts.mapInPandas(run, "lang string, words array<string>, a long, l array<long>")


def part_counts(wanted: DataFrame, counts: DataFrame, cuts: dict[str, list[tuple[bytes, ...]]]) -> DataFrame:
    """The counts of distinct phrases (lang, part): each goes to the range that it lies in, where the wanted ones' automaton is composed with that of the counts."""

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = [bisect.bisect_right(cuts.get(lang, []), tuple(part.encode().split(b" "))) for lang, part in zip(frame["lang"], frame["part"])]
            yield pd.DataFrame({"lang": _texts(frame["lang"]), "part": _texts(frame["part"]), "range": at})

    def looked_up(rows: pd.DataFrame) -> pd.DataFrame:
        parts, packed = rows["part"].dropna().tolist(), rows["automaton"].dropna().tolist()
        if not parts or not packed:
            return pd.DataFrame({"lang": _texts([]), "part": _texts([]), "r": np.zeros(0, _I)})
        asked = Automaton.of_phrases([tuple(p.encode().split(b" ")) for p in parts], np.ones(len(parts), _I))
        found = []
        for k, weights in enumerate(Automaton.unpack(packed[0]).compose(asked)):
            at = np.flatnonzero((asked.levels[k][2] > 0) & (weights > 0))
            found += zip((b" ".join(p).decode() for p in asked.phrases(k, at)), weights[at].tolist())
        return pd.DataFrame({"lang": _texts([rows["lang"].iloc[0]] * len(found)), "part": _texts(p for p, _ in found), "r": np.array([r for _, r in found], _I)})

    asked = wanted.mapInPandas(placed, "lang string, part string, range long")
    both = asked.unionByName(counts, allowMissingColumns=True)
    return both.groupBy("range", "lang").applyInPandas(looked_up, "lang string, part string, r long")


def collocations(docs: DataFrame) -> DataFrame:
    """Each language's TOP phrases by score: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty and have no words, a null lang is `und`; repeated rows count each; without a frequent phrase there is no row.  Other columns aren't read.
    """
    counts, totals, cuts = counted(docs)
    found = saved(candidates(counts).withColumn("phrase", F.array_join("words", " ")), "collocation-candidates")
    # every contiguous part of two words and more of a longer candidate, with the largest count of a candidate around it
    inside = F.expr(
        "flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), i -> array_join(slice(words, i, n), ' '))))"
    )
    around = found.where(F.size("words") > 2).select("lang", "a", F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = found.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * COVERED)
    )
    cut = kept.select("lang", "phrase", "a", F.posexplode("l").alias("k", "l"), "words").withColumn(
        "part", F.expr("array_join(slice(words, k + 2, size(words)), ' ')")
    )
    cut = saved(cut.drop("words"), "collocation-cuts")
    parts = part_counts(cut.select("lang", "part").distinct(), counts, cuts)
    score = F.expr(f"cast(cast(a as decimal(20,0)) * {SCALE} div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    worst = F.min(F.struct("score", "k", "l", "r"))
    scored = cut.join(parts, ["lang", "part"]).withColumn("score", score).groupBy("lang", "phrase", "a").agg(worst.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    scored = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(RANKED)))
    # a language's best stand among the best of its parts, so no task ranks all of a language
    place = "row_number() over (partition by {} order by score desc, a desc, phrase)"
    best = scored.withColumn("place", F.expr(place.format("lang, salt"))).where(F.col("place") <= TOP).drop("place", "salt")
    best = best.withColumn("rank", F.expr(place.format("lang")).cast("long")).where(F.col("rank") <= TOP)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same by self-joins of counted phrases.
SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
listed AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces),
placed AS (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM listed, (SELECT unnest(range(1, {LONGEST} + 1)) AS k) WHERE len(words) >= k),
f AS (SELECT lang, words[i : i + k - 1] AS words, k, count(*) AS f FROM placed GROUP BY ALL),
c AS (SELECT lang, words, k AS size, f AS a FROM f WHERE k > 1 AND f >= {LEAST}),
around AS (
  SELECT lang, words[i : i + n - 1] AS words, max(a) AS longer
  FROM (SELECT lang, words, a, n, unnest(range(1, size - n + 2)) AS i FROM c, (SELECT unnest(range(2, {LONGEST})) AS n) WHERE n < size) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN around USING (lang, words) WHERE longer IS NULL OR 100::HUGEINT * longer < {COVERED}::HUGEINT * a),
cut AS (SELECT lang, words, size, a, unnest(range(1, size)) AS cut FROM kept),
scored AS (
  SELECT cut.lang, cut.words, cut.a, cut.cut, one.f AS l, two.f AS r, ({SCALE}::HUGEINT * cut.a) // (one.f + two.f) AS score
  FROM cut JOIN f one ON one.lang = cut.lang AND one.words = cut.words[1 : cut.cut]
  JOIN f two ON two.lang = cut.lang AND two.words = cut.words[cut.cut + 1 : cut.size]),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(words, ' '))) AS rank,
       array_to_string(words, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
FROM worst JOIN n USING (lang) QUALIFY rank <= {TOP}
"""
