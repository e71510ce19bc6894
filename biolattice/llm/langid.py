"""Language identification by cross-parsing entropy.

A suffix automaton of each language's sample finds the longest matches of a text with the sample; the text is parsed into such phrases, and
the language that needs fewest of them, normalised by the sample's length, wins.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, remainder, saved
from .walk import active, batches, pieces

#: Sample of each language: documents, and symbols of each. Languages whose automata a worker holds at a time; more are parsed in passes over the documents.
DOCS, SYMBOLS, LANGS = 48, 512, 32
#: Symbols: 0 is whatever isn't a letter, 1 a letter that no sample has; each learnt letter has one of its own. Transitions on symbols from ALPHABET on are sparse.
#: Texts are parsed in pieces of PIECE symbols at once and then joined; states are kept every CHECK symbols.
ALPHABET, PIECE, CHECK = 64, 512, 32
#: Pieces and languages that are finished one by one.
FEW = 400

_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])


def symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts as symbols, each text's non-letters collapsed to one 0; and where each text ends. table: symbol by code point."""
    low = [t.lower() for t in texts]
    points = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "replace"), np.uint32)
    out = table[points]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    ends = np.cumsum([len(t) + 1 for t in low]) - 1
    keep[ends] = True  # a separator of its own, which no text has
    keep[ends[:-1] + 1] = True  # and after it the text's first symbol, whatever it is
    return out[keep], np.cumsum(keep)[ends] - 1


def suffix_automaton(s: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton whose paths from state 0 are the substrings of s."""
    go, link, size, last = [{}], [-1], [0], 0
    for c in s:
        cur = len(go)
        go.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go


class Parser:
    """Cross-parses texts with every language's automaton in lockstep."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        seen = Counter(c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha())
        self.table = _LETTER.astype(np.int32)
        for k, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))):
            self.table[ord(c)] = k + 2
        self.letters = len(seen) + 2
        sparse: list[tuple[int, int]] = []
        cut = []
        for lang in self.langs:
            codes, ends = symbols(samples[lang], self.table)
            cut.append(np.concatenate([np.append(codes[low : min(high, low + SYMBOLS)], 0) for low, high in zip([0, *(ends[:-1] + 1)], ends)]))
        # an automaton has at most twice as many states as symbols
        table, self.roots, self.bits, base = np.empty((sum(2 * len(c) for c in cut), ALPHABET), np.int32), [], [], 0
        for codes in cut:
            go = suffix_automaton(codes.tolist())
            # next state times four, plus the phrases that this symbol completes: the one before it, and itself if the sample lacks it
            step = table[base : base + len(go)]
            step[:] = [(base + go[0][c]) * 4 + 1 if c in go[0] else base * 4 + 2 for c in range(ALPHABET)]
            step[0] = base * 4 + 1
            for state, to in enumerate(go):
                for c, t in to.items():
                    if c < ALPHABET:
                        step[state, c] = (base + t) * 4
                    else:
                        sparse.append(((base + state) * self.letters + c, base + t))
            self.roots.append(base)
            self.bits.append(math.log2(len(codes) + 1))
            base += len(go)
        self.step = table[:base].ravel()
        self.quick = memoryview(self.step)
        self.keys, self.to = np.array(sorted(sparse), np.int64).reshape(-1, 2).T.copy()

    def _sparse(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Steps, as in self.step, of states (languages x texts) on symbols from ALPHABET on."""

        def find(key: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return np.where(self.keys[at] == key, self.to[at], -1)

        roots = np.array(self.roots, np.int64)[:, None]
        on, anew = find(state * self.letters + codes), find(roots * self.letters + codes)
        return np.where(on >= 0, on * 4, np.where(anew >= 0, anew * 4 + 1, roots * 4 + 2 - (state == roots)))

    def _steps(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Next states times four, plus the phrases completed, of states (languages x texts)."""
        rare = np.flatnonzero(codes >= ALPHABET)
        got = self.step.take(state * ALPHABET + np.minimum(codes, ALPHABET - 1))
        if len(rare):
            got[:, rare] = self._sparse(state[:, rare], codes[rare])
        return got

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: phrases by language, symbols, and whether it has a letter.

        All pieces are parsed at once, each as if a phrase began with it.  Then each is parsed again from the state in which the one before it ends, until the two parses are in the
        same state; from there on they agree.  So the counts are those of the whole text.
        """
        codes, ends = symbols(texts, self.table)
        starts = np.concatenate([[0], ends[:-1] + 1])
        letters = np.add.reduceat(codes != 0, starts)
        owner, start, size = pieces(starts, ends, PIECE)
        roots = np.array(self.roots, np.int64)[:, None]
        state = np.repeat(roots, len(owner), 1)
        count = np.zeros(state.shape, np.int64)
        kept = []  # (states, counts) after every CHECK symbols
        for t in range(int(size.max(initial=0))):
            n = active(size, t)
            got = self._steps(state[:, :n], codes[start[:n] + t])
            state[:, :n] = got >> 2
            count[:, :n] += got & 3
            if t % CHECK == CHECK - 1:
                kept.append((state[:, :n].astype(np.int32), count[:, :n].astype(np.int16)))
        order = np.lexsort((start, owner))
        self._join(codes, owner, start, size, order, state, count, kept)
        total = np.array([np.bincount(owner, row, len(texts)) for row in count]).reshape(len(self.langs), len(texts))
        ending = order[np.append(owner[order][1:] != owner[order][:-1], True)] if len(order) else order
        total[:, owner[ending]] += state[:, ending] != roots  # a last phrase that the text's end completes
        return total, ends - starts, letters > 0

    def _join(self, codes: np.ndarray, owner: np.ndarray, start: np.ndarray, size: np.ndarray, order: np.ndarray, state: np.ndarray, count: np.ndarray, kept: list) -> None:
        """Corrects the pieces' end states and counts for the states that the pieces before them end in."""
        before, after = np.full(len(owner), -1), np.full(len(owner), -1)
        inner = np.flatnonzero(owner[order][1:] == owner[order][:-1])
        before[order[inner + 1]], after[order[inner]] = order[inner], order[inner + 1]
        alone_state, alone_count = state.copy(), count.copy()
        todo = np.sort(np.flatnonzero(before >= 0))  # the longest first
        while len(todo):
            now = state[:, before[todo]]
            made, synced = np.zeros(now.shape, np.int64), np.zeros(now.shape, bool)
            for t in range(int(size[todo[0]])):
                live = np.flatnonzero((size[todo] > t) & ~synced.all(0))
                if not len(live):
                    break
                got = self._steps(now[:, live], codes[start[todo[live]] + t])
                open_ = ~synced[:, live]
                now[:, live] = np.where(open_, got >> 2, now[:, live])
                made[:, live] += (got & 3) * open_
                if t % CHECK == CHECK - 1:
                    states, counts = (x[:, todo[live]] for x in kept[t // CHECK])
                    same = open_ & (now[:, live] == states)
                    made[:, live] += np.where(same, alone_count[:, todo[live]] - counts, 0)
                    now[:, live] = np.where(same, alone_state[:, todo[live]], now[:, live])
                    synced[:, live] |= same
                    cells = np.argwhere(~synced[:, live] & (size[todo[live]] > t + 1))
                    if len(cells) <= FEW and not len(self.keys):
                        for lang, k in cells.tolist():
                            now[lang, live[k]], made[lang, live[k]] = self._walk(
                                codes[start[todo[live[k]]] :][: size[todo[live[k]]]].tolist(), t + 1, int(now[lang, live[k]]), int(made[lang, live[k]]),
                                [(a[lang, todo[live[k]]], b[lang, todo[live[k]]]) for a, b in kept[: size[todo[live[k]]] // CHECK]], (int(alone_state[lang, todo[live[k]]]), int(alone_count[lang, todo[live[k]]])),
                            )
                        break
            changed = (state[:, todo] != now).any(0)
            state[:, todo], count[:, todo] = now, made
            todo = np.sort(after[todo[changed]])
            todo = todo[todo >= 0]

    def _walk(self, codes: list[int], t: int, state: int, made: int, kept: list, alone: tuple[int, int]) -> tuple[int, int]:
        """One piece and language to the end or to where both parses agree: the last few, which numpy would take one by one."""
        step = self.quick
        while t < len(codes):
            for c in codes[t : t + CHECK]:
                got = step[state * ALPHABET + c]
                state, made = got >> 2, made + (got & 3)
            t += CHECK
            if t <= len(codes) and state == kept[t // CHECK - 1][0]:
                return alone[0], made + alone[1] - int(kept[t // CHECK - 1][1])
        return state, made

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Entropy by language and text, and whether a text has a letter."""
        total, size, known = self.phrases(texts)
        return total * np.array(self.bits).reshape(-1, 1) / np.maximum(size, 1), known


def ranked(cost: np.ndarray, langs: list[str], frame: pd.DataFrame) -> pd.DataFrame:
    """_lang, _best, _second and _sum (of inverse entropies), as in frame from other languages and here from these."""
    best, second, lang = (frame[c].to_numpy() for c in ("_best", "_second", "_lang"))
    at = cost.argmin(0)
    low = cost[at, np.arange(cost.shape[1])]
    both = np.sort(np.vstack([cost, best, second]), 0)
    return pd.DataFrame({"_lang": np.where(low < best, np.array(langs, object)[at], lang), "_best": both[0], "_second": both[1], "_sum": frame["_sum"].to_numpy() + (1 / np.maximum(cost, 1e-9)).sum(0)})


_PARSERS: dict[str, Parser] = {}


def picked(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows to learn from with their hash and slot, of each language and slot the smallest hash, and the languages. The choice reads ids only."""
    h = F.xxhash64("doc_id")
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 4) != 2)).select(
        "lang", "text", h.alias("_h"), F.pmod(h, F.lit(DOCS)).alias("_slot")
    )
    picks = saved(rows.groupBy("lang", "_slot").agg(F.min("_h").alias("_h")), "langid-picks")
    return rows, picks, sorted(r["lang"] for r in picks.select("lang").distinct().collect())


def sampled(rows: DataFrame, picks: DataFrame, langs: list[str]) -> dict[str, list[str]]:
    """Texts to learn from, by language: a stretch of at most 2 * SYMBOLS code points of each picked document, at a place chosen by hash.

    The texts of the chosen few are fetched by a broadcast of at most LANGS * DOCS keys.
    """
    some = picks.where(F.col("lang").isin(langs))
    low = F.pmod(F.xxhash64("_h"), F.greatest(F.lit(1), F.length("text") - 2 * SYMBOLS + 1)).cast("int") + 1
    got = rows.join(F.broadcast(some), ["lang", "_slot", "_h"]).groupBy("lang", "_slot").agg(F.min(F.substr("text", low, F.lit(2 * SYMBOLS))).alias("text")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["_slot"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def identify(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, lead, and the columns named in keep.

    Null texts and texts without a letter are `und` with score and lead 0; so is everything if there is nothing to learn from.  The learnt sample is bounded
    (DOCS stretches of SYMBOLS symbols a language), whole texts are parsed.  score is the winner's share of the inverse entropies, lead the part by which its entropy is below
    the next language's.  Of languages that tie the first by code point is named.  More than LANGS languages take more than one pass, between which the rows are written.
    Repeated rows each get a row; columns not named aren't read.
    """
    spark = docs.sparkSession
    learnable, picks, langs = picked(docs)
    kinds = {f.name: f.dataType.simpleString() for f in docs.select(*keep).schema}
    whole = [c for c, k in kinds.items() if k in ("tinyint", "smallint", "int", "bigint")]
    text = "text" if "text" in keep else "_text"  # a kept text goes through Python once
    rows = docs.select(id_text(), (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), *[id_text(c) if c in whole else c for c in keep if c != text], F.col("text").alias(text), F.col("text").isNull().alias("_null"))
    far = F.lit(float("inf"))
    rows = rows.withColumns({"_known": F.lit(False), "_lang": F.lit("und"), "_best": far, "_second": far, "_sum": F.lit(0.0)})
    kept = "".join(f"`{c}` {'string' if c in whole else k}, " for c, k in kinds.items() if c != text)
    schema = f"doc_id string, held_out boolean, {kept}{text} string, _null boolean, _known boolean, _lang string, _best double, _second double, _sum double"

    def passed(rows: DataFrame, some: list[str], last: bool) -> DataFrame:
        samples, name = spark.sparkContext.broadcast(sampled(learnable, picks, some)), uuid.uuid4().hex

        def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if name not in _PARSERS:
                _PARSERS.clear()
                _PARSERS[name] = Parser(samples.value)
            parser = _PARSERS[name]
            for frame in batches(frames, text):
                cost, known = parser.costs(frame[text].tolist())
                frame = frame.assign(_known=known, **ranked(cost, parser.langs, frame).set_index(frame.index))
                yield frame.assign(_text=None) if last and text == "_text" else frame

        return rows.mapInPandas(parse, schema)

    blocks = [langs[k : k + LANGS] for k in range(0, len(langs), LANGS)]
    for k, some in enumerate(blocks):
        last = k == len(blocks) - 1
        rows = passed(rows, some, last)
        rows = rows if last else saved(rows, "langid-pass")
    one = F.lit(1.0)
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "held_out",
        *[F.col(c).cast(kinds[c]).alias(c) if c in whole else F.when(~F.col("_null"), F.col(c)).alias(c) if c == text else F.col(c) for c in keep],
        F.when(F.col("_known"), F.col("_lang")).otherwise("und").alias("lang_pred"),
        F.when(F.col("_known"), one / F.greatest(F.col("_best"), F.lit(1e-9)) / F.col("_sum")).otherwise(F.lit(0.0)).alias("score"),
        F.when(F.col("_known"), one - F.col("_best") / F.greatest(F.col("_second"), F.lit(1e-9))).otherwise(F.lit(0.0)).alias("lead"),
    )
