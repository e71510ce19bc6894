"""Cross-tokenizer alignment: token pairs that end at the same byte, counted over the corpus by a minimal perfect hash of the distinct pairs.

Each text is encoded once by both tokenizers and its token ids are written; every later pass aligns documents anew from their ids, which takes no more than sums of token lengths.
One pass finds the distinct pairs, on which a minimal perfect hash is built; one counts, each task in a dense vector indexed by the hash, and the vectors are summed in a tree by slice;
the last looks the counts up.  Keys are kept beside the counts, so that a foreign pair can't pass for a known one.

What is broadcast and gathered is bounded by the vocabularies, not by the corpus: two tokens that end together cover the same last bytes, so one is a suffix of the other, and there are at
most `possible_pairs` such pairs (some hundred thousands).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, saved
from .walk import batches
from .words import mixed

#: Where the public tokenizers' files are.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: How byte-level BPE splits text before its merges (fixed values).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space that the encoding by ranks, whose pattern matcher is recursive, can't take; texts with one go through the file's own tokenizer.
LONG_SPACE = re.compile(r"\s{500}")
#: Bits a key at each level of the hash; entries of a slice of the dense count vector; tasks whose vectors are summed at the tree's first level.
GAMMA, SLICE, FAN = 2, 1 << 16, 16
_EMPTY = np.zeros(0, np.int64)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: the byte's own where that is printable, else the next one from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class Tokenizers:
    """Both tokenizers of a folder, loaded once in each worker process; token strings as bytes."""

    _loaded: dict[str, Tokenizers] = {}

    def __init__(self, folder: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{folder}/{BYTE_BPE}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_BPE}")
        with open(f"{folder}/{BYTE_BPE}", encoding="utf-8") as f:
            whole = json.load(f)
        vocabulary = whole["model"]["vocab"] | {t["content"]: t["id"] for t in whole["added_tokens"]}
        byte = byte_alphabet()
        self.fast = self._ranked(whole, byte)
        size = max(self.a.get_vocab_size(), 1 + max(vocabulary.values()))
        self.a_bytes = [b""] * size
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.b.id_to_piece(k) for k in range(self.b.vocab_size()))
        ]
        self.a_size, self.b_size = np.array([len(t) for t in self.a_bytes]), np.array([len(t) for t in self.b_bytes])

    @staticmethod
    def _ranked(whole: dict, byte: dict[str, int]):
        """The same encoding by ranks, which takes a quarter of the time; None unless the file's merges are in the order of its ids and its pre-tokenizer is the plain byte-level one."""
        import tiktoken

        vocabulary, special = whole["model"]["vocab"], {t["content"] for t in whole["added_tokens"]}
        plain = {t: i for t, i in vocabulary.items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"]]
        ordered = all(plain.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)) and sorted(plain.values()) == list(range(256 + len(merges)))
        splits = whole["pre_tokenizer"] or {}
        if not ordered or whole["normalizer"] or splits.get("type") != "ByteLevel" or splits.get("add_prefix_space") or not splits.get("use_regex", True):
            return None
        ranks = {bytes(byte[c] for c in t): i for t, i in plain.items()}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, folder: str) -> Tokenizers:
        if folder not in cls._loaded:
            cls._loaded[folder] = cls(folder)
        return cls._loaded[folder]

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of space+text by the one and of text by the other (which adds the space); none where either's bytes differ from the text's."""
        first = [
            self.fast.encode_ordinary(" " + t) if self.fast and not LONG_SPACE.search(t) else self.a.encode(" " + t, add_special_tokens=False).ids for t in texts
        ]
        second = self.b.encode(texts, num_threads=1)
        for text, a, b in zip(texts, first, second):
            whole = (" " + text).encode("utf-8", "replace")
            same = text and b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
            yield (a, b) if same else ([], [])


def possible_pairs(first: list[bytes], second: list[bytes]) -> int:
    """How many pairs of tokens can end together, whatever the corpus: those of which one is a suffix of the other."""
    kinds_a, kinds_b = (pd.Series(t).value_counts().to_dict() for t in (first, second))
    total = sum(n * kinds_b.get(t[k:], 0) for t, n in kinds_a.items() for k in range(len(t) + 1))
    return total + sum(n * kinds_a.get(t[k:], 0) for t, n in kinds_b.items() for k in range(1, len(t) + 1))


def _width(vocabulary: np.ndarray) -> type:
    return np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32


class Alignment:
    """The links of a batch of documents, in order: the document, both ids; and each token's group."""

    def __init__(self, packed: pd.DataFrame, a_size: np.ndarray, b_size: np.ndarray):
        ids = [[np.frombuffer(zlib.decompress(x), _width(size)).astype(np.int64) for x in packed[c]] for c, size in (("a", a_size), ("b", b_size))]
        self.n_a, self.n_b = (np.array([len(x) for x in side]) for side in ids)
        self.a, self.b = (np.concatenate([*side, _EMPTY]) for side in ids)
        self.docs = len(packed)
        # both sides of a document have the same bytes, so the running sum goes on from document to document, one apart lest tokens without bytes meet those of another document
        end_a, end_b = (np.cumsum(size[x]) + np.repeat(np.arange(self.docs), n) for size, x, n in ((a_size, self.a, self.n_a), (b_size, self.b, self.n_b)))
        if not len(self.a):
            self.group_a = self.group_b = self.group_doc = self.link_a = self.link_b = self.link_doc = _EMPTY
            self.n_groups = np.zeros(self.docs, np.int64)
            return
        ends = np.zeros((2, int(end_a[-1]) + 1), bool)
        ends[0, end_a] = ends[1, end_b] = True
        last_a, last_b = ends[1][end_a], ends[0][end_b]  # tokens that end where one of the other side does
        # of tokens that end at one place only the first opens a group: one a side, or more where tokens have no bytes
        first_a, first_b = (last & np.append(True, end[1:] != end[:-1]) for last, end in ((last_a, end_a), (last_b, end_b)))
        self.group_a, self.group_b = (np.cumsum(first) - np.where(last, 1, 0) for first, last in ((first_a, last_a), (first_b, last_b)))
        self.group_doc = np.repeat(np.arange(self.docs), self.n_a)[first_a]
        self.n_groups = np.bincount(self.group_doc, minlength=self.docs)
        last_a, last_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        if len(last_a) == len(self.group_doc) == len(last_b):
            self.link_a, self.link_b, self.link_doc = self.a[last_a], self.b[last_b], self.group_doc
            return
        many_b = np.bincount(self.group_b[last_b], minlength=len(self.group_doc))
        repeat = many_b[self.group_a[last_a]]
        start_b = np.searchsorted(self.group_b[last_b], self.group_a[last_a])
        nth = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        self.link_a = np.repeat(self.a[last_a], repeat)
        self.link_b = self.b[last_b][np.repeat(start_b, repeat) + nth]
        self.link_doc = np.repeat(self.group_doc[self.group_a[last_a]], repeat)

    def keys(self) -> np.ndarray:
        return self.link_a << 32 | self.link_b

    def digests(self) -> list[str]:
        """The digest of each document's groups, written out as decimal ids; empty for documents without tokens."""
        n = len(self.a) + len(self.b)
        if not n:
            return [""] * self.docs
        ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        upto_a, upto_b = np.cumsum(np.bincount(self.group_a, minlength=len(self.group_doc))), np.cumsum(np.bincount(self.group_b, minlength=len(self.group_doc)))
        at_a = np.arange(len(self.a)) + np.concatenate([[0], upto_b])[self.group_a]
        at_b = np.arange(len(self.b)) + upto_a[self.group_b]
        ids[at_a], ids[at_b] = self.a, self.b
        mark[upto_a - 1 + np.concatenate([[0], upto_b[:-1]])] = ord("|")
        final = upto_a + upto_b - 1
        mark[final] = ord(";")
        digits = max(1, len(str(int(ids.max()))))
        cells, used = np.empty((n, digits + 1), np.uint8), np.ones((n, digits + 1), bool)
        for k in range(digits):
            cells[:, k] = ids // 10 ** (digits - 1 - k) % 10 + 48
            used[:, k] = (ids >= 10 ** (digits - 1 - k)) | (k == digits - 1)
        cells[:, digits] = mark
        flat, width = cells[used].tobytes(), np.cumsum(used.sum(axis=1))
        ends = np.concatenate([[0], width])[np.cumsum(self.n_a + self.n_b)]
        out, low = [], 0
        for high in ends.tolist():
            out.append(hashlib.sha256(flat[low : high - 1]).hexdigest() if high > low else "")
            low = high
        return out


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: at each level a key that has a bit to itself takes it, the others go on; a key's number is the rank of its bit.

    `find` gives -1 for keys that it wasn't built on, which the kept keys tell.
    """

    def __init__(self, keys: np.ndarray):
        self.bits: list[np.ndarray] = []
        rest = keys.astype(np.uint64)
        while len(rest):
            at = self._at(rest, len(self.bits), GAMMA * len(rest))
            alone = np.bincount(at, minlength=GAMMA * len(rest)) == 1
            self.bits.append(alone)
            rest = rest[~alone[at]]
        self.ranks, before = [], 0
        for level in self.bits:
            self.ranks.append(before + np.cumsum(level) - 1)
            before += int(level.sum())
        self.keys = np.zeros(before, np.int64)
        self.keys[self._number(keys)] = keys

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def _number(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks)):
            at = self._at(keys[open_].astype(np.uint64), level, len(bits))
            hit = bits[at]
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        number = self._number(keys)
        number[number >= 0] = np.where(self.keys[number[number >= 0]] == keys[number >= 0], number[number >= 0], -1)
        return number


def encoded(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id and the token ids of both tokenizers, packed as numbers of two bytes (four for large vocabularies); written, so that texts are encoded once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = Tokenizers.of(folder)
        for frame in batches(frames):
            widths = _width(both.a_size), _width(both.b_size)
            packed = [[zlib.compress(np.array(x, w).tobytes(), 1) for x, w in zip(pair, widths)] for pair in both.encode(frame["text"].tolist())]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "a": [p[0] for p in packed], "b": [p[1] for p in packed]})

    rows = docs.select(id_text(), "text").mapInPandas(run, "doc_id string, a binary, b binary")
    return saved(rows.withColumn("doc_id", F.col("doc_id").cast("long")), "alignment-ids")


def _parts(frames: Iterator[pd.DataFrame], sizes: tuple[np.ndarray, np.ndarray], rows: int = 256) -> Iterator[tuple[pd.DataFrame, Alignment]]:
    for frame in frames:
        for low in range(0, len(frame), rows):
            part = frame.iloc[low : low + rows]
            yield part, Alignment(part, *sizes)


def distinct_pairs(ids: DataFrame, sizes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The distinct pairs that are linked anywhere, in order; each task sends each of its own once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, lately = _EMPTY, np.full(1 << 18, -1, np.int64)  # lately: the last pair of each remainder, which most repeats meet
        for _, aligned in _parts(frames, sizes):
            keys = aligned.keys()
            at = (keys * 0x9E3779B1 >> 12) & (len(lately) - 1)
            new = lately[at] != keys
            lately[at[new]] = keys[new]
            seen = np.union1d(seen, keys[new])
        yield pd.DataFrame({"pair": seen})

    found = ids.select("a", "b").mapInPandas(run, "pair long").distinct()
    return np.sort(np.array(found.toPandas()["pair"], np.int64))


def _summed(key: str, packed: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in packed["counts"])
    return pd.DataFrame({"slice": [int(packed["slice"].iloc[0])], key: [int(packed[key].iloc[0])], "counts": [zlib.compress(total.tobytes(), 1)]})


def pair_counts(ids: DataFrame, hashed: PerfectHash, sizes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How often each pair is linked, by its number: dense vectors of the tasks, summed slice by slice in a tree of two levels."""
    shared = ids.sparkSession.sparkContext.broadcast(hashed)
    n = len(hashed.keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n, np.int64)
        for _, aligned in _parts(frames, sizes):
            number = shared.value.find(aligned.keys())
            if (number < 0).any():
                raise ValueError("a pair isn't among those that the hash was built on")
            total += np.bincount(number, minlength=n)
        slices = [(k // SLICE, total[k : k + SLICE]) for k in range(0, n, SLICE)]
        slices = [(k, part) for k, part in slices if part.any()]
        yield pd.DataFrame({"slice": [k for k, _ in slices], "counts": [zlib.compress(part.tobytes(), 1) for _, part in slices]})

    # a table's own rows are read in the same order each time, so the branch of a lost task stays the same
    leaves = ids.select("a", "b").mapInPandas(run, "slice long, counts binary").withColumn("branch", F.spark_partition_id().cast("long") % FAN)
    middle = leaves.groupBy("slice", "branch").applyInPandas(lambda f: _summed("branch", f), "slice long, branch long, counts binary")
    top = middle.withColumn("branch", F.lit(0).cast("long")).groupBy("slice", "branch").applyInPandas(lambda f: _summed("branch", f), "slice long, branch long, counts binary")
    out = np.zeros(n, np.int64)
    for row in top.collect():
        part = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
        out[row["slice"] * SLICE : row["slice"] * SLICE + len(part)] = part
    shared.unpersist()
    return out


def align(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts a document's links whose pair is linked as often as any pair with the same B id; count_sum adds up the pairs' counts over its links.  Null and empty texts, and texts
    that a tokenizer doesn't give back byte for byte, have no tokens: zeros and an empty digest.  Repeated rows have each their own row and count each.  Other columns aren't read.
    """
    both = Tokenizers.of(folder)
    sizes = (both.a_size, both.b_size)
    ids = encoded(docs, folder)
    hashed = PerfectHash(distinct_pairs(ids, sizes))
    counts = pair_counts(ids, hashed, sizes)
    second = hashed.keys & 0xFFFFFFFF
    most = np.zeros(len(both.b_bytes), np.int64)
    np.maximum.at(most, second, counts)
    shared = docs.sparkSession.sparkContext.broadcast((hashed, counts, counts == most[second]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, count, best = shared.value
        for part, aligned in _parts(frames, sizes):
            number = index.find(aligned.keys())
            sums, hits = np.zeros(aligned.docs, np.int64), np.zeros(aligned.docs, np.int64)
            np.add.at(sums, aligned.link_doc, count[number])
            np.add.at(hits, aligned.link_doc, best[number])
            yield pd.DataFrame(
                {
                    "doc_id": part["doc_id"], "n_a": aligned.n_a, "n_b": aligned.n_b, "n_groups": aligned.n_groups, "n_links": np.bincount(aligned.link_doc, minlength=aligned.docs),
                    "n_best": hits, "count_sum": sums, "groups_sha256": aligned.digests(),
                }
            )

    out = ids.withColumn("doc_id", id_text()).mapInPandas(
        run, "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
