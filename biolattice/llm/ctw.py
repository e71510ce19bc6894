"""Language-model scores by context-tree weighting over binary-decomposed bytes.

All bytes of the training texts are counted with their last DEPTH bytes.  Every context of every depth that was seen is a node, so the tree grows with the corpus; each of a byte's
eight binary decisions has its own weighting over the nodes that met it: a node mixes its own Krichevsky-Trofimov estimate with its children's product, half and half.  A decision that
a context never met is left to the longest shorter context that did.

The tree is never in one place.  Grams (a context and a byte) are dealt out by the context's last TOP + 1 bytes, so each part holds whole subtrees; what the parts pass up to depth
TOP, a table that the alphabet bounds, gives the weights that they are sent down again.  Where a suffix has more than PART grams, the subtrees below it are dealt out one byte deeper, and so on;
its own decisions are rows of a table that is summed on the way up and joined on the way down, so no part holds more than a subtree of PART grams besides its share.  The outcome is a written table: the log probability of each gram that any text has.  Texts are
scored from its commonest rows, which are broadcast, and by a join with all others.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, remainder, saved
from .walk import batches

#: Bytes of context; depth up to which the tree is one table (255 decisions of 65,536 contexts at most; far fewer occur in UTF-8).
DEPTH, TOP = 6, 2
#: Grams whose log probabilities are broadcast (24 MB), and tokens whose counts are; the rest and all tokens of more than LONG bytes are joined.
HOT, COMMON, LONG = 1 << 21, 1 << 17, 64
#: Grams in a part of the tree on average, and from which on a suffix is dealt out deeper; distinct tokens, grams and bytes that a worker holds before it passes counts on or merges them.
PART, WORDS, GRAMS, HELD = 120_000, 250_000, 2_000_000, 2_000_000


def tokens(text: str) -> list[bytes]:
    """Words of the text with A-Z lower-cased; bytes.split() parts at exactly space and U+0009 to U+000D. The end token is the empty string."""
    return [*text.encode("utf-8", "replace").lower().split(), b""]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code of each byte of each text and of its end (0xFF, never in UTF-8) with DEPTH bytes before it, zeros before a text; and how many each text has.

    The byte is the code's lowest one, then come the bytes before it, the nearest first.
    """
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    data = b"".join([b"\0" * 7, *(b"\0" * DEPTH + r + b"\xff" for r in raw)])
    windows = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))  # the eight bytes that end at each place
    inside = np.ones(len(windows), bool)
    starts = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    for k in range(DEPTH):
        inside[starts + k] = False
    return (windows[inside] & np.uint64((1 << 8 * (DEPTH + 1)) - 1)).astype(np.int64), sizes


class _Counts:
    """Counts of grams in a worker."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.raw: list[np.ndarray] = []
        self.held = 0

    def add(self, codes: np.ndarray, known: bool) -> None:
        """Codes of training texts (known) count one each, others none: they are only asked for."""
        if known:
            self.raw.append(codes)
            self.held += len(codes)
            if self.held > HELD:
                self._count()
        elif len(codes):
            asked = np.sort(codes)
            asked = asked[np.append(True, asked[1:] != asked[:-1])]
            self.parts.append((asked, np.zeros(len(asked), np.int64)))

    def _count(self) -> None:
        if self.raw:
            self.parts.append(np.unique(np.concatenate(self.raw), return_counts=True))
        self.raw, self.held = [], 0

    def full(self) -> bool:
        """Whether too many grams are held even when those of the parts are merged."""
        if sum(len(c) for c, _ in self.parts) > GRAMS:
            self._merge()
        return bool(self.parts) and len(self.parts[0][0]) > GRAMS * 3 // 4

    def _merge(self) -> None:
        if len(self.parts) > 1:
            codes = np.concatenate([c for c, _ in self.parts])
            order = np.argsort(codes, kind="stable")
            codes = codes[order]
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            self.parts = [(codes[first], np.add.reduceat(np.concatenate([n for _, n in self.parts])[order], first))]

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        self._count()
        self._merge()
        out, self.parts = self.parts, []
        return out[0] if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts: (code, token, n); grams have no token and tokens the code 0."""
    _TABLES.clear()
    words: Counter[bytes] = Counter()
    counts = _Counts()

    def batch(codes: np.ndarray, tokens: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(codes), tokens, pa.array(n)], ["code", "token", "n"])

    def some_words(words: Counter) -> Iterator[pa.RecordBatch]:
        tokens, n = list(words), np.fromiter(words.values(), np.int64, len(words))
        for low in range(0, len(tokens), 100_000):
            part = tokens[low : low + 100_000]
            yield batch(np.zeros(len(part), np.int64), pa.array(part, pa.binary()), n[low : low + 100_000])

    def some_grams(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(codes), 100_000):
            part = codes[low : low + 100_000]
            yield batch(part, pa.nulls(len(part), pa.binary()), n[low : low + 100_000])

    for frame in batches(p.to_pandas() for p in parts):
        for held_out, part in frame.groupby("held_out"):
            texts = part["text"].tolist()
            if not held_out:
                for t in texts:
                    words.update(tokens(t))
            counts.add(grams(texts)[0], not held_out)
        if len(words) > WORDS:
            yield from some_words(words)
            words = Counter()
        if counts.full():
            yield from some_grams(*counts.taken())
    yield from some_words(words)
    yield from some_grams(*counts.taken())


def _threshold(n: str, df: DataFrame, most: int) -> int:
    """A bound, to an eighth of a power of two, such that at most `most` rows of df have an n that large. A few hundred rows are collected."""
    left = most
    for r in df.groupBy(F.floor(F.log2(n) * 8).cast("int").alias("b")).count().orderBy(F.desc("b")).collect():
        left -= r["count"]
        if left < 0:
            return math.ceil(2 ** ((r["b"] + 1) / 8) * (1 - 1e-9))
    return 1


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after a shift by 8 for small arguments."""
    low = x < 8
    y = np.where(low, x + 8, x)
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    if low.any():
        z = x[low]
        out[low] -= np.log(z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6) * (z + 7))
    return out


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimate gives to all that a node has seen."""
    return _log_gamma(ones + 0.5) + _log_gamma(zeros + 0.5) - _log_gamma(zeros + ones + 1) - math.log(math.pi)


def _decisions(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each gram the keys of its eight decisions (context and the byte's bits before, after a leading one), and the bits themselves."""
    b, byte = np.arange(8), (codes & 255)[:, None]
    return (codes >> 8)[:, None] << 8 | (1 << b) | (byte >> (8 - b)), (byte >> (7 - b)) & 1


def _shorter(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the same decisions after the last `depth` bytes alone."""
    return (keys >> 8 & ((1 << 8 * depth) - 1)) << 8 | keys & 255


class Nodes:
    """The decisions met in a set of contexts of one depth: counts, weights, and the place of each one's parent in the next shorter depth."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        alone = _kt(zeros, ones)
        self.weighted = alone if below is None else np.logaddexp(alone, below) - math.log(2)
        self.own = (ones + 0.5) / (zeros + ones + 1)
        self.stop = np.ones(len(keys)) if below is None else np.exp(alone - math.log(2) - self.weighted)

    def parents(self, depth: int) -> Nodes:
        keys, self.up = np.unique(_shorter(self.keys, depth), return_inverse=True)
        return Nodes(keys, *(np.bincount(self.up, x, len(keys)) for x in (self.zeros, self.ones, self.weighted)))

    def settle(self, add: np.ndarray, share: np.ndarray, final: np.ndarray) -> None:
        """From what the shorter contexts give to a one and the share that they leave, and from their word where this context never met the decision: the same for longer ones."""
        self.final = np.where(self.zeros + self.ones > 0, add + share * self.own, final)
        self.add, self.share = add + share * self.stop * self.own, share * (1 - self.stop)

    def following(self, up: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.add[up], self.share[up], self.final[up]


def subtree(codes: np.ndarray, n: np.ndarray, root: int = TOP + 1) -> tuple[list[Nodes], np.ndarray, np.ndarray]:
    """The nodes above these grams, of depths DEPTH to root; where each gram's decisions are in the first of them; their bits."""
    keys, bits = _decisions(codes)
    first, at = np.unique(keys.ravel(), return_inverse=True)
    times = np.repeat(n.astype(float), 8)
    levels = [Nodes(first, np.bincount(at, times * (1 - bits.ravel()), len(first)), np.bincount(at, times * bits.ravel(), len(first)), None)]
    for depth in range(DEPTH - 1, root - 1, -1):
        levels.append(levels[-1].parents(depth))
    return levels, at, bits


def _raised(nodes: Nodes, depth: int) -> pd.DataFrame:
    """What nodes pass up to their parents of this depth: depth, key, zeros, ones and the weight of the longer contexts."""
    keys, up = np.unique(_shorter(nodes.keys, depth), return_inverse=True)
    return pd.DataFrame({"depth": depth, "key": keys, **{c: np.bincount(up, x, len(keys)) for c, x in (("zeros", nodes.zeros), ("ones", nodes.ones), ("below", nodes.weighted))}})


def _by_root(frame: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    """The grams by root; nearly all parts have a single one."""
    roots = frame["root"].unique().tolist()
    return ((r, frame if len(roots) == 1 else frame[frame["root"] == r]) for r in roots)


def passed_up(frame: pd.DataFrame) -> pd.DataFrame:
    """From grams (code, n, root): what the subtrees, which begin at depth root, pass up."""
    return pd.concat(_raised(subtree(part["code"].to_numpy(), part["n"].to_numpy(), root)[0][-1], root - 1) for root, part in _by_root(frame))


class Top:
    """The tree's depths 0 to TOP, from the sums of what the subtrees pass up."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        order = np.argsort(keys)
        self.levels = [Nodes(keys[order], zeros[order], ones[order], below[order])]
        for depth in range(TOP - 1, -1, -1):
            self.levels.append(self.levels[-1].parents(depth))
        root = self.levels[-1]
        root.settle(np.zeros(len(root.keys)), np.ones(len(root.keys)), np.full(len(root.keys), 0.5))
        for longer, shorter in zip(self.levels[-2::-1], self.levels[::-1]):
            longer.settle(*shorter.following(longer.up))
        for nodes in self.levels:  # what is sent on is little
            del nodes.zeros, nodes.ones, nodes.weighted, nodes.own, nodes.stop

    def following(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As Nodes.following, for keys of depth TOP + 1; a decision never met at depth TOP has its word from a shorter context, or else one half."""
        add, share, final = np.zeros(len(keys)), np.ones(len(keys)), np.full(len(keys), 0.5)
        for depth, nodes in zip(range(TOP + 1), self.levels[::-1]):
            if len(nodes.keys):
                want = _shorter(keys, depth)
                at = np.minimum(np.searchsorted(nodes.keys, want), len(nodes.keys) - 1)
                hit = nodes.keys[at] == want
                add, share, final = (np.where(hit, new, old) for new, old in zip(nodes.following(at), (add, share, final)))
        return add, share, final


def passed_down(frame: pd.DataFrame, top: Top, given: pd.DataFrame | None = None) -> pd.DataFrame:
    """From grams (code, n, root): code, n and log10 of the byte's probability after its context. given: what the decisions above deeper roots send down (depth, key, add, share, final)."""
    out = []
    for root, part in _by_root(frame):
        codes = part["code"].to_numpy()
        levels, at, bits = subtree(codes, part["n"].to_numpy(), root)
        if root == TOP + 1:
            sent = top.following(levels[-1].keys)
        else:
            above = given[given["depth"] == root - 1].sort_values("key")
            of = np.searchsorted(above["key"].to_numpy(), _shorter(levels[-1].keys, root - 1))
            sent = tuple(above[c].to_numpy()[of] for c in ("add", "share", "final"))
        levels[-1].settle(*sent)
        for longer, shorter in zip(levels[-2::-1], levels[::-1]):
            longer.settle(*shorter.following(longer.up))
        one = np.clip(levels[0].final, 1e-12, 1 - 1e-12)[at].reshape(-1, 8)
        out.append(pd.DataFrame({"code": codes, "n": part["n"].to_numpy(), "log": np.log10(np.where(bits == 1, one, 1 - one)).sum(1).astype(np.float32)}))
    return pd.concat(out)


def _last(depth: int) -> Column:
    """The context's last bytes as they stand in a gram's code."""
    return F.col("code").bitwiseAND(F.lit((1 << 8 * (depth + 1)) - 256))


def _rooted(counts: DataFrame) -> tuple[DataFrame, int]:
    """The grams with the depth (root) at which the subtrees that are dealt out begin, and the largest root: below suffixes of more than PART grams they begin a byte deeper.

    A whole context has 256 grams at most, so the deepest root is DEPTH.  There is at most one such suffix for every PART grams of each depth: 8 bytes of each are broadcast.
    """
    out, root = counts.withColumn("root", F.lit(TOP + 1)), TOP + 1
    while root < DEPTH:
        full = saved(out.where(F.col("root") == root).groupBy(_last(root).alias("full")).count().where(F.col("count") > PART).select("full"), "ctw-full")
        if full.isEmpty():
            break
        out = out.join(F.broadcast(full), (F.col("root") == root) & (_last(root) == F.col("full")), "left")
        root += 1
        out = out.withColumn("root", F.when(F.col("full").isNotNull(), F.lit(root)).otherwise(F.col("root"))).drop("full")
    return out, root


_UP, _DOWN = "depth long, key long, zeros double, ones double, below double", "depth long, key long, add double, share double, final double"


def _summed(up: DataFrame, depth: int) -> DataFrame:
    return up.where(F.col("depth") == depth).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])


def _settled(frames: Iterator[pd.DataFrame], depth: int, top: Top | None) -> Iterator[pd.DataFrame]:
    """Decisions (key, zeros, ones, below, and where they lie deeper what their parents send down) settled."""
    for frame in frames:
        nodes = Nodes(*(frame[c].to_numpy() for c in ("key", "zeros", "ones", "below")))
        nodes.settle(*(top.following(nodes.keys) if top else (frame[c].to_numpy() for c in ("add", "share", "final"))))
        yield pd.DataFrame({"depth": depth, "key": nodes.keys, "add": nodes.add, "share": nodes.share, "final": nodes.final})


def modelled(counts: DataFrame) -> DataFrame:
    """From saved grams (code, n), n being 0 for those that only texts to score have: code, n, log (float), written. A decision's probability is held between 1e-12 and 1 - 1e-12."""
    spark = counts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + counts.count() // PART)
    rooted, deepest = _rooted(counts)
    suffix = F.coalesce(*[F.when(F.col("root") == d, _last(d)) for d in range(TOP + 1, deepest + 1)])
    dealt = rooted.withColumn("part", F.pmod(F.xxhash64(suffix), F.lit(parts)).cast("int"))
    up = dealt.groupBy("part").applyInPandas(passed_up, _UP)
    split: dict[int, DataFrame] = {}  # the decisions of the suffixes that are split, by depth
    if deepest > TOP + 1:
        up = saved(up, "ctw-up")
    for depth in range(deepest - 1, TOP, -1):
        split[depth] = saved(_summed(up, depth), "ctw-split")
        raised = split[depth].mapInPandas(lambda frames, d=depth: (_raised(Nodes(*(f[c].to_numpy() for c in ("key", "zeros", "ones", "below"))), d - 1) for f in frames), _UP)
        up = up.where(F.col("depth") < depth).unionByName(raised)
    sums = _summed(up, TOP).toArrow()
    shared = spark.sparkContext.broadcast(Top(*(sums[c].to_numpy() for c in ("key", "zeros", "ones", "below"))))
    down: list[DataFrame] = []
    for depth in range(TOP + 1, deepest):
        nodes = split[depth]
        if down:
            parent = down[-1].select(F.col("key").alias("_parent"), "add", "share", "final")
            nodes = nodes.join(parent, F.col("key").bitwiseAND(F.lit((1 << 8 * depth) - 1)) == F.col("_parent"))
        first = not down
        down.append(saved(nodes.mapInPandas(lambda frames, d=depth, f=first: _settled(frames, d, shared.value if f else None), _DOWN), "ctw-down"))
    if down:
        # what a split suffix's decisions send down goes to the parts that hold subtrees below it
        above = F.coalesce(*[F.when(F.col("root") == d, _last(d - 1)) for d in range(TOP + 2, deepest + 1)])
        held = dealt.where(F.col("root") > TOP + 1).select(F.col("part").alias("to_part"), (F.col("root") - 1).alias("depth"), above.alias("_above")).distinct()
        sent = functools.reduce(DataFrame.unionByName, down).withColumn("_above", F.col("key").bitwiseAND(F.lit(-256)))
        given = held.join(sent, ["depth", "_above"]).select("to_part", "depth", "key", "add", "share", "final")
        logs = dealt.groupBy("part").cogroup(given.groupBy("to_part")).applyInPandas(lambda frame, g: passed_down(frame, shared.value, g), "code long, n long, log float")
    else:
        logs = dealt.groupBy("part").applyInPandas(lambda frame: passed_down(frame, shared.value), "code long, n long, log float")
    model = saved(logs, "ctw-model")
    shared.unpersist()
    return model


class Table:
    """log10 probabilities of the commonest grams, found by hashing into a direct table."""

    def __init__(self, codes: np.ndarray, logs: np.ndarray):
        self.codes, self.logs = np.append(codes, -1), np.append(logs, 0).astype(np.float32)
        self.bits = max(10, (4 * len(codes)).bit_length())
        self.slots = np.full(1 << self.bits, len(codes), np.int32)
        self.steps, left = 0, np.arange(len(codes), dtype=np.int32)
        while len(left):
            slot = self._slot(codes[left], self.steps)
            free = self.slots[slot] == len(codes)
            self.slots[slot[free]] = left[free]
            left = left[self.slots[slot] != left]
            self.steps += 1

    def _slot(self, codes: np.ndarray, step: int) -> np.ndarray:
        h = codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(64 - self.bits)).astype(np.int64) + step * (1 + 2 * (h >> np.uint64(8) & np.uint64(1023)).astype(np.int64))) & ((1 << self.bits) - 1)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Places of the codes, the last place for those that aren't there."""
        none = len(self.codes) - 1
        out = self.slots[self._slot(codes, 0)]
        left = np.flatnonzero((self.codes[out] != codes) & (out != none))
        for step in range(1, self.steps):
            at = self.slots[self._slot(codes[left], step)]
            out[left] = at
            left = left[(self.codes[at] != codes[left]) & (at != none)]
        out[left] = none
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """For each text the sum over its common grams, and its other grams with how often they come."""
        codes, sizes = grams(texts)
        at = self.find(codes)
        ends = np.cumsum(sizes)
        total = np.add.reduceat(self.logs[at].astype(float), ends - sizes) if len(texts) else np.zeros(0)
        other = np.flatnonzero(at == len(self.codes) - 1)
        cuts = np.searchsorted(other, ends[:-1])
        rare = [np.unique(codes[x], return_counts=True) for x in np.split(other, cuts)]
        return total, [c for c, _ in rare], [n for _, n in rare]


_TABLES: dict[str, Table] = {}


def _rest(scored: DataFrame, names: str, times: str, key: str, table: DataFrame, *sums) -> DataFrame:
    """By _row, sums over the listed keys joined with the table; column times is how often each comes."""
    listed = scored.where(F.size(names) > 0).select("_row", F.inline(F.arrays_zip(F.col(names).alias(key), F.col(times).alias("times")))).toDF("_row", key, "times")
    return listed.join(table, key, "left").groupBy("_row").agg(*sums)


def language_model(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Null texts count as empty: one token, the end.  With nothing to train on all counts are 0 and the tree knows nothing: each byte has probability 1/256.  Repeated
    rows are counted and scored as often as they come; columns other than doc_id and text aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(id_text(), (remainder(F.col("doc_id"), 5) == 1).alias("held_out"), "text")
    partial = rows.select("held_out", "text").mapInArrow(_counted, "code long, token binary, n long")
    # workers have combined their counts, so the rows are dealt out before any more of that
    partial = partial.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "code", "token")
    counts = saved(partial.groupBy("code", "token").agg(F.sum("n").alias("n")), "lm-counts")
    vocabulary = counts.where("token is not null").select("token", "n")
    kinds, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = _threshold("n", vocabulary, COMMON)
    common = {bytes(r["token"]): math.log10(r["n"] + 0.5) for r in vocabulary.where((F.col("n") >= least) & (F.length("token") <= LONG)).toLocalIterator()}
    model = modelled(counts.where("token is null").select("code", "n"))
    least_gram = _threshold("n", model.where("n > 0"), HOT)
    hot = model.where(F.col("n") >= least_gram).select("code", "log").toArrow()
    name = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast((common, hot["code"].to_numpy(), hot["log"].to_numpy()))
    del common, hot

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs, codes, of_codes = shared.value
        if name not in _TABLES:
            _TABLES.clear()
            _TABLES[name] = Table(codes, of_codes)
        for frame in batches(frames):
            texts = frame["text"].tolist()
            out = []
            for t in texts:
                words = tokens(t)
                rare = Counter(w for w in words if w not in logs)
                out.append((len(words), len(words) - rare.total(), math.fsum(logs[w] for w in words if w in logs), list(rare), list(rare.values())))
            made = pd.DataFrame(out, columns=["n_tokens", "n_common", "base", "rare", "times"])
            made.insert(0, "doc_id", frame["doc_id"].to_numpy())
            made.insert(1, "held_out", frame["held_out"].to_numpy())
            made["score"], made["grams"], made["gram_times"] = _TABLES[name].score(texts)
            made["n_bytes"] = [len(t.encode("utf-8", "replace")) for t in texts]
            yield made

    schema = "doc_id string, held_out boolean, n_tokens long, n_common long, base double, rare array<binary>, times array<long>, score double, grams array<long>, gram_times array<long>, n_bytes long"
    scored = rows.mapInPandas(run, schema)
    scored = saved(scored.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("_row", F.monotonically_increasing_id()), "lm-scored")
    shared.unpersist()
    known = F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(F.lit(0))).alias("_known")
    rare = _rest(scored, "rare", "times", "token", vocabulary.where((F.col("n") < least) | (F.length("token") > LONG)), known, F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("_logs"))
    other = _rest(scored, "grams", "gram_times", "code", model.where(F.col("n") < least_gram).select("code", "log"), F.sum(F.col("times") * F.col("log")).alias("_more"))
    per_token = math.log10(total + 0.5 * (kinds + 1))
    score = F.col("score") + F.coalesce("_more", F.lit(0.0))
    return scored.drop("rare", "times", "grams", "gram_times").join(rare, "_row", "left").join(other, "_row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_logs", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"),
        score.alias("score"),
        "n_bytes",
        (-score * math.log2(10) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
