"""Near-duplicate detection: circulant MinHash, banding, exact Jaccard, components.

Two permutations make the whole signature: the first scatters the shingles over the ring of 32-bit numbers, the second ranks them, and coordinate k ranks the
scattered set shifted by k places round the ring.  Documents with the same set are one class from the start.  Of a bucket only pairs with its leader, the
member that meets most others, are verified at first.  Then documents that share a bucket and are still apart are compared: in small buckets all such pairs, in
large ones those that an exact prefix filter leaves.  So a large group round a centre costs about one pair a document, and no link within a bucket is left out.  Only of a
large group without a centre, whose members share buckets but no links, is more compared: all pairs of similar size that the filter can't exclude.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, id_text, saved
from .components import components
from .walk import batches
from .words import mixed, shingles

#: Coordinates of a band; probability at most that two sets just similar enough share no band.
ROWS, MISS = 6, 1.2e-5
#: Links have 100 * intersection >= threshold * union; the threshold unless another is asked for.
LINK = 85
#: Members of a bucket whose pairs are taken as they are; width of the size classes of the prefix filter.
SMALL, CLASS = 24, 1.08
#: A node is hot if it is in more than one in so many pairs; parts that a hot one's pairs are dealt into.
HOT, SALTS = 1000, 64
_CHUNK = 1 << 16


def bands_for(threshold: int) -> int:
    """Bands that keep the misses at the threshold within MISS: 24 for 85, 38 for 80."""
    alike = (threshold / 100) ** ROWS
    return math.ceil(math.log(MISS) / math.log1p(-alike)) if alike < 1 else 1


def signatures(sets: list[np.ndarray], bands: int) -> np.ndarray:
    """MinHash coordinates (sets x bands * ROWS) of non-empty sets."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    out = np.empty((len(sets), bands * ROWS), np.uint32)
    low = 0
    while low < len(sets):  # parts that stay in the cache
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _CHUNK, side="right")))
        ring = (np.concatenate(sets[low:high]) >> np.uint64(32)).astype(np.uint32)
        starts = ends[low:high] - sizes[low:high] - (ends[low - 1] if low else 0)
        x = np.empty_like(ring)
        shifted = np.empty_like(ring)
        for k in range(bands * ROWS):
            np.add(ring, np.uint32(k), out=x)
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                np.right_shift(x, np.uint32(shift), out=shifted)
                np.bitwise_xor(x, shifted, out=x)
                np.multiply(x, np.uint32(factor), out=x)
            np.right_shift(x, np.uint32(16), out=shifted)
            np.bitwise_xor(x, shifted, out=x)
            out[low:high, k] = np.minimum.reduceat(x, starts)
        low = high
    return out


def _described(frames: Iterator[pd.DataFrame], bands: int) -> Iterator[pd.DataFrame]:
    for frame in batches(frames):
        sets = shingles(frame["text"].tolist())
        full = [s for s in sets if len(s)]
        keys = np.zeros((len(full), bands), np.uint64)
        if full:
            rows = signatures(full, bands).reshape(len(full), bands, ROWS).astype(np.uint64)
            keys += np.arange(1, bands + 1, dtype=np.uint64)
            for k in range(ROWS):
                keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
        of = iter(keys.view(np.int64).tolist())
        yield pd.DataFrame(
            {
                **{c: frame[c] for c in frame.columns if c != "text"},
                "n_shingles": [len(s) for s in sets],
                "node": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "bands": [next(of) if len(s) else None for s in sets],
            }
        )


def _verified(frames: Iterator[pd.DataFrame], threshold: int) -> Iterator[pd.DataFrame]:
    last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
    for frame in frames:
        linked = []
        for low in range(0, len(frame), 256):
            part = frame.iloc[low : low + 256]
            texts = {**dict(zip(part["b"], part["text_b"])), **{a: t for a, t in zip(part["a"], part["text_a"]) if a != last[0]}}
            sets = dict(zip(texts, shingles(list(texts.values()))))
            sets.setdefault(last[0], last[1])
            for a, b in zip(part["a"], part["b"]):
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                linked.append(100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both))
                last = (a, sets[a])
        yield frame.loc[linked, ["a", "b"]]


def _beside(many: DataFrame, one: DataFrame, key: str, other: str, keys: DataFrame) -> DataFrame:
    """many joined with one (a row a key), where a key may hold a large part of many's rows; keys is many without its wide columns.

    Fewer than HOT keys can be hot; these are broadcast, their rows dealt out by the other column, and the one row that they all need is repeated for each part.
    """
    counts = keys.groupBy(key).agg(F.count("*").alias("_c"))
    hot = F.broadcast(counts.where(F.col("_c") * HOT > counts.agg(F.sum("_c")).scalar()).select(key, F.lit(SALTS).alias("_n")))
    salt = F.when(F.col("_n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    salts = F.when(F.col("_n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    left = many.join(hot, key, "left").withColumn("_salt", salt).drop("_n")
    right = one.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_n")
    return left.join(right, [key, "_salt"]).drop("_salt")


def _links(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b) of nodes those that are similar on their full sets; each pair's texts move to it."""
    with_b = _beside(pairs, texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b", "a", pairs)
    both = _beside(with_b, texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a", "b", pairs)
    return both.select("a", "b", "text_a", "text_b").mapInPandas(lambda frames: _verified(frames, threshold), "a binary, b binary")


def _prefixes(frames: Iterator[pd.DataFrame], threshold: int) -> Iterator[pd.DataFrame]:
    """For each member of a leader's group, the ways by which it can meet a similar member.

    The group's shingles are ordered: those that the leader lacks come first.  If two sets are similar, the first shingle that they share stands so early in both that enough
    may follow: at place i of n, only partners of at most (n - i + 1) * (100 + threshold) / threshold - n shingles are possible.  So members meet in an early shingle that the leader lacks
    (a row each), or else have most of their shingles in common with the leader; these meet by size class (class set): the larger asks for the classes that it allows.
    """
    for frame in frames:
        for low in range(0, len(frame), 256):
            part = frame.iloc[low : low + 256]
            leads = dict(zip(part["lead"], part["text_lead"]))
            known = dict(zip(leads, shingles(list(leads.values()))))
            out = []
            for lead, node, least, mine in zip(part["lead"], part["node"], part["least"], shingles(part["text_node"].tolist())):
                own = mine[np.isin(mine, known[lead], assume_unique=True, invert=True)]
                n = len(mine)
                most = (n - np.arange(len(own) + 1)) * (100 + threshold) // threshold - n
                low_n = max(int(least), -(-n * threshold // 100))  # the smallest partner there can be
                keep = most[:-1] >= low_n
                if keep.any():
                    out.append(pd.DataFrame({"lead": lead, "node": node, "n": n, "token": own[keep].view(np.int64), "class": -1, "most": most[:-1][keep], "larger": False}))
                top = int(most[-1])
                if len(own) < n and top >= low_n:
                    first, last = (int(np.floor(np.log(x) / np.log(CLASS))) for x in (low_n, min(top, n)))
                    asks = list(range(first, last + 1))
                    mine_too = [int(np.floor(np.log(n) / np.log(CLASS)))] if top >= n else []
                    out.append(pd.DataFrame({"lead": lead, "node": node, "n": n, "token": 0, "class": asks + mine_too, "most": top, "larger": [True] * len(asks) + [False] * len(mine_too)}))
            if out:
                yield pd.concat(out)


def _apart(members: DataFrame, roots: DataFrame, by: str) -> DataFrame:
    """Members of the groups that hold several components, with their root, the root of the group's largest component and the smallest n of the group."""
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counted = placed.groupBy(by, "root").agg(F.count("*").alias("c"), F.min("n").alias("least"))
    several = counted.groupBy(by).agg(F.count("*").alias("k"), F.max(F.struct("c", "root")).alias("most"), F.min("least").alias("least")).where("k > 1")
    return _beside(placed, several.select(by, F.col("most.root").alias("main"), "least"), by, "node", members)


def near_duplicates(docs: DataFrame, threshold: int = LINK, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, the columns in keep (text columns), n_shingles, component_id, kept, component (null for an empty set, else the same for all of a component).

    Documents are linked whose shingles have a Jaccard similarity of at least threshold (1 to 100) per cent.  Null texts and texts without words have an empty set, n_shingles 0, and are linked with nothing.  A component's id is its smallest doc_id (nulls come last); rows that
    repeat a doc_id with other texts are documents of their own.  Shingles are 64-bit hashes, classes 128-bit digests of the whole set.  Other columns aren't read.
    """
    if not 1 <= threshold <= 100:
        raise ValueError(f"threshold {threshold} is not between 1 and 100")
    bands = bands_for(threshold)
    more = "".join(f"`{c}` string, " for c in keep)
    rows = docs.select(id_text(), *keep, F.xxhash64("text").alias("text_hash"), "text")
    rows = rows.mapInPandas(lambda frames: _described(frames, bands), f"doc_id string, {more}text_hash long, n_shingles long, node binary, bands array<long>")
    rows = saved(rows.withColumn("doc_id", F.col("doc_id").cast("long")), "minhash-rows")
    met = rows.where("node is not null").groupBy("node")
    members = met.agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands")).select("node", "n", F.explode("bands").alias("key"))
    shared = saved(members.join(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"), "minhash-shared")
    # a group's centre meets more of the group than its edges do, and so makes the better leader
    ranked = shared.join(shared.groupBy("node").agg(F.sum("size").alias("met")), "node")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("met", "node", "n")).alias("lead"))
    buckets = saved(shared.join(leaders, "key").select("key", "size", "node", "n", F.col("lead.node").alias("lead"), F.col("lead.n").alias("l_n")), "minhash-buckets")
    # sets whose sizes differ too much can't be similar enough
    close = lambda n, m: F.least(n, m) * 100 >= threshold * F.greatest(n, m)
    stars = buckets.where((F.col("node") != F.col("lead")) & close(F.col("n"), F.col("l_n")))
    ends = lambda df, p, q: df.select(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")).distinct()
    tried = saved(ends(stars, "node", "lead"), "minhash-tried")
    # any member of a bucket of three or more may be compared again
    wanted = tried.select(F.explode(F.array("a", "b")).alias("node")).unionByName(buckets.where("size > 2").select("node")).distinct()
    # a node's text is found by the id and the text's hash of one of its documents: rows without an id, or with one that many have, don't meet each other
    name = F.struct("doc_id", "text_hash")
    names = met.agg(F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), name)), F.min(name)).alias("name")).select("node", "name.*")
    found = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), "text").join(
        wanted.join(names, "node"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))
    )
    texts = saved(found.select("node", "text").mapInPandas(_own, "node binary, text string"), "minhash-texts")
    if not texts.groupBy("node").count().where("count > 1").isEmpty():  # rows that repeat both id and text
        texts = saved(texts.groupBy("node").agg(F.first("text").alias("text")), "minhash-texts")
    links = saved(_links(tried, texts, threshold), "minhash-links")
    roots = components(links)
    # second round, small buckets: all pairs that are still apart
    few = saved(_apart(buckets.where(f"size between 3 and {SMALL}").select("key", "node", "n"), roots, "key").drop("least"), "minhash-few")
    p = few.where("root != main").select("key", F.col("node").alias("p"), F.col("n").alias("p_n"), F.col("root").alias("p_root"))
    pairs = ends(p.join(few, "key").where((F.col("root") != F.col("p_root")) & close(F.col("n"), F.col("p_n"))), "p", "node")
    # large buckets: pairs that meet in their prefixes
    grouped = saved(buckets.where((F.col("size") > SMALL) & (F.col("node") != F.col("lead"))).select("lead", "node", "n").distinct(), "minhash-groups")
    many = saved(_apart(grouped, roots, "lead"), "minhash-apart")
    if not many.isEmpty():
        with_lead = many.select("lead", "node", "least").join(texts.select("node", F.col("text").alias("text_node")), "node")
        with_lead = _beside(with_lead, texts.select(F.col("node").alias("lead"), F.col("text").alias("text_lead")), "lead", "node", many.select("lead"))
        meet = with_lead.select("lead", "node", "least", "text_lead", "text_node").mapInPandas(lambda frames: _prefixes(frames, threshold), "lead binary, node binary, n long, token long, class int, most long, larger boolean")
        meet = saved(meet.join(many.select("lead", "node", "root", (F.col("root") != F.col("main")).alias("few")), ["lead", "node"]), "minhash-prefixes")
        y = meet.where("not larger").select("lead", "token", "class", *[F.col(c).alias(f"y_{c}") for c in ("node", "n", "most", "root", "few")])
        # in each pair one member at least is outside the group's largest component
        sides = (("class < 0 and few", "true"), ("larger and few", "true"), ("larger and not few", "y_few"))
        for x_side, y_side in sides:
            asked = meet.where(x_side).join(y.where(y_side), ["lead", "token", "class"])
            asked = asked.where("root != y_root and least(n, y_n) * 100 >= greatest(n, y_n) * %d and y_n <= most and n <= y_most and (class < 0 or y_n <= n)" % threshold)
            pairs = pairs.unionByName(ends(asked, "node", "y_node"))
        pairs = pairs.distinct()
    untried = saved(pairs.join(tried, ["a", "b"], "left_anti"), "minhash-untried")
    if not untried.isEmpty():
        # the links between components, and the components that they join
        more = _links(untried, texts, threshold)
        for end in ("a", "b"):
            more = more.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
        joined = components(more.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
        alone = joined.select(F.col("node"), F.col("node").alias("root")).join(roots.select("node"), "node", "left_anti")
        roots = roots.unionByName(alone).withColumnRenamed("root", "_r").join(joined.select(F.col("node").alias("_r"), "root"), "_r", "left").select("node", F.coalesce("root", "_r").alias("root"))
    drop(texts)
    named = met.agg(F.min("doc_id").alias("doc_id")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = named.join(smallest, "root").select("node", "component_id", F.hex("root").alias("component"))
    return rows.select("doc_id", *keep, "n_shingles", "node").join(of_node, "node", "left").select(
        "doc_id",
        *keep,
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("node").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
        "component",
    )


def _own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows whose text has the node's set, one of each in a batch."""
    for frame in batches(frames):
        sets = shingles(frame["text"].tolist())
        right = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == n for s, n in zip(sets, frame["node"])]
        yield frame[right].drop_duplicates("node")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
