"""Mixing sources to target weights, by blocks.

Each source is a stream of words cut into blocks of a fixed length.  A source's target is met by whole passes over its blocks and a last
part of a pass, cut to the word; each pass visits the blocks by a pseudorandom permutation of its own (swap-or-not network), and each visit is a slot.  One more such permutation
shuffles all slots, and the result is cut into output shards of a fixed number of slots, so a shard's counts by source are a multinomial draw whose totals are held at the targets.
Slots and blocks are then joined by (source, block index), a key that no large source makes hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, saved, word_count

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words in a block; blocks in an output shard; times that a word may be used at most.
BLOCK, SHARD_BLOCKS, MOST = 1024, 256, 3
#: Runs that each source is cut into for prefix sums; rounds of the permutation network.
RUNS, ROUNDS = 1024, 12
SEED = 17
_SPLIT = 4096


def _key(source: Column) -> Column:
    """Sorts by code point with null last and joins like any string."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def permuted(x: Column, n: Column, source: Column, turn: Column, backward: bool = False) -> Column:
    """Where the permutation of [0, n) that belongs to (source, turn) sends x; backward: what it sends to x."""
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if backward else F.sequence(F.lit(1), F.lit(ROUNDS))

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), source, turn, r), n) - at, n)
        return F.when(F.pmod(F.xxhash64(F.lit(SEED + 1), source, turn, r, F.greatest(at, other)), F.lit(2)) == 1, other).otherwise(at)

    return F.aggregate(rounds, x.cast("long"), step)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, source_size), one row per source: adds target.  Targets share the total by weight and stop at `most` times the size.

    Sources reach their limit in order of limit / weight; so running sums tell at which one the rest share what is left.  The
    windows hold one row per source, not per document.
    """
    everything = W.partitionBy(F.lit(1))
    order = everything.orderBy(_key(F.col("source")))
    w = F.array(*map(F.lit, weights))[F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))]
    by_limit = everything.orderBy("_ratio", _key(F.col("source")))
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0))) / F.sum("_weight").over(onward)
    return (
        sizes.withColumn("_weight", w)
        .withColumn("_limit", F.col("source_size") * most)
        .withColumn("_ratio", F.col("_limit") / F.col("_weight"))
        .withColumn("_level", level)
        .withColumn("_level", F.max(F.when(F.col("_ratio") >= F.col("_level"), F.col("_level"))).over(everything))
        .select("source", "source_size", F.least(F.col("_limit").cast("double"), F.coalesce(F.col("_level") * F.col("_weight"), F.lit(0.0))).alias("target"))
    )


def placed(docs: DataFrame) -> DataFrame:
    """docs (with size and _tie) with _source and _start, the place of its first word in its source's stream.

    The stream's order is a hash of doc_id, then doc_id, size and _tie, a hash of all that the mix shows of a document; prefix sums go over runs and then over each source's RUNS totals, so a source with a
    third of all rows is no one's task.
    """
    sized = docs.withColumn("_source", _key(F.col("source"))).withColumn("_run", F.pmod(F.xxhash64("doc_id"), F.lit(RUNS)))
    runs = sized.groupBy("_source", "_run").agg(F.sum("size").alias("_words"))
    earlier = W.partitionBy("_source").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    ahead = runs.select("_source", "_run", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_ahead"))
    within = W.partitionBy("_source", "_run").orderBy("doc_id", "size", "_tie").rowsBetween(W.unboundedPreceding, -1)
    return (
        sized.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(ahead, ["_source", "_run"])
        .withColumn("_start", F.col("_ahead") + F.col("_within"))
        .drop("_within", "_ahead", "_run")
    )


def visits(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per source that the mix takes from: adds _source, _want (its words), _blocks, _last (words of its last block) and _slots, the visits that meet the target.

    Whole passes take every block; of the last pass as many visits as its rest needs, counted with the short block where its permutation puts it.
    """
    goals = (
        goals.withColumn("_source", _key(F.col("source")))
        .where("source_size > 0 and target > 0")
        .withColumn("_want", F.round("target").cast("long"))
        .where("_want > 0")
        .withColumn("_blocks", F.ceil(F.col("source_size") / block).cast("long"))
        .withColumn("_last", F.col("source_size") - (F.col("_blocks") - 1) * block)
        .withColumn("_turn", F.floor((F.col("_want") - 1) / F.col("source_size")).cast("long"))
        .withColumn("_rest", F.col("_want") - F.col("_turn") * F.col("source_size"))
        .withColumn("_short_at", permuted(F.col("_blocks") - 1, F.col("_blocks"), F.col("_source"), F.col("_turn"), backward=True))
    )
    full = F.ceil(F.col("_rest") / block)
    visited = F.when(F.col("_short_at") >= full, full).otherwise(F.ceil((F.col("_rest") + block - F.col("_last")) / block))
    return goals.withColumn("_slots", (F.col("_turn") * F.col("_blocks") + visited).cast("long")).drop("_turn", "_rest", "_short_at")


def slots(goals: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """One row per visit of a block: _source, _block, slot, shard and _take, the words taken from the block's start.

    All sources' slots together are put in a random order, which is cut into shards of shard_blocks slots each (the last one may be shorter).  So each shard
    draws its counts by source from what the targets hold: a multinomial draw without replacement, whose sums over the shards are exact.
    """
    counted = saved(visits(goals, block), "mix-visits")
    every = counted.agg(F.coalesce(F.sum("_slots"), F.lit(0))).first()[0]
    earlier = W.partitionBy(F.lit(1)).orderBy("_source").rowsBetween(W.unboundedPreceding, -1)  # a row per source
    each = (
        counted.withColumn("_offset", F.coalesce(F.sum("_slots").over(earlier), F.lit(0)))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slots") - 1, F.lit(_SPLIT).cast("long"))).alias("_from"))
        # a number that is given isn't coalesced: the few rows become many only after this
        .repartition(max(int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + every // (64 * _SPLIT)), "_source", "_from")
        .select("*", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + _SPLIT, F.col("_slots")) - 1)).alias("slot"))
        .withColumn("_turn", F.floor(F.col("slot") / F.col("_blocks")))
        .withColumn("_at", F.pmod("slot", "_blocks"))
        .withColumn("_block", permuted(F.col("_at"), F.col("_blocks"), F.col("_source"), F.col("_turn")))
        .withColumn("_short_at", permuted(F.col("_blocks") - 1, F.col("_blocks"), F.col("_source"), F.col("_turn"), backward=True))
        .withColumn("_place", permuted(F.col("_offset") + F.col("slot"), F.lit(every).cast("long"), F.lit("shards"), F.lit(-1).cast("long")))
    )
    length = F.when(F.col("_block") == F.col("_blocks") - 1, F.col("_last")).otherwise(F.lit(block))
    ahead = F.col("_turn") * F.col("source_size") + F.col("_at") * block - F.when(F.col("_at") > F.col("_short_at"), block - F.col("_last")).otherwise(F.lit(0))
    return each.withColumn("_take", F.least(length.cast("long"), F.col("_want") - ahead)).select(
        "_source", "_block", "slot", F.floor(F.col("_place") / shard_blocks).cast("long").alias("shard"), "_take"
    )


def _goals(rows: DataFrame, weights: tuple) -> DataFrame:
    return targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights)


def _tie(*extra: str) -> Column:
    """Orders rows that agree in id, source and size; rows that agree here too give the same mix in either order."""
    return F.xxhash64("text", *extra).alias("_tie")


def _taken(parts: DataFrame, goals: DataFrame, block: int, shard_blocks: int) -> DataFrame:
    """Parts of placed rows by block, joined with the slots that visit the block."""
    # the optimiser sees few sources, not how many slots they explode into, and would broadcast them
    return (
        parts.join(slots(goals, block, shard_blocks).hint("merge"), ["_source", "_block"])
        .withColumn("n_words", F.least("_high", F.col("_block") * block + F.col("_take")) - F.col("_low"))
        .where("n_words > 0")
    )


def _parts(block: int, words: Column | None = None) -> Column:
    """The blocks that a placed row lies in, with where it does and, if asked for, the words there."""

    def part(b: Column) -> Column:
        low, high = F.greatest(F.col("_start"), b * block), F.least(F.col("_start") + F.col("size"), (b + 1) * block)
        some = [] if words is None else [F.slice(words, (low - F.col("_start") + 1).cast("int"), (high - low).cast("int")).alias("_words")]
        return F.struct(b.alias("_block"), low.alias("_low"), high.alias("_high"), *some)

    return F.inline(F.transform(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block)), part))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The mix itself, a row per part of a document in a slot: shard, slot, doc_id, source, lang, first_word, n_words, text (the words, single spaces).

    Null texts and texts without words have no parts; null sources are one source, the last.  Repeated rows count as often as they
    come.  An empty table gives an empty mix.  Runs over the same rows agree.  Long documents are cut into their parts before they move.
    """
    sizes = saved(docs.select("source", word_count(F.col("text")).alias("size")), "mix-sizes")
    rows = placed(docs.select("doc_id", "source", "lang", "text", word_count(F.col("text")).alias("size"), _tie("lang"))).where("size > 0")
    # a row of its own for the words, so that a text is split once and not again for each of its blocks
    rows = rows.select("doc_id", "source", "lang", "size", "_source", "_start", F.explode(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("_all"))
    parts = rows.select("doc_id", "source", "lang", "_source", "_start", _parts(block, F.col("_all")))
    return _taken(parts, _goals(sizes, weights), block, shard_blocks).select(
        "shard",
        "slot",
        "doc_id",
        "source",
        "lang",
        (F.col("_low") - F.col("_start")).alias("first_word"),
        "n_words",
        F.array_join(F.slice("_words", F.lit(1), F.col("n_words").cast("int")), " ").alias("text"),
    )


def mix_report(docs: DataFrame, weights: tuple = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """What the mix takes of each row of docs: doc_id, size, source_size, target, taken.

    Cases as in mix(); a row without words takes 0.  Rows are told apart by their place in the stream, so repeated ids keep their own
    counts.  Only sizes move, no texts.
    """
    sizes = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _tie()), "mix-sizes")
    rows, goals = placed(sizes), _goals(sizes, weights)
    parts = rows.where("size > 0").select("_source", "_start", _parts(block))
    sums = _taken(parts, goals, block, SHARD_BLOCKS).groupBy("_source", "_start").agg(F.sum("n_words").alias("_taken"))
    counted = rows.where("size > 0").join(sums, ["_source", "_start"], "left").select("doc_id", "size", "_source", F.coalesce("_taken", F.lit(0)).alias("taken"))
    wordless = sizes.where("size = 0").select("doc_id", "size", _key(F.col("source")).alias("_source"), F.lit(0).cast("long").alias("taken"))
    return (
        counted.unionByName(wordless)
        .join(goals.select(_key(F.col("source")).alias("_source"), "source_size", "target"), "_source")
        .select("doc_id", "size", "source_size", "target", "taken")
    )
