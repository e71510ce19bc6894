"""Collocations, alignment of tokenizers and toxicity against brute force and planted cases."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from biolattice.llm import alignment, collocations, toxicity
from biolattice.llm.collocations import Automaton, Shard

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en", extra=False):
    rows = [(i, t, lang[i] if isinstance(lang, list) else lang, "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    return df.selectExpr("*", "1 AS a", "'x' AS words", "2 AS n", "3 AS score", "'y' AS held_out") if extra else df


# ---- collocations


def corpus(seed, docs=300):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["New", "YORK", "city", "Å", "x y"]
    out = []
    for _ in range(docs):
        text = []
        for _ in range(rng.randint(0, 30)):
            text.append(rng.choice(["new york city hall", "New  York", "a\tb c d", "of the", rng.choice(words), rng.choice(words[:6])]) + rng.choice(["", "", ",", ". ", "\n", "\v"]))
        out.append(" ".join(text))
    return out


def test_collocations_agree_with_sql(spark):
    texts = corpus(1) + ["", None, "   ", "...", "one"] + ["same words here again"] * 35
    langs = [random.Random(2).choice(["en", "de", None, "und"]) for _ in texts]
    docs = documents(spark, texts, langs, extra=True)
    got = collocations.collocations(docs).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"text": texts, "lang": langs}))
    want = con.execute(collocations.SQL).df()
    order = lambda x: x[list(want.columns)].sort_values(["lang", "rank"]).astype(str).values.tolist()
    assert len(want) > 20 and order(got) == order(want)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(documents(spark, ["", None])).count() == 0
    assert collocations.collocations(documents(spark, []).limit(0)).count() == 0


def shard_of(texts):
    shard = Shard()
    shard.add(texts)
    return shard


def brute(texts):
    found = Counter()
    for t in texts:
        for piece in t.lower().replace("\v", "\n").replace(".", "\n").replace(",", "\n").replace("\n", "\n").split("\n"):
            words = piece.replace("\t", " ").split(" ")
            words = tuple(w.encode() for w in words if w)
            found.update(words[i : i + k] for k in range(1, 5) for i in range(len(words) - k + 1))
    return found


def weights(one):
    return {p: w for k in range(4) for p, w in list(zip(one.phrases(k, np.arange(len(one.levels[k][1]))), one.levels[k][2].tolist()))[one.skip[k] :]}


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_automata_cut_into_ranges_unite_to_whole_counts(ranges):
    everything = np.full(collocations.CELLS, 255, np.uint8)
    parts = [[t.replace("Å", "a") for t in corpus(s, 40)] for s in range(3)]
    automata = [Automaton.unpack(Automaton.of_shard("en", shard_of(p), everything).pack()) for p in parts]
    whole = brute([t for p in parts for t in p])
    assert weights(automata[0]) == dict(brute(parts[0]))
    phrases = sorted(whole)
    bounds = sorted({phrases[len(phrases) * k // ranges] for k in range(1, ranges)})
    found, frequent = {}, {}
    for k in range(len(bounds) + 1):
        pieces = []
        for one in automata:
            low, context = one.places(bounds[k - 1]) if k else ([0] * 4, [False] * 4)
            high = one.places(bounds[k])[0] if k < len(bounds) else [len(label) for _, label, _ in one.levels]
            pieces.append(Automaton.unpack(one.piece(low, context, high).pack()))
        united = Automaton.union(pieces)
        own = weights(united)
        assert not set(own) & set(found)
        assert all((not k or bounds[k - 1] <= p) and (k == len(bounds) or p < bounds[k]) for p in own)
        # the weights along a path are the whole counts of the phrase's prefixes, context included
        for level in range(1, 4):
            at = np.arange(united.skip[level], len(united.levels[level][1]))
            for p, row in zip(united.phrases(level, at), united.table(level, at)[1].tolist()):
                assert row == [whole[p[: i + 1]] for i in range(len(p))]
        found |= own
        frequent |= weights(united.frequent())
        asked = Automaton.of_phrases([*list(own)[::3], (b"no", b"such")], np.ones(len(list(own)[::3]) + 1, np.int64))
        answers = {p: w for level, ws in enumerate(united.compose(asked)) for p, w, one in zip(asked.phrases(level, np.arange(len(ws))), ws.tolist(), asked.levels[level][2]) if one}
        assert answers == {**{p: own[p] for p in list(own)[::3]}, (b"no", b"such"): 0}
    assert found == dict(whole)
    assert frequent == {p: w for p, w in whole.items() if w >= collocations.LEAST}


# ---- alignment


def plainly(both, texts):
    rows, count = [], Counter()
    for t in texts:
        ids = list(both.encode([t or ""]))[0]
        ends = []
        for side, size in zip(ids, (both.a_size, both.b_size)):
            ends.append(np.cumsum(size[side]).tolist() if side else [])
        common = sorted(set(ends[0]) & set(ends[1]))
        links = [(a, b) for a, ea in zip(ids[0], ends[0]) for b, eb in zip(ids[1], ends[1]) if ea == eb]
        groups, low = [], 0
        for high in common:
            groups.append("|".join(",".join(str(i) for i, e in zip(side, end) if low < e <= high) for side, end in zip(ids, ends)))
            low = high
        count.update(links)
        rows.append([len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if ids[0] else ""])
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(*r[:3], len(r[3]), sum(count[x] == best[x[1]] for x in r[3]), sum(count[x] for x in r[3]), r[4]) for r in rows]


def test_alignment_agrees_with_brute_force(spark):
    texts = [
        "Hello world, hello  worlds!", "", None, " ", "\n\n x", "<|endoftext|> and <s> </s> <unk>", "naïve café — 你好 世界 🙂", "a▁b", "\u0000\u0001", "x" * 5000, " " * 1200 + "end",
        "Hello world, hello  worlds!", "1234567 abc\tdef\r\n", "é é", "  z", "don't we'll I'M",
    ]
    both = alignment.Tokenizers.of(alignment.TOKENIZERS)
    got = sorted(map(tuple, alignment.align(documents(spark, texts, extra=True)).collect()))
    assert [g[1:] for g in got] == plainly(both, texts)
    assert got[7][1:] == (0, 0, 0, 0, 0, 0, "")  # a text that already has the space sign isn't given back


def test_ranks_encode_as_the_file_does():
    both = alignment.Tokenizers.of(alignment.TOKENIZERS)
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \n\t'aZé1你.🙂  -st") for _ in range(200)) for _ in range(200)]
    assert both.fast is not None
    assert [both.fast.encode_ordinary(t) for t in texts] == [both.a.encode(t, add_special_tokens=False).ids for t in texts]


def test_alignment_of_nothing(spark):
    assert alignment.align(documents(spark, []).limit(0)).count() == 0
    assert [tuple(r)[1:] for r in alignment.align(documents(spark, [None, ""])).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_perfect_hash_is_minimal_and_knows_its_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 50, 50_000))
    hashed = alignment.PerfectHash(keys)
    assert sorted(hashed.find(keys).tolist()) == list(range(len(keys)))
    assert (hashed.find(np.arange(1000, dtype=np.int64) + (1 << 51)) == -1).all()
    assert len(alignment.PerfectHash(keys[:0]).find(keys[:0])) == 0


def test_possible_pairs_counts_suffixes():
    first, second = [b"ab", b"b", b"cab", b"x"], [b"b", b"b", b"ab", b"q"]
    assert alignment.possible_pairs(first, second) == sum(a.endswith(b) or b.endswith(a) for a in first for b in second)


# ---- toxicity


def planted(n=900, seed=3):
    rng = random.Random(seed)
    filler = [f"{a}{b}{c}" for a in ("ra", "mo", "ti") for b in ("ke", "lu", "so") for c in ("n", "x", "da")]
    texts, toxic = [], []
    for _ in range(n):
        kind = rng.random()
        words = rng.choices(filler, k=rng.randint(5, 60))
        if kind < 0.5:
            words.insert(rng.randrange(len(words)), "blockhead")
        if 0.25 < kind < 0.75:
            words.insert(rng.randrange(len(words)), "villagers")
        texts.append(" ".join(words))
        toxic.append(int(0.25 < kind < 0.5))
    return texts, toxic


def test_toxicity_learns_what_only_pairs_tell(spark):
    texts, toxic = planted()
    docs = documents(spark, texts, extra=True)
    labels = spark.createDataFrame([(i, None, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).toPandas().sort_values("doc_id")
    held = got[got.held_out]
    truth = np.array(toxic)[held.doc_id]
    assert (held.predicted.to_numpy() == truth).mean() > 0.97
    machine = toxicity.fitted(docs, labels)
    terms = toxicity.distinct_terms(["blockhead", "villagers", "blockhead villagers", ""], machine.index)
    alone, mention, both, none = machine.raw(terms)
    assert both > 0 > max(alone, mention) and both - none > (alone - none) + (mention - none)


def test_toxicity_without_labels_or_terms(spark):
    docs = documents(spark, ["fine text", None, "", "x" * 200_000])
    none = spark.createDataFrame([(0, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, none).toPandas()
    assert got.score.tolist() == [0.5] * 4 and got.predicted.tolist() == [0] * 4
    one = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.classify(docs, one).toPandas().score.between(0, 1).all()
    assert toxicity.classify(docs.limit(0), one).count() == 0


def test_terms_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["Worthless nonsense!", "", "é 你好 x", "a b-c"]
    alone = [toxicity.distinct_terms([t])[0].tolist() for t in texts]
    assert [t.tolist() for t in toxicity.distinct_terms(texts)] == alone
    assert alone[1] == [] and len(alone[2]) == 3
