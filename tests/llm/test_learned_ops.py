"""Language ID, quality, language model, near dedup, decontamination and the pipeline, against brute force or held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from biolattice.llm import components, ctw, decontam, langid, minhash, quality, words

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, node string"
ODD = [(900001, None), (900002, ""), (900003, " \n"), (900004, "x" * 50_000), (900005, "word " * 30_000), (900006, "1234 !!"), (900007, "é😀 ß"), (None, "a b c"), (900003, " \n"), (2**60 + 1, "one two three four")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, None if k % 2 else "en", None if k % 3 else "s", None, "clash", "clash") for k, (i, t) in enumerate(rows)], SCHEMA)


def with_odd(spark, docs):
    return docs.unionByName(odd(spark), allowMissingColumns=True)


def crc(i, n):
    return zlib.crc32(str(i if i is not None else "").encode()) % n


def test_automaton_has_exactly_the_substrings():
    rng = random.Random(1)
    s = [rng.randrange(3) for _ in range(40)]
    go = langid.suffix_automaton(s)
    subs = {tuple(s[i:j]) for i in range(40) for j in range(i, 41)}
    count = [1] * len(go)
    reach, todo = {()}, [((), 0)]
    while todo:
        path, state = todo.pop()
        for c, t in go[state].items():
            reach.add((*path, c))
            todo.append(((*path, c), t))
    assert reach == subs and len(go) <= 2 * len(s) and count


def parsed(x, has):
    """Phrases of the greedy parse; a symbol that the sample lacks is one by itself."""
    i, n = 0, 0
    while i < len(x):
        j = i + 1
        while j < len(x) and tuple(x[i : j + 1]) in has:
            j += 1
        i, n = j, n + 1
    return n


def test_cross_parse_counts_longest_matches():
    samples = ("the cat sat on the mat", "ein hund lief")
    p = langid.Parser({"a": [samples[0]], "b": [samples[1]]})
    rng = random.Random(5)
    texts = ["the hat", "cat on mat zzz", "hund", "sat on the mat the cat", "zz", "z the z", "", "the the? 3", "é"]
    texts += ["".join(rng.choices("thecasonmdilf zé", k=n)) for n in (31, 32, 33, 511, 512, 513, 1024, 1500, 5000)]  # longer than a piece
    texts += [" ".join(rng.choices(("the cat", "sat on", "hund lief", "zzz"), k=n)) for n in (200, 900)] + ["a" * 3000, "the cat sat on the mat " * 300]
    total, size, _ = p.phrases(texts)
    for k, sample in enumerate(samples):
        ref = langid.symbols([sample], p.table)[0].tolist()
        has = {tuple(ref[i:j]) for i in range(len(ref)) for j in range(i + 1, len(ref) + 1)}
        for n, text in enumerate(texts):
            x = langid.symbols([text], p.table)[0][:-1].tolist()
            assert size[n] == len(x) and total[k, n] == parsed(x, has), (sample, text[:40])


def test_many_languages_take_passes(spark, docs):
    rows = [(r.doc_id * 10 + k, f"{r.text} x{k}", f"{r.lang}{k}", None, None) for r in docs.where("lang is not null").limit(60).collect() for k in range(2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted(map(tuple, langid.identify(table, "lang").collect()))
    old, langid.LANGS = langid.LANGS, 3
    try:
        got = sorted(map(tuple, langid.identify(table, "lang").collect()))
    finally:
        langid.LANGS = old
    assert len(got) == len(want) == len(rows)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and np.allclose(g[4:], w[4:])


def test_language(spark, docs):
    got = langid.identify(with_odd(spark, docs)).collect()
    assert len(got) == docs.count() + len(ODD)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    for r in got:
        assert r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.doc_id in (900001, 900002, 900003, 900006))
    assert langid.identify(odd(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}


def test_languages_of_several_scripts():
    rng = random.Random(7)
    letters = lambda low, n: [c for c in map(chr, range(low, low + 4 * n)) if c.isalpha() and c == c.lower()][:n]
    alphabets = {"la": letters(0x61, 26), "ru": letters(0x430, 32), "ar": letters(0x627, 28), "hi": letters(0x904, 40), "th": letters(0xE01, 40), "ko": letters(0xAC00, 200)}
    alphabets |= {"zh": letters(0x4E00, 300), "ja": letters(0x3041, 80), "m1": letters(0x16A40, 15), "m2": letters(0x12000, 60)}

    def text(lang, vocabulary):
        return " ".join(rng.choices(vocabulary[lang], k=60))

    words = {lang: ["".join(rng.choices(a, k=rng.randrange(2, 6))) for _ in range(80)] for lang, a in alphabets.items()}
    # two languages of one large alphabet, told apart by their words
    words["z2"] = ["".join(rng.choices(alphabets["zh"], k=rng.randrange(2, 6))) for _ in range(80)]
    parser = langid.Parser({lang: [text(lang, words) for _ in range(20)] for lang in words})
    truth = [lang for lang in words for _ in range(5)]
    cost, known = parser.costs([text(lang, words) for lang in truth])
    low = np.sort(cost, 0)
    assert [parser.langs[k] for k in cost.argmin(0)] == truth and known.all() and (low[0] < low[1]).all()


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.classify(with_odd(spark, docs), labels.unionByName(spark.createDataFrame([(None, 1, 0), (900004, None, 1)], labels.schema))).collect()
    assert len(got) == docs.count() + len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (crc(r.doc_id, 3) == 1) for r in got)
    assert all(r.score == 0.5 for r in quality.classify(docs, labels.limit(0)).collect())
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r.doc_id: r.quality for r in big[1].collect()}
    held = [r for r in quality.classify(*big).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_isotonic_pools_ties():
    for raw, label in (((1, 1, 1, 1), (0, 0, 1, 1)), ((1, 1, 1, 1), (1, 1, 0, 0)), ((1, 2, 2, 3), (0, 1, 0, 1)), ((1, 2, 2, 3), (0, 0, 1, 1))):
        x, y = quality.pooled(np.array(raw, float), np.array(label, float))
        assert (x.tolist(), y.tolist()) == (([1.0], [0.5]) if raw[1] == 1 else ([1.0, 2.0, 3.0], [0.0, 0.5, 1.0]))
    rng = random.Random(1)
    for _ in range(50):  # against the minimax formula
        raw = np.array([rng.randrange(12) for _ in range(40)], float)
        label = np.array([float(rng.random() < r / 12) for r in raw])
        x, y = quality.pooled(raw, label)
        values = sorted(set(raw))
        mean = lambda a, b: label[(raw >= a) & (raw <= b)].mean()
        want = {v: max(min(mean(a, b) for b in values if b >= v) for a in values if a <= v) for v in values}
        # each pool has the mean label of its values
        assert np.allclose(sorted(set(np.round(list(want.values()), 9))), sorted(set(np.round(y, 9))))


def test_quality_against_plain_ridge(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    described = quality._described(with_odd(spark, docs))
    model = quality.fitted(described, labels.repartition(3))
    h = {r.doc_id: r.h for r in docs.select("doc_id", quality.F.pmod(quality.F.xxhash64("doc_id", quality.F.lit(quality.SEED)), quality.F.lit(1_000_000)).alias("h")).collect()}
    marks = {r.doc_id: float(r.quality) for r in labels.collect() if r.quality is not None}
    rows = [(r.doc_id, r.text or "") for r in docs.collect() if crc(r.doc_id, 3) != 1 and r.doc_id in marks]
    stats = np.vstack([quality.statistics([t]) for _, t in rows])
    y = np.array([marks[i] for i, _ in rows])
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.spread, np.where(stats.std(0) > 1e-9, stats.std(0), 1))
    fit = np.array([h[i] % 5 != 0 for i, _ in rows])
    z = np.hstack([np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((stats - model.mean) / model.spread, -8, 8) @ model.w + model.b), np.ones((len(stats), 1))])
    penalty = quality.RIDGE * np.diag([1.0] * quality.FEATURES + [1e-6])
    coef = np.linalg.solve(z[fit].T @ z[fit] + penalty, z[fit].T @ y[fit])
    assert np.allclose(coef, model.coef, atol=1e-6)
    x, v = quality.pooled(np.round(z[~fit] @ coef, 6), y[~fit])
    got = {r.doc_id: r.score for r in quality.classify(with_odd(spark, docs), labels).collect()}
    for (i, _), row in zip(rows, z):
        assert abs(got[i] - np.clip(np.interp(row @ coef, x, v), 0, 1)) < 1e-3
    assert quality.classify(odd(spark, []), labels).count() == 0


def test_isotonic():
    x, y = quality.pooled(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(y) > 0).all() and (np.diff(x) > 0).all() and y[0] == 0 and y[-1] == 1


def test_language_model_base(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + ODD
    split = {k: ctw.tokens(t or "") for k, (_, t) in enumerate(rows)}
    counts = Counter(w for k, (i, _) in enumerate(rows) if crc(i, 5) != 1 for w in split[k])
    n, v = counts.total(), len(counts)
    want = Counter()
    for k, (i, _) in enumerate(rows):
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split[k])
        want[(i, crc(i, 5) == 1, len(split[k]), sum(counts[w] > 0 for w in split[k]), n, round(base, 4))] += 1
    most, ctw.COMMON = ctw.COMMON, 100
    try:
        got = ctw.language_model(with_odd(spark, docs)).collect()
    finally:
        ctw.COMMON = most
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    held = [r for r in got if r.held_out and (r.doc_id or 900000) < 900000]
    assert -sum(r.score for r in held) * math.log2(10) / sum(r.n_bytes for r in held) < 3.5
    assert ctw.language_model(odd(spark, [])).count() == 0
    nothing = ctw.language_model(odd(spark, [(i, t) for i, t in ODD if crc(i, 5) == 1])).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and abs(r.bits_per_byte - 8 * (r.n_bytes + 1) / max(1, r.n_bytes)) < 1e-3 for r in nothing)


def plain_ctw(training):
    """log10 probability of texts by the definition: recursive weighting, one tree per binary decision, context by context."""
    depth, seen = ctw.DEPTH, {}

    def steps(t):
        data = b"\0" * depth + t.encode("utf-8", "replace") + b"\xff"
        for i in range(depth, len(data)):
            for b in range(8):
                yield data[i - depth : i], (b, data[i] >> (8 - b)), data[i] >> (7 - b) & 1

    for t, times in training:
        for context, decision, bit in steps(t):
            for d in range(depth + 1):
                seen.setdefault((context[depth - d :], decision), [0, 0])[bit] += times
    children = {}
    for context, decision in seen:
        if context:
            children.setdefault((context[1:], decision), []).append((context, decision))
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
    memo = {}

    def both(node):
        if node not in memo:
            alone = kt(*seen[node])
            if len(node[0]) == depth:
                memo[node] = (alone, alone)
            else:
                memo[node] = (alone, float(np.logaddexp(alone, sum(both(c)[1] for c in children[node]))) - math.log(2))
        return memo[node]

    def one(context, decision, d):
        node = (context[depth - d :], decision)
        own = (seen[node][1] + 0.5) / (sum(seen[node]) + 1)
        if d == depth or (context[depth - d - 1 :], decision) not in seen:
            return own
        alone, weighted = both(node)
        stop = math.exp(alone - math.log(2) - weighted)
        return stop * own + (1 - stop) * one(context, decision, d + 1)

    def score(text):
        total = 0.0
        for context, decision, bit in steps(text):
            p = one(context, decision, 0) if (b"", decision) in seen else 0.5
            total += math.log10(p if bit else 1 - p)
        return total

    return score


def test_context_tree_weighting_by_definition(spark, docs):
    rows = [(r.doc_id, (r.text or "")[:300]) for r in docs.orderBy("doc_id").limit(60).collect()] + [(70_000, None), (70_001, ""), (70_002, "ü😀" * 20), (70_003, "abracadabra" * 30), (70_003, "abracadabra" * 30)]
    training = [(t or "", 1) for i, t in rows if crc(i, 5) != 1]
    plain = plain_ctw(training)
    want = {i: plain(t or "") for i, t in rows}
    old, base = (ctw.HOT, ctw.PART, ctw.LONG), None
    try:
        for ctw.HOT, ctw.PART, ctw.LONG in ((1 << 21, 250_000, 64), (500, 12, 5)):  # all grams broadcast, nearly all joined and many suffixes split; long tokens joined
            got = ctw.language_model(odd(spark, rows)).collect()
            assert len(got) == len(rows) and any(r.held_out for r in got)
            assert all(abs(r.score - want[r.doc_id]) < 1e-3 + 1e-5 * abs(want[r.doc_id]) for r in got)
            now = sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got)
            assert base is None or now == base
            base = now
    finally:
        ctw.HOT, ctw.PART, ctw.LONG = old


def test_heavy_suffixes_are_split(spark):
    rng, letters, old = random.Random(8), "abcdefghijklmnopqrstuvwxyz", ctw.PART
    texts = ["".join(rng.choices(letters, k=3)) + "xen" + rng.choice(letters) for _ in range(10_000)] + ["zzzzzxen" + c for c in letters * 3]
    codes, n = np.unique(ctw.grams(texts)[0], return_counts=True)
    counts = spark.createDataFrame(pd.DataFrame({"code": codes, "n": n}))
    heavy = np.unique(codes & ((1 << 32) - 256), return_counts=True)[1].max()
    try:
        ctw.PART = 10**9
        whole = {r.code: r.log for r in ctw.modelled(counts).collect()}
        for ctw.PART, reach in ((300, 5), (10, ctw.DEPTH)):
            rooted, deepest = ctw._rooted(counts)
            assert heavy > 9000 and deepest == reach
            sizes = rooted.selectExpr("root", "code & (shiftleft(1L, 8 * (root + 1)) - 256) as suffix").groupBy("root", "suffix").count()
            assert sizes.where(f"count > {ctw.PART} and root < {ctw.DEPTH}").isEmpty()
            split = {r.code: r.log for r in ctw.modelled(counts).collect()}
            assert set(split) == set(whole) == set(codes.tolist())
            assert max(abs(split[c] - whole[c]) for c in whole) < 1e-4
    finally:
        ctw.PART = old


def test_huge_counts_keep_scores_finite(spark):
    texts = ["the cat sat on the mat", "the dog sat", "zebra", "the the the"]
    training = [(texts[0], 10**12), (texts[1], 2**24 + 1), (texts[3], 3)]
    counts = Counter()
    for t, times in training:
        for c in ctw.grams([t])[0].tolist():
            counts[c] += times
    for t in texts:
        for c in ctw.grams([t])[0].tolist():
            counts[c] += 0
    model = {r.code: r.log for r in ctw.modelled(spark.createDataFrame(list(counts.items()), "code long, n long")).collect()}
    assert set(model) == set(counts) and all(math.isfinite(v) and v <= 0 for v in model.values())
    plain = plain_ctw(training)
    for t in texts:  # a probability under 1e-12 counts as that, which only the text that wasn't trained on meets
        got = sum(model[c] for c in ctw.grams([t])[0].tolist())
        assert abs(got - plain(t)) < 1e-3 + (0.1 if t == "zebra" else 1e-3) * abs(got)


def test_grams_and_their_table():
    texts = ["", "ab", "é" * 5, "x" * 100, ""]
    codes, sizes = ctw.grams(texts)
    want = []
    for t in texts:
        data = b"\0" * ctw.DEPTH + t.encode() + b"\xff"
        want += [int.from_bytes(data[i - ctw.DEPTH : i + 1], "big") for i in range(ctw.DEPTH, len(data))]
    assert codes.tolist() == want and sizes.tolist() == [1, 3, 11, 101, 1] and len(ctw.grams([])[0]) == 0
    rng = np.random.default_rng(3)
    some = np.unique(rng.integers(0, 1 << 56, 20_000))
    table = ctw.Table(some[::2], np.arange(len(some[::2])))
    assert (table.find(some)[::2] == np.arange(len(some[::2]))).all() and (table.find(some)[1::2] == len(some[::2])).all()
    assert (ctw.Table(some[:0], some[:0]).find(some) == 0).all()


def test_the_sixth_byte_back_counts(spark):
    rng = random.Random(9)
    rows = [(k, "".join(f"{c}12345{c}" for c in rng.choices("ab", k=80))) for k in range(80)]
    held = [r for r in ctw.language_model(odd(spark, rows)).collect() if r.held_out]
    # of each seven bytes the first is a coin, the last repeats it
    assert held and 7 * sum(r.bits_per_byte for r in held) / len(held) < 1.5


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), i if not s else least.get(find(k))) for k, (i, s) in enumerate(sets)), key=str)


def test_near_duplicates(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(500)]
    rows = list(ODD)
    drift = [rng.choice(vocab) for _ in range(200)]
    for k in range(40):  # a chain whose ends are far apart
        drift = drift[:]
        drift[5 * k % 200] = f"n{k}"
        rows.append((k * 3 + 1, " ".join(drift)))
    for k in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randrange(1, 120))]
        rows.append((1000 + 7 * k, " ".join(w)))
        for c in range(rng.randrange(4)):
            v = w[:]
            for _ in range(rng.randrange(3)):
                v[rng.randrange(len(v))] = "zz"
            rows.append((2000 + 10 * k + c, rng.choice([" ", "\n", "  "]).join(v).upper()))
    rows.append((1000, "another text of a repeated id that is different"))
    base = [rng.choice(vocab) for _ in range(150)]
    for k in range(120):  # a large group of which some members are near its centre and some near each other only
        w = base[:]
        if k % 10 == 9:
            w[:20] = [f"s{j}" for j in range(20)]
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = f"e{rng.randrange(400)}"
        rows.append((5000 + k, " ".join(w[: 150 - k % 7])))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(odd(spark, rows)).collect()), key=str)
    assert got == brute(rows)
    assert minhash.near_duplicates(odd(spark, [])).count() == 0


def test_near_duplicates_without_ids(spark):
    """Rows that share an id, or have none, are documents of their own; of rows that repeat id and text a node's text is taken once."""
    rng = random.Random(14)
    texts = []
    for _ in range(100):
        w = [f"w{rng.randrange(2000)}" for _ in range(60)]
        texts += [" ".join(w), " ".join([*w[:-1], "end"]), " ".join([*w, "more"])]
    rows = [(None if k % 3 else 5, t) for k, t in enumerate(texts)] + [(None, texts[0])] * 50 + [(None, texts[1])] * 50 + [(9, texts[4])]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(odd(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_near_duplicates_at_other_thresholds(spark):
    assert minhash.bands_for(85) == 24 and minhash.bands_for(80) == 38
    rng = random.Random(8)
    rows = []
    for k in range(60):  # pairs of 100 shingles with 80 to 90 per cent in common
        w, lost = [f"{k}x{rng.randrange(10**6)}" for _ in range(104)], 6 + k % 6
        v = w[: 104 - lost] + [f"{k}y{j}" for j in range(lost)]
        rows += [(2 * k + 1, " ".join(w)), (2 * k + 2, " ".join(v))]
    base = [f"b{j}" for j in range(104)]
    for k in range(60):  # a large group round one centre
        w = base[:]
        for j in range(k % 4):
            w[(17 * k + 31 * j) % 104] = f"c{k}x{j}"
        rows.append((1000 + k, " ".join(w)))
    sets = {i: shingle_set(t) for i, t in rows}
    linked = {p: sum(100 * len(sets[2 * k + 1] & sets[2 * k + 2]) >= p * len(sets[2 * k + 1] | sets[2 * k + 2]) for k in range(60)) for p in (80, 85)}
    assert 0 < linked[85] < linked[80]
    for threshold in (80, 85):
        parent = {i: i for i in sets}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(odd(spark, rows), threshold).collect()}
        assert got == {i: find(i) for i in sets}
    kept = {r.doc_id for r in corpus_pipeline.stage_near_dedup(spark, odd(spark, rows), "").collect()}
    assert sum(2 * k + 2 not in kept for k in range(60)) == linked[80]


def test_components(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, 500 + k) for k in range(80)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(7, 7)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for p in links if p[0] != p[1] for x in p}


def test_word_hashes():
    texts = ["A b\tc", "", "a B c", "x" * 3000 + " a", " b "]
    h, ends = words.word_hashes(texts)
    assert ends.tolist() == [3, 3, 6, 8, 9] and (h[:3] == h[3:6]).all() and h[7] == h[0] and h[8] == h[1] and len(set(h.tolist())) == 4


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.common_length(a, decontam.masks_of(b), len(b)) == table[-1][-1]


def test_singular_vectors(spark, docs):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    space = decontam._fitted(docs, decontam.Space(items))
    terms = {int(h): k for k, h in enumerate(space.terms.hashes)}
    rows = []
    for text, weight in [(t, decontam.EMPHASIS) for _, t in items] + [(r.text or "", 1.0) for r in docs.collect()]:
        h, ends = words.word_hashes([text])
        starts, _ = decontam._passages(h, ends)
        for low, high in zip(starts, [*starts[1:], len(h)]):
            row = np.zeros(len(terms))
            for x in h[low:high]:
                if int(x) in terms:
                    row[terms[int(x)]] += space.weight[terms[int(x)]] * weight
            rows.append(row)
    exact = np.linalg.svd(np.array(rows), full_matrices=False)
    k = len(space.singular)
    assert k == min(decontam.RANK, len(terms)) and (np.diff(space.singular) <= 0).all()
    # the leading values and the subspace of the largest half are those of a full decomposition
    assert np.allclose(space.singular[: k // 2], exact[1][: k // 2], rtol=0.02)
    basis = space.latent[:-1] / space.weight[:, None]
    assert np.allclose(basis.T @ basis, np.eye(k), atol=1e-3)
    kept = np.linalg.norm(basis.T @ exact[2][: k // 4].T, axis=0)
    assert (kept > 0.98).all()


def test_latent_space_is_of_all_documents(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.sample(vocabulary, 20))) for k in range(12)]
    made = [" ".join(rng.choices(vocabulary[: 12 + k % 48], k=rng.randrange(1, 150))) for k in range(3 * decontam.WHOLE // 2)]
    made[7:9] = ["w3 w3 " * 90, None]
    space = decontam._fitted(spark.createDataFrame([(5, t) for t in made], "doc_id long, text string").repartition(7), decontam.Space(items))
    terms = {int(h): k for k, h in enumerate(space.terms.hashes)}
    seen = np.array([sum(h in set((t or "").split()) for t in made) for h in vocabulary])
    of = {int(words.word_hashes([w])[0][0]): n for w, n in zip(vocabulary, seen)}
    weight = np.log((len(made) + 1) / (np.array([of[h] for h in terms]) + 0.5)).clip(0.05)
    assert np.allclose(space.weight, weight, rtol=1e-5)
    gram = np.zeros((len(terms), len(terms)))
    for text, times in [(t, decontam.EMPHASIS**2) for _, t in items] + [(t or "", decontam.WHOLE / len(made)) for t in made]:
        h, ends = words.word_hashes([text])
        starts, _ = decontam._passages(h, ends)
        for low, high in zip(starts, [*starts[1:], len(h)]):
            row = np.bincount([terms[int(x)] for x in h[low:high] if int(x) in terms], minlength=len(terms)) * weight
            gram += times * np.outer(row, row)
    assert np.allclose(space.singular**2, np.sort(np.linalg.eigvalsh(gram))[::-1], rtol=1e-3)


@pytest.mark.parametrize("held", [1 << 21, 50])
def test_pairs_of_terms_are_counted_whole(spark, held):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(30)]
    made = [" ".join(rng.choices([*vocabulary, "other"], k=rng.randrange(0, 200))) for _ in range(60)]
    terms = decontam.Terms(words.word_hashes([" ".join(vocabulary)])[0])
    want = Counter()
    for t in made:
        h, ends = words.word_hashes([t])
        for part in np.split(terms.find(h), decontam._passages(h, ends)[0][1:]):
            want.update((int(x), int(y)) for x in part for y in part if x >= 0 and y >= 0)
    old, sizes = (decontam._PAIRS, decontam._SLICE), (held, 90)
    decontam._PAIRS, decontam._SLICE = sizes
    try:
        table, tall = decontam._counted(spark.createDataFrame([(t,) for t in made], "text string").repartition(3), terms)
        got = Counter()
        assert table.groupBy("slice").count().where("count > 1").isEmpty()  # one row a slice moves on, whatever the partitions
        for r in table.where("slice >= 0").collect():
            for cell, n in zip(*decontam._unpacked(r["cells"], r["counts"])):
                got[(r["slice"] * tall + int(cell) // 30, int(cell) % 30)] += int(n)
    finally:
        decontam._PAIRS, decontam._SLICE = old
    assert tall == 3 and got == want


def test_decontamination_against_brute_force(spark, docs):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    rng = random.Random(14)
    kinds = ("copy", "changed", "added", "dropped")
    rows, rate = [], 0.12
    for k, (i, t) in enumerate(items.items()):
        w = t.split()
        if kinds[k % 4] == "changed":
            w = [x if rng.random() > rate else "changed" for x in w]
        elif kinds[k % 4] == "added":
            w = [y for x in w for y in ([x, "added"] if rng.random() < rate else [x])]
        elif kinds[k % 4] == "dropped":
            w = [x for x in w if rng.random() > rate]
        around = rng.choice([r.text for r in docs.limit(30).collect()]).split()[:60]
        rows.append((30_000 + k, " ".join([*around, *w, *around])))
    rows += [(r.doc_id, r.text) for r in docs.collect()]
    codes: dict[bytes, int] = {}
    ids = lambda t: [codes.setdefault(x, len(codes)) for x in (t or "").encode().lower().split()]
    want = set()
    for i, t in items.items():
        seq = ids(t)
        tail = seq[-max(3, round(len(seq) * decontam.ANSWER)) :]
        for d, text in rows:
            doc, reach = ids(text), len(seq) + len(seq) // 2
            for start in range(0, max(1, len(doc)), decontam.BLOCK):  # every region that a window can have
                region = doc[max(0, start - reach) : start + 2 * decontam.BLOCK + reach]
                got = decontam.common_length(region, decontam.masks_of(seq), len(seq))
                if got >= decontam.ALONE * len(seq) or (got >= decontam.WITH_ANSWER * len(seq) and decontam.common_length(region, decontam.masks_of(tail), len(tail)) >= decontam.ANSWER_SHARE * len(tail)):
                    want.add((d, i))
                    break
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got <= want and {(30_000 + k, i) for k, i in enumerate(items)} <= want
    assert len(want - got) <= 0.02 * len(want), sorted(want - got)


def test_decontamination(spark, docs):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    rng = random.Random(4)
    clean = [r.text for r in docs.collect() if len(r.text.split()) > 100][:40]
    rows, want = list(ODD), set()
    for k, (i, t) in enumerate(items.items()):
        w = t.split()
        changed = w if k % 2 else [x if rng.random() > 0.15 else "changed" for x in w]
        before = clean[k % len(clean)].split()[:77]
        rows.append((10_000 + k, " ".join([*before[: k % 70], *changed, *before[k % 70 :]])))
        want.add((10_000 + k, i))
    rows += [(20_000 + k, " ".join(t.split()[100:])) for k, t in enumerate(clean) if not any(" ".join(x.split()[:6]) in " ".join(t.split()) for x in items.values())]
    extra = spark.createDataFrame([(7777, None), (7778, ""), (None, "x")], bench.schema)
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(odd(spark, rows), bench.unionByName(extra)).collect()}
    assert len(want - got) <= 0.1 * len(want)
    assert not [g for g in got if g[0] is None or g[0] >= 20_000]
    blocks, decontam.ITEMS = decontam.ITEMS, 15
    try:
        assert len(want & {(r.doc_id, r.item_id) for r in decontam.contaminated(odd(spark, rows), bench).collect()}) >= 0.9 * len(want)
    finally:
        decontam.ITEMS = blocks
    assert decontam.contaminated(odd(spark, rows), bench.limit(0)).count() == 0
    assert decontam.contaminated(odd(spark, []), bench).count() == 0


def test_decontamination_finds_every_copy_of_many_items(spark):
    rng = random.Random(6)
    texts = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if r.text and len(r.text.split()) > 150]
    items = [(7000, "two words")]
    for k in range(1200):
        w, n = texts[k % len(texts)], rng.randrange(16, 60)
        at = rng.randrange(len(w) - n)
        items.append((k, " ".join(w[at : at + n])))
    rows = []
    for k, (i, t) in enumerate(items[::4]):
        around, cut = texts[(k + 5) % len(texts)], rng.randrange(70)
        rows.append((i, " ".join([*around[:cut], t, *around[cut:100]])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert not {(i, i) for i, _ in rows} - got


def test_stages_decide_by_row(spark, docs, tmp_path):
    t, u, v = (" ".join(f"{c}{k}" for k in range(60)) for c in "tuv")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    item = bench.first().text
    make = lambda rows: spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], docs.schema)
    left = lambda stage, rows, at=DATA: sorted(((r.doc_id, r.text) for r in stage(spark, make(rows), at).collect()), key=str)
    rows = [(3, t), (7, t), (7, u), (7, u), (9, v + " "), (9, v)]
    assert left(corpus_pipeline.stage_exact_dedup, rows) == [(3, t), (7, u), (9, v + " ")]
    near = [(3, t), (7, t + " x"), (7, u), (7, u + " y"), (None, v), (None, ""), (8, None)]
    assert [i for i, _ in left(corpus_pipeline.stage_near_dedup, near)] == [3, 7, 8, None, None]
    found = [(5, item), (5, t), (None, item), (None, u)]
    assert left(corpus_pipeline.stage_decontaminate, found) == sorted([(5, t), (None, u)], key=str)
    for k, x in enumerate((item, u)):  # files of one name in two folders
        make([(k, x)]).coalesce(1).write.parquet(f"{tmp_path}/docs/part={k}")
    parts = spark.read.schema(docs.schema).parquet(*(f"{tmp_path}/docs/part={k}" for k in (0, 1)))
    assert corpus_pipeline._keyed(parts).select("_row").distinct().count() == 2
    assert [r.doc_id for r in corpus_pipeline.stage_decontaminate(spark, parts, DATA).collect()] == [1]
    for stage in (corpus_pipeline.stage_language, corpus_pipeline.stage_exact_dedup, corpus_pipeline.stage_near_dedup, corpus_pipeline.stage_decontaminate, corpus_pipeline.stage_mix):
        assert not left(stage, []) if stage is not corpus_pipeline.stage_mix else stage(spark, make([]), DATA).count() == 0
    # a text that two languages explain equally well is rejected, one that a language wins stays
    two = spark.createDataFrame([(k, f"same words here {k % 7}", lang, "s", 1) for k in range(80) for lang in ("de", "fr")] + [(500, "same words here", None, "s", 1)], docs.schema)
    assert 500 not in {r.doc_id for r in corpus_pipeline.stage_language(spark, two, DATA).collect()}


def test_pipeline_without_benchmark(spark, docs, tmp_path):
    spark.read.parquet(f"{DATA}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.limit(40).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline(spark, docs, tmp_path):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = docs.unionByName(odd(spark).select(*docs.columns)).unionByName(docs.limit(3)).withColumn("_id", langid.F.lit("clash"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    text = {r.doc_id: r.text for r in rows.collect()}
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert mixed and set(mixed[0].asDict()) == {"shard", "slot", "doc_id", "source", "lang", "first_word", "n_words", "text"}
    for r in mixed:
        assert r.text.split() == text[r.doc_id].split()[r.first_word : r.first_word + r.n_words]
    ids = {r.doc_id for r in mixed}
    used = [(i, text[i]) for i in ids]
    assert all(c == i for i, _, c in brute(used)) and len({"".join(t.split()) for _, t in used}) == len(used)
    found = {r.doc_id for r in decontam.contaminated(docs, bench).collect()}
    assert found and not found & ids
    assert not ids & {900001, 900002, 900003, 900006}
