"""Compressed families of sets against plain sets of sets, and gene rules that could not be listed."""

import gc
import itertools
import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from biolattice.functions import gpr
from biolattice.functions.families import EMPTY, UNIT, Families


def plain(f, x):
    return {frozenset(s) for s in f.sets(x)}


def least(family):
    return {s for s in family if not any(t < s for t in family)}


@pytest.mark.parametrize("seed", range(6))
def test_operations_agree_with_plain_sets(seed):
    rng, f = random.Random(seed), Families()
    made = [(EMPTY, set()), (UNIT, {frozenset()})] + [(f.single(k), {frozenset([k])}) for k in "abcdefg"]
    for _ in range(120):
        (x, p), (y, q) = rng.choice(made), rng.choice(made)
        kind = rng.randrange(4)
        if kind == 0:
            made.append((f.union(x, y), p | q))
        elif kind == 1 and len(p) * len(q) < 3000:
            made.append((f.join(x, y), {a | b for a in p for b in q}))
        elif kind == 2:
            made.append((f.without_supersets(x, y), {a for a in p if not any(b <= a for b in q)}))
        else:
            made.append((f.minimal(x), least(p)))
        x, p = made[-1]
        assert plain(f, x) == p and f.count(x) == len(p)
        assert f.smallest(x) == min(map(len, p), default=None)
        present = set(rng.sample("abcdefg", 3))
        assert f.within(x, present) == any(s <= present for s in p)
    # a family has one diagram
    for (x, p), (y, q) in itertools.combinations(made, 2):
        assert (x == y) == (p == q)


def wide(n):
    return " and ".join(f"(a{k} or b{k})" for k in range(n))


def test_a_product_of_thirty_alternatives_takes_no_time():
    began = time.perf_counter()
    f, whole = gpr.family(wide(30))
    assert f.count(whole) == 2**30 and f.nodes(whole) == 60
    with pytest.raises(gpr.TooManyComplexes, match=str(2**30)):
        gpr.dnf(wide(30))
    g, small = gpr.family(f"({wide(30)}) or a1", absorb=True)
    assert g.count(small) == 2**29 + 1 and g.smallest(small) == 1
    again = " and ".join(["(a or b)"] * 40)
    assert sorted(map(sorted, gpr.dnf(again))) == [["a"], ["a", "b"], ["a", "b"], ["b"]]
    assert time.perf_counter() - began < 1


def test_long_rules_do_not_run_out_of_stack():
    f, whole = gpr.family(" and ".join(f"g{k}" for k in range(3000)), absorb=True)
    assert f.count(whole) == 1 and f.smallest(whole) == 3000
    f, whole = gpr.family(" or ".join(f"g{k}" for k in range(3000)), absorb=True)
    assert f.count(whole) == 3000 and f.smallest(whole) == 1


def test_columns(spark):
    rows = [(0, wide(30), ["a0"]), (1, "a or (a and b)", ["a"]), (2, None, ["a"]), (3, "", None), (4, "(x and y) or z", ["x", "y"]), (5, wide(30), [f"a{k}" for k in range(30)])]
    df = spark.createDataFrame(rows, "i int, rule string, present array<string>")
    got = {r.i: r for r in df.select("i", gpr.gene_sets("rule").alias("s"), gpr.possible("rule", "present").alias("p")).collect()}
    assert tuple(got[0].s) == (60, str(2**30), str(2**30), 30, 60) and tuple(got[1].s) == (2, "2", "1", 1, 1)
    assert tuple(got[2].s) == tuple(got[3].s) == (0, "0", "0", None, 0)
    assert [got[k].p for k in range(6)] == [False, True, False, False, True, True]
    with pytest.raises(Exception, match="complexes, more than 100000"):
        df.select(gpr.complexes("rule")).collect()
    few = df.where(F.col("i") != 0).where(F.col("i") != 5).select(gpr.complexes("rule").alias("c")).collect()
    assert few[0].c == [["a"], ["a", "b"]]


def test_listed_rules_come_in_pieces_of_bounded_size(spark):
    rules = [wide(8).replace("(a", f"(x{k % 400}a") for k in range(500)]
    pieces = list(gpr.in_pieces(rules, gpr.dnf, held=20_000))
    assert [c for p in pieces for c in p] == [gpr.dnf(r) for r in rules] and len(pieces) > 1
    assert all(sum(len(c) for f in p for c in f) <= 20_000 for p in pieces)
    assert list(gpr.in_pieces([wide(8), None, wide(8)], gpr.dnf, held=10)) == [[gpr.dnf(wide(8))], [[]], [gpr.dnf(wide(8))]]
    tracemalloc.start()
    for _ in gpr.in_pieces(rules, gpr.dnf, held=20_000):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all of the lists at once take more than 10 MB
    assert most < 4_000_000
    got = spark.createDataFrame([(k, r) for k, r in enumerate([*rules, None, ""])], "k int, rule string").coalesce(1)
    got = got.select("k", gpr.complexes("rule").alias("c"), gpr.possible("rule", F.array(F.lit("a1"))).alias("p")).orderBy("k").collect()
    assert [r.c for r in got] == [gpr.dnf(r) for r in rules] + [[], []] and not any(r.p for r in got)


def test_told_families_leave_nothing_for_the_cycle_collector():
    gc.disable()
    try:
        gc.collect()
        for _ in range(3):
            f, whole = gpr.family(wide(12))
            assert f.count(whole) == 2**12 and f.smallest(whole) == 12 and not f.within(whole, {"a0"})
            del f
        assert not any(isinstance(x, Families) for x in gc.get_objects())
    finally:
        gc.enable()
