"""Stored expansions and patterns against plain walks over small random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from biolattice.operators import graph, patterns, traverse
from biolattice.operators.expansion import Adjacency, Expansion
from biolattice.operators.graph import Graph
from biolattice.operators.patterns import BOTH, IN, OUT, Hop


@pytest.fixture(scope="module")
def tangle(spark):
    """60 nodes of four labels, 150 edges of two labels with loops, cycles and edges to nowhere; and the same as Python sets."""
    rng = random.Random(8)
    ids = [f"{'ABCD'[k % 4]}/{k}" for k in range(60)]
    arcs = {(rng.choice(ids), rng.choice("xy"), rng.choice([*ids, "Z/0"])) for _ in range(150)} | {("A/0", "x", "A/0")}
    n = graph.nodes(spark.createDataFrame([(i[0], i[2:], k) for k, i in enumerate(ids)], "l string, k string, ord long"), F.col("l"), "k")
    e = graph.edges(spark.createDataFrame([(*a, 0) for a in sorted(arcs)], "s string, l string, d string, ord long"), "s", F.col("l"), "d")
    made = Graph(n.cache(), e.cache())
    return made, ids, {a for a in arcs if a[2] in ids}


def plain_expand(ids, arcs, roots, allowed, depth):
    seen, met, frontier = {r: 0 for r in roots if r in ids}, {}, [r for r in roots if r in ids]
    for d in range(1, depth + 1):
        new = set()
        for s, label, t in arcs:
            if s in frontier and allowed.get(s[0], (0, 0))[0]:
                met.setdefault((s, label, t), d)
                new.add(t)
            if t in frontier and allowed.get(t[0], (0, 0))[1]:
                met.setdefault((s, label, t), d)
                new.add(s)
        frontier = [x for x in new if x not in seen]
        seen.update({x: d for x in frontier})
    return seen, met


ALLOWED = {"A": (True, False), "B": (True, True), "C": (False, True)}


def stored(e):
    nodes = {r.id: r.depth for r in e.nodes().collect()}
    return nodes, {(r.src_id, r.label, r.dst_id): r.depth for r in e.edges().collect()}


def test_resumed_expansion_equals_one_run(spark, tangle, tmp_path):
    made, ids, arcs = tangle
    adjacency = Adjacency.write(made, f"file://{tmp_path}/graph")
    one = Expansion(adjacency, f"file://{tmp_path}/one", ALLOWED).start_at("A", " 0 ").grow(3)
    two = Expansion(adjacency, f"file://{tmp_path}/two", ALLOWED).start_at("A", "0").grow(2)
    assert two.depth == 2 and stored(two) == plain_expand(ids, arcs, ["A/0"], ALLOWED, 2)
    again = Expansion(Adjacency.read(spark, f"file://{tmp_path}/graph"), f"file://{tmp_path}/two", ALLOWED).grow()
    assert stored(one) == stored(again) == plain_expand(ids, arcs, ["A/0"], ALLOWED, 3)
    nodes, edges = traverse.expand(made, spark.createDataFrame([("A/0",)], "id string"), ALLOWED, 3)
    assert {r.id: r.depth for r in nodes.collect()} == stored(one)[0]
    assert {(r.src_id, r.label, r.dst_id) for r in edges.collect() if r.dst_id in ids} == set(stored(one)[1])


def test_a_depth_cut_short_is_made_anew(spark, tangle, tmp_path):
    made, ids, arcs = tangle
    e = Expansion(Adjacency.write(made, f"file://{tmp_path}/graph"), f"file://{tmp_path}/e", ALLOWED).start_at("A", "0").grow(1)
    before = stored(e)
    # what a call that died has left: edges and nodes of the next depth without its mark
    spark.createDataFrame([("q", "x", "q", "q/x/q", [("q", "Q")])], "src_id string, edge_label string, dst_id string, id string, _ends array<struct<_to:string,_label:string>>").write.parquet(f"file://{tmp_path}/e/edges/depth=2")
    spark.createDataFrame([("q", "Q")], "id string, node_label string").write.parquet(f"file://{tmp_path}/e/nodes/depth=2")
    assert stored(e) == before and e.depth == 1
    assert stored(e.grow(1)) == plain_expand(ids, arcs, ["A/0"], ALLOWED, 2)
    with pytest.raises(ValueError):
        e.start_at("A", "0")
    assert stored(e.reset().start_at("A", "4")) == ({"A/4": 0}, {}) and e.depth == 0
    with pytest.raises(ValueError):
        e.reset().grow()


def test_expansion_without_roots_or_followed_labels(spark, tangle, tmp_path):
    adjacency = Adjacency.write(tangle[0], f"file://{tmp_path}/graph")
    none = Expansion(adjacency, f"file://{tmp_path}/none", ALLOWED).start_at("A", "missing").grow(3)
    assert stored(none) == ({}, {}) and none.depth == 0
    leaf = Expansion(adjacency, f"file://{tmp_path}/leaf", ALLOWED).start_at("D", "3").grow(2)
    assert stored(leaf) == ({"D/3": 0}, {})


def arcs_of(arcs, hop):
    kept = [(s, t) for s, label, t in arcs if hop.edge in (None, label)]
    return set(kept if hop.direction == OUT else [(t, s) for s, t in kept] if hop.direction == IN else [*kept, *[(t, s) for s, t in kept]])


def plain_match(ids, arcs, start, hops):
    rows = {((i,), ()) for i in ids if i[0] == start}
    for hop in hops:
        steps, made = arcs_of(arcs, hop), set()
        for path, taken in rows:
            level, found = {path[-1]}, {path[-1]: 0} if hop.least == 0 else {}
            for length in range(1, hop.most + 1):
                level = {t for s, t in steps if s in level}
                if length >= hop.least:
                    for x in level:
                        found.setdefault(x, length)
            for x, length in found.items():
                if x in ids and hop.to in (None, x[0]):
                    made.add(((*path, x), taken if hop.least == hop.most else (*taken, length)))
        rows = made
    return {(*p, *t) for p, t in rows}


@pytest.mark.parametrize(
    "hops",
    [
        (Hop("x", "B"), Hop("y", "C", IN)),
        (Hop(None, None, BOTH), Hop("x"), Hop("y", "A", BOTH)),
        (Hop("x", None, OUT, 1, 4),),
        (Hop(None, "C", BOTH, 0, 3), Hop("y", None, IN, 2, 3)),
        (Hop("y", "D", OUT, 3, 3),),
    ],
)
def test_patterns_agree_with_plain_walks(tangle, hops):
    made, ids, arcs = tangle
    got = patterns.match(made, "A", *hops)
    names = [f"n{k}" for k in range(len(hops) + 1)] + [f"h{k}" for k, h in enumerate(hops, 1) if h.least != h.most]
    rows = [tuple(r) for r in got.select(*names).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_match(ids, arcs, "A", hops)


def test_patterns_from_given_nodes_and_wrong_hops(spark, tangle):
    made, ids, arcs = tangle
    start = spark.createDataFrame([("B/1",), ("B/1",), ("Z/0",)], "id string")
    assert {tuple(r) for r in patterns.match(made, start, Hop()).collect()} == {("B/1", t) for s, _, t in arcs if s == "B/1"}
    for wrong in ({"direction": "up"}, {"least": 2}, {"least": -1}):
        with pytest.raises(ValueError):
            Hop(**wrong)
