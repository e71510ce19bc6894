"""Loads that appear whole or not at all."""

import pytest
from pyspark.sql import functions as F

from biolattice.operators import graph
from biolattice.operators.graph import Graph
from biolattice.operators.versions import LoadConflict, VersionedStore, constrained


def made(spark, keys, arcs):
    n = spark.createDataFrame([(k, f"name of {k[0]}", i) for i, k in enumerate(keys)], "k string, name string, ord long")
    e = spark.createDataFrame([(f"T/{a}", f"T/{b}", i) for i, (a, b) in enumerate(arcs)], "a string, b string, ord long")
    return Graph(graph.nodes(n, "T", "k", graph.props(name=F.col("name"))), graph.edges(e, "a", "to", "b"))


def seen(store, version=None):
    g = store.graph(version)
    nodes = {(r.id, r.props["name"], r.eid) for r in g.nodes.collect()}
    return nodes, {(r.id, r.src_eid, r.dst_eid, r.eid) for r in g.edges.collect()}


class Killed(Exception):
    pass


def die():
    raise Killed


def test_a_load_that_dies_between_nodes_and_edges_leaves_nothing(spark, tmp_path):
    one, two = made(spark, ["a1", "a2", "b1"], [("a1", "a2"), ("a2", "b1"), ("a1", "nowhere")]), made(spark, ["b1", "c1"], [("a1", "a2"), ("c1", "a1")])
    whole, broken = VersionedStore(spark, f"file://{tmp_path}/whole"), VersionedStore(spark, f"file://{tmp_path}/broken")
    assert (whole.version, whole.load(one), whole.load(two)) == (0, 1, 2)
    for g in (one, two):
        before = broken.version, seen(broken)
        with pytest.raises(Killed):
            broken.load(g, between=die)
        assert (broken.version, seen(broken)) == before
        broken.load(g)
    assert seen(broken) == seen(whole) and {n[0] for n in seen(whole)[0]} == {"T/a1", "T/a2", "T/b1", "T/c1"}
    assert {e[0] for e in seen(whole)[1]} == {"T/a1/to/T/a2", "T/a2/to/T/b1", "T/c1/to/T/a1"}
    assert seen(whole, 1) == seen(broken, 1) and len(seen(whole, 1)[0]) == 3 and seen(whole, 0) == (set(), set())
    assert broken.vacuum() == 2 and whole.vacuum() == 0 and seen(broken) == seen(whole)
    assert whole.load(two) == 2 and [tuple(r) for r in whole.history().collect()] == [(1, 3, 2), (2, 4, 3)]
    assert [tuple(r) for r in constrained(whole, "T", "name").collect()] == [("name of a", 2)]


def test_strict_loads_and_conflicts(spark, tmp_path):
    store = VersionedStore(spark, f"file://{tmp_path}/s")
    with pytest.raises(Exception, match="duplicate id T/a"):
        store.load(made(spark, ["a", "a"], []), strict=True)
    with pytest.raises(Exception, match="edge end not found"):
        store.load(made(spark, ["a", "b"], [("a", "z")]), strict=True)
    assert store.version == 0
    assert store.load(made(spark, ["a", "b"], [("a", "b")]), strict=True) == 1
    with pytest.raises(ValueError, match="T/a already"):
        store.load(made(spark, ["a"], []), strict=True)
    # another load is committed while this one is between nodes and edges
    with pytest.raises(LoadConflict):
        store.load(made(spark, ["c"], []), between=lambda: VersionedStore(spark, f"file://{tmp_path}/s").load(made(spark, ["d"], [])))
    assert {n[0] for n in seen(store)[0]} == {"T/a", "T/b", "T/d"} and store.load(made(spark, ["c"], [])) == 3
