"""Graphs, stores, traversal, curation, profiles and streams."""

import pytest

from biolattice.operators import curation, graph, profile, store, traverse
from biolattice.operators.graph import Graph
from biolattice.streaming import curation as stream
from pyspark.sql import functions as F


def nodes(spark, rows):
    return spark.createDataFrame([("L" if len(r) < 4 else r[3], r[0], f"{'L' if len(r) < 4 else r[3]}/{r[0]}", [], {"v": r[1]}, None, r[2]) for r in rows], graph.NODE)


def edges(spark, rows):
    return spark.createDataFrame([(s, t, d, f"{s}/{t}/{d}", {"v": v}, o) for s, t, d, v, o in rows], graph.EDGE)


def test_build_and_concat(spark):
    a = Graph.build(
        [nodes(spark, [("a", "1", 1), ("a", "2", 2), ("b", "3", 3)])],
        [edges(spark, [("L/a", "e", "L/b", "x", 1), ("L/a", "e", "L/b", "y", 2), ("L/a", "f", "L/b", "z", 3), ("L/a", "e", "L/none", "q", 4)])],
    )
    assert {(r.id, r.props["v"]) for r in a.nodes.collect()} == {("L/a", "1"), ("L/b", "3")}
    assert {(r.id, r.props["v"]) for r in a.edges.collect()} == {("L/a/e/L/b", "y"), ("L/a/f/L/b", "z")}
    assert {tuple(r) for r in a.summary().collect()} == {("node", "L", 2), ("edge", "e", 1), ("edge", "f", 1)}
    b = Graph(nodes(spark, [("a", "new", 0), ("c", "4", 0)]), edges(spark, [("L/a", "e", "L/b", "w", 0)]))
    c = Graph(nodes(spark, [("c", "5", 0)]), edges(spark, []))
    left, right = a.concat(b).concat(c), a.concat(b.concat(c))
    got = {(r.id, r.props["v"]) for r in left.nodes.collect()}
    assert got == {("L/a", "new"), ("L/b", "3"), ("L/c", "5")} == {(r.id, r.props["v"]) for r in right.nodes.collect()}
    assert {(r.id, r.props["v"]) for r in left.edges.collect()} == {("L/a/e/L/b", "w"), ("L/a/f/L/b", "z")}
    assert a.node("L", "a").count() == 1 and a.of_label("M").count() == 0
    assert [tuple(r) for r in a.query("SELECT n.key, count(*) AS c FROM {edges} e JOIN {nodes} n ON n.id = e.src_id WHERE n.key = :key GROUP BY n.key", {"key": "a"}).collect()] == [("a", 2)]


def test_edges_whose_ids_read_alike_stay_apart(spark):
    rows = edges(spark, [("L/x", "e", "L/y/e/L/z", "1", 1), ("L/x/e/L/y", "e", "L/z", "2", 2)])
    assert sorted(r.props["v"] for r in graph.last_wins(rows).collect()) == ["1", "2"]
    assert {r.id for r in graph.last_wins(rows).collect()} == {"L/x/e/L/y/e/L/z"}
    assert graph.first_wins(nodes(spark, [])).count() == 0


def test_write_and_read(spark, tmp_path):
    g = Graph.build([nodes(spark, [("a", "1", 1), ("b", "2", 1)])], [edges(spark, [("L/a", "e", "L/b", "x", 1)])])
    g.write(str(tmp_path / "g"))
    assert {tuple(r) for r in Graph.read(spark, str(tmp_path / "g")).summary().collect()} == {tuple(r) for r in g.summary().collect()}


def test_nodes_need_keys(spark):
    rows = spark.createDataFrame([("a b", 1), ("", 2), (None, 3)], "k string, ord long")
    assert [(r.id, r.key) for r in graph.nodes(rows, "L", "k").collect()] == [("L/a_b", "a_b")]


def test_load_is_idempotent(spark):
    g = Graph.build([nodes(spark, [("a/b", "1", 1), ("b", "2", 1), ("c", "3", 1)])], [edges(spark, [("L/a/b", "e", "L/b", "x", 1), ("L/b", "e", "L/c", "x", 2)])])
    none_n, none_e = spark.createDataFrame([], "id string, eid string"), spark.createDataFrame([], "id string")
    n, e = store.load(g, none_n, none_e)
    assert n.count() == 3 and e.count() == 2 and e.where("src_eid is null or dst_eid is null").count() == 0
    n2, e2 = store.load(g, n.select("id", "eid"), e)
    assert n2.count() == e2.count() == 0
    part = n.where("key <> 'c'").select("id", "eid")
    n3, e3 = store.load(g, part, none_e)
    assert [r.key for r in n3.collect()] == ["c"] and e3.count() == 2
    assert {r.eid is None for r in store.resolve(g.nodes.select("id"), part).collect()} == {True, False}


def test_strictness(spark):
    e = edges(spark, [("L/a", "e", "L/x", "v", 1)])
    stored = spark.createDataFrame([("L/a", "1")], "id string, eid string")
    assert store.endpoints(e, stored).count() == 0
    with pytest.raises(Exception, match="edge end not found"):
        store.endpoints(e, stored, strict=True).collect()
    with pytest.raises(Exception, match="duplicate id"):
        store.checked(spark.createDataFrame([("a",), ("a",)], "id string")).collect()
    assert store.checked(spark.createDataFrame([("a",), ("b",)], "id string")).count() == 2


def test_upserts(spark):
    old = spark.createDataFrame([("a", "1", 5, 5)], "id string, v string, created_at long, updated_at long")
    new = spark.createDataFrame([("a", "2"), ("b", "3")], "id string, v string")
    assert {tuple(r) for r in store.upsert(old, new, 9).collect()} == {("a", "1", 5, 9), ("b", "3", 9, 9)}
    assert {tuple(r) for r in store.upsert(old, new, 9, update_props=True).collect()} == {("a", "2", 5, 9), ("b", "3", 9, 9)}
    assert [r.id for r in store.delete(old, new).collect()] == []
    oe = spark.createDataFrame([], "id string, src_id string, dst_id string, created_at long, updated_at long")
    ne = spark.createDataFrame([("x", "a", "b"), ("y", "a", "zz")], "id string, src_id string, dst_id string")
    assert [r.id for r in store.upsert_edges(oe, ne, new, 3).collect()] == ["x"]
    assert [tuple(r) for r in store.unique(spark.createDataFrame([(1,), (1,), (2,)], "k int"), "k").collect()] == [(1, 2)]


def test_sequence_store(spark):
    none = spark.createDataFrame([], "hash string, seq string")
    seqs = spark.createDataFrame([("mkv",), ("MKV",), ("ac",)], "seq string")
    hashed, new = store.store_sequences(seqs, none, "ACDEFGHIKLMNPQRSTVWY")
    assert hashed.count() == 3 and sorted(r.seq for r in new.collect()) == ["AC", "MKV"]
    assert store.store_sequences(seqs, new)[1].count() == 0
    got = store.sequence(new, spark.createDataFrame([(hashed.first().hash,), ("0",)], "hash string")).collect()
    assert sorted(str(r.seq) for r in got) == ["MKV", "None"]
    for bad in ("a1", "", None):
        with pytest.raises(Exception, match="invalid sequence"):
            store.store_sequences(spark.createDataFrame([(bad,)], "seq string"), none, "ACD")[0].collect()


def test_annotation_and_execution(spark):
    n, e = store.annotation(spark.createDataFrame([("h1", "a kinase", 1), ("h2", " ", 2), ("h3", None, 3)], "hash string, function string, quality int"), "m")
    assert {r.key for r in n.where("label = 'ProteinAnnotation'").collect()} == {"a kinase", "NONE"}
    assert {r.dst_id for r in e.collect()} == {"ProteinAnnotation/a_kinase", "ProteinAnnotation/NONE"}
    rows = [("b", "host", ["x", "y"], "s2", 2), ("b", "host", ["z"], "s1", 1)]
    schema = "batch string, host string, parameters array<string>, step string, ord int"
    assert store.execution(spark.createDataFrame(rows, schema)).first().execs == '[{"step":"s1","parameters":"z"},{"step":"s2","parameters":"x y"}]'
    with pytest.raises(Exception, match="several hosts"):
        store.execution(spark.createDataFrame([*rows, ("b", "other", [], "s", 3)], schema)).collect()


def test_traversal(spark):
    g = Graph(
        nodes(spark, [(k, k, 1, label) for k, label in (("a", "A"), ("b", "B"), ("c", "B"), ("d", "C"), ("e", "B"))]),
        edges(spark, [("A/a", "e", "B/b", "", 1), ("B/b", "e", "B/c", "", 1), ("B/c", "e", "C/d", "", 1), ("C/d", "e", "B/e", "", 1), ("B/c", "f", "A/a", "", 1), ("A/a", "e", "X/none", "", 1)]),
    )
    root = spark.createDataFrame([("A/a",), ("Z/z",)], "id string")
    seen, met = traverse.expand(g, root, {"A": (True, False), "B": (True, False)}, 3)
    assert {(r.id, r.depth) for r in seen.collect()} == {("A/a", 0), ("B/b", 1), ("B/c", 2), ("C/d", 3)}
    assert met.count() == 5
    for way in ({"A": (True, False), "B": (True, False)}, {"B": (False, True)}):
        both = [traverse.expand(g, root, way, 3, materialize=m) for m in (False, True)]
        assert [{tuple(r) for r in s.collect()} for s, _ in both][0] == {tuple(r) for r in both[1][0].collect()}
        assert {r.id for r in both[0][1].collect()} == {r.id for r in both[1][1].collect()}
    seen, _ = traverse.expand(g, root, {"A": (True, True), "B": (True, True), "C": (True, True)}, 2)
    assert {(r.id, r.depth) for r in seen.collect()} == {("A/a", 0), ("B/b", 1), ("B/c", 1), ("C/d", 2)}
    assert traverse.expand(g, root, {}, 0)[0].count() == 1
    assert {r.neighbor for r in traverse.children(g, root).collect()} == {"B/b"}
    assert {r.neighbor for r in traverse.parents(g, root, "f").collect()} == {"B/c"}
    assert {tuple(r) for r in traverse.undirected(g, "A", "B").collect()} == {("A/a", "B/b"), ("A/a", "B/c")}


LOG = [("f1", "A", "u1", 5), ("f1", "B", "u2", 5), ("f1", "C", "u1", 4), ("f2", "D", "u3", 9)]


def log(spark):
    rows = [("template_reactions", "rxn1@t", k, ts, u, a, t, "", "functions") for k, (t, a, u, ts) in enumerate(LOG)]
    rows += [("template_reactions", "rxn1@t", 9, 1, "u", None, None, "a note", "comments"), ("template_reactions", "rxn1@t", 10, 1, "u", "v", "k", "", "attributes"), ("template_reactions", "rxn2@s", 0, 1, "u", "Z", "f1", "", "functions")]
    return spark.createDataFrame(rows, curation.EVENT)


def test_curation(spark):
    events = log(spark)
    f = events.where("kind = 'functions' and doc_id = 'rxn1@t'")
    want = {("rxn1@t", "f1", "A", "u1", 5), ("rxn1@t", "f2", "D", "u3", 9)}
    assert {tuple(r) for r in curation.latest(f).collect()} == want
    assert {tuple(r) for r in curation.template_rollup(events, "t").collect()} == {("rxn1", *w[1:]) for w in want}
    wanted = spark.createDataFrame([("rxn1@t",), ("none@t",)], "doc_id string")
    docs = {r.doc_id: r for r in curation.documents(events, "template_reactions", wanted).collect()}
    assert docs["none@t"].fields == {} and docs["none@t"].log == [] and docs["none@t"].comments == [] and docs["none@t"].attributes == {}
    assert docs["rxn1@t"].fields == {"f1": "C", "f2": "D"} and docs["rxn1@t"].comments[0].comment == "a note" and docs["rxn1@t"].attributes == {"k": "v"} and len(docs["rxn1@t"].log) == 4
    assert [r.k for r in curation.documents(events, "template_reactions").where("doc_id = 'rxn1@t'").select(F.map_keys("fields").alias("k")).collect()] == [["f1", "f2"]]
    rows = spark.createDataFrame([("r", "t", "g@x.1", "yes")], "i string, t string, g string, a string")
    e = curation.event(rows, "reaction_gene_annotation", F.col("i"), F.col("t"), F.col("g"), F.col("a"), F.lit("u"), F.lit(3)).first()
    assert (e.doc_id, e.target, e.kind) == ("r@t", "g@x.1", "genes")
    seeds = spark.createDataFrame([("s", "d1", 1), ("s", "d2", 2)], "seed_id string, doc_id string, ord int")
    assert [tuple(r) for r in curation.from_seed(seeds).collect()] == [("s", "d2")]


def test_profile(spark):
    row = spark.sql("SELECT 'GenomicFeature' l, map('source', 's', '_x', 'y', 'gff_attr_product', null, 'other', 'o') p")
    got = row.select(profile.projected(F.col("l"), F.col("p")), profile.projected(F.lit("Other"), F.col("p")), profile.public(F.col("p")), profile.public(F.col("p"), ("_x",))).first()
    assert got[0] == {"gff_source": "s"} and got[1] == {} and set(got[2]) == {"source", "gff_attr_product", "other"} and "_x" in got[3]


def test_streams(spark, tmp_path):
    log(spark).where("kind = 'functions'").write.parquet(str(tmp_path / "log"))
    events = spark.readStream.schema(curation.EVENT).parquet(str(tmp_path / "log"))
    q = stream.latest_actions(events).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("latest").count() == 3
    timed = events.withColumn("ts", F.timestamp_seconds("timestamp"))
    q = stream.activity(timed, "ts", "10 seconds", "1 minute", "target").writeStream.outputMode("complete").format("memory").queryName("active").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.target, r.n) for r in spark.table("active").collect()} == {("f1", 4), ("f2", 1)}
    nodes(spark, [("a", "1", 1), ("a", "1", 1), ("b", "2", 2)]).write.parquet(str(tmp_path / "in"))
    for run in range(2):
        source = spark.readStream.schema(graph.NODE).parquet(str(tmp_path / "in"))
        stream.load_stream(source, str(tmp_path / "store"), str(tmp_path / f"ckpt{run}")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "store")).count() == 2
