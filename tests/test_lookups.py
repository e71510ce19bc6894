"""Search index, hash store and fitness matrices."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from biolattice.operators.hashstore import HashStore
from biolattice.operators.search import Index, Term, any_of
from biolattice.sources import fitness

RECORDS = [
    (1, "Escherichia coli K-12", "complete genome"), (2, "escherichia COLI", None), (3, "Coli escherichia", "draft genome; K 12"), (4, None, None), (5, "", "k-12 complete"), (6, "Ärger coli", "x"),
]


def plain(query):
    def words(t):
        return [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split(" ") if w]

    def fits(q, rec):
        if isinstance(q, Term):
            fields = [words(rec[1]), words(rec[2])] if q.field is None else [words(rec[1 if q.field == "name" else 2])]
            n = len(q.words)
            return n > 0 and any(tuple(f[i : i + n]) == q.words for f in fields for i in range(len(f)))
        if hasattr(q, "part"):
            return not fits(q.part, rec)
        a, b = (fits(p, rec) for p in q.parts)
        return a and b if q.how == "AND" else a or b

    return [r[0] for r in RECORDS if fits(query, r)]


def queries():
    rng = random.Random(1)
    leaves = [Term("coli"), Term("Escherichia Coli", "name"), Term("k 12"), Term("genome", "title"), Term("absent"), Term("  "), Term("COMPLETE", "name"), Term("ärger")]
    made = list(leaves) + [~leaves[0], ~leaves[4], any_of(*leaves[:3])]
    for _ in range(8):
        a, b = rng.choice(made), rng.choice(made)
        made.append(rng.choice([lambda: a & b, lambda: a | b, lambda: ~a & b])())
    return made


def test_search_agrees_with_a_plain_scan(spark, tmp_path):
    rows = spark.createDataFrame([*RECORDS, (None, "coli", "x")], "uid int, name string, title string")
    index = Index.of(rows, "uid", "name", "title").write(f"file://{tmp_path}/index")
    for q in queries():
        want = plain(q)
        assert [r.id for r in index.hits(q).orderBy("id").collect()] == want, str(q)
    q = (Term("coli") | Term("k 12", "title")) & ~Term("draft")
    assert str(q) == '(("coli"[All Fields] OR "k 12"[title]) AND (NOT "draft"[All Fields]))'
    assert [r.id for r in index.page(q, 2, 1).collect()] == plain(q)[1:3]
    assert [tuple(r) for r in index.told(q).collect()] == [('"coli"[All Fields]', 4), ('"k 12"[title]', 2), ('"draft"[All Fields]', 1), (str(q), len(plain(q)))]


def test_hash_store_reads_what_a_batch_can_hit(spark, tmp_path):
    store = HashStore(spark, f"file://{tmp_path}/store")
    ask = lambda seqs: spark.createDataFrame([(hashlib.sha256(s.encode()).hexdigest(),) for s in seqs], "hash string")
    assert [tuple(r)[1:] for r in store.lookup(ask(["AAA"])).collect()] == [(None,)]
    seqs = [f"MKV{'ACDEFGHIKL'[k % 10]}{'LMNPQRSTVW'[k // 10 % 10]}{'ACDEFGHIKL'[k // 100]}" for k in range(600)]
    batch = store.insert(spark.createDataFrame([(s.lower(),) for s in [*seqs, *seqs[:50]]], "seq string"), "ACDEFGHIKLMNPQRSTVWY")
    assert batch.count() == 650 and store.rows().count() == 600
    again = store.insert(spark.createDataFrame([(s,) for s in [*seqs[:5], "WWW"]], "seq string"))
    assert again.count() == 6 and store.rows().count() == 601 and store.rows().select("hash").distinct().count() == 601
    few = ask([seqs[3], seqs[3], "nothing", seqs[9]])
    assert sorted((r.seq or "") for r in store.lookup(few).collect()) == sorted(["", seqs[3], seqs[3], seqs[9]])
    hit = store.touched(few)
    assert {r.seq for r in hit.collect()} == {seqs[3], seqs[9]}
    scan = hit._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    files = scan.metrics().apply("numFiles").value()
    assert 0 < files <= 3 * 2 < len(store.rows().inputFiles())  # of three prefixes, each with a file an insert
    assert "prefix" in str(scan) and "In(hash" in str(scan).replace("PushedFilters: [", "")
    everything = store.lookup(ask([*seqs, *(f"x{k}" for k in range(900))]))
    assert everything.where("seq is not null").count() == 600
    with pytest.raises(Exception, match="invalid sequence"):
        store.insert(spark.createDataFrame([("MKZ1",)], "seq string"), "MK")


def test_fitness_matrices_of_any_width(spark, tmp_path):
    wide = [f"exp{k}" for k in range(300)]
    folder = tmp_path / "d" / "fitness_values"
    folder.mkdir(parents=True)
    rows = [["\t".join(["locusId", "desc", *wide])]] + [["\t".join([f"g{g}", f"gene {g}", *(str(g * 300 + k) if k % 7 else "NA" for k in range(300))])] for g in range(20)]
    (folder / "orgA.tsv").write_text("\n".join(r[0] for r in rows) + "\n\n")
    (folder / "orgB.tsv").write_text("e1\tlocusId\te2\r\n1.5\tb0\t-2e3\r\n\tb1\r\n9\tb2\t8\t7\r\n")
    cells = fitness.matrices(spark, str(folder), ("locusId", "desc"))
    a = cells.where("organism = 'orgA'")
    assert a.count() == 6000 and a.where("value is null").count() == 20 * 43
    assert a.agg(F.sum("value")).first()[0] == sum(g * 300 + k for g in range(20) for k in range(300) if k % 7)
    assert a.where("locusId = 'g3' and experiment = 'exp8'").first().asDict() == {"organism": "orgA", "locusId": "g3", "desc": "gene 3", "experiment": "exp8", "value": 908.0}
    b = sorted((r.locusId, r.experiment, r.value, r.desc) for r in cells.where("organism = 'orgB'").collect() if r.value is not None)
    assert b == [("b0", "e1", 1.5, None), ("b0", "e2", -2000.0, None), ("b2", "e1", 9.0, None), ("b2", "e2", 8.0, None)]
    (tmp_path / "d" / "genome").mkdir()
    (tmp_path / "d" / "genome" / "orgA.fasta").write_text(">a\nAC\n")
    found = fitness.catalogue(spark, str(tmp_path / "d"))
    assert {(r.organism, r.dataset) for r in found.collect()} == {("orgA", "fitness_values"), ("orgB", "fitness_values"), ("orgA", "genome")}
    assert {r.organism: (r.datasets, len(r.lacking)) for r in fitness.complete(found).collect()} == {"orgA": (2, 7), "orgB": (1, 8)}
