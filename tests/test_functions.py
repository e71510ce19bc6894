"""Column functions against truth tables."""

import hashlib
import zlib
from urllib.parse import quote

import pytest

from biolattice.functions import gpr, keys, sequences, tags
from biolattice.functions.casts import typed
from pyspark.sql import functions as F


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["_"]) if all(v is not None for v in values.values()) else spark.sql("SELECT " + ", ".join(f"cast(null as string) {k}" if v is None else f"'{v}' {k}" for k, v in values.items()))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "mode,want",
    [
        ("raw", "d4f92ed83a7cef7409c6041b779366bec021a8cc19b7878592fb7723d4173f56"),
        ("upper", "7a6b28e35ba51a92c105cfec8f4002d323eee3b9e4c2d5cbc20c789200b69b34"),
        ("protein", "06101e170c22fd1e3eb5769d9ec67e9b76a226c73f20c30aa46e2436cb60abce"),
    ],
)
def test_digests(spark, mode, want):
    assert one(spark, keys.digest("s", mode), s="mkv*") == want


def test_digest_lists(spark):
    row = spark.sql("SELECT array('mkv*', 'AAA') a, array('AAA', 'mkv*') b, array('g2', 'g1', 'g2') c")
    list_of = lambda c: keys.list_digest(F.transform(c, lambda x: keys.digest(x, "protein")))
    got = row.select(list_of("a"), list_of("b"), keys.set_digest("c")).first()
    assert got[0] == got[1] == "c2317156634bb66bcdab4c9e86b62867c1f3bc682cbcee0d34c0efb6968570f6"
    assert got[2] == "1052fcd58c0d89863b7b59f61eab6e35fab6187e96be35086f6386ec045c800e"
    with pytest.raises(ValueError):
        keys.digest("a", "other")


def test_protein_digest_strips_one_star_only(spark):
    rows = spark.createDataFrame([("ab**",), ("ab*\n",), ("",), (None,)], "s string").select("s", keys.digest("s", "protein").alias("h")).collect()
    assert [r.h for r in rows[:3]] == [hashlib.sha256(x).hexdigest() for x in (b"AB*", b"AB*\n", b"")] and rows[3].h is None


def test_keys(spark):
    rows = spark.createDataFrame([(" a b\t",), ("x/y",), ("",), (None,), (" k\n",)], "k string").select(keys.node_id("L", "k"), keys.edge_id("k", F.lit("e"), "k")).collect()
    assert [r[0] for r in rows] == ["L/a_b", "L/x/y", None, None, "L/k"]
    assert one(spark, F.to_json(keys.unescape_keys(F.create_map(F.lit("a#b"), F.lit(1), F.lit("c"), F.lit(2), F.lit("a.b"), F.lit(3))))) == '{"a.b":3,"c":2}'
    left, right = keys.split_composite("k")
    assert [tuple(r) for r in spark.createDataFrame([("a@b",), ("a@b@c",), ("a",)], "k string").select(left, right).collect()] == [("a", "b"), (None, None), (None, None)]


def test_sequences(spark):
    rows = spark.createDataFrame([("ACDX",), ("ACU",), ("AC-",), ("",), ("AC\n",)], "s string")
    got = rows.select(*[f("s") for f in (sequences.is_standard, sequences.is_extended, sequences.is_ambiguous, sequences.is_valid)]).collect()
    assert [tuple(r) for r in got] == [(False, False, True, True), (False, True, False, True), (False, False, False, False), (False, False, False, False), (False, False, False, False)]
    assert one(spark, sequences.reverse_complement("s"), s="ACGTNacgt") == "acgtNACGT"
    cut = rows.limit(1).select(sequences.slice_inclusive("s", F.lit(2), F.lit(3)), sequences.slice_inclusive("s", F.lit(0), F.lit(3)), sequences.slice_inclusive("s", F.lit(3), F.lit(2))).first()
    assert tuple(cut) == ("CD", None, "")
    assert one(spark, sequences.bad_letters("s", sequences.ALPHABETS["dna", "document"]), s="acgtUBu-") == ["-", "B", "U"]
    assert one(spark, sequences.bad_letters("s", sequences.ALPHABETS["dna", "array"], upper=False), s="ACGTUa") == ["a"]


GPR = [
    ("(a and b) or c", [["a", "b"], ["c"]], [["a", "b"], ["c"]]),
    ("(a or b) and c", [["a", "c"], ["b", "c"]], [["a or b)", "c"]]),
    ("((a and b) or c)", [["a", "b"], ["c"]], [["a", "b) or c"]]),
    ("a OR b", [["a"], ["b"]], [["a OR b"]]),
    ("orf19 and b", [["orf19", "b"]], [["orf19", "b"]]),
    ("a or b and c or d", [["a"], ["b", "c"], ["d"]], [["a"], ["b", "c"], ["d"]]),
    ("", [], []),
    ("a and (b or (c and d)", [["a", "b"], ["a", "c", "d"]], None),
    (None, [], []),
]


@pytest.mark.parametrize("rule,full,narrow", GPR)
def test_gene_rules(rule, full, narrow):
    assert gpr.dnf(rule) == full
    assert narrow is None or gpr.flat_rule(rule) == narrow


def test_gene_rules_as_columns(spark):
    rows = spark.createDataFrame([(r,) for r, _, _ in GPR], "rule string").select(gpr.complexes("rule").alias("c")).collect()
    assert [r.c for r in rows] == [f for _, f, _ in GPR]
    assert gpr.note_rule("<p>GENE_ASSOCIATION: (a and b)</p>") == "(a and b)" and gpr.note_rule("x") is None and gpr.note_rule("GENE ASSOCIATION: none") is None and gpr.note_rule("<p>gene association : b1 or b2\nnext</p>") == "b1 or b2" and gpr.note_rule("GENE_ASSOCIATION:") is None


VERDICT = """```xml
<evaluation><conflicts><conflict><type>name</type><nodes_involved>a, b ,,</nodes_involved></conflict></conflicts>
<gene_function> kinase </gene_function><reaction><id>r1</id><confidence>0.5</confidence><substrates>x, y</substrates></reaction><reaction><confidence>bad</confidence></reaction>
<issue><severity>high</severity></issue><overall_confidence>n/a</overall_confidence><recommendation>one</recommendation><recommendation>two</recommendation></evaluation>
```"""


def test_verdict(spark):
    rows = spark.createDataFrame([(VERDICT,), ("nothing",), ("<evaluation></evaluation>",), (None,), ("<evaluation> <overall_confidence>0.7</overall_confidence></evaluation>",)], "response string")
    v = [r.verdict for r in tags.verdicts(rows).collect()]
    assert v[0].error is None and v[0].gene_function == "kinase" and v[0].confidence == 0.0 and v[0].recommendations == ["one", "two"]
    assert v[0].conflicts[0].asDict() == {"type": "name", "severity": "info", "description": "", "nodes_involved": ["a", "b"], "suggested_resolution": ""}
    assert [r.confidence for r in v[0].reactions] == [0.5, None] and v[0].reactions[0].substrates == ["x", "y"] and v[0].reactions[1].direction == "unknown"
    assert v[0].issues[0].severity == "high" and v[0].issues[0].affected_elements == []
    assert v[1].error.startswith("no evaluation") and v[2].error.startswith("empty evaluation") and v[3].error
    assert v[4].confidence == 0.7 and v[4].gene_function == "Unknown"


def test_prompts(spark):
    n = spark.createDataFrame([("g", 2, "second"), ("g", 1, "first"), ("h", 1, "only")], "g string, ord int, line string")
    e = spark.createDataFrame([("g", 1, "edge")], "g string, ord int, line string")
    got = {r.g: r.prompt for r in tags.prompts(n, e, "g", "N:{nodes} E:{edges}").collect()}
    assert got == {"g": "N:first\nsecond E:edge", "h": "N:only E:"}
    row = spark.sql("SELECT map('b', '2', 'a', null) p, map() q")
    line = row.select(tags.node_line(F.lit("L"), F.lit("k"), F.col("p")), tags.edge_line(F.lit("s"), F.lit("e"), F.lit("d"), F.col("q").cast("map<string,string>"))).first()
    assert tuple(line) == ("[L] k: a=; b=2", "s -[e]-> d")


def test_typed(spark):
    row = spark.sql("SELECT map('Taxid', '9606', 'Coverage', 'x', 'Name', 'n') m").select(*typed(F.col("m"), ["Taxid", "Coverage", "Name", "TaxId"])).first()
    assert tuple(row) == (9606, None, "n", None)


def test_compressed_sequences(spark):
    seqs = ["", "MKV", "M" * 100_000, None, "é"]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "k int, s string").withColumn("z", sequences.compressed("s"))
    got = rows.select("k", "z", sequences.decompressed("z").alias("s")).orderBy("k").collect()
    assert [r.s for r in got] == seqs and [None if r.z is None else zlib.decompress(r.z).decode() for r in got] == seqs and len(got[2].z) < 1000


def test_quoted_and_role_key(spark):
    texts = ["a b/c?d=é&~*+%.-_", "", None, "Alanine--tRNA ligase (EC 6.1.1.7)"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", keys.quoted("t").alias("q"), keys.role_key("t").alias("r")).orderBy("k").collect()
    assert [r.q for r in rows] == [None if t is None else quote(t, safe="") for t in texts]
    assert [r.r for r in rows][1:] == ["", None, "alaninetrnaligaseec6117"]
