"""Order of records and source lines: the same for any splits, sizes and listings of files."""

import random
import xml.parsers.expat

import pytest
from pyspark.sql import functions as F

from biolattice.plans import genome as genome_plan
from biolattice.sources import fasta, gff, proteins


@pytest.fixture
def split(spark):
    """Reads with splits of a size; what the reader has written is read as usual."""
    usual = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def read(size, source, *args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            return source(spark, *args)
        finally:
            for k, v in usual.items():
                spark.conf.set(k, v)

    return read


SPLITS = (97, 1000, 1 << 27)


def spread(folder, names, parts):
    """The same files, written in another order and so with other times."""
    for name, part in zip(names, parts):
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(part)
    return str(folder)


def records(n, seed):
    rng = random.Random(seed)
    return [(f"p{rng.randrange(n // 3)}", "".join(rng.choices("ACGT", k=rng.randrange(0, 40)))) for _ in range(n)]


def test_fasta_order_and_last_wins_do_not_depend_on_splits(spark, tmp_path, split):
    found = records(150, 1)
    text = ["".join(f">{i} some > words\n{s[:20]}\n{s[20:]}\n" for i, s in found[a:b]) for a, b in ((0, 20), (20, 21), (21, 150))]
    one = spread(tmp_path / "x", ["a.fa", "b.fa", "c.fa"], text)
    two = spread(tmp_path / "y", ["c.fa", "a.fa", "b.fa"], [text[2], text[0], text[1]])
    for size in SPLITS:
        for path in (one, two):
            read = split(size, fasta.fasta, path)
            rows = read.orderBy("ord").collect()
            assert [(r.id, r.seq) for r in rows] == found and [r.ord for r in rows] == list(range(150))
            last = read.groupBy("id").agg(F.max_by("seq", "ord").alias("seq"))
            assert {r.id: r.seq for r in last.collect()} == dict(found)


def test_gff_order_and_genome_do_not_depend_on_splits(spark, tmp_path, split):
    rng = random.Random(2)
    lines = []
    for k in range(120):
        start = rng.randrange(1, 20)
        attrs = f"locus_tag=b{rng.randrange(9)};protein_id=p{rng.randrange(12)};n={k}"
        lines.append("\t".join(["c1", "src", rng.choice(["gene", "CDS"]), str(start), str(start + 3), ".", rng.choice("+-"), ".", attrs]))
        if k % 7 == 0:
            lines.append("# a comment")
    text = ["\n".join(lines[:50]) + "\n", "\n".join(lines[50:]) + "\n"]
    path = spread(tmp_path / "g", ["1.gff", "2.gff"], text)
    contigs = "".join(f">c1\n{s}\n" for s in ("ACGT" * 9, "TTGCA" * 6))
    prots = "".join(f">{i} x\nM{s}\n" for i, s in records(40, 3))
    spread(tmp_path / "f", ["c.fna", "p.faa"], [contigs, prots])
    seen = set()
    for size in SPLITS[::2]:
        feats = split(size, gff.gff, path)
        assert [r.attrs["n"] for r in feats.orderBy("ord").collect()] == [str(k) for k in range(120)]
        made = genome_plan.genome("G", *(split(size, fasta.fasta, str(tmp_path / "f" / n)) for n in ("c.fna", "p.faa")), feats).graph
        nodes = sorted((r.id, tuple(sorted(r.props.items())), r.value or "", r.ord) for r in made.nodes.collect())
        edges = sorted((r.id, tuple(sorted(r.props.items())), r.ord) for r in made.edges.collect())
        seen.add(str((nodes, edges)))
    assert len(seen) == 1


def entry(k, rng):
    refs = "".join(f'<dbReference type="GO" id="GO:{j}">' + rng.choice(["", "\n"]) + f'<property type="t" value="{j}"/></dbReference>\n' for j in range(rng.randrange(4)))
    comments = "".join(
        rng.choice([
            f'<comment type="function"><text>a &lt;comment&gt; {j}\n</text></comment>\n',
            '<!-- <comment> <dbReference/> \n -->',
            '<comment type="cofactor"><cofactor><name>x</name>\n<dbReference type="ChEBI" id="CHEBI:1"/></cofactor></comment>',
            "<comment\n type='x > y'/>",
            '<comment type="m"><text><![CDATA[ <comment> <dbReference>\n ]]></text></comment>\n',
        ])
        for j in range(rng.randrange(5))
    )
    return f'<entry dataset="S"{rng.choice(["", chr(10)])}>\n<accession>A{k}</accession>{rng.choice(["", chr(10) * 3])}\n{comments}{refs}</entry>{rng.choice(["", chr(10), chr(10) * 2])}'


def plain_lines(text):
    """(accession, tag, line) of a plain parse."""
    found, path, parser = [], [], xml.parsers.expat.ParserCreate()

    def start(name, attrs):
        path.append(name)
        if len(path) == 2 and name == "entry" or len(path) == 3 and name in ("comment", "dbReference"):
            found.append((name, parser.CurrentLineNumber))

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda name: path.pop()
    parser.Parse(text, True)
    return sorted(found)


def test_source_lines_equal_a_plain_parse(spark, tmp_path, split):
    rng = random.Random(4)
    texts = []
    for name, n in (("a.xml", 40), ("b.xml", 3), ("c.xml", 25)):
        texts.append('<?xml version="1.0"?>\n<!-- <entry> -->\n<uniprot xmlns="http://uniprot.org/uniprot">\n' + "".join(entry(f"{name[0]}{k}", rng) for k in range(n)) + "\n<copyright/>\n</uniprot>\n")
    path = spread(tmp_path / "u", ["a.xml", "b.xml", "c.xml"], texts)
    want = sorted(x for t in texts for x in plain_lines(t))
    for size in (211, 5000, 1 << 27):
        rows = split(size, proteins.entries, path).orderBy("ord").collect()
        assert [r.accession[0] for r in rows] == [f"A{n}{k}" for n, m in (("a", 40), ("b", 3), ("c", 25)) for k in range(m)]
        got = [("entry", r._xml_sourceline) for r in rows]
        got += [(c, x._xml_sourceline) for r in rows for c in ("comment", "dbReference") for x in r[c] or []]
        assert sorted(got) == want
    assert [r.accession[0] for r in proteins.entries(spark, path, 2).collect()] == ["Aa0", "Aa1"]


FULL = """<uniprot>
<entry dataset="S"><accession>P1</accession>
<geneLocation type="plasmid" evidence="1"><name status="known">pX</name></geneLocation>
<reference key="1"><citation type="journal article" date="1999" name="J" volume="2" first="3" last="4"><title>T</title><authorList><person name="A B"/><person name="C D"/></authorList></citation><scope>SEQ</scope></reference>
<feature type="chain" id="F1" description="d" evidence="1 2"><location><begin position="5"/><end position="9" status="uncertain"/></location></feature>
<feature type="mod"><original>A</original><variation>B</variation><variation>C</variation><location><position position="7"/></location></feature>
<feature type="none"/>
<evidence key="1" type="ECO:1"><source ref="3"><dbReference type="PubMed" id="77"/></source><importedFrom><dbReference type="DB" id="i"/></importedFrom></evidence>
<evidence key="2" type="ECO:2"/>
</entry></uniprot>"""


def test_captures_are_nested_rows(spark, tmp_path):
    rows = proteins.entries(spark, spread(tmp_path / "v", ["a.xml"], [FULL]))
    f = [tuple(r)[2:] for r in proteins.features(rows).orderBy("pos").collect()]
    assert f[0] == (0, "chain", "F1", "d", ["1", "2"], 5, None, 9, "uncertain", None, None)
    assert f[1] == (1, "mod", None, None, None, 7, None, 7, None, "A", ["B", "C"]) and f[2][6:9:2] == (None, None)
    sources = {tuple(r)[2:] for r in proteins.evidence_sources(rows).collect()}
    assert sources == {("1", "ECO:1", "source", "3", "PubMed", "77"), ("1", "ECO:1", "importedFrom", None, "DB", "i"), ("2", "ECO:2", None, None, None, None)}
    e = proteins.plain_names(rows).first()
    assert (e.xml_sourceline, e.geneLocation[0].name[0].value, e.reference[0].citation.authorList.person[1].name, e.reference[0].scope) == (2, "pX", "C D", ["SEQ"])
    assert e.feature[0].location.begin.position == 5
