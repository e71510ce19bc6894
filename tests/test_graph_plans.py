"""Genome and model transforms over odd rows against plain dictionaries: first node wins, edges need both ends. Their edges are made with their nodes, so plans look no ends up."""

import hashlib
import json

import pytest

from biolattice.plans.genome import genome
from biolattice.plans.models import model
from biolattice.sources.models import Model

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
norm = lambda s: s.strip().replace(" ", "_")
fill = lambda s: s.replace(" ", "_")


def joined(sep, *parts):
    return sep.join(str(p) for p in parts if p is not None)


class Plain:
    def __init__(self):
        self.nodes, self.edges = {}, set()

    def node(self, label, key, order, **props):
        if key:
            at = f"{label}/{norm(key)}"
            self.nodes[at] = min(self.nodes.get(at, (order, props)), (order, props), key=lambda x: x[0])
            return at

    def edge(self, a, label, b):
        if a and b:
            self.edges.add((a, label, b))

    def checked(self, graph, *names):
        got_nodes = [(r.id, *(r.props.get(n) for n in names)) for r in graph.nodes.collect()]
        assert len(set(got_nodes)) == len(got_nodes)
        assert sorted(got_nodes, key=str) == sorted([(k, *(v[1].get(n) for n in names)) for k, v in self.nodes.items()], key=str)
        got = [(r.src_id, r.label, r.dst_id) for r in graph.edges.collect()]
        assert len(set(got)) == len(got)
        assert set(got) == {e for e in self.edges if e[0] in self.nodes and e[2] in self.nodes}
        assert all(r.id == f"{r.src_id}/{r.label}/{r.dst_id}" for r in graph.edges.collect())


CONTIGS = [("c1", "ACGTACGTAC", 0), ("c1", "TTGACCATGA", 3), ("c 2", "TTGACCATGA", 1), ("c_2", "GGGGCCCCAA", 2), ("nul", None, 4), ("", "AC", 5)]
PROTEINS = [("p1", "MKV", 0), ("p2", "MKV", 1), ("p3", "MA", 2), ("p3", "MC", 9), ("p4", None, 4)]
FEATURES = [  # contig, type, start, end, strand, tag, old, protein, ord
    ("c1", "gene", 2, 5, "+", "t1", None, None, 0), ("c1", "gene", 2, 5, "-", " t1 ", None, None, 1), ("c1", "CDS", 2, 5, "+", "t1", "o1", "p1", 2), ("c1", "CDS", 2, 5, "-", "t1", None, "p3", 3),
    ("c 2", "gene", 1, 4, "-", "t 2", None, None, 4), ("c_2", "gene", 1, 4, "+", "t_2", "t1", None, 5), ("c 2", "CDS", 1, 4, "+", "t 2", None, "p2", 6), ("no", "gene", 1, 4, "+", "t3", None, None, 7),
    ("no", "CDS", 1, 4, "+", "t3", None, "p4", 8), ("nul", "gene", 1, 4, "+", "t4", None, None, 9), ("c1", "gene", 0, 3, "+", "t5", None, None, 10), ("c1", "gene", 8, 30, None, None, "o2", None, 11),
    ("c1", "gene", 11, 30, "+", "t6", None, None, 12), ("c1", "CDS", 3, 6, "+", None, None, None, 13), (None, "gene", 1, 2, "+", "t7", "", None, 14), ("", "gene", 1, 2, "+", "t8", None, None, 15),
]


def test_genome(spark):
    rows = [(c, "s", t, a, b, ".", s, ".", {k: v for k, v in (("locus_tag", x), ("old_locus_tag", y), ("protein_id", z)) if v is not None}, o) for c, t, a, b, s, x, y, z, o in FEATURES]
    frame = lambda x, ddl: spark.createDataFrame(x, ddl).repartition(3)
    seqs = "id string, seq string, ord long"
    made = genome("G", frame(CONTIGS, seqs), frame(PROTEINS, seqs), frame(rows, "contig_id string, source string, feature_type string, start long, end long, score string, strand string, phase string, attrs map<string,string>, ord long"))
    p, lost, dna_of, protein_of = Plain(), [], {}, {}
    contig, protein = ({i: s for i, s, _ in sorted(x, key=lambda r: r[2])} for x in (CONTIGS, PROTEINS))
    g = p.node("Genome", "G", 0)
    for i, s in contig.items():
        if s is not None:
            p.edge(g, "has_contig", p.node("GenomicContig", sha(s), min(r[2] for r in CONTIGS if r[0] == i), accession=i))
    for c, t, a, b, s, x, y, z, o in FEATURES:
        f = p.node("GenomicFeature", joined("_", "G", c, t, a, b), o, strand=s, contig_id=c, gff_attr_locus_tag=x)
        tag, old = (p.node("LocusTag", n, o) if n else None for n in (x, y))
        p.edge(f, "has_locus_tag", tag)
        p.edge(tag or f, "parent" if tag else "has_locus_tag", old)
        seq = contig.get(c)
        if seq is None:
            lost += ["contig_not_found"] + ["contig_not_found_for_dna"] * (t == "gene")
        else:
            p.edge(f"GenomicContig/{sha(seq)}", "has_feature", f)
        if t == "gene" and seq and a >= 1 and (cut := seq[a - 1 : b]):
            cut = cut.translate(str.maketrans("ACGT", "TGCA"))[::-1] if s == "-" else cut
            d = p.node("DNASequence", sha(cut), o, length=str(len(cut)))
            p.edge(f, "has_dna_sequence", d)
            if x:
                dna_of[x] = d
        if t == "CDS":
            if protein.get(z) is None:
                lost.append("protein_not_found")
            else:
                d = p.node("ProteinSequence", sha(protein[z]), o, protein_id=z)
                p.edge(f, "has_protein_sequence", d)
                if x:
                    protein_of[x] = d
    for x in dna_of:
        p.edge(dna_of[x], "has_protein_translation", protein_of.get(x))
    p.checked(made.graph, "strand", "contig_id", "gff_attr_locus_tag", "protein_id", "accession")
    assert sorted(r.reason for r in made.unmatched.collect()) == sorted(lost)
    assert {(r.key, r.value) for r in made.graph.nodes.where("label = 'DNASequence'").collect()} == {(sha(r.value), r.value) for r in made.graph.nodes.where("label = 'DNASequence'").collect()}
    assert {tuple(r.labels) for r in made.graph.nodes.where("key = 'o1'").collect()} == {("OldLocusTag",)}
    # no edge is looked up among the nodes
    assert "LeftSemi" not in made.graph.edges._jdf.queryExecution().optimizedPlan().toString()


MODELS = ["m1", "m 2", "m_2", " m3"]
SPECIES = [("m1", "a", "c"), ("m1", "a b", "e"), ("m1", "a_b", "x"), ("m1", "tail ", "c"), ("m 2", "a", "c"), ("m_2", "a", "e"), (" m3", "a", "c"), ("none", "a", "c"), ("m1", "a", "e"), ("m1", "lone", None)]
GENES = [("m1", "g1"), ("m1", "g 2"), ("m1", "g_2"), ("m 2", "g1"), ("m_2", "g3"), (" m3", "g1"), ("m1", "end "), ("none", "g1")]
REACTIONS = [  # model, id, reactants, products, complexes
    ("m1", "R1", [("a", "1"), ("a", "2"), ("gone", "1")], [("a b", "3")], [["g1", "g 2"], ["g 2", "g1", "g1"], [], ["end "]]),
    ("m1", "R1", [("a", "5")], [("a_b", "1"), ("tail ", "1")], [["g_2", "new"], ["x|y"], ["x", "y"]]),
    ("m1", "R 1", [], [("a", "0.5")], [["g 2", "g_2"]]), ("m 2", "R1", [("a", "1")], [], [["g1"]]), ("m_2", "R1", [("a", "7")], [("a", "2")], [["g1"], ["g3"]]),
    (" m3", "R1", [("a", "1")], [], [["g1"]]), ("none", "R2", [("a", "1")], [("a", "1")], [["g1"], ["g9"]]), ("m1", "R3 ", [("a", "1")], [], [["g1", "g 2"]]), ("m1", "R4", None, None, None),
]


@pytest.mark.parametrize("kind", ["SBML", "COBRA"])
def test_models(spark, kind):
    side = "array<struct<species:string,stoichiometry:string>>"
    frame = lambda x, ddl: spark.createDataFrame(x, ddl).repartition(3)
    elem = lambda x: [(*r, k) for k, r in enumerate(x)]
    compartments = [(m, c) for m in [*MODELS, "none"] for c in ("c", "e")]
    m = Model(
        frame([(x, {"name": "n"}) for x in MODELS], "model_id string, props map<string,string>"),
        frame(elem([(x, {"id": c}) for x, c in compartments]), "model_id string, props map<string,string>, ord long"),
        frame(elem([(x, {"id": s} | ({"compartment": c} if c else {})) for x, s, c in SPECIES]), "model_id string, props map<string,string>, ord long"),
        frame(elem([(x, g, {"fbc:id": g}) for x, g in GENES]), "model_id string, gene_id string, props map<string,string>, ord long"),
        frame(elem([(x, {"id": r}, a, b, c) for x, r, a, b, c in REACTIONS]), f"model_id string, props map<string,string>, reactants {side}, products {side}, complexes array<array<string>>, ord long"),
    )
    graph = model(m, kind)
    p, sbml = Plain(), kind == "SBML"
    species = f"{kind}{'Species' if sbml else 'Metabolite'}"
    at = lambda label, *key: f"{label}/{fill(joined(':', *key))}"
    of_model = lambda x: f"{kind}Model/{fill(x.strip(' '))}"
    for x in MODELS:
        p.node(f"{kind}Model", x, 0)

    def element(label, x, k, order, edge, **props):
        p.node(label, joined(":", x, k), order, **props)
        p.edge(of_model(x), edge, at(label, x, k))

    for k, (x, c) in enumerate(compartments):
        element(f"{kind}Compartment", x, c, k, "has_compartment", id=c)
    for k, (x, s, c) in enumerate(SPECIES):
        element(species, x, s, k, "has_species", id=s, compartment=c)
        if (x, c) in compartments:
            p.edge(at(species, x, s), "has_compartment", at(f"{kind}Compartment", x, c))
    for k, (x, g) in enumerate(GENES):
        element(f"{kind}Gene", x, g, k, "has_gene", **{"fbc:id": g})
    values = {}
    for k, (x, r, a, b, c) in enumerate(REACTIONS):
        element(f"{kind}Reaction", x, r, k, "has_reaction", id=r)
        for n, group in enumerate(c or []):
            genes = sorted(set(group))
            if genes:
                key = sha("|".join(genes))
                p.node(f"{kind}Complex", f"{x}:{key}", k * 4096 + n, genes=json.dumps(genes, separators=(",", ":")))
                p.edge(at(f"{kind}Reaction", x, r), "has_gpr_complex", at(f"{kind}Complex", x, key))
                for g in genes:
                    if sbml and (x, g) not in GENES:
                        element(f"{kind}Gene", x, g, k + (1 << 40), "has_gene", id=g)
                    if sbml or (x, g) in GENES:
                        p.edge(at(f"{kind}Complex", x, key), "has_gene", at(f"{kind}Gene", x, g))
        for sign, part in ((-1, a or []), (1, b or [])):
            for s, v in part:
                if (x, s) in [z[:2] for z in SPECIES]:
                    edge = (at(f"{kind}Reaction", x, r), ("has_product" if sign > 0 else "has_reactant") if sbml else "has_stoichiometry_coefficient", at(species, x, s))
                    p.edge(*edge)
                    values[edge] = v if sbml else str(float(v) * sign)
    p.checked(graph, "id", "compartment", "genes", "fbc:id")
    got = {(r.src_id, r.label, r.dst_id): r.props for r in graph.edges.collect() if r.props}
    assert {e: v for e, v in values.items() if e[0] in p.nodes and e[2] in p.nodes} == {e: v["stoichiometry" if sbml else "coefficient"] for e, v in got.items()}
    # ends are not looked up among the nodes
    plan = graph.edges._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "LeftSemi" in x and ("dst_id" in x or "src_id" in x)]


def test_attributes_are_read_without_building_maps(spark):
    from pyspark.sql import functions as F

    seqs = spark.createDataFrame([("c1", "ACGT", 0)], "id string, seq string, ord long")
    text = lambda v, name: F.lit(v).alias(name)
    rows = spark.range(4).select(
        text("c1", "contig_id"), text("s", "source"), text("gene", "feature_type"), F.lit(1).cast("long").alias("start"), F.col("id").alias("end"), text(".", "score"), text("+", "strand"), text(".", "phase"),
        F.create_map(F.lit("locus_tag"), F.concat(F.lit("t"), "id"), F.lit("protein_id"), F.lit("c1")).alias("attrs"), F.col("id").alias("ord"),
    )
    edges = genome("G", seqs, seqs, rows).graph.edges
    assert "map(locus_tag" not in edges._jdf.queryExecution().optimizedPlan().toString()
    assert edges.where("label = 'has_locus_tag'").count() == 4 and edges.where("label = 'has_dna_sequence'").count() == 3
