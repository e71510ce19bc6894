"""File sources and composite transforms on small fixtures."""

import gzip
import hashlib
import json

import pytest

from biolattice.plans import biochem as biochem_plan
from biolattice.plans import genome as genome_plan
from biolattice.plans import models as model_plan
from biolattice.plans import proteins as protein_plan
from biolattice.sources import biochem, fasta, fitness, gff, models, proteins, summaries, xmlblocks
from pyspark.sql import functions as F

GFF = """##gff-version 3
c1\tsrc\tgene\t1\t6\t.\t+\t.\tlocus_tag=b1;old_locus_tag=o1
c1\tsrc\tCDS\t1\t6\t.\t+\t0\tlocus_tag=b1;protein_id=P1
c1\tsrc\tgene\t5\t10\t.\t-\t.\tlocus_tag=b2
c1\tsrc\tCDS\t5\t10\t.\t-\t0\tlocus_tag=b2;protein_id=PX
c9\tsrc\tgene\t1\t3\t.\t+\t.\tlocus_tag=b3
too\tfew\tfields
"""


def counts(g):
    return {(r.kind, r.label): r.n for r in g.summary().collect()}


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode()) if path.name.endswith(".gz") else text.encode())
    return str(path)


@pytest.mark.parametrize("suffix", ["", ".gz"])
def test_genome(spark, tmp_path, suffix):
    contigs = fasta.fasta(spark, write(tmp_path / f"c.fna{suffix}", ">c1 a contig -> x > y\nACGTAC\r\nGTAC\n"))
    prot = fasta.fasta(spark, write(tmp_path / f"p.faa{suffix}", ">P1 protein\nMK\nV\n>P2\n\n"))
    feats = gff.gff(spark, write(tmp_path / f"f.gff{suffix}", GFF))
    assert [(r.id, r.description, r.seq) for r in contigs.collect()] == [("c1", "a contig -> x > y", "ACGTACGTAC")]
    assert [(r.id, r.seq) for r in prot.orderBy("ord").collect()] == [("P1", "MKV"), ("P2", "")]
    assert feats.count() == 5 and feats.first().attrs == {"locus_tag": "b1", "old_locus_tag": "o1"}
    made = genome_plan.genome("G", contigs, prot, feats)
    assert counts(made.graph) == {
        ("node", "Genome"): 1, ("node", "GenomicContig"): 1, ("node", "GenomicFeature"): 5, ("node", "LocusTag"): 4, ("node", "DNASequence"): 2, ("node", "ProteinSequence"): 1,
        ("edge", "has_contig"): 1, ("edge", "has_feature"): 4, ("edge", "has_locus_tag"): 5, ("edge", "parent"): 1, ("edge", "has_dna_sequence"): 2, ("edge", "has_protein_sequence"): 1, ("edge", "has_protein_translation"): 1,
    }
    assert sorted(r.reason for r in made.unmatched.collect()) == ["contig_not_found", "contig_not_found_for_dna", "protein_not_found"]
    assert {r.value for r in made.graph.of_label("DNASequence").collect()} == {"ACGTAC", "GTACGT"}
    for r in made.graph.nodes.where("value is not null").collect():
        assert r.key == hashlib.sha256(r.value.encode()).hexdigest() and len(r.key) == 64
    feature = made.graph.node("GenomicFeature", "G_c1_gene_1_6").first()
    assert feature.props["gff_attr_locus_tag"] == "b1" and feature.props["start"] == "1" and feature.props["strand"] == "+"
    old = made.graph.node("LocusTag", "o1").first()
    assert old.labels == ["OldLocusTag"]


def test_gff_attributes(spark):
    rows = spark.createDataFrame([("a=b=c; flag ;d = e;a=z;=x",), (".",), (None,)], "s string").select(gff.attributes(F.col("s")).alias("m")).collect()
    assert [r.m for r in rows] == [{"a": "z", "d": "e", "": "x"}, {}, {}]


MODEL = {
    "id": "M", "name": "mini", "version": "1", "compartments": {"c": "cytosol", "e": "outside"},
    "metabolites": [{"id": "a_c", "name": "A", "compartment": "c", "formula": "C", "charge": 0}, {"id": "b_c", "compartment": "c"}, {"id": "a_e", "compartment": "e"}],
    "reactions": [
        {"id": "R1", "name": "one", "metabolites": {"a_c": -1.0, "b_c": 2.0, "zero": 0}, "lower_bound": -10, "gene_reaction_rule": "(g1 and g2) or g3", "subsystem": "x"},
        {"id": "R2", "metabolites": {"a_e": -1, "a_c": 1e-05, "z_c": 1}, "gene_reaction_rule": "g1 and g2"},
    ],
    "genes": [{"id": "g1", "name": "G1", "annotation": {"sbo": ["SBO:1"], "fbc:label": "spread"}}, {"id": "g2"}],
}


def test_cobra_json(spark, tmp_path):
    path = write(tmp_path / "m.json", json.dumps(MODEL))
    m = models.cobra_json(spark, path)
    r = {x.props["id"]: x for x in m.reactions.collect()}
    assert r["R1"].reactants == [("a_c", "1.0")] and r["R1"].products == [("b_c", "2.0")] and r["R1"].complexes == [["g1", "g2"], ["g3"]]
    assert r["R2"].products[0] == ("a_c", "1e-05") or float(r["R2"].products[0].stoichiometry) == 1e-05
    assert "metabolites" not in r["R1"].props and r["R1"].props["subsystem"] == "x"
    g = {x.gene_id: x.props for x in m.genes.collect()}
    assert g["g1"]["fbc:label"] == "spread" and json.loads(g["g1"]["sbo"]) == ["SBO:1"] and g["g2"] == {"fbc:id": "g2", "fbc:label": "g2"}
    assert m.models.first().props["_file_sha256"] == hashlib.sha256(json.dumps(MODEL).encode()).hexdigest()
    made = model_plan.model(m, "COBRA")
    assert counts(made) == {
        ("node", "COBRAModel"): 1, ("node", "COBRACompartment"): 2, ("node", "COBRAMetabolite"): 3, ("node", "COBRAGene"): 2, ("node", "COBRAReaction"): 2, ("node", "COBRAComplex"): 2,
        ("edge", "has_compartment"): 5, ("edge", "has_species"): 3, ("edge", "has_gene"): 4, ("edge", "has_reaction"): 2, ("edge", "has_stoichiometry_coefficient"): 4, ("edge", "has_gpr_complex"): 3,
    }
    signed = {r.id: float(r.props["coefficient"]) for r in made.edges.where("label = 'has_stoichiometry_coefficient'").collect()}
    assert signed["COBRAReaction/M:R1/has_stoichiometry_coefficient/COBRAMetabolite/M:a_c"] == -1 and signed["COBRAReaction/M:R1/has_stoichiometry_coefficient/COBRAMetabolite/M:b_c"] == 2
    assert not any(k.startswith("_") for r in made.nodes.collect() for k in r.props)
    moved = model_plan.translated(m, spark.createDataFrame([("a_c", "cpd1")], "old_id string, new_id string"), spark.createDataFrame([("c", "c0")], "old_id string, new_id string"), spark.createDataFrame([("b_c",)], "id string"), "^R2")
    assert [r.reactants for r in moved.reactions.collect()] == [[("cpd1", "1.0")]] and moved.reactions.first().products == []
    assert {r.props["id"] for r in moved.species.collect()} == {"cpd1", "a_e"} and {r.props["id"] for r in moved.compartments.collect()} == {"c0", "e"}
    assert {r.props["compartment"] for r in moved.species.collect()} == {"c0", "e"}


SBML = """<?xml version="1.0"?>
<sbml xmlns="http://www.sbml.org/sbml/level3/version1/core" xmlns:fbc="http://fbc" xmlns:groups="http://groups" xmlns:html="http://www.w3.org/1999/xhtml">
<model id="M" fbc:strict="true"><listOfUnitDefinitions><unitDefinition id="u"><listOfUnits><unit kind="mole" scale="-3"/></listOfUnits></unitDefinition></listOfUnitDefinitions>
<listOfCompartments><compartment id="c"/><compartment id="e"/></listOfCompartments>
<listOfSpecies><species id="a_c" compartment="c" fbc:charge="1"/><species id="b_c"
  compartment="c"/><species id="a_e" compartment="e"></species></listOfSpecies>
<listOfParameters><parameter id="lb" value="-1000"/></listOfParameters>
<fbc:listOfGeneProducts><fbc:geneProduct fbc:id="g1" fbc:label="G>1"/><fbc:geneProduct fbc:id="g2"/></fbc:listOfGeneProducts>
<listOfReactions><reaction id="R1"><listOfReactants><speciesReference species="a_c" stoichiometry="1"/></listOfReactants><listOfProducts><speciesReference species="b_c"/></listOfProducts>
<fbc:geneProductAssociation><fbc:or><fbc:and><fbc:geneProductRef fbc:geneProduct="g1"/><fbc:geneProductRef fbc:geneProduct="g2"/></fbc:and><fbc:geneProductRef fbc:geneProduct="g3"/></fbc:or></fbc:geneProductAssociation></reaction>
<reaction id="R2"><notes><html:p>GENE_ASSOCIATION: (g1 or g2) and g4</html:p></notes><listOfReactants><speciesReference species="a_e" stoichiometry="1"/></listOfReactants><listOfProducts><speciesReference species="a_c" stoichiometry="1"/><speciesReference species="z_c" stoichiometry="1"/></listOfProducts></reaction>
<reaction id="R3"><fbc:geneProductAssociation><fbc:and><fbc:or><fbc:geneProductRef fbc:geneProduct="g1"/><fbc:geneProductRef fbc:geneProduct="g2"/></fbc:or><fbc:geneProductRef fbc:geneProduct="g3"/></fbc:and></fbc:geneProductAssociation></reaction></listOfReactions>
<fbc:listOfObjectives><fbc:objective fbc:id="obj"><fbc:listOfFluxObjectives><fbc:fluxObjective fbc:reaction="R1" fbc:coefficient="1"/></fbc:listOfFluxObjectives></fbc:objective></fbc:listOfObjectives>
<groups:listOfGroups><groups:group groups:id="G"><groups:listOfMembers><groups:member groups:idRef="R1"/></groups:listOfMembers></groups:group></groups:listOfGroups>
</model></sbml>
"""


def test_sbml(spark, tmp_path):
    path = write(tmp_path / "m.xml", SBML)
    rows = models.sbml_elements(spark, path).collect()
    data = SBML.encode()
    for r in rows:
        assert data[r.start : r.end].decode() == r.raw_xml and r.raw_xml.startswith("<") and r.raw_xml.endswith(">") and r.file_sha256 == hashlib.sha256(data).hexdigest()
        assert r.row == data[: r.start].count(b"\n") + 1
    by = {(r.element, r.attrs.get("id") or r.attrs.get("fbc:id") or r.attrs.get("groups:id")): r for r in rows}
    assert by["species", "b_c"].raw_xml == '<species id="b_c"\n  compartment="c"/>' and by["species", "a_e"].raw_xml.endswith("</species>")
    assert by["species", "b_c"].xpath == "/sbml[1]/model[1]/listOfSpecies[1]/species[2]" and by["species", "a_c"].attrs["fbc:charge"] == "1"
    assert by["geneProduct", "g1"].attrs["fbc:label"] == "G>1" and by["unitDefinition", "u"].children == [{"kind": "mole", "scale": "-3"}]
    assert by["objective", "obj"].children[0]["fbc:reaction"] == "R1" and by["group", "G"].children == [{"groups:idRef": "R1"}]
    assert by["reaction", "R1"].complexes == [["g1", "g2"], ["g3"]] and by["reaction", "R2"].complexes == [["g1", "g4"], ["g2", "g4"]] and by["reaction", "R3"].complexes == [["g1", "g2", "g3"]]
    assert by["reaction", "R1"].products == [("b_c", None)]
    m = models.sbml(spark, path)
    assert m.extras.count() == 4
    made = model_plan.model(m, "SBML")
    got = counts(made)
    assert got["node", "SBMLGene"] == 4 and got["edge", "has_reactant"] == 2 and got["edge", "has_product"] == 2 and got["node", "SBMLComplex"] == 5
    assert got["edge", "has_compartment"] == 5 and got["edge", "has_gpr_complex"] == 5
    kept = made.node("SBMLReaction", "M:R1").first().props
    assert "_raw_xml" in kept and "_row" not in kept
    assert {r.id: r.props for r in made.edges.where("label = 'has_product'").collect()}["SBMLReaction/M:R1/has_product/SBMLSpecies/M:b_c"] == {}


def test_biochem(spark, tmp_path):
    cpds = [{"id": "cpd1", "name": "A", "aliases": ["x"], "notes": ["n1", "n2"], "charge": None}, {"id": "cpd2", "name": "B"}]
    rxns = [{"id": "rxn1", "name": "r", "ec_numbers": ["1.1", "2.2"], "pathways": None, "aliases": ["q"], "thermodynamics": {"eQuilibrator": [1.5, 0.1], "Group contribution": [2, 3]},
             "stoichiometry": [{"compound": "cpd1", "coefficient": -1, "compartment": 0}, {"compound": "cpd9", "coefficient": 1, "compartment": 0}, {"compound": "cpd1", "coefficient": 1, "compartment": 1}]}]
    write(tmp_path / "Biochemistry/compound_00.json", json.dumps(cpds))
    write(tmp_path / "Biochemistry/compound_01.json", json.dumps([{"id": "cpd2", "name": "B2"}]))
    write(tmp_path / "Biochemistry/reaction_00.json", json.dumps(rxns))
    g = biochem_plan.biochem(*biochem.biochem(spark, str(tmp_path)))
    assert counts(g) == {("node", "ModelSEEDCompound"): 3, ("node", "ModelSEEDReaction"): 1, ("edge", "has_stoichiometry_coefficient"): 2}
    by = {r.key: r.props for r in g.nodes.collect()}
    assert by["cpd1"] == {"id": "cpd1", "name": "A", "notes": "n1; n2"} and by["cpd2"]["name"] == "B2" and by["cpd9"] == {}
    r = by["rxn1"]
    assert r["ec_numbers"] == "1.1; 2.2" and float(r["deltag_eQuilibrator"]) == 1.5 and float(r["deltagerr_group_contribution"]) == 3 and not {"id", "aliases", "stoichiometry", "thermodynamics", "pathways"} & set(r)
    assert {r.dst_id: r.props["coefficient"] for r in g.edges.collect()}["ModelSEEDCompound/cpd1"] == "1"
    with pytest.raises(ValueError):
        biochem.biochem(spark, str(tmp_path / "none"))


UNIPROT = """<?xml version="1.0"?>
<uniprot xmlns="http://uniprot.org/uniprot">
<entry dataset="Swiss-Prot" created="2000-01-01"><accession>P2</accession><accession>P1</accession><name>N_X</name>
<protein><recommendedName><fullName evidence="1">kinase</fullName><ecNumber>1.1.1.1</ecNumber></recommendedName></protein><gene><name type="primary">abc</name></gene>
<comment type="catalytic activity"><reaction evidence="1"><text>x</text><dbReference type="Rhea" id="RHEA:1"/><dbReference type="EC" id="1.1.1.1"/></reaction></comment>
<comment type="catalytic activity"><reaction><dbReference type="Rhea" id="RHEA:2"/></reaction><reaction><dbReference type="Rhea" id="RHEA:3"/></reaction></comment>
<comment type="catalytic activity"><reaction><dbReference type="EC" id="9.9"/></reaction></comment>
<comment type="cofactor"><cofactor evidence="1 2"><name>Mg</name><dbReference type="ChEBI" id="CHEBI:1"/></cofactor></comment>
<comment type="subcellular location"><subcellularLocation><location evidence="2">Cytoplasm</location><location>Membrane</location></subcellularLocation></comment>
<dbReference type="KEGG" id="eco:b1"/><dbReference type="AlphaFoldDB" id="P1"/><dbReference type="EC" id="1.1.1.1"/><dbReference type="GO" id="GO:1"><property type="term" value="C:x"/></dbReference>
<evidence key="1" type="ECO:1"/><evidence key="2" type="ECO:2"/><sequence length="4" mass="1" checksum="C"> mkv* </sequence></entry>
<entry dataset="Swiss-Prot"><accession>Q1</accession><name>M</name></entry>
</uniprot>
"""


def test_protein_entries(spark, tmp_path):
    rows = proteins.entries(spark, write(tmp_path / "u.xml", UNIPROT))
    assert rows.count() == 2 and proteins.entries(spark, str(tmp_path / "u.xml"), 1).count() == 1
    e = rows.where("_created is not null").first()
    assert e.protein.recommendedName.fullName._VALUE == "kinase" and e.gene[0].name[0]._type == "primary" and e.dbReference[3].property[0]._value == "C:x"
    g = protein_plan.entries(rows)
    got = counts(g)
    assert got["node", "uniprotkb_sprot"] == 2 and got["node", "uniprotkb_accession"] == 3 and got["node", "eco_term"] == 2 and got["node", "RHEA_reaction"] == 1
    assert got["node", "EC_number"] == 1 and got["edge", "uniprotkb_sprot_has_ec"] == 1 and got["edge", "uniprotkb_sprot_has_catalytic_activity_ec_number"] == 1
    assert got["edge", "uniprotkb_sprot_has_subcell"] == 2 and got["edge", "uniprotkb_sprot_has_cofactor_chebi_term"] == 1 and got["edge", "uniprotkb_sprot_has_reference_to_kegg_gene"] == 1
    eco = {(r.label.rpartition("_has_")[2], r.dst_id): r.props.get("eco") for r in g.edges.collect()}
    assert eco["catalytic_activity_rhea_reaction", "RHEA_reaction/RHEA:1"] == "ECO:1" and eco["cofactor_chebi_term", "ChEBI_term/CHEBI:1"] is None
    assert eco["subcell", "uniprotkb_subcell/Cytoplasm"] == "ECO:2" and eco["subcell", "uniprotkb_subcell/Membrane"] is None
    seq = g.of_label("re_seq_protein").first()
    assert seq.key == "06101e170c22fd1e3eb5769d9ec67e9b76a226c73f20c30aa46e2436cb60abce" and seq.props == {"size": "4"}
    assert g.node("uniprotkb_sprot", "P1_P2").count() == 1


def test_protein_api(spark, tmp_path):
    rows = [
        {"entryType": "UniProtKB reviewed (Swiss-Prot)", "primaryAccession": "P2", "secondaryAccessions": ["P1"], "genes": [{"a": 1}], "sequence": {"value": "mkv*", "length": 4}},
        {"entryType": "UniProtKB unreviewed (TrEMBL)", "primaryAccession": "A1", "uniProtkbId": "A_B"},
    ]
    path = write(tmp_path / "a.json", "\n".join(map(json.dumps, rows)))
    g = protein_plan.api_entries(proteins.api_entries(spark, path))
    got = counts(g)
    assert got["node", "uniprotkb_sprot"] == got["node", "uniprotkb_trembl"] == 1 and got["node", "uniprotkb_accession"] == 3 and got["edge", "uniprotkb_sprot_has_accession"] == 2
    assert json.loads(g.node("uniprotkb_sprot", "P1_P2").first().props["gene"]) == [{"a": 1}] and g.node("uniprotkb_trembl", "A1").first().props["name"] == '["A_B"]'
    for bad in ("Inactive", "other"):
        path = write(tmp_path / f"{bad}.json", json.dumps({"entryType": bad, "primaryAccession": "X"}))
        with pytest.raises(Exception, match="entry is inactive|entry of unknown type"):
            protein_plan.api_entries(proteins.api_entries(spark, path)).nodes.collect()


def test_clusters(spark, tmp_path):
    xml = """<UniRef><entry id="UniRef50_A" updated="x"><name>Cluster</name><property type="member count" value="2"/><property type="t" value="1"/><property type="t" value="2"/>
<representativeMember><dbReference type="UniProtKB ID" id="A_B"><property type="acc" value="P1"/><property type="acc" value="P2"/></dbReference><sequence length="3" checksum="z">MK
V</sequence></representativeMember><member><dbReference type="UniParc ID" id="U"/></member></entry></UniRef>"""
    r = proteins.clusters(spark, write(tmp_path / "r.xml", xml)).first()
    assert r.id == "UniRef50_A" and r.properties == {"member count": ["2"], "t": ["1", "2"]}
    assert r.representative_members[0].sequence.value == "MKV" and r.representative_members[0].db_reference[0].properties == {"acc": ["P1", "P2"]}
    assert r.members[0].db_reference[0].id == "U"


def test_summaries_and_links(spark, tmp_path):
    xml = """<eSummaryResult><DocumentSummarySet><DocumentSummary uid="1"><Taxid>562</Taxid><Coverage>1.5</Coverage><Organism>E</Organism></DocumentSummary>
<DocumentSummary uid="2"><Taxid>bad</Taxid><Coverage>x</Coverage><Organism>F</Organism></DocumentSummary></DocumentSummarySet></eSummaryResult>"""
    rows = {r._uid: r for r in summaries.summaries(spark, write(tmp_path / "s.xml", xml)).collect()}
    assert (rows["1"].Taxid, rows["1"].Coverage, rows["2"].Taxid, rows["2"].Organism) == (562, 1.5, None, "F")
    old = '<eSummaryResult><DocSum><Id>7</Id><Item Name="A" Type="String">x</Item><Item Name="B" Type="Integer">2</Item></DocSum></eSummaryResult>'
    r = summaries.doc_sums(spark, write(tmp_path / "d.xml", old)).first()
    assert (r.id, r["items"]) == ("7", {"A": "x", "B": "2"})
    link = "<r><LinkSet><LinkSetDb><Link><Id>5</Id></Link><Link><Id>6</Id></Link><Link><Id>5</Id></Link></LinkSetDb></LinkSet></r>"
    assert sorted(r.id for r in summaries.link_sets(spark, write(tmp_path / "l.xml", link)).collect()) == [5, 6]
    cache = spark.createDataFrame([("a", 1)], "key string, v int")
    wanted = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    got, fetched = summaries.read_through(wanted, cache, lambda k: k.withColumn("v", F.lit(2)))
    assert {tuple(r) for r in got.collect()} == {("a", 1), ("b", 2)} and fetched.count() == 1
    assert [r[0] for r in spark.createDataFrame([("", "g"), ("r", "g"), (None, None)], "a string, b string").select(summaries.preferred_path(F.col("a"), F.col("b"))).collect()] == ["g", "r", None]
    page = summaries.search(spark.range(30), F.col("id") % 2 == 0, "id", 3, 2)
    assert [r.id for r in page.collect()] == [4, 6, 8]


def test_fitness_and_blocks(spark, tmp_path):
    write(tmp_path / "t_scores/org.tsv", "locus\tv\nb1\t1.5\n")
    write(tmp_path / "proteins/org.fasta", ">p x\nMK\n")
    assert [tuple(r) for r in fitness.dataset(spark, str(tmp_path), "t_scores", "org").collect()] == [("b1", "1.5", "org")]
    assert fitness.dataset(spark, str(tmp_path), "proteins", "org").first().seq == "MK"
    for bad in (("nope", "org", ()), ("genes", "x", ("org",))):
        with pytest.raises(ValueError):
            fitness.dataset(spark, str(tmp_path), *bad)
    got = {r.id: r.block for r in xmlblocks.blocks(spark.range(103), "id", 10).collect()}
    assert got == {k: k // 10 for k in range(103)}
    xmlblocks.split(spark.range(25).coalesce(1), str(tmp_path / "blocks"), 10)
    assert len(list((tmp_path / "blocks").glob("part-*"))) == 3
