"""Protein knowledge-base entries as graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import digest, node_id
from ..operators.graph import Graph, edges, first_wins, nodes, props

NAMES = "has_ec has_subcell has_accession has_protein_sequence has_reference_to_kegg_gene has_reference_to_alphafolddb has_cofactor_chebi_term has_catalytic_activity_rhea_reaction has_catalytic_activity_ec_number".split()


def _listed(c: str, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind)) if kind else F.col(c)


def _eco(evidence: Column) -> Column:
    """Terms of an evidence key; a string of several keys names none."""
    kinds = F.transform(F.filter("evidence", lambda e: e["_key"] == evidence), lambda e: e["_type"])
    return F.when(F.size(kinds) > 0, F.array_join(F.array_sort(F.array_distinct(kinds)), ","))


def _ids(refs: Column, kind: str) -> Column:
    return F.transform(F.filter(refs, lambda r: r["_type"] == kind), lambda r: r["_id"])


def entries(rows: DataFrame, kind: str = "sprot", hash_store: bool = True) -> Graph:
    """Accessions, evidence terms, locations, reactions, cofactors, references and sequences of entries read by sources.proteins.

    Catalytic activities count if their comment has exactly one reaction with a Rhea id.  Evidence is attached where it is a single known key.  Edges are
    kept as they come, repeats too; of nodes that repeat the entry with the smallest ord counts.
    """
    label, edge = f"uniprotkb_{kind}", {n: f"uniprotkb_{kind}_{n}" for n in NAMES}
    r = rows.where(F.size("accession") > 0).withColumn("_key", F.array_join(F.array_sort("accession"), "_"))
    r = r.withColumn("_at", node_id(label, F.col("_key"))).withColumn("evidence", F.coalesce(F.transform("evidence", lambda e: F.struct(e["_key"].alias("_key"), e["_type"].alias("_type"))), F.array().cast("array<struct<_key:string,_type:string>>")))
    kept = props(**{c: F.to_json(c) for c in ("gene", "proteinExistence", "protein", "comment")}, name=F.to_json("name"))
    comments = r.select("_at", "ord", "evidence", F.explode("comment").alias("c"))
    of = lambda t: comments.where(F.col("c._type") == t)
    places = of("subcellular location").select("_at", "ord", "evidence", F.explode("c.subcellularLocation").alias("s")).select("_at", "ord", "evidence", F.explode("s.location").alias("l"))
    places = places.select("_at", "ord", F.col("l._VALUE").alias("k"), _eco(F.col("l._evidence")).alias("eco"))
    one = of("catalytic activity").where(F.size("c.reaction") == 1).select("_at", "ord", "evidence", F.col("c.reaction")[0].alias("x"))
    one = one.select("_at", "ord", F.element_at(F.concat(F.array(F.lit(None).cast("string")), _ids(F.col("x.dbReference"), "Rhea")), -1).alias("k"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), _ids(F.col("x.dbReference"), "EC")), -1).alias("ec"), _eco(F.col("x._evidence")).alias("eco")).where("k is not null")
    cofactors = of("cofactor").select("_at", "ord", "evidence", F.explode("c.cofactor").alias("x"))
    cofactors = cofactors.select("_at", "ord", F.element_at(F.concat(F.array(F.lit(None).cast("string")), _ids(F.col("x.dbReference"), "ChEBI")), -1).alias("k"), _eco(F.col("x._evidence")).alias("eco")).where("k is not null")
    refs = r.select("_at", "ord", F.explode("dbReference").alias("d")).select("_at", "ord", F.col("d._type").alias("t"), F.col("d._id").alias("k"))
    accession = r.select("_at", "ord", F.explode("accession").alias("k"))
    seq = r.select("_at", "ord", F.regexp_replace("sequence._VALUE", r"\A\s+|\s+\z", "").alias("s")).where("s <> ''")
    seq = seq.withColumn("k", digest("s", "protein") if hash_store else F.col("s"))
    terms = r.select("ord", F.explode("evidence").alias("e")).select("ord", F.col("e._type").alias("k"))
    targets = [
        (accession, "uniprotkb_accession", "has_accession", False),
        (places, "uniprotkb_subcell", "has_subcell", True),
        (one, "RHEA_reaction", "has_catalytic_activity_rhea_reaction", True),
        (one.select("_at", "ord", F.col("ec").alias("k")).where("k is not null"), "EC_number", "has_catalytic_activity_ec_number", False),
        (cofactors, "ChEBI_term", "has_cofactor_chebi_term", True),
        (refs.where("t = 'KEGG'"), "kegg_gene", "has_reference_to_kegg_gene", False),
        (refs.where("t = 'AlphaFoldDB'"), "alphafolddb", "has_reference_to_alphafolddb", False),
        (refs.where("t = 'EC'"), "EC_number", "has_ec", False),
    ]
    node_parts = [nodes(r, label, "_key", kept), nodes(terms, "eco_term", "k"), nodes(seq, "re_seq_protein", "k", props(size=F.length("s")))]
    edge_parts = [edges(seq, "_at", edge["has_protein_sequence"], node_id("re_seq_protein", F.col("k")))]
    for df, to, name, evidence in targets:
        node_parts.append(nodes(df, to, "k"))
        edge_parts.append(edges(df, "_at", edge[name], node_id(to, F.col("k")), props(eco=F.col("eco")) if evidence else None))
    return Graph.build(node_parts, edge_parts, keep_all_edges=True)


def api_entries(rows: DataFrame) -> Graph:
    """Accessions and sequences of entries of the API, whose ord decides between repeats; inactive entries and unknown types fail the query."""
    kind = (
        F.when(F.col("entryType") == "UniProtKB reviewed (Swiss-Prot)", "sprot")
        .when(F.col("entryType") == "UniProtKB unreviewed (TrEMBL)", "trembl")
        .when(F.col("entryType") == "Inactive", F.raise_error(F.concat(F.lit("entry is inactive: "), F.coalesce("primaryAccession", F.lit("")))).cast("string"))
        .otherwise(F.raise_error(F.concat(F.lit("entry of unknown type: "), F.coalesce("entryType", F.lit("null")))).cast("string"))
    )
    r = rows.withColumn("_kind", kind)
    r = r.withColumn("_ids", F.concat(F.array("primaryAccession"), F.coalesce("secondaryAccessions", F.array().cast("array<string>"))))
    r = r.withColumn("_key", F.array_join(F.array_sort("_ids"), "_")).withColumn("_label", F.concat(F.lit("uniprotkb_"), F.col("_kind"))).withColumn("_at", node_id(F.col("_label"), F.col("_key")))
    kept = props(gene=F.col("genes"), proteinExistence=F.col("proteinExistence"), protein=F.col("proteinDescription"), name=F.to_json(F.array_compact(F.array("uniProtkbId"))), comment=F.col("comments"))
    accession = r.select("_at", "_kind", "ord", F.explode("_ids").alias("k"))
    seq = r.where("sequence.value is not null").select("_at", "_kind", "ord", F.col("sequence.value").alias("s")).withColumn("k", digest("s", "protein"))
    name = lambda n: F.concat(F.lit("uniprotkb_"), F.col("_kind"), F.lit("_" + n))
    return Graph(
        first_wins(nodes(r, F.col("_label"), "_key", kept).unionByName(nodes(accession, "uniprotkb_accession", "k")).unionByName(nodes(seq, "re_seq_protein", "k", props(size=F.length("s"))))),
        edges(accession, "_at", name("has_accession"), node_id("uniprotkb_accession", F.col("k"))).unionByName(edges(seq, "_at", name("has_protein_sequence"), node_id("re_seq_protein", F.col("k")))),
    )
