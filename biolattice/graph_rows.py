"""Registered queries that compare composite transforms row by row: ids, keys and properties of nodes, ends of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.graph import Graph
from .queries import _t, genome_graph, query


def _props(c: Column | str) -> Column:
    """A map as text: its entries in order of keys."""
    entries = F.array_sort(F.map_entries(c))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def _rows(g: Graph, *without: str) -> DataFrame:
    """(kind, label, id, props) of all nodes and edges, without some properties."""
    kept = F.map_filter("props", lambda k, v: ~k.isin(*without)) if without else F.col("props")
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), "label", "id", _props(kept).alias("props"))
    return one(g.nodes, "node").unionByName(one(g.edges, "edge"))


@query("""
WITH contig AS (SELECT 'c' || s_suppkey AS id, s_suppkey AS ord, translate(sha256(s_name), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM supplier),
protein AS (SELECT 'P' || p_partkey AS id, upper(p_type) AS seq FROM part),
f AS (SELECT 'c' || (l_suppkey + l_linenumber % 2 * 3) AS contig_id, CASE WHEN l_linestatus = 'O' THEN 'gene' ELSE 'CDS' END AS type, l_linenumber AS s, l_linenumber + 10 + l_partkey % 5 AS e,
  l_returnflag = 'R' AS minus, 'b' || l_orderkey AS tag, 'P' || (l_partkey + l_linenumber % 2 * 100) AS protein_id,
  ((l_linenumber::BIGINT * 1073741824 + l_partkey) * 8388608 + l_suppkey) * 2 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS ord FROM lineitem),
g AS (SELECT f.*, 'GenomicFeature/G_' || contig_id || '_' || type || '_' || s || '_' || e AS fid, 'GenomicContig/' || sha256(c.seq) AS cid, c.seq AS cseq, substr(c.seq, s, e - s + 1) AS cut, p.seq AS pseq
  FROM f LEFT JOIN contig c ON c.id = contig_id LEFT JOIN protein p ON p.id = protein_id AND type = 'CDS'),
d AS (SELECT *, CASE WHEN type = 'gene' AND cseq IS NOT NULL THEN CASE WHEN minus THEN reverse(translate(cut, 'ACGT', 'TGCA')) ELSE cut END END AS dna FROM g),
h AS (SELECT *, 'DNASequence/' || sha256(dna) AS did, 'ProteinSequence/' || sha256(pseq) AS pid FROM d)
SELECT 'node' AS kind, 'Genome' AS label, 'Genome/G' AS id, '' AS props
UNION ALL SELECT 'node', 'GenomicContig', 'GenomicContig/' || sha256(seq), 'accession=' || arg_min(id, ord) || ';length=64' FROM contig GROUP BY seq
UNION ALL SELECT 'node', 'GenomicFeature', fid, 'contig_id=' || any_value(contig_id) || ';end=' || any_value(e) || ';feature_type=' || any_value(type) || ';gff_attr_protein_id=' || arg_min(protein_id, ord)
  || ';phase=.;score=.;source=table;start=' || any_value(s) || ';strand=' || CASE WHEN arg_min(minus, ord) THEN '-' ELSE '+' END FROM h GROUP BY fid
UNION ALL SELECT DISTINCT 'node', 'LocusTag', 'LocusTag/' || tag, '' FROM h
UNION ALL SELECT DISTINCT 'node', 'DNASequence', did, 'length=' || length(dna) FROM h WHERE dna <> ''
UNION ALL SELECT 'node', 'ProteinSequence', pid, 'length=' || length(any_value(pseq)) || ';protein_id=' || arg_min(protein_id, ord) FROM h WHERE pseq IS NOT NULL GROUP BY pid
UNION ALL SELECT DISTINCT 'edge', 'has_contig', 'Genome/G/has_contig/GenomicContig/' || sha256(seq), '' FROM contig
UNION ALL SELECT DISTINCT 'edge', 'has_feature', cid || '/has_feature/' || fid, '' FROM h WHERE cid IS NOT NULL
UNION ALL SELECT DISTINCT 'edge', 'has_locus_tag', fid || '/has_locus_tag/LocusTag/' || tag, '' FROM h
UNION ALL SELECT DISTINCT 'edge', 'has_dna_sequence', fid || '/has_dna_sequence/' || did, '' FROM h WHERE dna <> ''
UNION ALL SELECT DISTINCT 'edge', 'has_protein_sequence', fid || '/has_protein_sequence/' || pid, '' FROM h WHERE pid IS NOT NULL
UNION ALL SELECT DISTINCT 'edge', 'has_protein_translation', did || '/has_protein_translation/' || pid, ''
  FROM (SELECT tag, arg_max(did, ord) AS did FROM h WHERE dna <> '' GROUP BY tag) JOIN (SELECT tag, arg_max(pid, ord) AS pid FROM h WHERE pseq IS NOT NULL GROUP BY tag) USING (tag)
""")
def genome_rows(spark, sf):
    """The genome transform's nodes with keys and properties, and its edges' ends. Which of equally placed features names a locus tag first isn't settled by the table, so that property is left out."""
    return _rows(genome_graph(spark, sf).graph, "gff_attr_locus_tag")


@query("""
WITH r AS (SELECT o_orderkey AS k, min(o_orderpriority) AS p, min(o_orderstatus) AS s, min(o_totalprice) AS t FROM orders GROUP BY o_orderkey),
x AS (SELECT r.*, 'cpd' || k % 50 AS left_id, 'cpd' || (50 + k % 70) AS right_id FROM r)
SELECT 'node' AS kind, 'ModelSEEDReaction' AS label, 'ModelSEEDReaction/rxn' || k AS id,
       CASE WHEN k % 5 = 0 THEN '' ELSE 'deltag_eQuilibrator=' || k % 9 || '.5;deltagerr_eQuilibrator=0.25;' END || 'ec_numbers=1.' || k % 4 || '.1; 2.2;name=' || p || CASE WHEN k % 3 = 0 THEN '' ELSE ';notes=n; ' || s END AS props FROM x
UNION ALL SELECT 'node', 'ModelSEEDCompound', 'ModelSEEDCompound/cpd' || k, CASE WHEN k < 60 THEN 'id=cpd' || k || ';name=N' || k % 7 ELSE '' END FROM (SELECT unnest(range(120)) AS k)
  WHERE k < 60 OR 'cpd' || k IN (SELECT right_id FROM x)
UNION ALL SELECT 'edge', 'has_stoichiometry_coefficient', 'ModelSEEDReaction/rxn' || k || '/has_stoichiometry_coefficient/ModelSEEDCompound/' || left_id, 'coefficient=-1;compound=' || left_id FROM x
UNION ALL SELECT 'edge', 'has_stoichiometry_coefficient', 'ModelSEEDReaction/rxn' || k || '/has_stoichiometry_coefficient/ModelSEEDCompound/' || right_id, 'coefficient=2;compound=' || right_id FROM x
""")
def biochem_rows(spark, sf):
    """Orders as reactions with thermodynamics, notes, codes and two sides; 60 declared compounds (from numbers in the table), those beyond are proxies."""
    from .plans.biochem import biochem

    o = _t(spark, sf, "orders").groupBy(F.col("o_orderkey").alias("k")).agg(F.min("o_orderpriority").alias("p"), F.min("o_orderstatus").alias("s"))
    k, array = F.col("k"), lambda *c: F.to_json(F.array(*c))
    thermo = F.when(k % 5 != 0, F.concat(F.lit('{"eQuilibrator": ['), k % 9, F.lit(".5, 0.25]}")))
    side = lambda c, n: F.concat(F.lit('{"compound": "cpd'), c, F.lit('", "coefficient": "'), F.lit(n), F.lit('"}'))
    sides = F.concat(F.lit("["), side(k % 50, "-1"), F.lit(","), side(50 + k % 70, "2"), F.lit("]"))
    props = F.create_map(
        F.lit("id"), F.concat(F.lit("rxn"), k), F.lit("name"), F.col("p"), F.lit("aliases"), array(F.lit("q")), F.lit("notes"), F.when(k % 3 != 0, array(F.lit("n"), F.col("s"))),
        F.lit("ec_numbers"), array(F.concat(F.lit("1."), k % 4, F.lit(".1")), F.lit("2.2")), F.lit("thermodynamics"), thermo, F.lit("stoichiometry"), sides,
    )
    c = o.select((k % 60).alias("c")).distinct().select(F.create_map(F.lit("id"), F.concat(F.lit("cpd"), F.col("c")), F.lit("name"), F.concat(F.lit("N"), F.col("c") % 7)).alias("props"), F.col("c").alias("ord"))
    return _rows(biochem(c, o.select(props.alias("props"), k.alias("ord"))))


_MODEL_ROWS = """
WITH l AS (SELECT *, 'm' || l_orderkey % 3 AS m, 'R' || l_orderkey AS r FROM lineitem),
x AS (SELECT r, m, list_sort(list_distinct(list('g' || l_suppkey))) AS genes FROM l GROUP BY ALL),
k AS (SELECT r, m, genes, m || ':' || sha256(array_to_string(genes, '|')) AS k FROM x),
s AS (SELECT 'm' || p_partkey % 3 AS m, 'p' || p_partkey AS p, CASE p_size % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'e' ELSE 'x' END AS c FROM part),
d AS (SELECT 'm' || s_suppkey % 3 AS m, 'g' || s_suppkey AS g FROM supplier),
member AS (SELECT DISTINCT k, m, unnest(genes) AS g FROM k),
made AS (SELECT DISTINCT m, g FROM member WHERE (m, g) NOT IN (SELECT (m, g) FROM d)),
side AS (SELECT DISTINCT l.m, r, p, l_returnflag = 'R' AS back FROM l JOIN s ON s.m = l.m AND s.p = 'p' || l_partkey),
model AS (SELECT 'm' || unnest(range(3)) AS m), comp AS (SELECT m, unnest(['c', 'e']) AS c FROM model)
SELECT 'node' AS kind, '{0}Model' AS label, '{0}Model/' || m AS id, 'id=' || m AS props FROM model
UNION ALL SELECT 'node', '{0}Compartment', '{0}Compartment/' || m || ':' || c, 'id=' || c FROM comp
UNION ALL SELECT 'node', '{0}{1}', '{0}{1}/' || m || ':' || p, 'compartment=' || c || ';id=' || p FROM s
UNION ALL SELECT 'node', '{0}Gene', '{0}Gene/' || m || ':' || g, 'fbc:id=' || g FROM d
UNION ALL SELECT 'node', '{0}Reaction', '{0}Reaction/' || m || ':' || r, 'id=' || r FROM x
UNION ALL SELECT DISTINCT 'node', '{0}Complex', '{0}Complex/' || k, 'genes=["' || array_to_string(genes, '","') || '"]' FROM k
UNION ALL SELECT 'edge', 'has_compartment', '{0}Model/' || m || '/has_compartment/{0}Compartment/' || m || ':' || c, '' FROM comp
UNION ALL SELECT 'edge', 'has_compartment', '{0}{1}/' || m || ':' || p || '/has_compartment/{0}Compartment/' || m || ':' || c, '' FROM s WHERE c <> 'x'
UNION ALL SELECT 'edge', 'has_species', '{0}Model/' || m || '/has_species/{0}{1}/' || m || ':' || p, '' FROM s
UNION ALL SELECT 'edge', 'has_gene', '{0}Model/' || m || '/has_gene/{0}Gene/' || m || ':' || g, '' FROM d
UNION ALL SELECT 'edge', 'has_reaction', '{0}Model/' || m || '/has_reaction/{0}Reaction/' || m || ':' || r, '' FROM x
UNION ALL SELECT 'edge', 'has_gpr_complex', '{0}Reaction/' || m || ':' || r || '/has_gpr_complex/{0}Complex/' || k, '' FROM k
"""


def _model_rows(spark, sf, kind: str) -> DataFrame:
    from .plans.models import model
    from .queries import _models

    # of a species that a reaction names several times on one side, which amount counts isn't settled by the table
    return _rows(model(_models(spark, sf), kind), "stoichiometry", "coefficient")


@query(_MODEL_ROWS.format("SBML", "Species") + """
UNION ALL SELECT 'node', 'SBMLGene', 'SBMLGene/' || m || ':' || g, 'id=' || g FROM made
UNION ALL SELECT 'edge', 'has_gene', 'SBMLModel/' || m || '/has_gene/SBMLGene/' || m || ':' || g, '' FROM made
UNION ALL SELECT 'edge', 'has_gene', 'SBMLComplex/' || k || '/has_gene/SBMLGene/' || m || ':' || g, '' FROM member
UNION ALL SELECT 'edge', CASE WHEN back THEN 'has_reactant' ELSE 'has_product' END,
  'SBMLReaction/' || m || ':' || r || CASE WHEN back THEN '/has_reactant/' ELSE '/has_product/' END || 'SBMLSpecies/' || m || ':' || p, '' FROM side
""")
def sbml_rows(spark, sf):
    """The SBML transform's nodes with properties and its edges' ends; genes that only complexes name are created."""
    return _model_rows(spark, sf, "SBML")


@query(_MODEL_ROWS.format("COBRA", "Metabolite") + """
UNION ALL SELECT 'edge', 'has_gene', 'COBRAComplex/' || k || '/has_gene/COBRAGene/' || m || ':' || g, '' FROM member WHERE (m, g) IN (SELECT (m, g) FROM d)
UNION ALL SELECT DISTINCT 'edge', 'has_stoichiometry_coefficient', 'COBRAReaction/' || m || ':' || r || '/has_stoichiometry_coefficient/COBRAMetabolite/' || m || ':' || p, '' FROM side
""")
def cobra_rows(spark, sf):
    """The COBRA transform's: such genes are left out, and both sides have one kind of edge."""
    return _model_rows(spark, sf, "COBRA")
