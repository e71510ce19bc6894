"""Genome annotation as a graph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import digest, node_id, normalize_key
from ..functions.sequences import reverse_complement, slice_inclusive
from ..operators.graph import Graph, first_wins, linked, links, nodes, props


@dataclass
class GenomeGraph:
    graph: Graph
    unmatched: DataFrame  # reason, contig_id, protein_id, feature_id, ord


def genome(genome_id: str, contigs: DataFrame, proteins: DataFrame, features: DataFrame) -> GenomeGraph:
    """Genome, contig, feature, locus tag, DNA and protein nodes of one annotation, from (id, seq), (id, seq) and GFF rows.

    A feature's id has its place but no strand, so features of one type and span are one node, the first's.  Of records with one accession, and of a locus tag's genes and
    proteins, the last counts.  What finds no contig or protein is in `unmatched`.

    Rows are told apart by what they name and grouped before properties, digests and ids are made; every edge is made with both its nodes, so ends need no look-up.
    """
    spark = contigs.sparkSession
    last = lambda df: df.groupBy("id").agg(F.max_by("seq", "ord").alias("seq"), F.min("ord").alias("ord"))
    # accessions whose last record has a sequence
    known = lambda df, name: df.groupBy("id").agg(F.max_by(F.col("seq").isNotNull(), "ord").alias("_there")).where("_there").select(F.col("id").alias(name))
    contig, protein = last(contigs), last(proteins).where("seq is not null")
    gid = node_id("Genome", F.lit(genome_id))
    g = spark.range(1).select(F.lit(genome_id).alias("g"), F.lit(0).alias("ord"))
    contig = contig.withColumn("contig_node", F.concat(F.lit("GenomicContig/"), digest("seq")))
    named = F.concat_ws("_", F.lit(genome_id), "contig_id", "feature_type", F.col("start").cast("string"), F.col("end").cast("string"))
    # by key and once each, so that the optimiser takes them straight from a map's parts where it sees them made
    tag = lambda k: F.col("attrs")[k]
    place = ("contig_id", "source", "feature_type", "start", "end", "score", "strand", "phase")
    rows = features.select(*place, "attrs", "ord", tag("locus_tag").alias("_tag"), tag("old_locus_tag").alias("_old"), tag("protein_id").alias("_protein"), F.coalesce(F.col("strand") == "-", F.lit(False)).alias("_minus"))
    rows = rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("_tag", "_old", "_protein")} | {"_name": named})
    f = rows if genome_id else rows.where("length(_name) > 0")
    is_gene = F.col("feature_type") == "gene"
    tags, olds, genes, cds = f.where("_tag is not null"), f.where("_old is not null"), f.where(is_gene), rows.where("feature_type = 'CDS'")

    # features: the first's columns move, its properties are made afterwards
    feature = f.withColumn("_key", normalize_key("_name")).groupBy("_key").agg(F.min_by(F.struct(*place, "attrs"), "ord").alias("_f"), F.min("ord").alias("ord"))
    data = F.map_concat(props(**{c: F.col(f"_f.{c}") for c in place}), F.transform_keys("_f.attrs", lambda k, _: F.concat(F.lit("gff_attr_"), k)))
    either = tags.select(F.col("_tag").alias("_key"), F.lit(False).alias("_is_old"), "ord").unionByName(olds.select(F.col("_old").alias("_key"), F.lit(True).alias("_is_old"), "ord"))
    tag_rows = either.withColumn("_key", normalize_key("_key")).groupBy("_key").agg(F.min_by("_is_old", "ord").alias("_is_old"), F.min("ord").alias("ord"))
    feature_node, tag_node, old_node = node_id("GenomicFeature", F.col("_name")), node_id("LocusTag", F.col("_tag")), node_id("LocusTag", F.col("_old"))

    # each stretch of a contig is cut once; of genes by tag only the digest of what is cut moves on
    at_contig = contig.select(F.col("id").alias("contig_id"), "seq").where("seq is not null")
    either_strand = F.when(F.col("_minus"), reverse_complement("_cut")).otherwise(F.col("_cut"))
    sliced = lambda rows: rows.join(at_contig, "contig_id").withColumn("_cut", slice_inclusive("seq", F.col("start"), F.col("end"))).where("_cut <> ''").withColumn("dna", either_strand)
    stretches = f.groupBy("contig_id", "feature_type", "start", "end", "_minus").agg(F.min("ord").alias("ord"), F.max("ord").alias("_last")).withColumn("_name", named)
    on_contig = stretches.select("contig_id", "_name", "_last").join(contig.select(F.col("id").alias("contig_id"), "contig_node"), "contig_id").where("contig_node is not null")
    dna = sliced(stretches.where(is_gene)).select("_name", "ord", "_last", "dna")
    of_gene = sliced(genes.where("_tag is not null").select("contig_id", "start", "end", "_minus", "_tag", "ord"))
    of_gene = of_gene.select("_tag", "ord", F.unhex(digest("dna")).alias("_dna"), F.lit(None).cast("binary").alias("_made"))

    # a protein's sequence meets its first record only, its digest all of them
    first_cds = cds.groupBy("_protein").agg(F.min("ord").alias("ord")).join(protein.select(F.col("id").alias("_protein"), "seq"), "_protein")
    made = first_cds.groupBy("seq").agg(F.min_by("_protein", "ord").alias("_protein"), F.min("ord").alias("ord"))
    digests = protein.select(F.col("id").alias("_protein"), F.unhex(digest("seq")).alias("_made"))
    coded = cds.where(F.lit(True) if genome_id else "length(_name) > 0").select("_protein", "_name", "ord").join(digests, "_protein")
    of_cds = cds.where("_tag is not null").select("_protein", "_tag", "ord").join(digests, "_protein").select("_tag", "ord", F.lit(None).cast("binary").alias("_dna"), "_made")
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("ord"))
    pairs = of_gene.unionByName(of_cds).groupBy("_tag").agg(F.max_by("_dna", at("_dna")).alias("_dna"), F.max_by("_made", at("_made")).alias("_made"), F.max(at("_dna")).alias("ord"))
    pairs = pairs.where("_dna is not null and _made is not null")

    text = lambda label, c: F.concat(F.lit(f"{label}/"), F.lower(F.hex(c)))
    size = F.length("seq").cast("string")
    node_rows = [
        first_wins(nodes(contig, "GenomicContig", digest("seq"), props(accession=F.col("id"), length=size), value=F.col("seq"))),
        nodes(feature, "GenomicFeature", "_key", data, normal=True),
        nodes(tag_rows, "LocusTag", "_key", more=F.when(F.col("_is_old"), F.array(F.lit("OldLocusTag"))).otherwise(F.array().cast("array<string>")), normal=True),
        nodes(dna.groupBy("dna").agg(F.min("ord").alias("ord")), "DNASequence", digest("dna"), props(length=F.length("dna")), value=F.col("dna"), normal=True),
        nodes(made, "ProteinSequence", digest("seq"), props(protein_id=F.col("_protein"), length=size), value=F.col("seq"), normal=True),
    ]
    edge_rows = [
        links(contig.where("contig_node is not null" if genome_id else "false"), gid, "has_contig", "contig_node"),
        links(on_contig, "contig_node", "has_feature", feature_node, "_last"),
        links(tags, feature_node, "has_locus_tag", tag_node),
        links(olds.where("_tag is not null"), tag_node, "parent", old_node),
        links(olds.where("_tag is null"), feature_node, "has_locus_tag", old_node),
        links(dna, feature_node, "has_dna_sequence", F.concat(F.lit("DNASequence/"), digest("dna")), "_last"),
        links(coded, feature_node, "has_protein_sequence", text("ProteinSequence", "_made")),
        links(pairs, text("DNASequence", "_dna"), "has_protein_translation", text("ProteinSequence", "_made")),
    ]
    by_feature = ("contig_id", "feature_type", feature_node.alias("feature_node"), "ord")
    lost_contig = rows.select(*by_feature).join(known(contigs, "contig_id"), "contig_id", "left_anti")
    reasons = F.when(is_gene, F.array(F.lit("contig_not_found"), F.lit("contig_not_found_for_dna"))).otherwise(F.array(F.lit("contig_not_found")))
    lost_protein = cds.select(*by_feature, "_protein").join(known(proteins, "_protein"), "_protein", "left_anti")
    unmatched = lost_contig.select(F.explode(reasons).alias("reason"), "contig_id", F.lit(None).cast("string").alias("protein_id"), "feature_node", "ord").unionByName(
        lost_protein.select(F.lit("protein_not_found").alias("reason"), "contig_id", F.col("_protein").alias("protein_id"), "feature_node", "ord")
    )
    return GenomeGraph(Graph(reduce(DataFrame.unionByName, node_rows, nodes(g, "Genome", "g")), linked(edge_rows)), unmatched)
