"""Metabolic models as graphs, in the SBML and the COBRA vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import col, is_bare, scope
from ..operators.graph import Graph, distinct_edges, firsts, links, linked, nodes, props
from ..operators.profile import public
from ..sources.models import Model


def stoichiometry(rows: DataFrame, ident: Column, value: Column, order: Column) -> DataFrame:
    """id, coefficient and side of each (reaction, species): zeros are left out, negative is a reactant; of several the last counts, products after reactants."""
    kept = rows.select(ident.alias("id"), value.alias("coefficient"), order.alias("_o")).where("coefficient <> 0")
    side = F.when(F.col("coefficient") < 0, "reactant").otherwise("product")
    picked = kept.groupBy("id").agg(F.max_by(F.struct("coefficient", side.alias("side")), F.struct((F.col("coefficient") > 0).alias("_p"), "_o")).alias("_r"))
    return picked.select("id", "_r.coefficient", "_r.side")


def _filled(c: Column | str) -> Column:
    return F.replace(col(c), F.lit(" "), F.lit("_"))


def model(m: Model, kind: str = "SBML") -> Graph:
    """Model, compartment, species, gene, reaction and complex nodes with their edges; many models at once.

    SBML: reactant and product edges with the raw stoichiometry, genes that only complexes name are created.  COBRA: one kind of edge with a signed coefficient,
    such genes are left out.  Species that a model doesn't have get no edges.

    An edge's ends are nodes because it is made from their own rows, or joined to them before it is given its id; keys with white space at their ends have nodes, but no edges.
    Complexes are told apart by their genes' names until they have moved; their digests and edges are made from one row of each.
    """
    sbml = kind == "SBML"
    names = {x: f"{kind}{y}" for x, y in {"model": "Model", "compartment": "Compartment", "species": "Species" if sbml else "Metabolite", "gene": "Gene", "reaction": "Reaction", "complex": "Complex"}.items()}
    clean = public(F.col("props"), ("_raw_xml",) if sbml else ())
    key = lambda *of: F.concat_ws(":", "model_id", *of)
    elem = lambda df: df.withColumn("_id", F.col("props")["id"]).withColumn("_key", key("_id"))
    bare = lambda df: df.where(is_bare("_key"))
    compartments, species, reactions = elem(m.compartments), elem(m.species), elem(m.reactions)
    at = lambda x, c="_key": F.concat(F.lit(f"{names[x]}/"), _filled(c))
    model_nodes = firsts(m.models.withColumn("ord", F.lit(0)), names["model"], "model_id", clean)
    at_model = F.concat(F.lit(f"{names['model']}/"), _filled(F.trim("model_id")))
    in_model = lambda df: bare(df).select(at_model.alias("_model"), "_key", "ord").join(model_nodes.select(F.col("id").alias("_model")), "_model", "left_semi")
    housing = bare(compartments).select("model_id", F.col("_id").alias("_c"), at("compartment").alias("_at")).distinct()
    housed = bare(species).select("model_id", "_key", "ord", F.try_element_at("props", F.lit("compartment")).alias("_c")).join(housing, ["model_id", "_c"])

    groups = reactions.select("model_id", "_key", "ord", F.posexplode("complexes").alias("_p", "_g"))
    groups = groups.select("model_id", "_key", F.array_sort(F.array_distinct("_g")).alias("genes"), (F.col("ord") * 4096 + F.col("_p")).alias("ord")).where("size(genes) > 0")
    declared = m.genes.select("model_id", "gene_id").distinct()
    genes = m.genes.select("model_id", "gene_id", "props", "ord")
    if sbml:
        named = groups.select("model_id", "ord", F.explode("genes").alias("gene_id")).groupBy("model_id", "gene_id").agg(F.min("ord").alias("ord"))
        created = named.join(declared, ["model_id", "gene_id"], "left_anti")
        genes = genes.unionByName(created.select("model_id", "gene_id", F.create_map(F.lit("id"), F.col("gene_id")).alias("props"), (F.col("ord") + (1 << 40)).alias("ord")))
    genes = genes.withColumn("_key", key("gene_id"))
    # a complex's key is its model's and the digest of these names, so they tell it apart; of ids that mean one model, and of names that read alike, the genes are put together
    in_scope, has_ends = scope("model_id")
    groups = groups.select("model_id", "_key", "genes", "ord", in_scope.alias("_scope"), has_ends.alias("_ends"), F.array_join("genes", "|").alias("_names"))
    listed = F.collect_set(F.when(F.col("_ends"), F.struct("model_id", "genes"))).alias("_lists")
    complexes = groups.groupBy("_scope", "_names").agg(F.min_by("genes", "ord").alias("genes"), listed, F.min("ord").alias("ord"), F.max("ord").alias("_last"))
    complex_key = F.concat_ws(":", "_scope", F.sha2("_names", 256))
    complex_at = F.concat(F.lit(f"{names['complex']}/"), complex_key)
    gpr = bare(groups.where("_ends")).groupBy(_filled("_key").alias("_key"), "_scope", "_names").agg(F.max("ord").alias("ord"))
    if sbml:
        each = F.flatten(F.transform("_lists", lambda x: F.transform(x["genes"], lambda g: F.concat_ws(":", x["model_id"], g))))
        members = complexes.select("_scope", "_names", F.explode(F.array_distinct(F.transform(F.filter(each, is_bare), _filled))).alias("_key"), F.col("_last").alias("ord"))
    else:
        members = complexes.select("_names", "_last", F.explode("_lists").alias("_l")).select("_names", "_last", "_l.model_id", F.explode("_l.genes").alias("gene_id"))
        members = bare(members.join(declared, ["model_id", "gene_id"], "left_semi").withColumn("_key", key("gene_id")))
        members = members.groupBy(in_scope.alias("_scope"), "_names", _filled("_key").alias("_key")).agg(F.max("_last").alias("ord"))

    # both sides of all reactions meet the species together
    ids = bare(species).select("model_id", F.col("_id").alias("species")).distinct()
    value = F.col("_s.stoichiometry")
    sides = [
        bare(reactions).select("model_id", _filled("_key").alias("_at"), "ord", F.posexplode(side).alias("_p", "_s")).select(
            "model_id", "_at", F.col("_s.species").alias("species"), (F.col("ord") * 65536 + F.col("_p") + (0 if sbml or sign < 0 else 32768)).alias("ord"),
            (value if sbml else (value.cast("double") * sign).cast("string")).alias("_value"), F.lit(sign > 0).alias("_product"),
        )
        for side, sign in (("reactants", -1), ("products", 1))
    ]
    met = sides[0].unionByName(sides[1]).join(ids, ["model_id", "species"]).select("_at", _filled(key("species")).alias("_to"), F.col("_product") if sbml else F.lit(None).cast("boolean").alias("_product"), "_value", "ord")
    met = met.groupBy("_at", "_to", "_product").agg(F.max_by("_value", "ord").alias("_value"), F.max("ord").alias("ord"))
    side_label = F.when(F.col("_product"), "has_product").otherwise("has_reactant") if sbml else "has_stoichiometry_coefficient"
    node_rows = [
        firsts(compartments, names["compartment"], "_key", clean),
        firsts(species, names["species"], "_key", clean),
        firsts(genes, names["gene"], "_key", F.col("props")),
        firsts(reactions, names["reaction"], "_key", clean),
        nodes(complexes.withColumn("_key", complex_key), names["complex"], "_key", props(genes=F.to_json("genes")), normal=True),
    ]
    links_of = [
        links(in_model(compartments), "_model", "has_compartment", at("compartment")),
        links(in_model(species), "_model", "has_species", at("species")),
        links(in_model(genes), "_model", "has_gene", at("gene")),
        links(in_model(reactions), "_model", "has_reaction", at("reaction")),
        links(housed, at("species"), "has_compartment", "_at"),
    ]
    edge_rows = [
        distinct_edges(gpr, at("reaction"), "has_gpr_complex", complex_at),
        distinct_edges(members, complex_at, "has_gene", at("gene")),
        distinct_edges(met, at("reaction", "_at"), side_label, at("species", "_to"), props(stoichiometry=F.col("_value")) if sbml else props(coefficient=F.col("_value"))),
    ]
    return Graph(reduce(DataFrame.unionByName, node_rows, model_nodes), reduce(DataFrame.unionByName, edge_rows, linked(links_of)))


def translated(m: Model, species: DataFrame, compartments: DataFrame, dropped: DataFrame, exchange: str = "^EX_") -> Model:
    """The model with other ids: species (old_id, new_id) and compartments (old_id, new_id) are renamed, dropped species (id) and exchange reactions go."""
    def renamed(df: DataFrame, field: str, names: DataFrame) -> DataFrame:
        rows = df.withColumn("_old", F.try_element_at("props", F.lit(field))).join(names.select(F.col("old_id").alias("_old"), "new_id"), "_old", "left")
        changed = F.map_concat(F.map_filter("props", lambda k, _: k != field), F.create_map(F.lit(field), F.coalesce("new_id", "_old")))
        return rows.withColumn("props", F.when(F.col("_old").isNotNull(), changed).otherwise(F.col("props"))).select(*df.columns)

    gone = dropped.select(F.col("id").alias("_id"))
    kept = m.species.withColumn("_id", F.col("props")["id"]).join(gone, "_id", "left_anti").select(*m.species.columns)
    inner = m.reactions.where(~F.col("props")["id"].rlike(exchange))

    def side(rows: DataFrame, name: str) -> DataFrame:
        each = rows.select("model_id", "ord", F.posexplode_outer(name).alias("_p", "_s")).withColumn("_id", F.col("_s.species")).join(gone, "_id", "left_anti")
        each = each.join(species.select(F.col("old_id").alias("_id"), "new_id"), "_id", "left")
        part = F.struct("_p", F.coalesce("new_id", "_id").alias("species"), F.col("_s.stoichiometry").alias("stoichiometry"))
        listed = each.where("_p is not null").groupBy("model_id", "ord").agg(F.array_sort(F.collect_list(part)).alias("_l"))
        done = rows.join(listed, ["model_id", "ord"], "left").withColumn(
            name, F.coalesce(F.transform("_l", lambda x: F.struct(x["species"].alias("species"), x["stoichiometry"].alias("stoichiometry"))), F.array().cast("array<struct<species:string,stoichiometry:string>>"))
        )
        return done.select(*rows.columns)

    return Model(m.models, renamed(m.compartments, "id", compartments), renamed(renamed(kept, "id", species), "compartment", compartments), m.genes, side(side(inner, "reactants"), "products"), m.extras)
