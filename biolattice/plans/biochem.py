"""Biochemistry database as a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import node_id
from ..operators.graph import Graph, edges, nodes

#: Node labels, which stored graphs already use.
COMPOUND, REACTION = "ModelSEEDCompound", "ModelSEEDReaction"
_STOICHIOMETRY = "array<map<string,string>>"


def _joined(name: str) -> Column:
    """A field that is a JSON list, as text joined by semicolons; other values stay."""
    value = F.try_element_at("props", F.lit(name))
    return F.when(F.startswith(value, F.lit("[")), F.array_join(F.from_json(value, "array<string>"), "; ")).otherwise(value)


def _with(data: Column, values: dict[str, Column], without: tuple[str, ...]) -> Column:
    gone = (*values, *without)
    more = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()]), lambda e: e["value"].isNotNull())
    return F.map_concat(F.map_filter(data, lambda k, v: ~k.isin(*gone) & v.isNotNull()), F.map_from_entries(more))


def compounds(rows: DataFrame) -> DataFrame:
    """Compound nodes: without aliases and nulls, notes joined; of one id the last row."""
    last = rows.groupBy(F.col("props")["id"].alias("_id")).agg(F.max_by("props", "ord").alias("props"), F.max("ord").alias("ord")).where("_id is not null")
    return last.select("_id", _with(F.col("props"), {"notes": _joined("notes")}, ("aliases",)).alias("_data"), "ord")


def reactions(rows: DataFrame) -> DataFrame:
    """Reaction nodes' fields: lists joined, both thermodynamic estimates and their errors as fields of their own; and the stoichiometry. Of one id the first row."""
    thermo = F.from_json(F.try_element_at("props", F.lit("thermodynamics")), "map<string,array<string>>")
    estimate = lambda name, k: F.get(F.try_element_at(thermo, F.lit(name)), F.lit(k))
    values = {n: _joined(n) for n in ("notes", "pathways", "ec_numbers")}
    for name, short in (("Group contribution", "group_contribution"), ("eQuilibrator", "eQuilibrator")):
        values |= {f"deltag_{short}": estimate(name, 0), f"deltagerr_{short}": estimate(name, 1)}
    stoich = F.from_json(F.try_element_at("props", F.lit("stoichiometry")), _STOICHIOMETRY)
    return rows.select(F.col("props")["id"].alias("_id"), _with(F.col("props"), values, ("id", "aliases", "stoichiometry", "thermodynamics")).alias("_data"), stoich.alias("_stoich"), "ord").where("_id is not null")


def biochem(compound_rows: DataFrame, reaction_rows: DataFrame) -> Graph:
    """Compounds, reactions and their stoichiometry; what a reaction names and no one declares becomes a node without properties.

    A compound on both sides of a reaction has one edge, the last.
    """
    c, r = compounds(compound_rows), reactions(reaction_rows)
    number = F.row_number().over(W.partitionBy("_id").orderBy("ord"))
    sides = r.select("_id", "ord", F.posexplode("_stoich").alias("_p", "_s")).withColumn("_c", F.col("_s")["compound"]).withColumn("_n", F.struct("ord", "_p"))
    last = sides.groupBy("_id", "_c").agg(F.max_by("_s", "_n").alias("_s"))
    zero = F.lit(0)
    proxies = last.select(F.col("_c")).distinct()
    node_parts = [
        nodes(c, COMPOUND, "_id", F.col("_data"), zero),
        nodes(r.withColumn("_k", number), REACTION, "_id", F.col("_data"), "_k"),
        nodes(proxies, COMPOUND, "_c", order=F.lit(1 << 40)),
    ]
    edge_parts = [edges(last, node_id(REACTION, F.col("_id")), "has_stoichiometry_coefficient", node_id(COMPOUND, F.col("_c")), F.col("_s"), zero)]
    return Graph.build(node_parts, edge_parts)
