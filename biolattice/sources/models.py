"""Metabolic models: constraint-based JSON and SBML, in one shape.

Every table has a `model_id` column, so many model files are one job.  Elements are maps of their fields as text; nested JSON stays JSON.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.gpr import complexes, dnf, note_rule
from ..functions.keys import last_wins
from ..plans.tables import saved


@dataclass
class Model:
    """models (model_id, props), compartments and species (model_id, props, ord), genes (model_id, gene_id, props, ord), reactions (model_id, props, reactants,
    products, complexes, ord), extras (model_id, element, props, children, ord): parameters, objectives, unit definitions, groups.
    """

    models: DataFrame
    compartments: DataFrame
    species: DataFrame
    genes: DataFrame
    reactions: DataFrame
    extras: DataFrame | None = None


_SIDE = "array<struct<species:string,stoichiometry:string>>"


def cobra_json(spark: SparkSession, path: str, name: str | None = None) -> Model:
    """Models as JSON, one a file. Of the stoichiometry, zeros are left out, negative values become reactants; values keep the file's notation."""
    whole = spark.read.option("wholetext", True).text(path)
    top = whole.select(F.from_json("value", "map<string,string>").alias("m"), F.sha2("value", 256).alias("sha"))
    top = top.withColumn("model_id", F.lit(name) if name else F.try_element_at("m", F.lit("id")))
    get = lambda k: F.try_element_at("m", F.lit(k))
    listed = lambda k: top.select("model_id", F.posexplode(F.from_json(get(k), "array<map<string,string>>")).alias("ord", "props"))
    models = top.select("model_id", F.map_filter(F.map_concat(F.map_filter("m", lambda k, _: k.isin("id", "name", "version")), F.create_map(F.lit("_file_sha256"), F.col("sha"))), lambda _, v: v.isNotNull()).alias("props"))
    compartments = top.select("model_id", F.posexplode(F.map_entries(F.from_json(get("compartments"), "map<string,string>"))).alias("ord", "e")).select(
        "model_id", F.create_map(F.lit("id"), F.col("e.key"), F.lit("name"), F.col("e.value")).alias("props"), "ord"
    )
    genes = listed("genes")
    given = F.from_json(F.try_element_at("props", F.lit("annotation")), "map<string,string>")
    label = F.coalesce(F.try_element_at("props", F.lit("name")), F.col("props")["id"])
    spread = F.concat(F.array(F.struct(F.lit("fbc:id").alias("key"), F.col("props")["id"].alias("value")), F.struct(F.lit("fbc:label").alias("key"), label.alias("value"))), F.coalesce(F.map_entries(given), F.array()))
    genes = genes.select("model_id", last_wins(spread).alias("props"), "ord").select("model_id", F.col("props")["fbc:id"].alias("gene_id"), "props", "ord")
    parts = F.map_entries(F.from_json(F.try_element_at("props", F.lit("metabolites")), "map<string,string>"))
    side = lambda sign: F.coalesce(
        F.transform(
            F.filter(parts, lambda e: F.signum(e["value"].cast("double")) == sign),
            lambda e: F.struct(e["key"].alias("species"), F.regexp_replace(e["value"], "^-", "").alias("stoichiometry")),
        ),
        F.array().cast(_SIDE),
    )
    reactions = listed("reactions").select(
        "model_id",
        F.map_filter("props", lambda k, _: k != "metabolites").alias("props"),
        side(-1).alias("reactants"),
        side(1).alias("products"),
        complexes(F.coalesce(F.try_element_at("props", F.lit("gene_reaction_rule")), F.lit("")), "rule").alias("complexes"),
        "ord",
    )
    return Model(models, compartments, listed("metabolites").select("model_id", "props", "ord"), genes, reactions)


#: Elements that are reported, and the children whose attributes are kept with them.
ELEMENTS = {
    "model": (), "parameter": (), "compartment": (), "species": (), "geneProduct": (), "reaction": (), "objective": ("fluxObjective",), "unitDefinition": ("unit",), "group": ("member",),
}
_TAG_END = re.compile(rb"""(?:[^>"']|"[^"]*"|'[^']*')*>""")
ROW = (
    "model_id string, element string, attrs map<string,string>, row int, xpath string, raw_xml string, start bigint, end bigint, file_sha256 string, "
    f"children array<map<string,string>>, reactants {_SIDE}, products {_SIDE}, complexes array<array<string>>, ord bigint"
)


class _Reader:
    """One pass over an SBML file; exact byte ranges come from the parser."""

    def __init__(self, data: bytes):
        self.data, self.rows, self.stack, self.counts = data, [], [], [{}]
        self.parser = expat.ParserCreate(namespace_separator=" ")
        self.parser.namespace_prefixes = True
        self.parser.StartElementHandler, self.parser.EndElementHandler = self.open, self.close
        self.parser.EntityDeclHandler = self.entity
        self.gpa: list[list] = []
        self.side: str | None = None

    def read(self) -> list[dict]:
        self.parser.Parse(self.data, True)
        return self.rows

    def entity(self, *_) -> None:
        raise ValueError("entity declarations aren't read")

    @staticmethod
    def _short(name: str) -> str:
        parts = name.split(" ")
        return f"{parts[2]}:{parts[1]}" if len(parts) == 3 else parts[-1] if len(parts) == 1 else parts[1]

    def _here(self) -> dict | None:
        return next((e for e in reversed(self.stack) if e["row"] is not None), None)

    def open(self, name: str, attrs: dict) -> None:
        local = name.split(" ")[1] if " " in name else name
        short = {self._short(k): v for k, v in attrs.items()}
        seen = self.counts[-1]
        seen[local] = seen.get(local, 0) + 1
        self.counts.append({})
        entry = {"local": local, "nth": seen[local], "row": None, "start": self.parser.CurrentByteIndex}
        outer = self._here()
        self.stack.append(entry)
        if local in ELEMENTS:
            entry["row"] = {
                "element": local, "attrs": short, "row": self.parser.CurrentLineNumber, "xpath": "/" + "/".join(f"{e['local']}[{e['nth']}]" for e in self.stack),
                "start": entry["start"], "children": [], "reactants": [], "products": [], "complexes": [], "ord": len(self.rows),
            }
            self.rows.append(entry["row"])
        elif outer and local in ELEMENTS[outer["local"]]:
            outer["row"]["children"].append(short)
        elif local in ("listOfReactants", "listOfProducts"):
            self.side = "reactants" if local == "listOfReactants" else "products"
        elif local == "speciesReference" and outer and outer["local"] == "reaction" and self.side:
            outer["row"][self.side].append({"species": short.get("species"), "stoichiometry": short.get("stoichiometry")})
        elif local in ("geneProductAssociation", "and", "or") and (self.gpa or local == "geneProductAssociation"):
            self.gpa.append([])
        elif local == "geneProductRef" and self.gpa:
            gene = next((v for k, v in short.items() if k.rpartition(":")[2] == "geneProduct"), None)
            self.gpa[-1].append([[gene]] if gene else [])

    def close(self, name: str) -> None:
        entry = self.stack.pop()
        self.counts.pop()
        local = entry["local"]
        if local in ("listOfReactants", "listOfProducts"):
            self.side = None
        elif local in ("geneProductAssociation", "and", "or") and self.gpa:
            parts = self.gpa.pop()
            if local == "and":  # one complex of all genes below, alternatives too
                genes = [g for p in parts for c in p for g in c]
                value = [genes] if genes else []
            else:
                value = [c for p in (parts[:1] if local == "geneProductAssociation" else parts) for c in p]
            if self.gpa:
                self.gpa[-1].append(value)
            elif (outer := self._here()) and outer["local"] == "reaction":
                outer["row"]["complexes"] = value
        if entry["row"] is not None:
            at = self.parser.CurrentByteIndex
            tag = at if self.data[at : at + 2] == b"</" else entry["start"]
            end = _TAG_END.match(self.data, tag).end()
            raw = self.data[entry["start"] : end].decode("utf-8", "replace")
            entry["row"] |= {"end": end, "raw_xml": raw}
            if local == "reaction" and not entry["row"]["complexes"]:
                entry["row"]["complexes"] = dnf(note_rule(raw))


def sbml_elements(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Every reported element of SBML files with its place: line, path, byte range, raw XML and the file's digest, from one parse of each file."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                data = bytes(content)
                rows = _Reader(data).read()
                own = name or next((r["attrs"].get("id") for r in rows if r["element"] == "model"), None) or file.rpartition("/")[2]
                yield pd.DataFrame([r | {"model_id": own, "file_sha256": hashlib.sha256(data).hexdigest()} for r in rows])[[c.split()[0] for c in re.split(r", (?=\w+ )", ROW)]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, ROW)


def sbml(spark: SparkSession, path: str, name: str | None = None) -> Model:
    """SBML files as models; gene rules come from the package's associations, else from the notes. The parse is written once for all tables."""
    rows = saved(sbml_elements(spark, path, name))
    place = F.create_map(*[x for k in ("row", "xpath", "raw_xml", "start", "end") for x in (F.lit(f"_{k}"), F.col(k).cast("string"))], F.lit("_file_sha256"), F.col("file_sha256"))
    of = lambda kind: rows.where(F.col("element") == kind).withColumn("props", F.map_concat("attrs", place))
    gene_id = F.coalesce(F.nullif(F.try_element_at("attrs", F.lit("fbc:id")), F.lit("")), F.try_element_at("attrs", F.lit("id")))
    return Model(
        rows.where("element = 'model'").select("model_id", F.col("attrs").alias("props")),
        of("compartment").select("model_id", "props", "ord"),
        of("species").select("model_id", "props", "ord"),
        rows.where("element = 'geneProduct'").select("model_id", gene_id.alias("gene_id"), F.col("attrs").alias("props"), "ord").where("gene_id <> ''"),
        of("reaction").select("model_id", "props", "reactants", "products", "complexes", "ord"),
        rows.where("element in ('parameter', 'objective', 'unitDefinition', 'group')").select("model_id", "element", F.col("attrs").alias("props"), "children", "ord"),
    )
