"""Protein entries: knowledge-base XML and API JSON, and reference clusters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .places import numbered, placed

_REF = "array<struct<_type:string,_id:string,molecule:struct<_id:string>,property:array<struct<_type:string,_value:string>>>>"
_SPAN = "position:struct<_position:bigint,_status:string>,begin:struct<_position:bigint,_status:string>,end:struct<_position:bigint,_status:string>"
_TEXT = "array<struct<_VALUE:string,_evidence:string>>"
_NAME = f"struct<fullName:struct<_VALUE:string,_evidence:string>,shortName:{_TEXT},ecNumber:{_TEXT}>"
#: Schema of an entry; the reader takes no more than is selected.
ENTRY = f"""
_xml_sourceline bigint, _dataset string, _created string, _modified string, _version string, accession array<string>, name array<string>,
protein struct<recommendedName:{_NAME},alternativeName:array<{_NAME}>,submittedName:array<{_NAME}>,component:array<struct<recommendedName:{_NAME},alternativeName:array<{_NAME}>>>>,
gene array<struct<name:array<struct<_type:string,_VALUE:string>>>>,
organism struct<name:array<struct<_type:string,_VALUE:string>>,dbReference:{_REF}>, organismHost array<struct<name:array<struct<_type:string,_VALUE:string>>,dbReference:{_REF}>>,
geneLocation array<struct<_type:string,_evidence:string,name:array<struct<_status:string,_VALUE:string>>>>,
reference array<struct<_key:string,citation:struct<_type:string,_date:string,_name:string,_volume:string,_first:string,_last:string,title:string,authorList:struct<person:array<struct<_name:string>>>,dbReference:{_REF}>,scope:array<string>>>,
keyword array<struct<_id:string,_evidence:string,_VALUE:string>>,
feature array<struct<_type:string,_id:string,_description:string,_evidence:string,_ref:string,original:string,variation:array<string>,location:struct<_sequence:string,{_SPAN}>>>, proteinExistence struct<_type:string>,
comment array<struct<_xml_sourceline:bigint,_type:string,_evidence:string,text:{_TEXT},
 reaction:array<struct<_evidence:string,text:string,dbReference:{_REF}>>, physiologicalReaction:array<struct<_direction:string,_evidence:string,dbReference:{_REF}>>,
 cofactor:array<struct<_evidence:string,name:string,dbReference:{_REF}>>,
 subcellularLocation:array<struct<location:{_TEXT},topology:{_TEXT},orientation:{_TEXT}>>,
 isoform:array<struct<id:array<string>,name:array<struct<_VALUE:string,_evidence:string>>,sequence:struct<_type:string,_ref:string>>>,
 disease:struct<_id:string,name:string,acronym:string,description:string,dbReference:{_REF}>,
 interactant:array<struct<_intactId:string,id:string,label:string,dbReference:{_REF}>>, organismsDiffer:boolean, experiments:int,
 kinetics:struct<KM:{_TEXT},Vmax:{_TEXT},text:{_TEXT}>, absorption:struct<max:{_TEXT},text:{_TEXT}>, phDependence:struct<text:{_TEXT}>, temperatureDependence:struct<text:{_TEXT}>, redoxPotential:struct<text:{_TEXT}>,
 conflict:array<struct<_type:string,_ref:string,sequence:struct<_resource:string,_id:string,_version:string>>>, link:array<struct<_uri:string>>, event:array<struct<_type:string>>, molecule:struct<_VALUE:string,_id:string>,
 location:array<struct<{_SPAN}>>>>,
dbReference array<struct<_xml_sourceline:bigint,_type:string,_id:string,_evidence:string,molecule:struct<_id:string>,property:array<struct<_type:string,_value:string>>>>,
evidence array<struct<_key:string,_type:string,source:array<struct<_ref:string,dbReference:array<struct<_type:string,_id:string>>>>,importedFrom:array<struct<dbReference:array<struct<_type:string,_id:string>>>>>>,
sequence struct<_VALUE:string,_length:string,_mass:string,_checksum:string,_modified:string,_version:string>
"""


#: An entry's tags that get the number of their line, by the depth below the entry.
LINED = {"entry": 0, "comment": 1, "dbReference": 1}
_MARKUP = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(?P<end>/?)(?P<name>[^\s<>/!?]+)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>", re.DOTALL)


def lined(piece: str, before: int) -> str | None:
    """The entry that stands in a piece of a file (what comes before its end tag), with the line of each tag of LINED as an attribute; None without an entry.

    before: the number of lines that end before the piece.  Comments, CDATA and quoted text are passed over.
    """
    out, at, line, depth = [], None, before + 1, -1
    low = 0
    for m in _MARKUP.finditer(piece):
        line += piece.count("\n", low, m.start())
        low = m.start()
        name = m["name"]
        if name is None or depth < 0 and (m["end"] or name != "entry"):
            continue
        if m["end"]:
            depth -= 1
            continue
        depth += 1
        if depth == 0:
            at = m.start()
        if LINED.get(name) == depth:
            cut = m.start() + 1 + len(name)
            out += [piece[at:cut], f' xml_sourceline="{line}"']
            at = cut
        if m["empty"]:
            depth -= 1
    return None if at is None else "".join([*out, piece[at:], "</entry>"])


def _marked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each piece's entry with lines counted from its split's beginning; a task reads the pieces of a split in order."""
    split, line = None, 0
    for frame in frames:
        rows = []
        for file, start, at, value in zip(frame["_file"], frame["_start"], frame["_at"], frame["value"]):
            if (file, start) != split:
                split, line = (file, start), 0
            lines = value.count("\n")
            rows.append((file, start, at, lined(value, line), lines))
            line += lines
        yield pd.DataFrame(rows, columns=["_file", "_start", "_at", "entry", "lines"])


def _shifted(c: str, by: Column, schema: T.StructType) -> Column:
    """The array of captures with `by` added to each one's line."""
    fields = [f.name for f in schema[c].dataType.elementType.fields]
    return F.transform(c, lambda x: F.struct(*[(x[f] + by if f == "_xml_sourceline" else x[f]).alias(f) for f in fields]))


def entries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Knowledge-base entries, split at their end tags, so a large file is read by many tasks; values lie in _VALUE, attributes begin with _.

    _xml_sourceline of an entry, of its comments and of its dbReferences is the line of the file that the tag begins in, from 1.  ord is the place among all entries' pieces, in the order of
    the files' paths.  Both are the same for any splits.  limit: the first ones only.  Files are UTF-8 with plain tag names; an entry that isn't well-formed has null columns.
    """
    pieces = placed(spark.read.option("lineSep", "</entry>").text(path), "value")
    marked = pieces.mapInPandas(_marked, "_file string, _start bigint, _at bigint, entry string, lines bigint")
    rows = numbered(marked, "lines").where("entry is not null")
    schema = T._parse_datatype_string(ENTRY.replace("\n", " "))
    rows = rows.select(F.from_xml("entry", ENTRY.replace("\n", " ")).alias("e"), "ord", "_before").select("e.*", "ord", "_before")
    line = F.col("_before")
    rows = rows.withColumns({"_xml_sourceline": F.col("_xml_sourceline") + line, **{c: _shifted(c, line, schema) for c in ("comment", "dbReference")}}).drop("_before")
    return rows if limit is None else rows.orderBy("ord").limit(limit)


def plain_names(rows: DataFrame) -> DataFrame:
    """The same columns with attributes and values under their own names, at every depth: `_type` is type, `_VALUE` is value."""

    def named(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(named(kind.elementType), kind.containsNull)
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(name(f.name), named(f.dataType), f.nullable) for f in kind.fields])
        return kind

    def name(field: str) -> str:
        return "value" if field == "_VALUE" else field.removeprefix("_")

    return rows.select(*[F.col(f.name).cast(named(f.dataType)).alias(name(f.name)) for f in rows.schema.fields])


def features(rows: DataFrame) -> DataFrame:
    """A row for each feature of the entries: accession (the first), type, id, description, evidence keys, begin and end with their status (a single position is both), original, variations."""
    f = F.col("f")
    side = lambda c, k: F.coalesce(f["location"][c][k], f["location"]["position"][k])
    return rows.select(F.get("accession", F.lit(0)).alias("accession"), "ord", F.posexplode("feature").alias("pos", "f")).select(
        "accession", "ord", "pos", f["_type"].alias("type"), f["_id"].alias("id"), f["_description"].alias("description"), F.filter(F.split(f["_evidence"], " "), lambda k: k != "").alias("evidence"),
        side("begin", "_position").alias("begin"), side("begin", "_status").alias("begin_status"), side("end", "_position").alias("end"), side("end", "_status").alias("end_status"),
        f["original"].alias("original"), f["variation"].alias("variation"),
    )


def evidence_sources(rows: DataFrame) -> DataFrame:
    """A row for each source of each evidence of the entries: accession, key, eco, kind (`source` or `importedFrom`), ref (a reference of the entry), db and id; evidence without any has one."""
    e = F.col("e")
    none = F.lit(None).cast("string")
    part = lambda kind, ref, d: F.struct(F.lit(kind).alias("kind"), ref.alias("ref"), d["_type"].alias("db"), d["_id"].alias("id"))

    def parts(kind: str) -> Column:
        ref = (lambda s: s["_ref"]) if kind == "source" else (lambda s: none)
        empty = F.array(F.lit(None).cast("struct<_type:string,_id:string>"))
        several = F.transform(e[kind], lambda s: F.transform(F.coalesce(s["dbReference"], empty), lambda d: part(kind, ref(s), d)))
        return F.coalesce(F.flatten(several), F.array().cast("array<struct<kind:string,ref:string,db:string,id:string>>"))

    found = rows.select(F.get("accession", F.lit(0)).alias("accession"), "ord", F.explode("evidence").alias("e"))
    return found.select("accession", "ord", e["_key"].alias("key"), e["_type"].alias("eco"), F.explode_outer(F.concat(parts("source"), parts("importedFrom"))).alias("s")).select(
        "accession", "ord", "key", "eco", "s.*"
    )


#: Schema of an entry of the API.
API = """
entryType string, primaryAccession string, secondaryAccessions array<string>, uniProtkbId string, proteinExistence string, genes string, comments string, proteinDescription string,
sequence struct<value:string,length:int>
"""


def api_entries(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Entries of the API as JSON lines (or arrays: multi_line); nested parts that are passed on stay JSON. ord: their order in the files, in the order of the files' paths."""
    return numbered(placed(spark.read.schema(API).option("multiLine", multi_line).json(path), "*"))


_MEMBER = "struct<dbReference:array<struct<_type:string,_id:string,property:array<struct<_type:string,_value:string>>>>,sequence:struct<_VALUE:string,_length:string,_checksum:string>>"
CLUSTER = f"_id string, _updated string, name string, property array<struct<_type:string,_value:string>>, representativeMember array<{_MEMBER}>, member array<{_MEMBER}>"


def multimap(pairs: Column) -> Column:
    """map<string,array<string>> from an array of (_type, _value), values in order."""
    names = F.array_distinct(F.transform(pairs, lambda p: p["_type"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(pairs, lambda p: p["_type"] == n), lambda p: p["_value"])))


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """Reference clusters: id, name, properties, representative_members, members."""
    none = F.array().cast("array<struct<_type:string,_value:string>>")

    def members(c: str) -> Column:
        return F.transform(
            F.coalesce(c, F.array().cast(f"array<{_MEMBER}>")),
            lambda m: F.struct(
                F.transform(m["dbReference"], lambda r: F.struct(r["_type"].alias("type"), r["_id"].alias("id"), multimap(F.coalesce(r["property"], none)).alias("properties"))).alias("db_reference"),
                F.struct(F.regexp_replace(m["sequence"]["_VALUE"], r"\s", "").alias("value"), m["sequence"]["_length"].alias("length"), m["sequence"]["_checksum"].alias("checksum")).alias("sequence"),
            ),
        )

    rows = spark.read.format("xml").option("rowTag", "entry").schema(CLUSTER).load(path)
    return rows.select(F.col("_id").alias("id"), "name", multimap(F.coalesce("property", none)).alias("properties"), members("representativeMember").alias("representative_members"), members("member").alias("members"))
