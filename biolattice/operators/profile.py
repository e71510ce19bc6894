"""Extraction profiles: which attributes of which labels a prompt sees, and under which names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels with (follow children, follow parents).
FOLLOW = {
    "GenomicFeature": (True, True),
    "LocusTag": (True, True),
    "SBMLGene": (True, True),
    "SBMLComplex": (True, True),
    "SBMLReaction": (True, True),
    "SBMLSpecies": (True, False),
    "COBRAComplex": (True, True),
    "COBRAGene": (True, True),
    "COBRAReaction": (True, True),
    "COBRAMetabolite": (True, False),
}
#: Attributes kept, by label; a name is the new one, None keeps the old.
ATTRIBUTES = {
    "GenomicFeature": {"source": "gff_source", "gff_attr_product": "function", "gff_attr_locus_tag": "locus_tag", "gff_attr_old_locus_tag": "old_locus_tag", "feature_type": None},
    "COBRAReaction": {"name": None, "lower_bound": None, "upper_bound": None},
    "COBRAMetabolite": {"name": None, "compartment": None, "formula": None},
    "SBMLReaction": {"name": None, "id": None},
    "SBMLSpecies": {"name": None, "id": None, "compartment": None},
    "ModelSEEDCompound": {"name": None, "formula": None},
    "ModelSEEDReaction": {"name": None, "definition": None, "deltag": None, "deltag_eQuilibrator": None},
}


def projected(label: Column, props: Column, attributes: dict[str, dict[str, str | None]] = ATTRIBUTES) -> Column:
    """props with the profile's attributes only, renamed; labels without an entry keep none."""
    none = F.create_map().cast("map<string,string>")
    out = None
    for name, keep in attributes.items():
        kept = _kept(props, keep)
        out = F.when(label == name, kept) if out is None else out.when(label == name, kept)
    return none if out is None else out.otherwise(none)


def _kept(props: Column, keep: dict[str, str | None]) -> Column:
    entries = [F.struct(F.lit(new or old).alias("key"), F.try_element_at(props, F.lit(old)).alias("value")) for old, new in keep.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def public(props: Column, keep: tuple[str, ...] = ()) -> Column:
    """Without properties whose name starts with an underscore, but for those in keep."""
    return F.map_filter(props, lambda k, _: ~F.startswith(k, F.lit("_")) | k.isin(*(keep or ("",))))


def columns(df: DataFrame, keep: dict[str, str | None]) -> DataFrame:
    """The same for typed tables: a plain select, which prunes the scan."""
    return df.select(*[F.col(old).alias(new or old) for old, new in keep.items()])
