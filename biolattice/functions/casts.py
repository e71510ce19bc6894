"""Typed casts that leave bad values out instead of failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Summary fields that are numbers; all others stay text.
INTEGERS = ("RsUid", "GbUid", "ChainId", "Taxid", "SpeciesTaxid", "TaxId", "Project_Id")
DECIMALS = ("Coverage",)


def typed(fields: Column, names: list[str]) -> list[Column]:
    """Columns from a map<string,string>: numbers by name, null where the text isn't one."""
    kinds = {**dict.fromkeys(INTEGERS, "bigint"), **dict.fromkeys(DECIMALS, "double")}
    return [F.try_element_at(fields, F.lit(n)).try_cast(kinds.get(n, "string")).alias(n) for n in names]


def try_columns(df: DataFrame, **kinds: str) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items()})
