"""Biological sequences as columns."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .keys import col

#: Letters that each store's sequences may have, by (kind, store).
ALPHABETS = {
    ("dna", "document"): "ACGTRYKMSWHVN",
    ("dna", "array"): "ACGTURYKMSWBDHVN",
    ("protein", "document"): "ACDEFGHIKLMNPQRSTVWYOUBZJX",
    ("protein", "array"): "ACDEFGHIKLMNPQRSTVWY",
}
#: Amino acids, further ones, and letters that stand for several.
STANDARD, EXTENDED, AMBIGUOUS = "ACDEFGHIKLMNPQRSTVWY", "UO", "BJZX*"


def reverse_complement(c: Column | str) -> Column:
    """Complements A, C, G and T of either case; other letters stay."""
    return F.reverse(F.translate(col(c), "ACGTacgt", "TGCAtgca"))


def slice_inclusive(c: Column | str, start: Column, end: Column) -> Column:
    """Letters start to end, counted from 1, both included; null if start is below 1."""
    return F.when(start >= 1, F.substr(col(c), start.cast("int"), F.greatest(F.lit(0), (end - start + 1).cast("int"))))


def _only(c: Column, letters: str) -> Column:
    return c.rlike(f"^[{letters}]+\\z")


def is_standard(c: Column | str) -> Column:
    """Only standard amino acids; false for an empty sequence, like the other three."""
    return _only(col(c), STANDARD)


def is_extended(c: Column | str) -> Column:
    return _only(col(c), STANDARD + EXTENDED)


def is_ambiguous(c: Column | str) -> Column:
    """At least one letter that stands for several."""
    return col(c).rlike(f"[{AMBIGUOUS}]")


def is_valid(c: Column | str) -> Column:
    return _only(col(c), STANDARD + EXTENDED + AMBIGUOUS)


def bad_letters(c: Column | str, alphabet: str, upper: bool = True) -> Column:
    """Letters outside the alphabet, distinct and sorted; an empty array for a good sequence, null for null."""
    text = F.upper(col(c)) if upper else col(c)
    rest = F.regexp_replace(text, f"[{alphabet}]+", "")
    return F.when(text.isNotNull(), F.array_sort(F.array_distinct(F.filter(F.split(rest, ""), lambda x: x != ""))))


@F.pandas_udf(BinaryType())
def compressed(seqs: pd.Series) -> pd.Series:
    """Deflated UTF-8 with a zlib header, as sequence stores keep it; null for null."""
    return seqs.map(lambda s: None if s is None else zlib.compress(s.encode()))


@F.pandas_udf(StringType())
def decompressed(packed: pd.Series) -> pd.Series:
    """The sequence of a compressed one; null for null."""
    return packed.map(lambda b: None if b is None else zlib.decompress(b).decode())
