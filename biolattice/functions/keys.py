"""Identity: keys, ids and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is stripped from keys, in Unicode's sense.
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]+"
_FRONT = rf"^{_BLANK}"
_EDGE = rf"{_FRONT}|{_BLANK}\z"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _plain(c: Column) -> Column:
    """Whether it begins and ends with a visible ASCII character: so do most keys, and no pattern has to be tried for them."""
    return F.ascii(c).between(33, 126) & F.ascii(F.right(c, F.lit(1))).between(33, 126)


def is_bare(c: Column | str) -> Column:
    """Whether a key has no white space to strip and is neither empty nor null."""
    return F.coalesce((F.length(col(c)) > 0) & (_plain(col(c)) | ~col(c).rlike(_EDGE)), F.lit(False))


def normalize_key(c: Column | str) -> Column:
    """Strips white space at both ends and turns spaces into underscores; null for null and for empty input, which no node may have."""
    return F.when(F.length(col(c)) > 0, F.replace(F.when(_plain(col(c)), col(c)).otherwise(F.regexp_replace(col(c), _EDGE, "")), F.lit(" "), F.lit("_")))


def scope(c: Column | str) -> tuple[Column, Column]:
    """The first part of keys that have more parts behind it, normalised, and whether it has no white space to strip."""
    bare = F.coalesce(F.ascii(col(c)).between(33, 126) | ~col(c).rlike(_FRONT), F.lit(True))
    return F.replace(F.when(bare, col(c)).otherwise(F.regexp_replace(col(c), _FRONT, "")), F.lit(" "), F.lit("_")), bare


def node_id(label: Column | str, key: Column | str) -> Column:
    """label/key; null if either is null or empty."""
    label = F.lit(label) if isinstance(label, str) else label
    return F.when(F.length(label) > 0, F.concat(label, F.lit("/"), normalize_key(key)))


def edge_id(src_id: Column | str, label: Column | str, dst_id: Column | str) -> Column:
    return F.concat(col(src_id), F.lit("/"), col(label), F.lit("/"), col(dst_id))


def strip_stop(c: Column | str) -> Column:
    """Drops one trailing `*`."""
    c = col(c)
    return F.when(F.endswith(c, F.lit("*")), F.left(c, F.length(c) - 1)).otherwise(c)


def digest(c: Column | str, mode: str = "raw") -> Column:
    """SHA-256 in hex: of the text as it is (raw), upper-cased (upper), or without one trailing `*` and upper-cased (protein)."""
    canonical = {"raw": col, "upper": lambda x: F.upper(col(x)), "protein": lambda x: F.upper(strip_stop(x))}
    if mode not in canonical:
        raise ValueError(f"unknown hash mode {mode!r}")
    return F.sha2(canonical[mode](c), 256)


def list_digest(hashes: Column | str) -> Column:
    """Digest of a multiset of digests, in any order."""
    return F.sha2(F.array_join(F.array_sort(col(hashes)), "_"), 256)


def set_digest(members: Column | str) -> Column:
    """Digest of a set of names, in any order and with repeats."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(col(members))), "|"), 256)


def unescape_keys(m: Column | str) -> Column:
    """`#` in a map's keys back to `.`; of keys that become the same the last stays."""
    entries = F.transform(F.map_entries(col(m)), lambda e: F.struct(F.replace(e["key"], F.lit("#"), F.lit(".")).alias("key"), e["value"].alias("value")))
    return last_wins(entries)


def escape_key(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("."), F.lit("#"))


def last_wins(entries: Column) -> Column:
    """Map from an array of (key, value): the last of equal keys stays, at the first one's place."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))


def quoted(c: Column | str) -> Column:
    """Percent-encoded as part of a URL's path: all but letters, digits and `-._~` as UTF-8 bytes; null for null."""
    form = F.url_encode(col(c))
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def role_key(c: Column | str) -> Column:
    """A functional role's name for comparison: in lower case, letters and digits only."""
    return F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]+", "")


def split_composite(c: Column | str) -> tuple[Column, Column]:
    """Both parts of `left@right`; null unless there is exactly one `@`."""
    parts = F.split(col(c), "@")
    one = F.size(parts) == 2
    return F.when(one, parts[0]), F.when(one, parts[1])
