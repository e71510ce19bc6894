"""Personal data by bootstrapped contextual extraction.

Four strict patterns give seed entities.  The words around seeds and around looser candidates are lexical patterns; patterns and instances form a
graph whose scores are passed back and forth: a pattern is as good as the share of its instances that are trusted, an instance as its best patterns
together.  Candidates that end up trusted are added to the seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, saved

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: The strict patterns with possessive loops: the same leftmost matches as the plain ones, in linear time.
STRICT = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){11}", "phone": r"\+[0-9]"}
#: Looser shapes: written-out addresses, groups of hexadecimal digits, digits with separators.
LOOSE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?[(\[]\x20?at\x20?[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]\x20?dot\x20?[)\]]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])",
    "digits": r"\(?[0-9](?:[\x20()./-]{0,2}+[0-9])++",
}
LOOSE_HINT = {"email": r"[(\[]\x20?at\x20?[)\]]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "digits": r"[0-9](?:[\x20()./-]{0,2}[0-9]){6}"}
#: Rounds of scoring; trusted seed instances that a pattern needs; scores that a pattern and an instance need.
ROUNDS, SUPPORT, TRUST = 3, 3, 0.8
#: Code points read for the words beside an entity.
REACH = 80
_BLOCK = 256


def running(lengths: Column) -> Column:
    """Exclusive running sums of an array<bigint>, in blocks so that the work stays linear."""
    add = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    zero = F.array(F.lit(0).cast("long"))
    n = F.size(lengths)
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int"))), lambda b: F.aggregate(F.slice(lengths, b * _BLOCK + 1, _BLOCK), zero, add)
    )
    offsets = F.aggregate(F.transform(blocks, lambda a: F.element_at(a, -1)), zero, add)
    shifted = F.zip_with(blocks, F.slice(offsets, F.lit(1), F.size(blocks)), lambda a, o: F.transform(F.slice(a, F.lit(1), F.size(a) - 1), lambda x: x + o))
    return F.flatten(shifted)


def _found(df: DataFrame, regex: str, hint: str) -> DataFrame:
    """Adds _m: struct(start, end, text, left gap, right gap) of every match in _text; positions are sums of the pieces between matches."""
    has = F.contains(F.col("_text"), F.lit(hint)) if hint == "@" else F.col("_text").rlike(hint)
    none = F.array().cast("array<string>")
    df = df.withColumn("_has", has)
    df = df.withColumn("_x", F.when(F.col("_has"), F.regexp_extract_all("_text", F.lit(regex), F.lit(0))).otherwise(none))
    df = df.withColumn("_gaps", F.when(F.col("_has"), F.split("_text", regex, -1)).otherwise(none))
    df = df.withColumn("_at", running(F.zip_with("_x", F.slice("_gaps", F.lit(1), F.size("_x")), lambda x, g: (F.length(x) + F.length(g)).cast("long"))))
    made = F.transform(
        "_x",
        lambda x, i: F.struct(
            (F.get("_at", i) + F.length(F.get("_gaps", i))).cast("int").alias("start"),
            (F.get("_at", i) + F.length(F.get("_gaps", i)) + F.length(x)).cast("int").alias("end"),
            x.alias("text"),
            F.right(F.get("_gaps", i), F.lit(REACH)).alias("left"),
            F.left(F.get("_gaps", i + 1), F.lit(REACH)).alias("right"),
        ),
    )
    return df.withColumn("_m", made).drop("_has", "_x", "_gaps", "_at")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5)).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v) % 10 == 0


def _passes(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: p.try_cast("double") <= 255)
    if kind == "card":
        d = _digits(x)
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False))
    return F.length(_digits(x)).between(9, 15) if kind == "phone" else F.lit(True)


def _item(kind: Column, m: Column, strict: bool) -> Column:
    """kind number, place, key of the instance and its patterns."""
    left = F.regexp_extract_all(ascii_lower(m["left"]), F.lit(WORD), F.lit(0))
    right = F.regexp_extract(ascii_lower(m["right"]), f"^[\\x20\\x09-\\x0D]*({WORD})", 1)
    one, two = F.coalesce(F.try_element_at(left, F.lit(-1)), F.lit("")), F.coalesce(F.try_element_at(left, F.lit(-2)), F.lit(""))
    key = F.when(kind >= 2, _digits(m["text"])).otherwise(ascii_lower(m["text"]))
    return F.struct(
        kind.alias("kind"),
        m["start"].alias("start"),
        m["end"].alias("end"),
        F.lit(strict).alias("strict"),
        key.alias("key"),
        # a side without words tells nothing, and would be one pattern for all texts that begin or end there
        F.filter(
            F.array(F.when(one != "", F.concat_ws(" ", two, one, F.lit("_"))), F.when((one != "") | (right != ""), F.concat_ws(" ", one, F.lit("_"), right))),
            lambda p: p.isNotNull(),
        ).alias("patterns"),
    )


def _items(found: Column, kind: Column, strict: bool) -> Column:
    return F.transform(found, lambda m: _item(kind, m, strict))


def _passing(kind: str):
    return lambda m: _passes(kind, m["text"])


def items(docs: DataFrame) -> DataFrame:
    """doc_id and its items, strict ones and candidates, for every row of docs; compact, without texts."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    for n, kind in enumerate(KINDS):
        df = _found(df, STRICT[kind], HINT[kind])
        df = df.withColumn(f"_{kind}", _items(F.filter("_m", _passing(kind)), F.lit(n), True))
    inside = r"[A-Za-z0-9@_%+]"
    free = lambda m: ~m["left"].rlike(inside + "$") & ~m["right"].rlike("^" + inside)
    for n, kind in enumerate(KINDS[:2]):
        df = _found(df, LOOSE[kind], LOOSE_HINT[kind])
        df = df.withColumn(f"_{kind}_loose", _items(F.filter("_m", free), F.lit(n), False))
    df = _found(df, LOOSE["digits"], LOOSE_HINT["digits"])
    taken = lambda m: m["text"].rlike(f"(?:{HINT['ip']})") | F.exists(F.regexp_extract_all(m["text"], F.lit(STRICT["card"]), F.lit(0)), lambda c: _passes("card", c))
    size = lambda m: F.length(_digits(m["text"]))
    df = df.withColumn("_m", F.filter("_m", lambda m: size(m).between(7, 19) & free(m) & ~taken(m)))
    df = df.withColumn("_digits_loose", F.transform("_m", lambda m: _item(F.when(size(m) < 12, 3).otherwise(2), m, False)))
    parts = [f"_{k}" for k in KINDS] + ["_email_loose", "_ip_loose", "_digits_loose"]
    return df.select("doc_id", F.concat(*parts).alias("items"))


def trusted(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """kind and key of the candidates that high-confidence patterns discover, from rows of (items)."""
    each = found.select(F.inline("items")).select("kind", "key", "strict", F.explode("patterns").alias("pattern"))
    # an edge counts once however often it occurs, so a copied document or a hot word pair adds nothing
    edges = saved(each.groupBy("kind", "key", "pattern").agg(F.max("strict").alias("seed")), "pii-edges")
    seeds = edges.groupBy("kind", "key").agg(F.max("seed").alias("seed"))
    scores = seeds.select("kind", "key", "seed", F.col("seed").cast("double").alias("score"))
    for _ in range(rounds):
        patterns = (
            edges.join(scores.select("kind", "key", "score"), ["kind", "key"])
            .groupBy("kind", "pattern")
            .agg((F.sum("score") / (F.count("*") + 1)).alias("worth"), F.sum(F.col("seed").cast("int")).alias("seeds"))
            .where(F.col("seeds") >= support)
        )
        told = edges.join(patterns, ["kind", "pattern"]).groupBy("kind", "key").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("worth")))))).alias("told"))
        scores = saved(
            seeds.join(told, ["kind", "key"], "left").select("kind", "key", "seed", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("told", F.lit(0.0))).alias("score")), "pii-scores"
        )
    return scores.where(~F.col("seed") & (F.col("score") >= trust)).select("kind", "key", "score")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (strict matches), base_sha256, spans (strict and discovered), n_discovered.

    Null and empty texts have no spans.  Discovered spans that overlap a strict one are left out.  Repeated rows each get a row; columns other than doc_id and
    text aren't read.  Patterns and instances are counted over all documents, each pair once.
    """
    rows = saved(items(docs).withColumn("_row", F.monotonically_increasing_id()), "pii-items")
    good = trusted(rows.select("items"), rounds, support, trust)
    candidates = rows.select("_row", F.inline("items")).where(~F.col("strict")).select("_row", "kind", "key", "start", "end")
    more = candidates.join(good, ["kind", "key"]).groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("_more"))
    base = F.transform(F.filter("items", lambda x: x["strict"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    out = rows.select("_row", "doc_id", base.alias("_base")).join(more, "_row", "left")
    clear = F.filter(F.coalesce("_more", F.array().cast("array<struct<start:int,kind:int,end:int>>")), lambda m: ~F.exists("_base", lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"])))
    out = out.withColumn("_clear", clear)
    count = lambda n: F.size(F.filter("_base", lambda x: x["kind"] == n)).cast("long")
    return out.select(
        "doc_id",
        *[count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)],
        F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"),
        _listed(F.concat("_base", "_clear")).alias("spans"),
        F.size("_clear").cast("long").alias("n_discovered"),
    )
