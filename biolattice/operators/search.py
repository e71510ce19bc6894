"""Search by terms of fields: an inverted index of words, and queries put together with `&`, `|` and `~`."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What parts words; words are compared in lower case.
_GAP = r"[^\p{L}\p{N}]+"


class Query:
    """A condition on a record: `Term`, or terms joined by `&`, `|` and `~`."""

    def __and__(self, other: Query) -> Query:
        return _Joined("AND", (self, other))

    def __or__(self, other: Query) -> Query:
        return _Joined("OR", (self, other))

    def __invert__(self) -> Query:
        return _Not(self)

    def terms(self) -> list[Term]:
        raise NotImplementedError

    def holds(self, flag) -> Column:
        """The condition as a Column, from a Column for each term."""
        raise NotImplementedError


@dataclass(frozen=True)
class Term(Query):
    """A word, or words that follow each other, in a field (in any one field if none is named). A term without a word fits nothing."""

    text: str
    field: str | None = None

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(w for w in re.split(r"[\W_]+", self.text.lower()) if w)

    def terms(self) -> list[Term]:
        return [self]

    def holds(self, flag) -> Column:
        return flag(self)

    def __str__(self) -> str:
        return f'"{" ".join(self.words)}"[{self.field or "All Fields"}]'


@dataclass(frozen=True)
class _Joined(Query):
    how: str
    parts: tuple[Query, Query]

    def terms(self) -> list[Term]:
        return [t for p in self.parts for t in p.terms()]

    def holds(self, flag) -> Column:
        a, b = (p.holds(flag) for p in self.parts)
        return a & b if self.how == "AND" else a | b

    def __str__(self) -> str:
        return f"({self.parts[0]} {self.how} {self.parts[1]})"


@dataclass(frozen=True)
class _Not(Query):
    part: Query

    def terms(self) -> list[Term]:
        return self.part.terms()

    def holds(self, flag) -> Column:
        return ~self.part.holds(flag)

    def __str__(self) -> str:
        return f"(NOT {self.part})"


@dataclass
class Index:
    """Postings (field, word, id, pos) and the ids of all records, with and without words."""

    postings: DataFrame
    ids: DataFrame

    @staticmethod
    def of(rows: DataFrame, id: str, *fields: str) -> Index:
        """Over text columns of rows; a record's null fields have no words, rows without an id aren't indexed."""
        rows = rows.where(F.col(id).isNotNull())
        texts = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.col(f).cast("string")).alias("text")) for f in fields])
        each = rows.select(F.col(id).alias("id"), F.explode(texts).alias("t")).where("t.text is not null")
        words = F.filter(F.split("t.text", _GAP), lambda w: w != "")
        found = each.select("id", F.col("t.field").alias("field"), F.posexplode(words).alias("pos", "word"))
        return Index(found.select("field", "word", "id", "pos"), rows.select(F.col(id).alias("id")).distinct())

    def write(self, path: str) -> Index:
        """By field and in ranges of words, so that a query reads only the row groups that its words can be in."""
        path = path.rstrip("/")
        ranged = self.postings.repartitionByRange("field", "word").sortWithinPartitions("field", "word", "id", "pos")
        ranged.write.partitionBy("field").parquet(f"{path}/postings")
        self.ids.write.parquet(f"{path}/ids")
        return Index.read(self.postings.sparkSession, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        return Index(spark.read.parquet(f"{path.rstrip('/')}/postings"), spark.read.parquet(f"{path.rstrip('/')}/ids"))

    def _met(self, terms: list[Term]) -> DataFrame:
        """Distinct (id, term) with the number of each term that a record meets; one scan for all terms, of their words only."""
        wanted = [(k, n, w, t.field, len(t.words)) for k, t in enumerate(terms) for n, w in enumerate(t.words)]
        spark = self.postings.sparkSession
        if not wanted:
            return self.ids.limit(0).withColumn("term", F.lit(0))
        read = self.postings.where(F.col("word").isin(sorted({w for _, _, w, _, _ in wanted})))
        if all(f for *_, f, _ in wanted):
            read = read.where(F.col("field").isin(sorted({f for *_, f, _ in wanted})))
        # as large as the query, whatever the index
        asked = F.broadcast(spark.createDataFrame(wanted, "term int, nth int, word string, of string, size int"))
        rows = read.join(asked, "word").where(F.col("of").isNull() | (F.col("of") == F.col("field")))
        runs = rows.select("id", "term", "field", (F.col("pos") - F.col("nth")).alias("at"), "nth", "size").distinct()
        whole = runs.groupBy("id", "term", "field", "at").agg((F.count("*") == F.max("size")).alias("all")).where("all")
        return whole.select("id", "term").distinct()

    def hits(self, query: Query) -> DataFrame:
        """The ids (column id, each once) of the records that fit."""
        terms = list(dict.fromkeys(query.terms()))
        flags = self._met(terms).groupBy("id").agg(F.collect_set("term").alias("met"))
        fits = query.holds(lambda t: F.array_contains("met", terms.index(t)))
        none = query.holds(lambda t: F.lit(False))
        # records that meet no term fit some queries with NOT only
        rest = self.ids.where(none).join(flags.select("id"), "id", "left_anti")
        return flags.where(fits).select("id").unionByName(rest)

    def page(self, query: Query, size: int = 10, start: int = 0) -> DataFrame:
        """Ids of a page of the hits, in order."""
        return self.hits(query).orderBy("id").offset(start).limit(size)

    def told(self, query: Query) -> DataFrame:
        """(text, n): how many records meet each term, and the whole query as it was understood with its hits."""
        terms = list(dict.fromkeys(query.terms()))
        names = self.postings.sparkSession.createDataFrame([(k, str(t)) for k, t in enumerate(terms)], "term int, text string")
        each = F.broadcast(names).join(self._met(terms).groupBy("term").agg(F.count("*").alias("n")), "term", "left")
        whole = self.hits(query).agg(F.count("*").alias("n")).select(F.lit(str(query)).alias("text"), "n")
        each = each.select("text", F.coalesce("n", F.lit(0)).alias("n"))
        return each if isinstance(query, Term) else each.unionByName(whole)


def any_of(*queries: Query) -> Query:
    return reduce(Query.__or__, queries)
