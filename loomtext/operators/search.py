"""Searching an index: ranked, sorted and paged results, counts, filters, projections, explanations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from loomtext.functions.scalars import float_value, int_value
from loomtext.operators.index import Index
from loomtext.plans.parser import Parser, ParseResult, Sort, SortField
from loomtext.plans.planner import Planner
from loomtext.plans.query import Boolean, Clause, KeyTerm, MatchAll, Phrase, Query, Term, Wildcard, extract_terms, rewrite


#: Pages up to this many hits are fetched by number.
MOST_IDS = 1000


@dataclass(frozen=True)
class Searcher:
    index: Index
    default_field: str = "*"

    def parser(self) -> Parser:
        types = {f.name: f.type for f in self.index.schema.fields if f.indexed or f.type != "text"}
        return Parser(types, self.default_field)

    def parse(self, query: str) -> ParseResult:
        return self.parser().parse(query)

    def compiled(self, query: str | Query) -> Query:
        return rewrite(self.parse(query).query if isinstance(query, str) else query, self.index.schema.types)

    def hits(self, query: str | Query, cutoff: float = 0.0, restrict: DataFrame | None = None) -> DataFrame:
        """All (doc_id, score) above the cutoff; restrict: only documents whose doc_id is in that table."""
        found = Planner(self.index).plan(self.compiled(query)).filter(F.col("score") > cutoff)
        return found if restrict is None else found.join(restrict, "doc_id", "left_semi")

    def total_hits(self, query: str | Query, **options) -> int:
        return self.hits(query, **options).count()

    def search(self, query: str | Query, first: int | None = None, num: int | None = None, sort: Sort | None = None, cutoff: float = 0.0, restrict: DataFrame | None = None) -> DataFrame:
        """(doc_id, score, rank): one page, best first unless sorted otherwise. Given options go before those of a query string."""
        parsed = self.parse(query) if isinstance(query, str) else ParseResult(query)
        first, num, sort = parsed.first if first is None else first, parsed.num if num is None else num, sort or parsed.sort
        if first < 0 or num <= 0:
            raise ValueError("first is at least 0 and num at least 1")
        found, order = self._ordered(self.hits(parsed.query, cutoff, restrict), sort)
        page = found.orderBy(*order).limit(first + num)
        page = page.offset(first) if first else page
        # a page is a few rows: numbering it in one place costs nothing
        return page.select("doc_id", "score", (F.row_number().over(Window.orderBy(*order)) + first).alias("rank"))

    def _ordered(self, found: DataFrame, sort: Sort | None):
        """The hits with their sort columns. Missing values come last, reversed first; ties in document order."""
        if sort is None or sort.fields == (SortField("score"),):
            down = not (sort and sort.reverse)
            return found, [F.col("score").desc() if down else F.col("score").asc(), F.col("doc_id").asc() if down else F.col("doc_id").desc()]
        if sort.fields == (SortField("document"),):
            return found, [F.col("doc_id").desc() if sort.reverse else F.col("doc_id").asc()]
        names = [f.name for f in sort.fields]
        values = []
        for i, name in enumerate(names):
            kind, c = self.index.schema[name].type, F.col(name)
            value = int_value(c.cast("string")) if kind == "int" else float_value(c.cast("string")) if kind == "float" else c
            values.append(value.alias(f"_s{i}"))
        joined = found.join(self.index.stored().select("doc_id", *values), "doc_id")
        order = [F.col(f"_s{i}").desc_nulls_first() if f.reverse != sort.reverse else F.col(f"_s{i}").asc_nulls_last() for i, f in enumerate(sort.fields)]
        return joined, [*order, F.col("doc_id").desc() if sort.reverse else F.col("doc_id").asc()]

    def documents(self, query: str | Query, fields: tuple[str, ...] | None = None, **options) -> DataFrame:
        """A page with the chosen fields (of the query string, or all stored ones), by rank."""
        chosen = fields or (self.parse(query).fields if isinstance(query, str) else ()) or tuple(self.index.schema.names("stored"))
        page = self.search(query, **options)
        found = page.limit(MOST_IDS + 1).collect()
        if len(found) > MOST_IDS:
            return page.join(self.index.stored().select("doc_id", *chosen), "doc_id").orderBy("rank")
        # a page of known size: its numbers go to the scan of the documents, which lie in order of doc_id
        rows = self.index.spark.createDataFrame([tuple(r) for r in found], page.schema)
        stored = self.index.stored().filter(F.col("doc_id").isin([r["doc_id"] for r in found])) if found else self.index.stored().filter(F.lit(False))
        return stored.select("doc_id", *chosen).join(F.broadcast(rows), "doc_id").select("doc_id", "score", "rank", *chosen).orderBy("rank")

    def each(self, query: str | Query, **options) -> Iterator[Row]:
        """One hit after another; stop whenever enough have come."""
        return self.documents(query, **options).toLocalIterator()

    def exists(self, query: str | Query) -> bool:
        return not self.hits(query).isEmpty()

    def doc_number(self, query: str | Query) -> int:
        row = self.hits(query).orderBy("doc_id").first()
        return row["doc_id"] if row else -1

    def by_key(self, value: str) -> DataFrame:
        return self.hits(KeyTerm(self.index.schema.key, value))

    def extract_terms(self, query: str | Query) -> set[tuple[str, str]]:
        return extract_terms(self.compiled(query))

    def explain(self, query: str | Query, doc_id: int) -> list[Row]:
        """What each named term adds for a document: tf, df, idf and norm; and the score."""
        n = self.index.max_doc()
        terms = self.index.spark.createDataFrame(sorted(self.extract_terms(query)) or [("", "")], "field string, term string")
        parts = self.index.postings().filter(F.col("doc_id") == doc_id).join(terms, ["field", "term"]).join(self.index.terms(), ["field", "term"]).join(self.index.norms().select("field", "doc_id", "norm"), ["field", "doc_id"], "left")
        score = self.hits(query).filter(F.col("doc_id") == doc_id).select("score")
        out = parts.select("field", "term", "tf", "df", self.index.similarity.idf_column(F.col("df"), n).alias("idf"), "norm").orderBy("field", "term").collect()
        first = score.first()
        return [Row(value=first["score"] if first else 0.0, description=f"{self.compiled(query)}", details=out)]


def field_query(field: str, value: str) -> Query:
    return Boolean((Clause(Term(field, value.lower()), "must"),))


def wildcard_query(field: str, pattern: str) -> Query:
    return MatchAll() if pattern == "*" else Wildcard(field, pattern)


def phrase_in_class_query(kind: str, field: str, words: str) -> Query:
    """Objects of a class that hold the words as a phrase in a field."""
    return Boolean.of(must=[Term("class", kind.lower()), Phrase.of(field, words.lower().split())])


def class_query(kind: str, words: str) -> str:
    """A query string for objects of a class with all the words."""
    return f"+class:{kind} " + " ".join(f"+{w}" for w in words.split())
