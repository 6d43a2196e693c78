"""Highlighting: a query becomes one regular expression a field, and texts are tagged by built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.plans.query import Boolean, Fuzzy, Phrase, Query, Regex, Term, Wildcard


def _word(q: Query) -> str | None:
    if isinstance(q, Term):
        return rf"\b{re.escape(q.text)}\b" if q.text else None
    if isinstance(q, Fuzzy):
        return rf"\b{re.escape(q.text)}\b"
    if isinstance(q, Wildcard):
        body = "".join(r"\w*" if c == "*" else r"\w" if c == "?" else re.escape(c) for c in q.pattern)
        return rf"\b{body}\b"
    if isinstance(q, Regex):
        return q.pattern
    if isinstance(q, Phrase):
        terms = sorted(q.terms, key=lambda t: t[1])
        out, at = re.escape(terms[0][0]), terms[0][1]
        gap = rf"\W+(?:\w+\W+){{0,{q.slop}}}" if q.slop else r"\W+"
        for t, o in terms[1:]:
            out += r"\W+\w+" * (o - at - 1) + gap + re.escape(t)
            at = o
        return rf"\b{out}\b"
    return None


def expressions(q: Query, conditions: dict[str, list[str]] | None = None, must: bool = False) -> dict[str, list[str]]:
    """Per field the patterns to tag, without prohibited clauses. conditions gets the patterns of required clauses."""
    out: dict[str, list[str]] = {}
    if isinstance(q, Boolean):
        for c in q.clauses:
            if c.occur != "must_not":
                for f, ps in expressions(c.query, conditions, c.occur == "must").items():
                    out.setdefault(f, []).extend(p for p in ps if p not in out.get(f, []))
        return out
    p = _word(q)
    if p:
        out[q.field] = [p]
        if must and conditions is not None:
            conditions.setdefault(q.field, []).append(p)
    return out


def any_of(patterns: list[str]) -> str:
    return "(?iU)(" + "|".join(patterns) + ")"


def sentences(text: Column, delimiters: str = ".?!") -> Column:
    """The text's sentences, each with the delimiter and white space that end it."""
    d = re.escape(delimiters)
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?s)[^{d}]*[{d}]*\s*"), F.lit(0)), lambda s: s != "")


def tag(text: Column, patterns: list[str], start: str = "<b>", end: str = "</b>") -> Column:
    if not patterns:
        return text
    safe = lambda s: s.replace("\\", r"\\").replace("$", r"\$")
    return F.regexp_replace(text, any_of(patterns), f"{safe(start)}$1{safe(end)}")


def annotate(text: Column, patterns: list[str], conditions: list[str] | None = None, start: str = "<b>", end: str = "</b>") -> Column:
    """The text with matches tagged; with conditions, only in sentences that have a match of one of them."""
    if not conditions:
        return tag(text, patterns, start, end)
    marked = lambda s: F.when(s.rlike(any_of(conditions)), tag(s, patterns, start, end)).otherwise(s)
    return F.array_join(F.transform(sentences(text), marked), "")


def whole_match(text: Column, patterns: list[str]) -> Column:
    return text.rlike("(?iU)^(?:" + "|".join(patterns) + ")$")


def precis(text: Column, patterns: list[str], every: bool = False, conditions: list[str] | None = None) -> Column:
    """The first matching stretch between . ; ! ? and commas, or all of them; with conditions (of required clauses) it must match one of them."""
    found = F.filter(sentences(text, ".;!?,"), lambda s: s.rlike(any_of(patterns)))
    if conditions:
        found = F.filter(found, lambda s: s.rlike(any_of(conditions)))
    found = F.transform(found, lambda s: F.trim(s))
    return found if every else F.try_element_at(found, F.lit(1))


def annotated_documents(searcher, query: str | Query, start: str = "<b>", end: str = "</b>", **options) -> DataFrame:
    """A page of results, each with its stored fields and `annotations`: a map from field to tagged text (null where nothing matches)."""
    conditions: dict[str, list[str]] = {}
    found = expressions(searcher.compiled(query), conditions)
    page = searcher.documents(query, **options)
    entries = [x for f, ps in found.items() if f in page.columns for x in (F.lit(f), F.when(F.col(f).rlike(any_of(ps)), annotate(F.col(f), ps, conditions.get(f), start, end)))]
    return page.withColumn("annotations", F.create_map(*entries) if entries else F.create_map().cast("map<string,string>"))


def digest(df: DataFrame, key: str, title: str = "title", author: str = "author", language: str = "language") -> DataFrame:
    """(doc_id, key, title, author, language) in order of the key without case; missing columns are null."""
    get = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return df.select("doc_id", F.col(key).alias("key"), *[get(c).alias(n) for c, n in ((title, "title"), (author, "author"), (language, "language"))]).orderBy(F.lower("key"), "doc_id")
