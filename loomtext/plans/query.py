"""Query trees: immutable, built by hand or by the parser, planned as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Literal

Occur = Literal["must", "should", "must_not"]


@dataclass(frozen=True)
class Query:
    boost: float = field(default=1.0, kw_only=True)

    def boosted(self, boost: float) -> Query:
        return replace(self, boost=boost)


@dataclass(frozen=True)
class Term(Query):
    field: str
    text: str


@dataclass(frozen=True)
class KeyTerm(Query):
    """A document by its key, compared without case; scores 1."""

    field: str
    text: str


@dataclass(frozen=True)
class Phrase(Query):
    """Terms at offsets; slop 0 wants them exactly there."""

    field: str
    terms: tuple[tuple[str, int], ...]
    slop: int = 0

    @classmethod
    def of(cls, field: str, words: list[str], slop: int = 0, **kw) -> Phrase:
        """Words at neighbouring places; '.' is a place for any word."""
        return cls(field, tuple((w, i) for i, w in enumerate(words) if w != "."), slop, **kw)


@dataclass(frozen=True)
class Wildcard(Query):
    field: str
    pattern: str


@dataclass(frozen=True)
class Regex(Query):
    field: str
    pattern: str


@dataclass(frozen=True)
class Range(Query):
    """Terms between bounds; None is open."""

    field: str
    lower: str | None
    upper: str | None
    include_lower: bool = True
    include_upper: bool = True

    def __post_init__(self) -> None:
        if self.lower is None and self.upper is None:
            raise ValueError("a range needs one bound at least")


@dataclass(frozen=True)
class Fuzzy(Query):
    """Terms whose edit distance is within (1 - similarity) of their length. compat: only terms from the word on, in code-point order."""

    field: str
    text: str
    similarity: float = 0.5
    compat: bool = False


@dataclass(frozen=True)
class MatchAll(Query):
    pass


@dataclass(frozen=True)
class TypedRange(Query):
    """A range on stored values of a field of type int, float or date; scores 1. Bounds are text as in a query string; None is open."""

    field: str
    type: Literal["int", "float", "date"]
    lower: str | None
    upper: str | None
    include_lower: bool = True
    include_upper: bool = True


@dataclass(frozen=True)
class TypedTerm(Query):
    """A stored value of a typed field; a partial date stands for all moments it fits."""

    field: str
    type: Literal["int", "float", "date"]
    text: str


@dataclass(frozen=True)
class Nothing(Query):
    """Matches no document."""


@dataclass(frozen=True)
class Clause:
    query: Query
    occur: Occur = "should"


@dataclass(frozen=True)
class Boolean(Query):
    clauses: tuple[Clause, ...] = ()

    @classmethod
    def of(cls, must: list[Query] = (), should: list[Query] = (), must_not: list[Query] = (), **kw) -> Boolean:
        parts = [Clause(q, "must") for q in must] + [Clause(q, "should") for q in should] + [Clause(q, "must_not") for q in must_not]
        return cls(tuple(parts), **kw)


def rewrite(q: Query, types: dict[str, str] | None = None) -> Query:
    """The simplest equal tree: one-clause booleans unwrapped with boosts multiplied, short phrases reduced, empty clauses dropped,
    ranges and terms on typed fields made typed."""
    types = types or {}
    if isinstance(q, Boolean):
        clauses = [Clause(r, c.occur) for c in q.clauses if not (isinstance(r := rewrite(c.query, types), Nothing) and c.occur != "must")]
        if len(clauses) == 1 and clauses[0].occur != "must_not":
            return clauses[0].query.boosted(clauses[0].query.boost * q.boost)
        return replace(q, clauses=tuple(clauses)) if clauses else Nothing()
    if isinstance(q, Phrase):
        if not q.terms:
            return Nothing()
        return Term(q.field, q.terms[0][0], boost=q.boost) if len(q.terms) == 1 else q
    if isinstance(q, Range) and types.get(q.field) in ("int", "float", "date"):
        return TypedRange(q.field, types[q.field], q.lower, q.upper, q.include_lower, q.include_upper, boost=q.boost)
    return q


def extract_terms(q: Query) -> set[tuple[str, str]]:
    """(field, term) pairs that a query names, without prohibited clauses."""
    if isinstance(q, Boolean):
        return set().union(*[extract_terms(c.query) for c in q.clauses if c.occur != "must_not"])
    if isinstance(q, (Term, KeyTerm)):
        return {(q.field, q.text)}
    return {(q.field, t) for t, _ in q.terms} if isinstance(q, Phrase) else set()
