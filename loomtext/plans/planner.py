"""Query trees to DataFrames (doc_id, score). Statistics come from one small aggregate over the dictionary; the rest is one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.scalars import YYYY_MM_DD, date_value, float_value, int_value, literal_prefix, parse_query_date, wildcard_position, wildcard_regex
from loomtext.functions.similarity import Similarity, decode_norm_column
from loomtext.plans.query import Boolean, Fuzzy, KeyTerm, MatchAll, Nothing, Phrase, Query, Range, Regex, Term, TypedRange, TypedTerm, Wildcard, rewrite

MULTI = (Wildcard, Regex, Range, Fuzzy)


def _norm() -> Column:
    """The posting's length norm; fields without norms count as 1."""
    return F.coalesce(decode_norm_column(F.col("norm_byte")), F.lit(1.0))


def dictionary_predicate(q: Query) -> Column:
    """The dictionary terms that a multi-term query stands for. Prefixes and bounds are comparisons that reach the Parquet scan."""
    t, mine = F.col("term"), F.col("field") == q.field
    if isinstance(q, Wildcard):
        at = wildcard_position(q.pattern)
        prefix = q.pattern if at < 0 else q.pattern[:at]
        return mine & t.startswith(prefix) & t.rlike("(?s)" + wildcard_regex(q.pattern))
    if isinstance(q, Regex):
        prefix = literal_prefix(q.pattern)
        return mine & t.startswith(prefix) & F.substr(t, F.lit(len(prefix) + 1)).rlike(q.pattern[len(prefix) :])
    if isinstance(q, Range):
        out = mine
        if q.lower is not None:
            out = out & ((t >= q.lower) if q.include_lower else (t > q.lower))
        if q.upper is not None:
            out = out & ((t <= q.upper) if q.include_upper else (t < q.upper))
        return out
    near = 1 - F.levenshtein(F.lower(t), F.lit(q.text.lower())) / F.length(t) >= q.similarity
    return mine & near & (t >= q.text) if q.compat else mine & near


def typed_predicate(index, q: TypedRange | TypedTerm) -> Column:
    f = index.schema[q.field]
    c, kind = F.col(q.field).cast("string"), index.field_kind(q.field)
    native = kind in ("byte", "short", "integer", "long", "float", "double") or kind.startswith("decimal")
    if q.type == "int":  # numbers are compared as they are, which the scan can do; digits are looked for in text only
        value, read = F.col(q.field) if native else int_value(c), lambda s: F.lit(int(s))
    elif q.type == "float":
        value, read = F.col(q.field) if native else float_value(c), lambda s: F.lit(float(s))
    else:
        if kind in ("date", "timestamp", "timestamp_ntz"):
            value = F.col(q.field).cast("timestamp")
        else:
            value = date_value(c, f.form or YYYY_MM_DD)
        at = lambda d: F.timestamp_micros(F.lit(int((d - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 1_000_000 + d.microsecond))
        if isinstance(q, TypedTerm):
            lower, upper = parse_query_date(q.text).interval()
            return (value >= at(lower)) & (value < at(upper))
        # a partial bound stands for all its moments: inclusive bounds take them in, exclusive ones leave them out
        out = value.isNotNull()
        if q.lower is not None:
            lo, hi = parse_query_date(q.lower).interval()
            out = out & ((value >= at(lo)) if q.include_lower else (value >= at(hi)))
        if q.upper is not None:
            lo, hi = parse_query_date(q.upper).interval()
            out = out & ((value < at(hi)) if q.include_upper else (value < at(lo)))
        return out
    if isinstance(q, TypedTerm):
        return value == read(q.text)
    out = value.isNotNull()
    if q.lower is not None:
        out = out & ((value >= read(q.lower)) if q.include_lower else (value > read(q.lower)))
    if q.upper is not None:
        out = out & ((value <= read(q.upper)) if q.include_upper else (value < read(q.upper)))
    return out


def sloppy_frequency(positions: list[list[int]], slop: int, weight: Callable[[int], float] = Similarity().sloppy_freq) -> float:
    """Sum of the weights, 1 / (1 + d) unless given, over the windows that greedy advance of the rearmost term finds within slop. positions: shifted by each term's offset."""
    if not all(positions):
        return 0.0
    heads = [0] * len(positions)
    now = [p[0] for p in positions]
    last, total = max(0, *now), 0.0
    while True:
        k = min(range(len(now)), key=lambda i: (now[i], i))
        following = min(n for i, n in enumerate(now) if i != k)
        start, over = now[k], False
        while now[k] <= following:
            start = now[k]
            heads[k] += 1
            if heads[k] == len(positions[k]):
                over = True
                break
            now[k] = positions[k][heads[k]]
        d = last - start
        if d <= slop:
            total += weight(d)
        if over:
            return total
        last = max(last, now[k])


class Planner:
    """Plans one query against one index."""

    def __init__(self, index):
        self.index, self.sim = index, index.similarity

    def plan(self, query: Query) -> DataFrame:
        q = rewrite(query, self.index.schema.types)
        self._statistics(q)
        squares = self._squares(q)
        return self._score(q, self.sim.query_norm(squares))

    # --- statistics ---

    def _leaves(self, q: Query) -> list[Query]:
        return [x for c in q.clauses if c.occur != "must_not" for x in self._leaves(c.query)] if isinstance(q, Boolean) else [q]

    def _everything(self, q: Query) -> list[Query]:
        return [x for c in q.clauses for x in self._everything(c.query)] if isinstance(q, Boolean) else [q]

    def _statistics(self, q: Query) -> None:
        """max_doc, each named term's document frequency and each multi-term leaf's sum of squared idf and bounds: one row, from one
        pass over the dictionary, kept with the snapshot."""
        leaves = self._everything(q)
        names = sorted({(x.field, x.text) for x in leaves if isinstance(x, Term)} | {(x.field, t) for x in leaves if isinstance(x, Phrase) for t, _ in x.terms})
        several = [x for x in dict.fromkeys(leaves) if isinstance(x, MULTI)]
        self.n = self.index.max_doc() if names or several else 0
        known = self.index.known
        idf2 = F.pow(self.sim.idf_column(F.col("df"), self.n), F.lit(2.0))
        tests, sums, keys = [], [], []
        for name in names:
            if name not in known:
                p = (F.col("field") == name[0]) & (F.col("term") == name[1])
                tests.append(p)
                sums.append(F.coalesce(F.sum(F.when(p, F.col("df"))), F.lit(0)))
                keys.append(name)
        for x in several:
            if (x, self.sim) not in known:
                p = dictionary_predicate(x)
                tests.append(p)
                sums.append(F.struct(F.coalesce(F.sum(F.when(p, idf2)), F.lit(0.0)), F.min(F.when(p, F.col("term"))), F.max(F.when(p, F.col("term")))))
                keys.append((x, self.sim))
        if tests:
            row = self.index.terms().filter(reduce(Column.__or__, tests)).agg(*[c.alias(f"n{i}") for i, c in enumerate(sums)]).first()
            known.update(zip(keys, row, strict=True))
        self.df = {name: known[name] for name in names}
        self.multi = {x: tuple(known[x, self.sim]) for x in several}

    def _idf(self, field: str, text: str) -> float:
        return self.sim.idf(self.df[field, text], self.n)

    def _squares(self, q: Query) -> float:
        if isinstance(q, Boolean):
            return sum(self._squares(c.query) for c in q.clauses if c.occur != "must_not") * q.boost**2
        if isinstance(q, Term):
            return (self._idf(q.field, q.text) * q.boost) ** 2
        if isinstance(q, Phrase):
            return (sum(self._idf(q.field, t) for t, _ in q.terms) * q.boost) ** 2
        if isinstance(q, MULTI):
            return self.multi[q][0] * q.boost**2
        return 0.0 if isinstance(q, Nothing) else 1.0

    # --- plans ---

    def _score(self, q: Query, norm: float) -> DataFrame:
        return getattr(self, f"_{type(q).__name__.lower()}")(q, norm)

    def _none(self) -> DataFrame:
        return self.index.stored().filter(F.lit(False)).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"))

    def _nothing(self, q: Nothing, norm: float) -> DataFrame:
        return self._none()

    def _matchall(self, q: MatchAll, norm: float) -> DataFrame:
        return self.index.stored().select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1.0).alias("score"))

    def _keyterm(self, q: KeyTerm, norm: float) -> DataFrame:
        return self.index.stored().filter(F.lower(F.col(q.field).cast("string")) == q.text.lower()).select("doc_id", F.lit(1.0).alias("score"))

    def _typedrange(self, q: TypedRange, norm: float) -> DataFrame:
        return self.index.stored().filter(typed_predicate(self.index, q)).select("doc_id", F.lit(1.0).alias("score"))

    _typedterm = _typedrange

    def _term(self, q: Term, norm: float) -> DataFrame:
        if not self.df.get((q.field, q.text)):
            return self._none()
        idf = self._idf(q.field, q.text)
        hits = self.index.postings().filter((F.col("field") == q.field) & (F.col("term") == q.text))
        value = idf * idf * q.boost * norm
        return hits.select("doc_id", (self.sim.tf(F.col("tf")) * F.lit(value) * _norm()).alias("score"))

    def _multi(self, q: Query, norm: float) -> DataFrame:
        idf = self.sim.idf_column(F.col("df"), self.n)
        terms = self.index.terms().filter(dictionary_predicate(q)).select("term", (idf * idf * F.lit(q.boost * norm)).alias("value"))
        low, high = self.multi[q][1:]
        if low is None:
            return self._none()
        hits = self.index.postings().filter(dictionary_predicate(q) & (F.col("term") >= low) & (F.col("term") <= high))
        value = self.sim.tf(F.col("tf")) * F.col("value")
        summed = hits.select("term", "doc_id", "tf", "norm_byte").join(terms, "term").groupBy("doc_id").agg(F.sum(value).alias("value"), F.any_value("norm_byte").alias("norm_byte"))
        return summed.select("doc_id", (F.col("value") * _norm()).alias("score"))

    _wildcard = _regex = _range = _fuzzy = _multi

    def _phrase(self, q: Phrase, norm: float) -> DataFrame:
        if not all(self.df.get((q.field, t)) for t, _ in q.terms):
            return self._none()
        total = sum(self._idf(q.field, t) for t, _ in q.terms)
        value = F.lit(total * total * q.boost * norm)
        rows = self.index.postings().filter(F.col("field") == q.field)
        if q.slop == 0:
            freq = self._exact(rows, q)
        else:
            freq = self._sloppy(rows, q)
        return freq.select("doc_id", (self.sim.tf(F.col("freq")) * value * _norm()).alias("score"))

    def _exact(self, rows: DataFrame, q: Phrase) -> DataFrame:
        """Each occurrence of a term proposes where the phrase would begin; places that all terms propose are counted. One exchange."""
        wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t"), F.lit(o).alias("o")) for i, (t, o) in enumerate(q.terms)])
        mine = rows.filter(F.col("term").isin(*{t for t, _ in q.terms}))
        claims = mine.select("doc_id", "norm_byte", "positions", F.explode(F.filter(wanted, lambda w: w["t"] == F.col("term"))).alias("w"))
        sets = claims.select("doc_id", "norm_byte", F.col("w.i").alias("i"), F.transform("positions", lambda p: p - F.col("w.o")).alias("at"))
        each = [F.max(F.when(F.col("i") == i, F.col("at"))).alias(f"p{i}") for i in range(len(q.terms))]
        together = sets.groupBy("doc_id").agg(F.any_value("norm_byte").alias("norm_byte"), *each).dropna(subset=[f"p{i}" for i in range(len(q.terms))])
        common = reduce(F.array_intersect, [F.col(f"p{i}") for i in range(len(q.terms))])
        return together.select("doc_id", "norm_byte", F.size(common).alias("freq")).filter("freq > 0")

    def _sloppy(self, rows: DataFrame, q: Phrase) -> DataFrame:
        mine = rows.filter(F.col("term").isin(*{t for t, _ in q.terms}))
        each = [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, (t, _) in enumerate(q.terms)]
        together = mine.groupBy("doc_id").agg(F.any_value("norm_byte").alias("norm_byte"), *each).dropna(subset=[f"p{i}" for i in range(len(q.terms))])
        # an offset is part of the expression, as a second parameter of the function would be the place in the array
        places = F.array(*[F.expr(f"transform(p{i}, p -> p - {o})") for i, (_, o) in enumerate(q.terms)])
        slop, weight = q.slop, self.sim.sloppy_freq

        def run(batch: pd.Series) -> pd.Series:
            return batch.map(lambda ps: sloppy_frequency([list(p) for p in ps], slop, weight))

        return together.select("doc_id", "norm_byte", F.pandas_udf(run, "double")(places).alias("freq")).filter("freq > 0")

    def _boolean(self, q: Boolean, norm: float) -> DataFrame:
        """Clauses in one union, one aggregate a document: all required there, none prohibited, an optional one if none is required."""
        musts = [i for i, c in enumerate(q.clauses) if c.occur == "must"]
        nots = [i for i, c in enumerate(q.clauses) if c.occur == "must_not"]
        if len(nots) == len(q.clauses):
            return self._none()
        parts = [self._score(c.query, norm * q.boost).select("doc_id", F.lit(i).alias("clause"), "score") for i, c in enumerate(q.clauses)]
        has = lambda i: F.max(F.when(F.col("clause") == i, F.col("score")))
        each = reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(*[has(i).alias(f"c{i}") for i in range(len(q.clauses))])
        test = F.lit(True)
        for i in musts:
            test = test & F.col(f"c{i}").isNotNull()
        for i in nots:
            test = test & F.col(f"c{i}").isNull()
        scoring = [i for i in range(len(q.clauses)) if i not in nots]
        if not musts:
            test = test & reduce(Column.__or__, [F.col(f"c{i}").isNotNull() for i in scoring])
        score = reduce(Column.__add__, [F.coalesce(F.col(f"c{i}"), F.lit(0.0)) for i in scoring])
        if self.sim.coord_enabled:
            overlap = reduce(Column.__add__, [F.col(f"c{i}").isNotNull().cast("int") for i in scoring])
            score = score * overlap / len(scoring)
        return each.filter(test).select("doc_id", score.alias("score"))
