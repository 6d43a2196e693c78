"""The registered queries of the search engine, and SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import analysis, scalars
from loomtext.functions.stemmer import stem_terms
from loomtext.functions.stopwords import ENGLISH
from loomtext.operators import abstracts, documents, highlight, maintenance, phrases
from loomtext.operators.index import FieldDef, Index, Schema
from loomtext.operators.search import Searcher
from loomtext.plans.parser import Sort, SortField
from loomtext.plans.query import Boolean, Fuzzy, MatchAll, Phrase, Range, Regex, Term, TypedRange, TypedTerm, Wildcard
from loomtext.sources import files
from loomtext.sources.storage import file_system, fresh_path, spread
from loomtext.streaming.append import start_indexing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SCHEMA = Schema((FieldDef("text"), FieldDef("source", index="untokenized"), FieldDef("lang", index="untokenized")), analyzer="lowercase", key="source")
_OPEN: dict[tuple, Index] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _opened(spark: SparkSession, sf_dir: str, name: str, make: Callable[[DataFrame], Index], tag: str = "") -> Index:
    """An index over a table: built once in a session for each state of the table's files, as a search engine's index is."""
    path, fs = file_system(spark, f"{sf_dir}/{name}.parquet")
    state = fs.getFileStatus(path).getModificationTime(), fs.getContentSummary(path).getLength()
    key = (spark.sparkContext.applicationId, sf_dir, name, tag, state)
    if key not in _OPEN:
        _OPEN[key] = make(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return _OPEN[key]


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    return _opened(spark, sf_dir, "documents", lambda df: Index.build(df.select("doc_id", "text", "source", "lang"), SCHEMA))


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# --- SQL building blocks -----------------------------------------------------------------------------------------------

ARRAYS = "arr AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]+'), lambda x: lower(x)) AS a FROM documents)"
POSTINGS = f"""{ARRAYS},
tok AS (SELECT doc_id, unnest(a) AS term, unnest(range(len(a))) AS pos FROM arr),
p AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT doc_id, count(*) AS length FROM tok GROUP BY doc_id),
tbl AS (SELECT b, CASE WHEN b = 0 THEN CAST(0 AS DOUBLE) ELSE (1 + (b & 3) / CAST(4 AS DOUBLE)) * pow(CAST(2 AS DOUBLE), 96 + (b >> 2) - 127) END AS v FROM range(256) t(b)),
byte AS (SELECT length, min(b) AS b FROM (SELECT DISTINCT length FROM len) JOIN tbl ON v >= 1 / sqrt(CAST(length AS DOUBLE)) GROUP BY length),
norm AS (SELECT doc_id, length, b, v AS norm FROM len JOIN byte USING (length) JOIN tbl USING (b)),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
d AS (SELECT term, count(*) AS df, 1 + ln((SELECT n FROM n) / (count(*) + 1)) AS idf FROM p GROUP BY term)"""


def idf_sql(term: str) -> str:
    return f"(SELECT 1 + ln((SELECT n FROM n) / ((SELECT count(*) FROM p WHERE term = '{term}') + 1)))"


def term_sql(term: str, boost: float, q: str) -> str:
    return f"SELECT doc_id, sqrt(tf) * {idf_sql(term)} * {idf_sql(term)} * {boost} * {q} * norm AS score FROM p JOIN norm USING (doc_id) WHERE term = '{term}'"


def q_sql(*weights: str) -> str:
    return "(1 / sqrt(" + " + ".join(f"pow({w}, 2)" for w in weights) + "))"


def multi_sql(where: str) -> str:
    q = f"(SELECT 1 / sqrt(sum(idf * idf)) FROM d WHERE {where})"
    return f"WITH {POSTINGS} SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, sum(sqrt(tf) * idf * idf * {q}) * any_value(norm) AS score FROM p JOIN d USING (term) JOIN norm USING (doc_id) WHERE {where} GROUP BY doc_id) WHERE score > 0"


def bool_sql(must: list[str] = (), should: list[str] = (), must_not: list[str] = ()) -> str:
    q = q_sql(*[idf_sql(t) for t in (*must, *should)])
    names = [(f"m{i}", t) for i, t in enumerate(must)] + [(f"s{i}", t) for i, t in enumerate(should)]
    parts = ", ".join(f"{n} AS ({term_sql(t, 1.0, q)})" for n, t in names)
    joins = " ".join(f"LEFT JOIN {n} ON {n}.doc_id = x.doc_id" for n, _ in names)
    test = " AND ".join(f"{n}.doc_id IS NOT NULL" for n, _ in names if n[0] == "m") or "(" + " OR ".join(f"{n}.doc_id IS NOT NULL" for n, _ in names) + ")"
    gone = "".join(f" AND x.doc_id NOT IN (SELECT doc_id FROM p WHERE term = '{t}')" for t in must_not)
    score = " + ".join(f"coalesce({n}.score, 0)" for n, _ in names)
    return f"WITH {POSTINGS}, {parts} SELECT x.doc_id, round({score}, 6) AS score FROM documents x {joins} WHERE {test}{gone}"


def hits(spark: SparkSession, sf_dir: str, q, index: Index | None = None, **options) -> DataFrame:
    return Searcher(index or index_of(spark, sf_dir)).hits(q, **options).select("doc_id", F.round("score", 6).alias("score"))


def page(spark: SparkSession, sf_dir: str, q, **options) -> DataFrame:
    return Searcher(index_of(spark, sf_dir)).search(q, **options).select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def page_sql(inner: str, first: int = 0, num: int = 10) -> str:
    return f"SELECT doc_id, score, rank FROM (SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({inner})) WHERE rank > {first} AND rank <= {first + num}"


ONE = f"WITH {POSTINGS} " + page_sql(term_sql("thanon", 1.0, q_sql(idf_sql("thanon"))))


@query("q_term_topk", ONE)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(spark, sf_dir, Term("text", "thanon"))


# --- analysis ----------------------------------------------------------------------------------------------------------


def _tokens_sql(pattern: str, lower: bool = False) -> str:
    found = f"regexp_extract_all(coalesce(text, ''), '{pattern}')"
    found = f"list_transform({found}, lambda x: lower(x))" if lower else found
    return f"SELECT doc_id, CAST(position AS INTEGER) AS position, image FROM (SELECT doc_id, unnest({found}) AS image, unnest(range(len({found}))) AS position FROM documents)"


def _token_query(name: str, analyzer: analysis.Analyzer, sql: str | None) -> None:
    query(name, sql)(lambda spark, sf_dir: analysis.token_table(table(spark, sf_dir, "documents"), "text", analyzer))


_token_query("tok_letter", analysis.letter, _tokens_sql("[a-zA-Z]+"))
_token_query("tok_lowercase", analysis.lowercase, _tokens_sql("[a-zA-Z]+", True))
_token_query("tok_word", analysis.word, _tokens_sql(r"[a-zA-Z0-9.\-@]+"))
_token_query("tok_whitespace", analysis.whitespace, _tokens_sql(r"[^\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}]+"))
_UNICODE_WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)
_QUOTED = {c: "chr(10)" if c == "\n" else "'" + c.replace("'", "''") + "'" for c in analysis.PUNCTUATION}
_TYPES = "CASE image " + " ".join(f"WHEN {_QUOTED[c]} THEN '{kind}'" for c, kind in analysis.PUNCTUATION.items()) + " END"


def _re2(pattern: str) -> str:
    """A tokenizer's pattern with Unicode classes spelled out, inside an SQL string."""
    return pattern.replace(r"\w", _UNICODE_WORD).replace(r"\W", "[^" + _UNICODE_WORD[1:]).replace(r"\d", r"\p{Nd}").replace("'", "''")


def _exploded(source: str, tokens: str) -> str:
    return f"SELECT doc_id, CAST(position AS INTEGER) AS position, image FROM (SELECT doc_id, unnest(a) AS image, unnest(range(len(a))) AS position FROM (SELECT doc_id, {tokens} AS a FROM {source}))"


def _found(pattern: str) -> str:
    return f"regexp_extract_all(coalesce(text, ''), '{_re2(pattern)}')"


_STANDARD = (
    f"list_filter(list_transform(list_filter({_found(analysis.STANDARD)}, lambda x: x <> ''), lambda x: lower("
    r"CASE WHEN regexp_matches(x, '^[a-zA-Z]\.([a-zA-Z]\.)+$') THEN replace(x, '.', '') "
    "WHEN regexp_matches(x, '^[a-zA-Z]+''[a-zA-Z]$') THEN regexp_replace(x, '''[sS]', '', 'g') ELSE x END)), "
    f"lambda x: x NOT IN ({_STOPS}))"
)
_token_query("tok_standard", analysis.standard(), _exploded("documents", _STANDARD))
_token_query("tok_base", analysis.base, _tokens_sql(r"[\p{L}\p{M}\p{Nd}\p{Pc}]+"))


_TYPED = (
    f"SELECT doc_id, position, image, CASE WHEN lower(image) IN ({_STOPS}) THEN 'stopword' "
    r"WHEN regexp_matches(image, '^\p{L}+$') THEN 'word' WHEN regexp_matches(image, '^\p{Nd}+$') THEN 'number' "
    f"ELSE {_TYPES} END AS type FROM ({_exploded('documents', _found(analysis.TEXT))})"
)


@query("tok_text_typed", _TYPED)
def tok_text_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = analysis.text().typed(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(t).alias("position", "t")).select("doc_id", "position", "t.image", "t.type")


_TURN_TOKENS = f"list_transform(list_filter({_found(analysis.TEXT)}, lambda x: x <> ' '), lambda x: lower(x))"


@query("tok_query", _exploded("(SELECT conv_id AS doc_id, text FROM conversations)", _TURN_TOKENS))
def tok_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.token_table(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "text"), "text", analysis.query())


_ESCAPED = (
    f"SELECT doc_id, position, lower(image) AS image, CASE WHEN regexp_matches(image, '^{_re2(chr(92) + 'W')}$') THEN coalesce({_TYPES}, 'punctuation') "
    f"ELSE 'word' END AS type FROM ({_exploded('documents', _found(analysis.ESCAPE))})"
)


@query("tok_escape", _ESCAPED)
def tok_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = analysis.escape().typed(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(t).alias("position", "t")).select("doc_id", "position", "t.image", "t.type")


_OPS = ["the", "of", "and"]


@query("tok_operators", f"SELECT doc_id, CAST(position AS INTEGER) AS position, image, CASE WHEN image IN ('the', 'of', 'and') THEN 'operator' ELSE 'word' END AS type FROM ({_tokens_sql('[a-zA-Z]+', True)})")
def tok_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = analysis.operators(_OPS).typed(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(t).alias("position", "t")).select("doc_id", "position", "t.image", "t.type")


_OFFSETS = """WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[a-zA-Z]+') AS t, regexp_split_to_array(coalesce(text, ''), '[a-zA-Z]+') AS g FROM documents),
r AS (SELECT doc_id, unnest(t) AS image, unnest(range(len(t))) AS position, unnest(g[1:len(t)]) AS gap FROM a),
e AS (SELECT doc_id, position, image, sum(length(gap) + length(image)) OVER (PARTITION BY doc_id ORDER BY position) AS stop FROM r)
SELECT doc_id, CAST(position AS INTEGER) AS position, lower(image) AS image, CAST(stop - length(image) AS INTEGER) AS start, CAST(stop AS INTEGER) AS end, 'word' AS type FROM e"""


@query("tok_offsets", _OFFSETS)
def tok_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.offsets(table(spark, sf_dir, "documents"), "text", analysis.lowercase)


@query("stem_porter")
def stem_porter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of the dictionary's words: each distinct word once."""
    words = index_of(spark, sf_dir).terms().filter("field = 'text'").select("term")
    return words.select("term", stem_terms(F.col("term")).alias("stem"))


@query("stop_filtered_positions", f"WITH {ARRAYS}, f AS (SELECT doc_id, list_filter(a, lambda x: NOT list_contains([{_STOPS}], x)) AS a FROM arr) SELECT doc_id, CAST(position AS INTEGER) AS position, image FROM (SELECT doc_id, unnest(a) AS image, unnest(range(len(a))) AS position FROM f)")
def stop_filtered_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.token_table(table(spark, sf_dir, "documents"), "text", analysis.stop())


# --- index tables ------------------------------------------------------------------------------------------------------


@query("postings_tf", f"WITH {POSTINGS} SELECT term, doc_id, tf FROM p")
def postings_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).postings().filter("field = 'text'").select("term", "doc_id", "tf")


@query("doc_freq", f"WITH {POSTINGS} SELECT term, df FROM d")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).terms().filter("field = 'text'").select("term", "df")


@query("field_lengths", f"WITH {POSTINGS} SELECT doc_id, length FROM len")
def field_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).norms().filter("field = 'text'").select("doc_id", "length")


@query("norms_byte", f"WITH {POSTINGS} SELECT doc_id, CAST(b AS INTEGER) AS norm_byte, norm FROM norm")
def norms_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).norms().filter("field = 'text'").select("doc_id", "norm_byte", "norm")


@query("term_vector", f"WITH {POSTINGS} SELECT doc_id, string_agg(term || ':' || tf, ' ' ORDER BY term) AS vector FROM p GROUP BY doc_id")
def term_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = index_of(spark, sf_dir).term_vector("text")
    return v.select("doc_id", F.array_join(F.transform("terms", lambda t: F.concat_ws(":", t["term"], t["tf"].cast("string"))), " ").alias("vector"))


@query("term_positions", f"WITH {POSTINGS} SELECT doc_id, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions FROM tok WHERE term IN ('the', 'of') GROUP BY doc_id")
def term_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = index_of(spark, sf_dir).term_positions("text", "the", "of")
    return v.select("doc_id", F.array_join(F.transform("positions", lambda x: x.cast("string")), " ").alias("positions"))


@query("term_dictionary_range", f"WITH {POSTINGS} SELECT term, df FROM d WHERE term >= 'than'")
def term_dictionary_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).terms_from("text", "than").select("term", "df")


@query("term_docs", f"WITH {POSTINGS} SELECT doc_id, tf FROM p WHERE term = 'the'")
def term_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).term_docs("text", "the")


@query("document_with_term", "SELECT doc_id, source FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE source = 'src3')")
def document_with_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).document_with("source", "src3").select("doc_id", "source")


@query("index_counts", f"WITH {POSTINGS} SELECT count(*) AS max_doc, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'thanon')) AS num_docs FROM documents")
def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a deletion: all documents, and the live ones."""
    ix = maintenance.delete(index_of(spark, sf_dir), Term("text", "thanon"))
    return spark.createDataFrame([(ix.max_doc(), ix.num_docs())], "max_doc long, num_docs long")


# --- queries -----------------------------------------------------------------------------------------------------------


@query("q_term_boost", f"WITH {POSTINGS} " + page_sql(term_sql("thanon", 3.0, q_sql(f"{idf_sql('thanon')} * 3.0"))))
def q_term_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(spark, sf_dir, Term("text", "thanon", boost=3.0))


@query("q_term_page", f"WITH {POSTINGS} " + page_sql(term_sql("the", 1.0, q_sql(idf_sql("the"))), 20, 15))
def q_term_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(spark, sf_dir, Term("text", "the"), first=20, num=15)


_BOOLEANS = {
    "q_bool_must": {"must": ["the", "thanon"]},
    "q_bool_should": {"should": ["thanon", "erin"]},
    "q_bool_mustnot": {"must": ["the"], "must_not": ["of", "was"]},
    "q_bool_mixed": {"must": ["the", "and"], "should": ["thanon", "erin"], "must_not": ["was"]},
}
for _name, _parts in _BOOLEANS.items():
    query(_name, bool_sql(**_parts))(lambda spark, sf_dir, p=_parts: hits(spark, sf_dir, Boolean.of(**{k: [Term("text", t) for t in v] for k, v in p.items()})))


@query("q_bool_only_not", "SELECT doc_id, CAST(0 AS DOUBLE) AS score FROM documents WHERE false")
def q_bool_only_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, Boolean.of(must_not=[Term("text", "the")]))


def _phrase_sql(terms: list[tuple[str, int]]) -> str:
    total = "(" + " + ".join(idf_sql(t) for t, _ in terms) + ")"
    first = terms[0]
    joins = " ".join(f"JOIN tok t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.pos - {o} = t0.pos - {first[1]} AND t{i}.term = '{t}'" for i, (t, o) in enumerate(terms[1:], 1))
    return f"WITH {POSTINGS}, f AS (SELECT t0.doc_id, count(*) AS freq FROM tok t0 {joins} WHERE t0.term = '{first[0]}' GROUP BY t0.doc_id) SELECT doc_id, round(sqrt(freq) * {total} * {total} * {q_sql(total)} * norm, 6) AS score FROM f JOIN norm USING (doc_id)"


@query("q_phrase_exact", _phrase_sql([("of", 0), ("the", 1)]))
def q_phrase_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, Phrase.of("text", ["of", "the"]))


@query("q_phrase_gap", _phrase_sql([("the", 0), ("of", 2)]))
def q_phrase_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, Phrase.of("text", ["the", ".", "of"]))


def _sloppy_sql(first: str, second: str, slop: int) -> str:
    """For two terms the greedy windows are the changes from one term to the other in the order of shifted places.

    Where both stand at one place, the term that stood before goes first, so the order turns with each such place in a row.
    """
    total = f"({idf_sql(first)} + {idf_sql(second)})"
    return f"""WITH {POSTINGS}, m AS (SELECT doc_id, CASE WHEN term = '{first}' THEN pos ELSE pos - 1 END AS place, CASE WHEN term = '{first}' THEN 0 ELSE 1 END AS i FROM tok WHERE term IN ('{first}', '{second}')),
k AS (SELECT doc_id, place, CASE WHEN count(*) = 2 THEN 2 ELSE min(i) END AS kind FROM m GROUP BY doc_id, place),
r AS (SELECT *, sum(CASE WHEN kind < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM k),
t AS (SELECT doc_id, place, kind, (coalesce(max(CASE WHEN kind < 2 THEN kind END) OVER (PARTITION BY doc_id, run), 0)
  + sum(CASE WHEN kind = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY place) - 1) % 2 AS leads FROM r),
g AS (SELECT m.doc_id, place - lag(place) OVER o AS d, i <> lag(i) OVER o AS change FROM m JOIN t USING (doc_id, place) WINDOW o AS (PARTITION BY m.doc_id ORDER BY place, CASE WHEN kind = 2 AND i <> leads THEN 1 ELSE 0 END)),
f AS (SELECT doc_id, sum(1 / CAST(1 + d AS DOUBLE)) AS freq FROM g WHERE change AND d <= {slop} GROUP BY doc_id)
SELECT doc_id, round(sqrt(freq) * {total} * {total} * {q_sql(total)} * norm, 6) AS score FROM f JOIN norm USING (doc_id)"""


@query("q_phrase_sloppy", _sloppy_sql("the", "of", 3))
def q_phrase_sloppy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, Phrase.of("text", ["the", "of"], slop=3))


_MULTI = {
    "q_wildcard_prefix": (Wildcard("text", "thano*"), "term LIKE 'thano%'"),
    "q_wildcard_inner": (Wildcard("text", "th*n?n"), "term LIKE 'th%n_n'"),
    "q_regex_terms": (Regex("text", "er(in|on)$"), "regexp_matches(term, '^er') AND regexp_matches(substr(term, 3), '(in|on)$')"),
    "q_range_terms_incl": (Range("text", "erin", "eris"), "term >= 'erin' AND term <= 'eris'"),
    "q_range_terms_excl": (Range("text", "erin", "eris", False, False), "term > 'erin' AND term < 'eris'"),
    "q_range_terms_open": (Range("text", "zu", None), "term >= 'zu'"),
    "q_fuzzy": (Fuzzy("text", "thanon", 0.8), "1 - levenshtein(term, 'thanon') / CAST(length(term) AS DOUBLE) >= 0.8"),
}
for _name, (_q, _where) in _MULTI.items():
    query(_name, multi_sql(_where))(lambda spark, sf_dir, q=_q: hits(spark, sf_dir, q))


@query("q_match_all", "SELECT doc_id, CAST(1 AS DOUBLE) AS score FROM documents")
def q_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, MatchAll())


def _typed(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str], kind: str, q: TypedRange | TypedTerm) -> DataFrame:
    """Typed queries read stored columns only, so the index holds nothing else. columns: names by what the table calls or computes them."""

    def make(df: DataFrame) -> Index:
        return Index.build(df.selectExpr(*[f"{c} AS {n}" for c, n in columns.items()]), Schema((FieldDef(q.field, index=None, type=kind),)))

    return hits(spark, sf_dir, q, index=_opened(spark, sf_dir, name, make, q.field))


@query("q_int_range", "SELECT p_partkey AS doc_id, CAST(1 AS DOUBLE) AS score FROM part WHERE p_size >= 10 AND p_size < 20")
def q_int_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir, "part", {"p_partkey": "doc_id", "p_size": "p_size"}, "int", TypedRange("p_size", "int", "10", "20", True, False))


@query("q_int_range_negative", "SELECT p_partkey AS doc_id, CAST(1 AS DOUBLE) AS score FROM part WHERE p_size - 25 >= -20 AND p_size - 25 <= 5")
def q_int_range_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir, "part", {"p_partkey": "doc_id", "p_size - 25": "distance"}, "int", TypedRange("distance", "int", "-20", "5"))


@query("q_float_range", "SELECT o_orderkey AS doc_id, CAST(1 AS DOUBLE) AS score FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000")
def q_float_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir, "orders", {"o_orderkey": "doc_id", "o_totalprice": "o_totalprice"}, "float", TypedRange("o_totalprice", "float", "100000", "200000", False, True))


@query("q_float_range_negative", "SELECT c_custkey AS doc_id, CAST(1 AS DOUBLE) AS score FROM customer WHERE c_acctbal >= -500 AND c_acctbal < 250.5")
def q_float_range_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir, "customer", {"c_custkey": "doc_id", "c_acctbal": "c_acctbal"}, "float", TypedRange("c_acctbal", "float", "-500", "250.5", True, False))


_DATED = {"o_orderkey": "doc_id", "o_orderdate": "o_orderdate"}


@query("q_date_range", "SELECT o_orderkey AS doc_id, CAST(1 AS DOUBLE) AS score FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-03-01' AND CAST(o_orderdate AS DATE) < DATE '1998-01-01'")
def q_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir, "orders", _DATED, "date", TypedRange("o_orderdate", "date", "199703", "1997", True, True))


@query("q_date_partial", "SELECT o_orderkey AS doc_id, CAST(1 AS DOUBLE) AS score FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-12-01' AND CAST(o_orderdate AS DATE) < DATE '1997-01-01'")
def q_date_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir, "orders", _DATED, "date", TypedTerm("o_orderdate", "date", "1996-12"))


@query("q_filter_semi", f"SELECT * FROM ({bool_sql(should=['thanon'])}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def q_filter_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, Term("text", "thanon"), restrict=table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id"))


@query("q_score_cutoff", f"WITH {POSTINGS} SELECT doc_id, round(score, 6) AS score FROM ({term_sql('the', 1.0, q_sql(idf_sql('the')))}) WHERE score > 0.05")
def q_score_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, Term("text", "the"), cutoff=0.05)


@query("q_sort_field", f"WITH h AS ({bool_sql(should=['thanon'])}) SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (ORDER BY source NULLS LAST, doc_id) AS rank FROM h JOIN documents USING (doc_id)) WHERE rank <= 25")
def q_sort_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Searcher(index_of(spark, sf_dir)).documents(Term("text", "thanon"), ("source",), num=25, sort=Sort((SortField("source"),)))
    return found.select("doc_id", "source", F.col("rank").cast("long").alias("rank"))


@query("q_sort_multi_rev", f"WITH h AS ({bool_sql(should=['the'])}) SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY lang DESC NULLS FIRST, source NULLS LAST, doc_id) AS rank FROM h JOIN documents USING (doc_id)) WHERE rank <= 40")
def q_sort_multi_rev(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Searcher(index_of(spark, sf_dir)).search(Term("text", "the"), num=40, sort=Sort((SortField("lang", True), SortField("source"))))
    return found.select("doc_id", F.col("rank").cast("long").alias("rank"))


@query("q_sort_docorder", f"WITH h AS ({bool_sql(should=['the'])}) SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM h) WHERE rank <= 12")
def q_sort_docorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(index_of(spark, sf_dir)).search("text:the/-document:0,12").select("doc_id", F.col("rank").cast("long").alias("rank"))


@query("q_parse_string", page_sql(bool_sql(must=["the"], should=["thanon", "erin"], must_not=["was"]), 5, 30))
def q_parse_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(spark, sf_dir, "+text:the text:thanon text:erin -text:was/score:5,30")


@query("q_key_lookup", "SELECT doc_id, CAST(1 AS DOUBLE) AS score FROM documents WHERE lower(source) = 'src7'")
def q_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(index_of(spark, sf_dir)).by_key("SRC7")


@query("q_chosen_fields", "SELECT doc_id, lang, source FROM (" + page_sql(bool_sql(should=["thanon"])) + ") JOIN documents USING (doc_id)")
def q_chosen_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(index_of(spark, sf_dir)).documents("text:thanon/score[lang s*]").select("doc_id", "lang", "source")


# --- aggregates and documents --------------------------------------------------------------------------------------------


@query("field_values", "SELECT DISTINCT source AS value FROM documents WHERE source <> ''")
def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).field_values("source")


@query("key_frequency", "SELECT lower(source) AS key, count(*) AS n FROM documents GROUP BY 1")
def key_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).key_frequency()


@query("metadata_vector", "SELECT doc_id, source AS key, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS author, lang AS language FROM documents")
def metadata_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return highlight.digest(table(spark, sf_dir, "documents"), "source", language="lang")


@query("corpus_survey", "SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS total, CAST(floor(avg(n_chars)) AS BIGINT) AS average, count(*) FILTER (n_chars = 0) AS empty FROM documents")
def corpus_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.survey(table(spark, sf_dir, "documents").select(F.col("n_chars").alias("size")))


@query("line_counts", "SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS INTEGER) AS lines FROM documents")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", files.line_count(F.col("text")).cast("int").alias("lines"))


@query("news_source", "SELECT doc_id AS path, string_split(text, chr(10))[1] AS title, substr(text, length(string_split(text, chr(10))[1]) + 2) AS body FROM documents")
def news_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.news(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"))


@query("suffix_counts", "SELECT regexp_extract(url, '([^/-]*)$', 1) AS suffix, count(*) AS n FROM (SELECT regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') AS url FROM pages) GROUP BY 1")
def suffix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.by_suffix(table(spark, sf_dir, "pages").select(F.col("url").alias("path")))


@query("html_strip", "SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scalars.strip_html(F.col("html")).alias("text"))


@query("html_escape", "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS text FROM pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scalars.escape_html(F.col("html")).alias("text"))


@query("multi_values", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS joined, count(*) AS n FROM conversations GROUP BY conv_id")
def multi_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as the values of one field."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(ordered.alias("values"))
    return rows.select("conv_id", documents.joined_values(F.col("values")).alias("joined"), F.size("values").cast("long").alias("n"))


# --- changes -----------------------------------------------------------------------------------------------------------


_CUSTOMERS = Schema((FieldDef("c_name"), FieldDef("c_mktsegment", index="untokenized")), analyzer="word", key="c_name")


def _customers(spark: SparkSession, sf_dir: str) -> tuple[Index, DataFrame]:
    """The index of customers, and new rows of which half have keys that are there."""
    index = _opened(spark, sf_dir, "customer", lambda df: Index.build(df.select(F.col("c_custkey").alias("doc_id"), "c_name", "c_mktsegment"), _CUSTOMERS))
    c = table(spark, sf_dir, "customer").filter("c_custkey % 10 = 0")
    half = F.col("c_custkey") % 20 == 0
    new = c.select((F.col("c_custkey") + F.when(half, 1_000_000).otherwise(0)).alias("doc_id"), F.concat(F.when(half, F.lit("New ")).otherwise(F.lit("")), F.upper("c_name")).alias("c_name"), F.lit("new").alias("c_mktsegment"))
    return index, new


_NEW = """new AS (SELECT c_custkey + CASE WHEN c_custkey % 20 = 0 THEN 1000000 ELSE 0 END AS doc_id,
CASE WHEN c_custkey % 20 = 0 THEN 'New ' ELSE '' END || upper(c_name) AS c_name, 'new' AS c_mktsegment FROM customer WHERE c_custkey % 10 = 0),
old AS (SELECT c_custkey AS doc_id, c_name, c_mktsegment FROM customer)"""


@query("upsert_by_key", f"WITH {_NEW} SELECT * FROM old WHERE lower(c_name) NOT IN (SELECT lower(c_name) FROM new) UNION ALL SELECT * FROM new")
def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.upsert(*_customers(spark, sf_dir)).stored().select("doc_id", "c_name", "c_mktsegment")


@query("insert_if_absent", f"WITH {_NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE lower(c_name) NOT IN (SELECT lower(c_name) FROM old)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.insert_if_absent(*_customers(spark, sf_dir)).stored().select("doc_id", "c_name", "c_mktsegment")


@query("upsert_then_search", f"WITH {_NEW} SELECT doc_id, CAST(1 AS BIGINT) AS tf FROM new")
def upsert_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of a word that only the replaced and added documents hold."""
    return maintenance.upsert(*_customers(spark, sf_dir)).term_docs("c_mktsegment", "new")


@query("change_feed", f"WITH {_NEW} SELECT * FROM old WHERE lower(c_name) NOT IN (SELECT lower(c_name) FROM new) UNION ALL SELECT * FROM new WHERE doc_id % 3 = 0")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, new = _customers(spark, sf_dir)
    feed = new.withColumn("op", F.when(F.col("doc_id") % 3 == 0, "upsert").otherwise("delete"))
    return maintenance.apply_changes(index, feed).stored().select("doc_id", "c_name", "c_mktsegment")


_HALVES = f"WITH {POSTINGS} " + page_sql(term_sql("thanon", 1.0, q_sql(idf_sql("thanon"))))


@query("add_then_search", _HALVES)
def add_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segments answer as one: the second half of the documents is added to an index of the first."""
    middle = table(spark, sf_dir, "documents").agg(F.floor(F.avg("doc_id")).cast("long")).first()[0]
    first = _opened(spark, sf_dir, "documents", lambda df: Index.build(df.select("doc_id", "text", "source", "lang").filter(F.col("doc_id") <= middle), SCHEMA), "half")
    rest = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang").filter(F.col("doc_id") > middle)
    found = Searcher(maintenance.add(first, rest)).search(Term("text", "thanon"))
    return found.select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("stream_then_search", _HALVES)
def stream_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come as a stream; each micro-batch is a segment."""
    schema, path = spark.read.parquet(f"{sf_dir}/documents.parquet").schema, fresh_path(spark, "streamed")
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]").select("doc_id", "text", "source", "lang")
    start_indexing(source, SCHEMA, path, fresh_path(spark, "stream-checkpoint")).awaitTermination()
    found = Searcher(Index.open(spark, path, SCHEMA)).search(Term("text", "thanon"))
    return found.select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("persist_and_open", f"WITH {POSTINGS} SELECT term, 2 * df AS df FROM d")
def persist_and_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persisted, then persisted again behind itself."""
    index, path = index_of(spark, sf_dir), fresh_path(spark, "persisted")
    maintenance.persist(index, path)
    return maintenance.persist(index, path, append=True).terms().filter("field = 'text'").select("term", "df")


@query("set_norm", f"WITH {POSTINGS} SELECT doc_id, round(CASE WHEN doc_id = (SELECT min(doc_id) FROM p WHERE term = 'thanon') THEN CAST(2 AS DOUBLE) ELSE norm END, 6) AS norm FROM norm")
def set_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    return maintenance.set_norm(index, Searcher(index).doc_number(Term("text", "thanon")), "text", 2.0).norms().filter("field = 'text'").select("doc_id", F.round("norm", 6).alias("norm"))


@query("delete_by_query", f"WITH {POSTINGS} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'thanon')")
def delete_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.delete(index_of(spark, sf_dir), Term("text", "thanon")).stored().select("doc_id", "source")


@query("update_by_query", f"WITH {POSTINGS} SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM p WHERE term = 'thanon') THEN 'changed' ELSE lang END AS lang FROM documents")
def update_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.update(index_of(spark, sf_dir), Term("text", "thanon"), {"lang": "changed"}).stored().select("doc_id", "lang")


@query("merge_indexes", f"WITH {POSTINGS} SELECT term, 2 * df AS df FROM d")
def merge_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = index_of(spark, sf_dir)
    return maintenance.merge([one, one]).terms().filter("field = 'text'").select("term", "df")


@query("compact", f"WITH {POSTINGS} SELECT term, count(*) AS df FROM p WHERE doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'thanon') GROUP BY term")
def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.compact(maintenance.delete(index_of(spark, sf_dir), Term("text", "thanon"))).terms().filter("field = 'text'").select("term", "df")


# --- text analytics ------------------------------------------------------------------------------------------------------


_EDGE = "([^" + _UNICODE_WORD[1:]  # a character beside a word, in an open group


@query("highlight_terms", rf"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '{_UNICODE_WORD}+|[^{_UNICODE_WORD[1:]}+'), lambda x: CASE WHEN lower(x) IN ('the', 'erin') THEN '<b>' || x || '</b>' ELSE x END), '') AS marked FROM documents")
def highlight_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = highlight.expressions(Boolean.of(should=[Term("text", "the"), Term("text", "erin")]))["text"]
    return table(spark, sf_dir, "documents").select("doc_id", highlight.tag(F.col("text"), patterns).alias("marked"))


_PRECIS = r"SELECT doc_id, trim(list_filter(regexp_extract_all(text, '[^.;!?,]*[.;!?,]*\s*'), lambda s: {test})[1], ' ' || chr(10)) AS precis FROM documents"


def _has_word(words: str) -> str:
    return rf"regexp_matches(s, '(?i)(^|{_EDGE}))({words})($|{_EDGE}))')"


@query("precis_first_sentence", _PRECIS.replace("{test}", _has_word("the")))
def precis_first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = highlight.precis(F.col("text"), highlight.expressions(Term("text", "the"))["text"])
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(got, F.lit(" \n")).alias("precis"))


@query("precis_conditions", _PRECIS.replace("{test}", _has_word("the|erin") + " AND " + _has_word("erin")))
def precis_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A required word: only stretches that hold it count."""
    conditions: dict[str, list[str]] = {}
    patterns = highlight.expressions(Boolean.of(must=[Term("text", "erin")], should=[Term("text", "the")]), conditions)["text"]
    got = highlight.precis(F.col("text"), patterns, conditions=conditions["text"])
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(got, F.lit(" \n")).alias("precis"))


_WORDS = r"regexp_extract_all(text, '[a-zA-Z0-9]+|[^\p{L}\p{M}\p{Nd}\p{Pc}]')"


_PHRASES = f"""WITH RECURSIVE toks AS (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS pos FROM (SELECT doc_id, list_filter({_WORDS}, lambda x: x <> ' ') AS l FROM documents)),
w AS (SELECT doc_id, pos, w FROM toks WHERE regexp_matches(w, '^[a-zA-Z]+$') AND lower(w) NOT IN ({_STOPS})),
g AS (SELECT doc_id, pos, w AS first, w AS phrase, 1 AS words, CAST(2 AS BIGINT) AS n FROM w
  UNION ALL SELECT doc_id, pos, first, phrase, words, n FROM (
    SELECT g.doc_id, g.pos, g.first, g.phrase || ' ' || w.w AS phrase, g.words + 1 AS words, count(*) OVER (PARTITION BY g.doc_id, g.phrase || ' ' || w.w) AS n
    FROM g JOIN w ON w.doc_id = g.doc_id AND w.pos = g.pos + g.words WHERE w.w <> g.first) WHERE n > 1),
f AS (SELECT DISTINCT doc_id, phrase, n FROM g WHERE words > 1)
SELECT doc_id, phrase, n, coalesce(starts_with(lower(lead(phrase) OVER o), lower(phrase)) AND lead(n) OVER o = n, false) AS redundant
FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY lower(phrase), phrase)"""


@query("phrases_repeated", _PHRASES)
def phrases_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.text_phrases(table(spark, sf_dir, "documents"), "text").select("doc_id", "phrase", "n", "redundant")


@query("token_frequencies", f"SELECT doc_id, lower(w) AS word, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) WHERE regexp_matches(w, '^[a-zA-Z]+$') AND lower(w) NOT IN ({_STOPS}) GROUP BY ALL")
def token_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.token_frequencies(table(spark, sf_dir, "documents"), "text")


_ABSTRACT = f"""WITH toks AS (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS pos FROM (SELECT doc_id, {_WORDS} AS l FROM documents)),
s AS (SELECT doc_id, w, sum(CASE WHEN w IN ('.', '?', '!', ';') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sentence FROM toks),
w AS (SELECT doc_id, sentence, lower(w) AS word FROM s WHERE regexp_matches(w, '^[a-zA-Z]+$') AND lower(w) NOT IN ({_STOPS}) AND length(w) > 1),
cores AS (SELECT DISTINCT doc_id, sentence FROM w WHERE word = 'erin'),
c AS (SELECT w.doc_id, w.word, count(*) AS frequency, count(m.sentence) AS overlap FROM w LEFT JOIN cores m ON m.doc_id = w.doc_id AND m.sentence = w.sentence WHERE w.doc_id IN (SELECT doc_id FROM cores) GROUP BY ALL),
r AS (SELECT *, word = 'erin' AS core, count(*) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY (word = 'erin') DESC, overlap DESC, word) AS place FROM c),
l AS (SELECT *, max(CASE WHEN place = 9 THEN overlap END) OVER (PARTITION BY doc_id) AS bound FROM r)
SELECT doc_id, word, frequency, CAST(overlap AS BIGINT) AS overlap, round(CASE WHEN core THEN 1 ELSE overlap / CAST(frequency AS DOUBLE) END, 6) AS saturation, core FROM l
WHERE overlap > 0 AND (total <= 12 OR (place <= 12 AND (core OR overlap >= bound)))"""


@query("word_abstract", _ABSTRACT)
def word_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abstracts.abstract(table(spark, sf_dir, "documents"), "text", "erin").withColumn("saturation", F.round("saturation", 6))


def _map_sql() -> str:
    """One step for each of the eleven words below the core: its candidates are the words that no step before has taken."""
    sentence = rf"(?i)(^|{_EDGE}))erin($|{_EDGE}))"
    out = f"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.?!]+')) AS t, unnest(range(len(regexp_extract_all(text, '[^.?!]+')))) AS sentence FROM documents),
w AS MATERIALIZED (SELECT doc_id, sentence, lower(x) AS word FROM (SELECT doc_id, sentence, unnest({_WORDS.replace('text', 't')}) AS x FROM s WHERE regexp_matches(t, '{sentence}')) WHERE regexp_matches(x, '^[a-zA-Z]+$') AND lower(x) NOT IN ({_STOPS}) AND length(x) > 1),
total AS MATERIALIZED (SELECT doc_id, word, count(*) AS frequency FROM w GROUP BY ALL),
t1 AS MATERIALIZED (SELECT doc_id, 'erin' AS parent, 'erin' AS word, count(*) AS overlap, CAST(0 AS BIGINT) AS place FROM w WHERE word = 'erin' GROUP BY doc_id),
taken1 AS (SELECT * FROM t1)"""
    for k in range(2, 14):
        parents = "SELECT doc_id, 'erin' AS parent FROM t1" if k == 2 else f"SELECT doc_id, word AS parent FROM t2 WHERE place = {k - 2}"
        out += f""",
p{k} AS ({parents}),
c{k} AS (SELECT total.doc_id, parent, word FROM total JOIN p{k} USING (doc_id) WHERE word <> parent AND NOT EXISTS (SELECT 1 FROM taken{k - 1} k WHERE k.doc_id = total.doc_id AND k.word = total.word)),
n{k} AS (SELECT w.doc_id, w.word, count(*) AS overlap FROM w JOIN (SELECT DISTINCT w.doc_id, sentence FROM w JOIN p{k} ON p{k}.doc_id = w.doc_id AND parent = word) m USING (doc_id, sentence) GROUP BY ALL),
r{k} AS (SELECT c.doc_id, parent, c.word, coalesce(overlap, 0) AS overlap, row_number() OVER (PARTITION BY c.doc_id ORDER BY coalesce(overlap, 0) DESC, c.word) AS place, count(*) OVER (PARTITION BY c.doc_id) AS many FROM c{k} c LEFT JOIN n{k} n ON n.doc_id = c.doc_id AND n.word = c.word),
l{k} AS (SELECT *, max(CASE WHEN place = 8 THEN overlap END) OVER (PARTITION BY doc_id) AS bound FROM r{k}),
t{k} AS MATERIALIZED (SELECT doc_id, parent, word, overlap, place FROM l{k} WHERE overlap > 0 AND (many < 12 OR (place < 12 AND overlap >= bound))),
taken{k} AS MATERIALIZED (SELECT * FROM taken{k - 1} UNION ALL SELECT * FROM t{k})"""
    return out + " SELECT doc_id, parent, word, CAST(overlap AS BIGINT) AS overlap, round(overlap / CAST(frequency AS DOUBLE), 6) AS saturation FROM taken13 JOIN total USING (doc_id, word)"


@query("word_map", _map_sql())
def word_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abstracts.wordmap(table(spark, sf_dir, "documents"), "text", "erin").withColumn("saturation", F.round("saturation", 6))
