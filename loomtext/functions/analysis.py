"""Analysis of text into tokens: each analyzer is a Column expression for tables and a Python twin for query strings.

A token is (image, type); its position is its place in the array, so a filter that drops tokens closes the gap.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.stopwords import stop_words

# The patterns of the tokenizers.
LETTER = r"[a-zA-Z]+"
WHITESPACE = r"\S+"
WORD = r"[a-zA-Z0-9.\-@]+"
BASE = r"\w+"
TEXT = r"[a-zA-Z0-9]+|\W"
ESCAPE = r"\w+|\W"
_P, _HAS_DIGIT = r"[_\/.,-]", r"\w*\d\w*"
STANDARD = (
    r"[a-zA-Z]+(?:(?:'[a-zA-Z]+)+|\.(?:[a-zA-Z]\.)+|(?:@|\&)\w+(?:[-.]\w+)*)"
    r"|\w+(?:(?:[\-._]\w+)*\@\w+(?:[-.]\w+)+"
    rf"|{_P}{_HAS_DIGIT}(?:{_P}\w+{_P}{_HAS_DIGIT})*(?:{_P}\w+)?"
    r"|(?:\.\w+)+|)"
)
#: Patterns whose matches have a character at least, so that none is to be dropped.
NEVER_EMPTY = frozenset({LETTER, WHITESPACE, WORD, BASE, TEXT, ESCAPE, STANDARD})

# Types of single characters that are not words.
PUNCTUATION = {
    ".": "period", ":": "colon", ";": "semicolon", "-": "hyphen", ",": "comma", "/": "slash", "\\": "backslash", "#": "hash", "&": "ampersand",
    "!": "exclamation-mark", ">": "gt", "<": "lt", "[": "open-square-bracket", "]": "closing-square-bracket", "{": "open-curly-bracket",
    "}": "closing-curly-bracket", "(": "open-parenthesis", ")": "closing-parenthesis", "%": "percentage", "|": "vertical-bar", "~": "tilde",
    "@": "at-sign", "$": "dollar", "^": "circumflex", "*": "asterisk", "?": "question-mark", "_": "underscore", "=": "equal", "+": "plus",
    "'": "single-quote", '"': "double-quote", "`": "grave", " ": "space", "\n": "newline",
}
TERMINATORS = ("period", "question-mark", "exclamation-mark", "semicolon")


@dataclass(frozen=True)
class Token:
    """A token; equal and ordered by start, end and image."""

    image: str
    start: int
    end: int
    type: str = field(default="word", compare=False)

    def __lt__(self, other: Token) -> bool:
        return (self.start, self.end, self.image) < (other.start, other.end, other.image)


def scan(pattern: str, text: str) -> list[Token]:
    """Leftmost matches with their offsets; an empty match moves on by one character and is no token."""
    return [Token(m[0], m.start(), m.end()) for m in re.finditer(pattern, text) if m[0]]


def extract(pattern: str, text: Column) -> Column:
    """The same matches as an array of strings; null text has none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))
    return found if pattern in NEVER_EMPTY else F.filter(found, lambda x: x != "")


def _simple_standard(image: str) -> str:
    if re.search(r"^[a-zA-Z]\.(?:[a-zA-Z]\.)+$", image):
        return image.replace(".", "")
    if re.search(r"^[a-zA-Z]+'[a-zA-Z]$", image):
        return re.sub(r"'[sS]", "", image)
    return image


def _standard_column(x: Column) -> Column:
    dotted, owned = x.rlike(r"^[a-zA-Z]\.(?:[a-zA-Z]\.)+$"), x.rlike(r"^[a-zA-Z]+'[a-zA-Z]$")
    return F.when(dotted, F.replace(x, F.lit("."), F.lit(""))).when(owned, F.regexp_replace(x, "'[sS]", "")).otherwise(x)


def punctuation_type(c: str) -> str | None:
    return PUNCTUATION.get(c)


def is_number(s: str) -> bool:
    return bool(s) and all(c.isdigit() for c in s)


def is_letters(s: str) -> bool:
    return bool(s) and all(c.isalpha() for c in s)


def text_type(image: str, stop: frozenset[str]) -> str | None:
    if image.lower() in stop:
        return "stopword"
    if is_letters(image):
        return "word"
    if is_number(image):
        return "number"
    return punctuation_type(image)


def text_type_column(image: Column, stop: list[str]) -> Column:
    types = F.create_map(*[F.lit(x) for pair in PUNCTUATION.items() for x in pair])
    return F.when(F.lower(image).isin(*stop), "stopword").when(image.rlike(r"(?U)^\p{L}+$"), "word").when(image.rlike(r"^\p{Nd}+$"), "number").otherwise(F.try_element_at(types, image))


@dataclass(frozen=True)
class Analyzer:
    """column: text -> array of images; twin: text -> tokens. typed, where types matter: text -> array<struct<image, type>>."""

    name: str
    column: Callable[[Column], Column]
    twin: Callable[[str], list[Token]]
    typed: Callable[[Column], Column] | None = None
    pattern: str | None = None  # where the tokens are this pattern's matches, but for case

    def terms(self, text: str | None) -> list[str]:
        return [t.image for t in self.twin(text or "")]


def _lowered(tokens: list[Token]) -> list[Token]:
    return [Token(t.image.lower(), t.start, t.end, t.type) for t in tokens]


def _plain(name: str, pattern: str, lower: bool = False) -> Analyzer:
    column = (lambda c: F.transform(extract(pattern, c), F.lower)) if lower else (lambda c: extract(pattern, c))
    return Analyzer(name, column, (lambda t: _lowered(scan(pattern, t))) if lower else (lambda t: scan(pattern, t)), pattern=pattern)


base = _plain("base", BASE)
letter = _plain("letter", LETTER)
lowercase = _plain("lowercase", LETTER, lower=True)
whitespace = _plain("whitespace", WHITESPACE)
word = _plain("word", WORD)


def without(tokens: Column, words: list[str]) -> Column:
    """Tokens but for the listed words; those after move up."""
    return F.filter(tokens, lambda x: ~x.isin(*words)) if words else tokens


def stop(words: list[str] | None = None) -> Analyzer:
    words = stop_words() if words is None else words
    dropped = frozenset(words)
    return Analyzer("stop", lambda c: without(lowercase.column(c), words), lambda t: [x for x in lowercase.twin(t) if x.image not in dropped])


def standard(words: list[str] | None = None) -> Analyzer:
    """Acronyms, names with & or @, e-mail addresses, numbers and dotted words stay whole; lower-cased, without stop words."""
    words = stop_words() if words is None else words
    dropped = frozenset(words)

    def twin(text: str) -> list[Token]:
        found = _lowered([Token(_simple_standard(t.image), t.start, t.end) for t in scan(STANDARD, text)])
        return [t for t in found if t.image not in dropped]

    return Analyzer("standard", lambda c: without(F.transform(extract(STANDARD, c), lambda x: F.lower(_standard_column(x))), words), twin)


def text(words: list[str] | None = None) -> Analyzer:
    """Words and every other single character, with types; nothing is dropped."""
    words = stop_words() if words is None else words
    listed = frozenset(words)
    typed = lambda c: F.transform(extract(TEXT, c), lambda x: F.struct(x.alias("image"), text_type_column(x, words).alias("type")))
    return Analyzer("text", lambda c: extract(TEXT, c), lambda t: [Token(x.image, x.start, x.end, text_type(x.image, listed) or "") for x in scan(TEXT, t)], typed)


def query(words: list[str] | None = None) -> Analyzer:
    """As text, but without spaces and lower-cased: how words of a query string are read."""
    words = stop_words() if words is None else words
    listed = frozenset(words)

    def twin(t: str) -> list[Token]:
        return [Token(x.image.lower(), x.start, x.end, text_type(x.image, listed) or "") for x in scan(TEXT, t) if x.image != " "]

    return Analyzer("query", lambda c: F.transform(F.filter(extract(TEXT, c), lambda x: x != " "), F.lower), twin)


def operators(words: list[str]) -> Analyzer:
    listed = frozenset(words)
    typed = lambda c: F.transform(lowercase.column(c), lambda x: F.struct(x.alias("image"), F.when(x.isin(*words), "operator").otherwise("word").alias("type")))
    return Analyzer("operators", lowercase.column, lambda t: [Token(x.image, x.start, x.end, "operator" if x.image in listed else "word") for x in lowercase.twin(t)], typed)


def _escape_type(image: str) -> str:
    if re.search(r"^\W$", image):
        return PUNCTUATION.get(image, "punctuation")
    return "wildcard-word" if re.search(r"(^|[^\\])(\*|\?)", image) else "word"


def escape() -> Analyzer:

    def typed(c: Column) -> Column:
        known = F.create_map(*[F.lit(x) for pair in PUNCTUATION.items() for x in pair])
        kind = lambda x: F.when(x.rlike(r"(?U)^\W$"), F.coalesce(F.try_element_at(known, x), F.lit("punctuation"))).when(x.rlike(r"(^|[^\\])(\*|\?)"), "wildcard-word").otherwise("word")
        return F.transform(extract(ESCAPE, c), lambda x: F.struct(F.lower(x).alias("image"), kind(x).alias("type")))

    return Analyzer("escape", lambda c: F.transform(extract(ESCAPE, c), F.lower), lambda t: [Token(x.image.lower(), x.start, x.end, _escape_type(x.image)) for x in scan(ESCAPE, t)], typed)


def porter() -> Analyzer:
    """Word tokens, stemmed. The stems come from a pandas UDF over whole arrays."""
    from loomtext.functions.stemmer import stem, stem_arrays

    return Analyzer("porter", lambda c: stem_arrays(word.column(c)), lambda t: [Token(stem(x.image), x.start, x.end) for x in word.twin(t)])


BY_NAME: dict[str, Callable[[], Analyzer]] = {
    "base": lambda: base, "letter": lambda: letter, "lowercase": lambda: lowercase, "whitespace": lambda: whitespace, "word": lambda: word,
    "stop": stop, "standard": standard, "text": text, "query": query, "escape": escape, "porter": porter,
}


def token_table(df, text_column: str, analyzer: Analyzer, key: str = "doc_id"):
    """(key, position, image): one row a token."""
    return df.select(key, F.posexplode(analyzer.column(F.col(text_column))).alias("position", "image"))


def offsets(df, text_column: str, analyzer: Analyzer, key: str = "doc_id"):
    """(key, position, image, start, end, type): with character offsets.

    Where tokens are a pattern's matches, a token begins after the tokens and gaps before it: a running sum by built-in functions
    (equal keys would be one text there, so keys are unique). Analyzers that change or drop tokens have their offsets from their twin.
    """
    if analyzer.pattern:
        from pyspark.sql import Window

        c, split = F.coalesce(F.col(text_column), F.lit("")), f"(?U){analyzer.pattern}"
        pairs = F.arrays_zip(analyzer.column(c).alias("image"), F.transform(F.split(c, split, -1), F.length).alias("gap"))
        rows = df.select(key, F.posexplode(pairs).alias("position", "x")).select(key, "position", "x.image", "x.gap").filter("image IS NOT NULL")
        end = F.sum(F.col("gap") + F.length("image")).over(Window.partitionBy(key).orderBy("position"))
        placed = rows.withColumn("end", end.cast("int"))
        return placed.select(key, "position", "image", (F.col("end") - F.length("image")).alias("start"), "end", F.lit("word").alias("type"))

    import pyarrow as pa

    from loomtext.sources.storage import with_workers

    with_workers(df.sparkSession)
    twin = analyzer.twin

    def run(batches):
        for b in batches:
            keys, pos, out = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, x in enumerate(twin(t or "")):
                    keys.append(k)
                    pos.append(i)
                    out.append(x)
            arrays = [pa.array(keys, b.schema.field(0).type), pa.array(pos, pa.int32()), pa.array([x.image for x in out], pa.string()), pa.array([x.start for x in out], pa.int32()), pa.array([x.end for x in out], pa.int32()), pa.array([x.type for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "position", "image", "start", "end", "type"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text_column).mapInArrow(run, f"{key} {kind}, position int, image string, start int, end int, type string")
