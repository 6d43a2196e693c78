"""Phrase discovery: word n-grams that a text repeats, grown word by word."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import analysis
from loomtext.sources.storage import materialise, with_workers

_TOKENS = re.compile(analysis.TEXT)


def is_word(image: Column, stop_words: list[str]) -> Column:
    """Of the text analyzer's tokens: letters alone, and no stop word."""
    letters = image.rlike("^[a-zA-Z]+$")
    return letters & ~F.lower(image).isin(*stop_words) if stop_words else letters


def word_runs(df: DataFrame, text: str, key: str, stop_words: list[str] | None = None) -> DataFrame:
    """(key, pos, word): word tokens with their place among all tokens but spaces."""
    tokens = F.filter(analysis.extract(analysis.TEXT, F.col(text)), lambda x: x != " ")
    rows = df.select(key, F.posexplode(tokens).alias("pos", "word"))
    return rows.filter(is_word(F.col("word"), analysis.stop_words() if stop_words is None else stop_words))


def repeated_phrases(text: str, stop: frozenset[str], most_words: int | None = None) -> list[tuple[str, int, int, bool]]:
    """(phrase, words, n, redundant) of one text; phrases grow by a word a round, at places whose phrase repeats, until none does."""
    image = [x if x.isalpha() and x.lower() not in stop else None for x in _TOKENS.findall(text) if x != " "]
    now = {i: w for i, w in enumerate(image) if w is not None}
    found: list[tuple[str, int, int]] = []
    n = 1
    while now and n != most_words:
        n += 1
        grown = {i: f"{p} {w}" for i, p in now.items() if i + n <= len(image) and (w := image[i + n - 1]) is not None and w != image[i]}
        counts = Counter(grown.values())
        now = {i: p for i, p in grown.items() if counts[p] > 1}
        found += [(p, n, c) for p, c in counts.items() if c > 1]
    found.sort(key=lambda f: (f[0].lower(), f[0]))
    return [(p, n, c, k + 1 < len(found) and found[k + 1][0].lower().startswith(p.lower()) and found[k + 1][2] == c) for k, (p, n, c) in enumerate(found)]


def text_phrases(df: DataFrame, text: str, key: str = "doc_id", most_words: int | None = None, stop_words: list[str] | None = None, drop_redundant: bool = False) -> DataFrame:
    """(key, phrase, words, n, redundant): n-grams of two words or more that a text has at least twice.

    A phrase doesn't hold its first word again, and is as long as its repetition unless most_words is given. redundant: the next phrase in order
    begins with it, without case, and occurs as often.
    Repetition is a matter of one text, so texts are counted where they lie: an exchange of all n-grams, which built-in
    functions would need for each length, is spared.
    """
    with_workers(df.sparkSession)
    stop = frozenset(analysis.stop_words() if stop_words is None else stop_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = repeated_phrases(t, stop, most_words) if t else []
                keys += [k] * len(rows)
                out += rows
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            types = [pa.string(), pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[key, "phrase", "words", "n", "redundant"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(key, text).mapInArrow(run, f"{key} {kind}, phrase string, words int, n long, redundant boolean")
    return out.filter("NOT redundant") if drop_redundant else out


def lone_rows(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key no other row has (null counts as a key), and the others, or None: what concerns one key can be counted in place for the first."""
    again = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(key).alias("_again"))
    if again.isEmpty():
        return df, None
    again = materialise(again, "again")
    return tuple(df.join(again, F.col(key).eqNullSafe(F.col("_again")), how) for how in ("left_anti", "left_semi"))


def counted(words: Column) -> Column:
    """array<struct<word, n>> of sorted words."""
    starts = F.filter(F.transform(words, lambda _, i: i), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
    one = lambda at, start, k: F.struct(F.get(words, start).alias("word"), (F.coalesce(F.get(at, k + 1), F.size(words)) - start).cast("long").alias("n"))
    return F.flatten(F.transform(F.array(starts), lambda at: F.transform(at, lambda start, k: one(at, start, k))))


def token_frequencies(df: DataFrame, text: str, key: str = "doc_id", stop_words: list[str] | None = None) -> DataFrame:
    """(key, word, n): how often each word of a text occurs, without case. Texts are counted where they lie; only those that share a key are exchanged."""
    alone, shared = lone_rows(df.select(key, text), key)
    listed = analysis.stop_words() if stop_words is None else stop_words
    words = F.transform(F.filter(analysis.extract(analysis.TEXT, F.col(text)), lambda x: is_word(x, listed)), F.lower)
    rows = alone.select(key, F.sort_array(words).alias("words")).select(key, F.explode_outer(counted(F.col("words"))).alias("x")).filter("x IS NOT NULL")
    out = rows.select(key, "x.word", "x.n")
    if shared is None:
        return out
    return out.unionByName(word_runs(shared, text, key, listed).groupBy(key, F.lower("word").alias("word")).agg(F.count("*").alias("n")))
