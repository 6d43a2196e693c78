"""Word-association abstracts: which words share sentences with a core word, and how exclusively."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import analysis
from loomtext.operators.highlight import sentences
from loomtext.operators.phrases import is_word, lone_rows
from loomtext.sources.storage import with_workers

#: Words of an abstract at most; the place whose overlap is the limit among more.
MOST, LIMIT_AT = 12, 9


def sentence_words(df: DataFrame, text: str, key: str = "doc_id", stop_words: list[str] | None = None) -> DataFrame:
    """(key, sentence, word): words of more than one letter, lower-cased, with the number of their sentence; . ? ! ; end one."""
    ends = [c for c, kind in analysis.PUNCTUATION.items() if kind in analysis.TERMINATORS]
    tokens = F.filter(analysis.extract(analysis.TEXT, F.col(text)), lambda x: x.isin(*ends) | x.rlike("^[a-zA-Z]{2,}$"))
    rows = df.select(key, F.posexplode(tokens).alias("pos", "image"))
    number = F.sum(F.col("image").isin(*ends).cast("int")).over(Window.partitionBy(key).orderBy("pos"))
    words = analysis.stop_words() if stop_words is None else stop_words
    return rows.withColumn("sentence", number).filter(is_word(F.col("image"), words)).select(key, "sentence", F.lower("image").alias("word"))


def core_sentences(text: Column, core: str) -> Column:
    """The sentences (ended by . ? !) that have the core word."""
    return F.filter(sentences(text), lambda s: s.rlike(rf"(?iU)\b{re.escape(core)}\b"))


def abstract_words(words: DataFrame, core: str, key: str = "doc_id") -> DataFrame:
    """(key, word, frequency, overlap, saturation, core): from sentence_words. A text without the core word has no rows.

    overlap: occurrences in sentences with the core word; saturation: overlap / frequency. Words without overlap go. Of at most twelve
    words the rest stays; of more, those that reach the ninth's overlap, twelve at most, the core first, then by overlap and word.
    All windows and the aggregate are by key, so the words move once.
    """
    is_core = F.col("word") == core.lower()
    near = words.withColumn("hit", F.max(is_core.cast("int")).over(Window.partitionBy(key, "sentence")))
    counted = near.groupBy(key, "word").agg(F.count("*").alias("frequency"), F.sum("hit").alias("overlap"))
    rated = counted.withColumn("core", is_core).withColumn("saturation", F.when(is_core, F.lit(1.0)).otherwise(F.col("overlap") / F.col("frequency")))
    order = Window.partitionBy(key).orderBy(F.col("core").desc(), F.col("overlap").desc(), "word")
    every = Window.partitionBy(key)
    placed = rated.withColumn("place", F.row_number().over(order)).withColumn("total", F.count("*").over(every)).withColumn("has_core", F.max("core").over(every))
    placed = placed.withColumn("limit", F.max(F.when(F.col("place") == LIMIT_AT, F.col("overlap"))).over(every)).filter("has_core AND overlap > 0")
    many = (F.col("place") <= MOST) & (F.col("core") | (F.col("overlap") >= F.col("limit")))
    return placed.filter((F.col("total") <= MOST) | many).select(key, "word", "frequency", "overlap", "saturation", "core")


def abstract_of(tokens: list[str], ends: frozenset[str], core: str) -> list[tuple[str, int, int, float, bool]]:
    """(word, frequency, overlap, saturation, core) of one text's words and ends of sentences, by the rule of abstract_words."""
    where: dict[str, list[int]] = {}
    sentence = 0
    for t in tokens:
        if t in ends:
            sentence += 1
        else:
            where.setdefault(t, []).append(sentence)
    if core not in where:
        return []
    return [(core, len(where[core]), len(where[core]), 1.0, True), *[(w, len(where[w]), n, f, False) for w, n, f in orbits(where, core, list(where))]]


def abstract(df: DataFrame, text: str, core: str, key: str = "doc_id", stop_words: list[str] | None = None) -> DataFrame:
    """abstract_words of a table of texts. A text's words are found by built-in functions and rated where they lie, so a task holds a few texts
    and not the words of all that were dealt to it; only texts that share a key are exchanged."""
    with_workers(df.sparkSession)
    alone, shared = lone_rows(df.filter(F.col(text).rlike(rf"(?i){re.escape(core)}")).select(key, text), key)
    listed = analysis.stop_words() if stop_words is None else stop_words
    ends = frozenset(c for c, kind in analysis.PUNCTUATION.items() if kind in analysis.TERMINATORS)
    low = core.lower()
    wanted = lambda x: x.isin(*ends) | ((F.length(x) > 1) & is_word(x, listed))
    tokens = F.transform(F.filter(analysis.extract(analysis.TEXT, F.col(text)), wanted), F.lower)

    def run(batch: pd.Series) -> pd.Series:
        names = ("word", "frequency", "overlap", "saturation", "core")
        return batch.map(lambda ts: [dict(zip(names, x, strict=True)) for x in abstract_of(list(ts), ends, low)])

    found = F.pandas_udf(run, "array<struct<word: string, frequency: long, overlap: long, saturation: double, core: boolean>>")(tokens)
    out = alone.select(key, F.explode_outer(found).alias("x")).filter("x IS NOT NULL").select(key, "x.word", "x.frequency", "x.overlap", "x.saturation", "x.core")
    return out if shared is None else out.unionByName(abstract_words(sentence_words(shared, text, key, listed), core, key))


def orbits(where: dict[str, list[int]], centre: str, free: list[str]) -> list[tuple[str, int, float]]:
    """(word, overlap, saturation) of the free words that share sentences with the centre, by the rule of the abstract; the centre is left out.

    where: the sentences of each word, one entry an occurrence.
    """
    mine = set(where[centre])
    rated = sorted(((w, sum(s in mine for s in where[w])) for w in free if w != centre), key=lambda x: (-x[1], x[0]))
    if len(rated) >= MOST:
        least = rated[LIMIT_AT - 2][1]
        rated = [x for x in rated if x[1] >= least][: MOST - 1]
    return [(w, n, n / len(where[w])) for w, n in rated if n]


def word_map_of(sentences: list[list[str]], core: str) -> list[tuple[str, str, int, float]]:
    """(parent, word, overlap, saturation) of one text's sentences: below the core its abstract, below each of those words, in order,
    the abstract of it among the words that are not taken yet."""
    where: dict[str, list[int]] = {}
    for i, s in enumerate(sentences):
        for w in s:
            where.setdefault(w, []).append(i)
    if core not in where:
        return []
    inner = orbits(where, core, list(where))
    taken = {core, *[w for w, _, _ in inner]}
    out = [(core, core, len(where[core]), 1.0), *[(core, *x) for x in inner]]
    for parent, _, _ in inner:
        found = orbits(where, parent, [w for w in where if w not in taken])
        taken |= {w for w, _, _ in found}
        out += [(parent, *x) for x in found]
    return out


def wordmap(df: DataFrame, text: str, core: str, key: str = "doc_id", stop_words: list[str] | None = None) -> DataFrame:
    """(key, parent, word, overlap, saturation): the sentences with the core word as a map of two levels (see word_map_of).

    The core stands below itself. Sentences and words are found by built-in functions; only texts with the core reach Python, where
    each word is placed once, below the first parent that claims it. Nothing is exchanged.
    """
    with_workers(df.sparkSession)
    core = core.lower()
    listed = analysis.stop_words() if stop_words is None else stop_words
    words = lambda s: F.transform(F.filter(analysis.extract(analysis.TEXT, s), lambda x: (F.length(x) > 1) & is_word(x, listed)), F.lower)
    texts = df.filter(F.col(text).rlike(rf"(?i){re.escape(core)}")).select(key, F.transform(core_sentences(F.col(text), core), words).alias("sentences"))

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda ss: [{"parent": p, "word": w, "overlap": n, "saturation": f} for p, w, n, f in word_map_of([list(s) for s in ss], core)])

    found = F.pandas_udf(run, "array<struct<parent: string, word: string, overlap: long, saturation: double>>")(F.col("sentences"))
    return texts.select(key, F.explode(found).alias("x")).select(key, "x.parent", "x.word", "x.overlap", "x.saturation")


def colour(saturation: Column, core: Column) -> Column:
    """A grey as hex, darker the more saturated; the core is red."""
    grey = (255 - F.floor(saturation * 255)).cast("int")
    return F.when(core, F.lit("#ff0000")).otherwise(F.format_string("#%02x%02x%02x", grey, grey, grey))
