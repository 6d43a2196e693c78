"""Benchmark decontamination: n-gram seeds and word counts that no copy can fall short of pick passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.alignment import MATCH, best_local
from loomtext.llm.common import by_place, materialise, pick, row_key, session

#: Words of a seed, and the fewest words of an item that is looked for.
NGRAM, SHORTEST = 2, 3
#: Share of an item's best possible score from which a passage counts as a copy.
THRESHOLD = 0.55
#: Test n-grams that one scan of the documents looks for; a larger benchmark is scanned for in several blocks.
BLOCK_GRAMS = 200_000

_WORDS = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def gram_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key for each run of n ids."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    x = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        key = x[: len(x) - n + 1].copy()
        for i in range(1, n):
            key = (key ^ (key >> np.uint64(29))) * _FACTOR + x[i : len(x) - n + 1 + i]
    return key


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, n) of the distinct items; those of fewer than SHORTEST words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [words(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([" ".join(ws) for ws in each], pa.string()), pa.array(list(map(len, each)), pa.int64())], names=["item_id", "words", "n"])

    plain = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return plain.mapInArrow(run, "item_id long, words string, n long").filter(F.col("n") >= SHORTEST).distinct()


class Index:
    """The seeds of a block of items, with what an alignment of at least the threshold must hold.

    Let m words of an item of n match, at p penalties: 2m - p >= 2Tn. So m >= Tn, the passage has at most m + p <= (3 - 2T)n words,
    and as every break between matching words costs a penalty, at least m - p - 1 >= (2T - 1)n - 1 pairs of neighbours are whole.
    Where that is no pair at all (ten words and fewer at 0.55), the single words are the seeds, and Tn of them must be there.
    """

    def __init__(self, items: list[tuple[int | None, str]], threshold: float):
        self.number: dict[str, int] = {}
        self.names = [i for i, _ in items]
        self.items = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in text.split()], np.int64) for _, text in items]
        self.unique = [np.unique(x) for x in self.items]
        self.mark = np.zeros(len(self.number) + 1, bool)  # by word, all false between uses
        n = np.array([len(x) for x in self.items], np.int64)
        self.least = np.maximum(1, np.ceil(threshold * n - 1e-9)).astype(np.int64)
        self.reach = np.maximum(n, np.floor((3 - 2 * threshold) * n + 1e-9)).astype(np.int64)
        whole = np.ceil((2 * threshold - 1) * n - 1 - 1e-9).astype(np.int64)
        self.need = np.where(whole >= 1, whole, self.least)
        self.tables = []
        for size, mine in ((NGRAM, np.flatnonzero(whole >= 1)), (1, np.flatnonzero(whole < 1))):
            grams = [np.unique(gram_keys(self.items[i], size)) for i in mine.tolist()]
            if grams:
                keys, owner = np.concatenate(grams), np.repeat(mine, list(map(len, grams)))
                order = np.argsort(keys, kind="stable")
                distinct, first = np.unique(keys[order], return_index=True)
                self.tables.append((size, distinct, np.append(first, len(keys)), owner[order]))

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, start, end) of the parts of a text (word numbers, 0 for words of no item) that may hold a copy."""
        places, owners = [], []
        for size, keys, first, owner in self.tables:
            known = ids > 0
            at = known[: max(0, len(ids) - size + 1)].copy()
            for i in range(1, size):
                at &= known[i : len(ids) - size + 1 + i]
            at = np.flatnonzero(at)
            if not len(at):
                continue
            mine = gram_keys(ids, size)[at]
            place = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            hit = keys[place] == mine
            at, place = at[hit], place[hit]
            count = first[place + 1] - first[place]
            places.append(np.repeat(at, count))
            owners.append(owner[np.repeat(first[place] - np.cumsum(count) + count, count) + np.arange(count.sum())])
        if not places:
            return []
        pos, own = np.concatenate(places), np.concatenate(owners)
        order = np.lexsort((pos, own))
        pos, own = pos[order], own[order]
        last = np.arange(len(pos)) + self.need[own] - 1
        fits = np.flatnonzero(last < len(pos))
        last = last[fits]
        fits = fits[(own[last] == own[fits]) & (pos[last] - pos[fits] <= self.reach[own[fits]])]
        if not len(fits):
            return []
        pos, own = pos[fits], own[fits]
        start, end = np.maximum(0, pos - self.reach[own]), np.minimum(len(ids), pos + self.reach[own])
        cut = np.flatnonzero((own[1:] != own[:-1]) | (start[1:] > end[:-1])) + 1
        out = []
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(own)], strict=True):
            item, lo, hi = int(own[a]), int(start[a]), int(end[b - 1])
            part, least, reach = ids[lo:hi], int(self.least[item]), int(self.reach[item])
            self.mark[self.unique[item]] = True
            same = self.mark[part]
            self.mark[self.unique[item]] = False
            if np.count_nonzero(same) < least:
                continue
            self.mark[part] = True
            there = np.count_nonzero(self.mark[self.items[item]])
            self.mark[part] = False
            if there < least:
                continue
            if len(part) > reach:
                inside = np.concatenate(([0], np.cumsum(same)))
                full = np.flatnonzero(inside[reach:] - inside[:-reach] >= least)
                if not len(full):
                    continue
                lo, hi = lo + int(full[0]), lo + int(full[-1]) + reach
            out.append((item, lo, hi))
        return out


def _align(item: np.ndarray, passages: list[np.ndarray], threshold: float) -> Iterator[tuple[int, float, int, int]]:
    """(passage, score, start, end) of the passages whose best alignment with the item reaches the threshold."""
    members = sorted(range(len(passages)), key=lambda i: len(passages[i]))
    lo, groups = 0, []
    for k, i in enumerate(members):  # similar lengths together, so that padding stays small
        if (k - lo + 1) * (len(passages[i]) + 1) > 1_000_000 and k > lo:
            groups.append(members[lo:k])
            lo = k
    groups.append(members[lo:])
    for group in groups:
        score, end = best_local(item, [passages[i] for i in group])
        good = np.flatnonzero(score >= threshold * MATCH * len(item) - 1e-9)
        if len(good):
            _, back = best_local(item[::-1], [passages[group[g]][: end[g]][::-1] for g in good])
            for g, n in zip(good.tolist(), back.tolist(), strict=True):
                yield group[g], float(score[g] / (MATCH * len(item))), int(end[g]) - n, int(end[g])


_FOUND = "doc_id long, th long, item_id long, score double, start_word long, end_word long"


def _copies(docs: DataFrame, items: list[tuple[int | None, str]], threshold: float) -> DataFrame:
    """Every stretch of every document that aligns with an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, threshold)
        get, find = index.number.get, _WORDS.findall
        for b in batches:
            doc_ids, hashes = b.column("doc_id").to_pylist(), b.column("th").to_pylist()
            met: dict[int, list[tuple[int, int, np.ndarray]]] = {}
            for row, text in enumerate(b.column("text").to_pylist()):
                ids = np.array([get(w, 0) for w in find(text.lower())], np.int64) if text else ()
                if len(ids):
                    for item, lo, hi in index.stretches(ids):
                        met.setdefault(item, []).append((row, lo, ids[lo:hi].astype(np.int32)))
            out: list[tuple] = []
            for item, mine in met.items():
                for k, score, start, end in _align(index.items[item], [x[2] for x in mine], threshold):
                    row, lo, _ = mine[k]
                    out.append((doc_ids[row], hashes[row], index.names[item], score, lo + start, lo + end))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            columns = zip(*out, strict=True) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "th", "item_id", "score", "start_word", "end_word"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    return rows.mapInArrow(run, _FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(doc_id, th, item_id, score, start_word, end_word): the best alignment of each document with each item it copies, exactly or edited.

    Whole texts are scanned once for the n-grams of the items (once a block of them, if they are more than block_grams). Every n-gram
    of an item is a seed, however common; the stretches of a text with as many seeds and words of an item as any alignment of
    the threshold holds (see Index) are aligned with it where they are found, so no copy is passed over; score is the share of the
    best possible. Null and empty texts and items match nothing; items with equal
    ids but different texts are items of their own; a document's repeated rows count once for each text.
    """
    spark = session(docs)
    items = materialise(_items(benchmark), "items")
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(total / block_grams))
    found = None
    for k in range(blocks):
        # items of about block_grams words come to the driver and go to the tasks
        block = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k).select("item_id", "words").collect()]
        if block:
            part = _copies(docs, block, threshold)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], _FOUND)
    best = F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", -F.col("start_word"))).alias("best")
    return found.groupBy("doc_id", "th", "item_id").agg(best).select("doc_id", "th", "item_id", "best.score", "best.start_word", "best.end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that copy no item, with all their columns, whatever their names. Null and empty texts stay; rows that repeat doc_id and
    text stay or go together."""
    bad = contaminated(docs, benchmark, threshold).select(row_key(F.col("doc_id"), F.col("th")).alias("_key")).distinct()
    plain, (doc_id, text) = by_place(docs, "doc_id", "text")
    return plain.withColumn("_key", row_key(doc_id, F.xxhash64(text))).join(bad, "_key", "left_anti").drop("_key").toDF(*docs.columns)
