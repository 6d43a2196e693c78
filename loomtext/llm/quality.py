"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import by_place, materialise, pick, row_key, session

SYMBOLS = "#*$%&|<>"
WINDOW = 8
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marked", "n_distinct", "n_lines")
SCHEMA = "doc_id long, th long, " + ", ".join(f"{f} long" for f in FEATURES)

#: Rules: name, ratio, good if at most, bad if over (between the two the rule abstains; documents under MIN_WORDS words: all abstain).
RULES: tuple[tuple[str, str, float, float], ...] = (
    ("symbols", "greatest(n_symbols, n_marked) / n_words", 0.03, 0.10),
    ("upper_case", "n_upper / word_chars", 0.15, 0.40),
    ("duplicate_lines", "n_dup_lines / n_lines", 0.05, 0.30),
    ("repeated_windows", "n_repeat_words / n_words", 0.05, 0.25),
    ("few_distinct", "1 - n_distinct / n_words", 0.75, 0.90),
    ("long_words", "word_chars / n_words", 12.0, 20.0),
)
MIN_WORDS = 20


def features(text: str | None, window: int = WINDOW) -> tuple[int, ...]:
    """The figures of one text, in the order of FEATURES (null: all zero). Words are runs other than ASCII white space."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0, 0, 0, 0, 0)
    line = b" ".join(words)
    chars = len(line.decode("utf-8", "surrogatepass")) - (n - 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > window:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = [line[a:b] for a, b in zip(starts[: n - window + 1].tolist(), ends[window - 1 :].tolist(), strict=True)]
        if len(set(spans)) < len(spans):
            seen: dict[bytes, int] = {}
            again = np.zeros(n + 1, np.int64)
            for i, s in enumerate(spans):
                j = seen.setdefault(s, i)
                if j != i:
                    for k in (i, j):
                        again[k] += 1
                        again[min(k + window, n)] -= 1
            repeated = int((np.cumsum(again[:n]) > 0).sum())
    octets = np.frombuffer(line, np.uint8)
    upper = int(((octets >= 65) & (octets <= 90)).sum())
    marked = sum(w[-1] in b"#*$%&|<>!" for w in words)
    return (n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, upper, marked, len(set(words)), len(lines))


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, th, FEATURES) for every row, over whole texts; th is a hash of the text."""
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([features(t) for t in b.column("text").to_pylist()], np.int64).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], names=["doc_id", "th", *FEATURES])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th")).mapInArrow(run, SCHEMA)


def base_failed() -> Column:
    return F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")


def votes() -> Column:
    """One character a rule: g (good), b (bad) or - (abstains)."""
    one = [F.when(F.col("n_words") < MIN_WORDS, "-").when(F.expr(ratio) <= good, "g").when(F.expr(ratio) > bad, "b").otherwise("-") for _, ratio, good, bad in RULES]
    return F.concat(*one)


def expectation_maximisation(patterns: dict[str, int], rounds: int = 200, least_ratio: float = 4.0) -> tuple[dict[str, float], dict[str, tuple[float, float]], float]:
    """(posterior quality of each vote pattern, each rule's accuracy on good and on bad documents, share of good documents).

    A rule that votes is right with a probability that depends on the class; given the class, rules are independent, and that a rule
    abstains tells nothing, so a document without votes has the prior, the share of good documents. patterns counts documents by votes, at
    most 3 ** rules of them. The first guess takes documents with a bad vote for bad. Rules are better than chance: after each step a bad
    vote stays at least `least_ratio` times as likely on bad documents, so the two classes can't change places. Counts are smoothed.
    """
    if not any(patterns.values()):
        return dict.fromkeys(patterns, 0.5), {}, 0.5
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    bad, good = (np.array([[c == v for c in k] for k in keys], float) for v in "bg")
    q = np.array([0.05 if "b" in key else 0.95 for key in keys])
    share, theta = 0.5, np.zeros((2, bad.shape[1]))  # theta: how likely a vote is a bad one, on good and on bad documents
    for _ in range(rounds):
        share = float((n @ q + 1) / (n.sum() + 2))
        for c, w in ((0, n * q), (1, n * (1 - q))):
            theta[c] = (w @ bad + 0.1) / (w @ (bad + good) + 0.2)
        theta[0] = np.minimum(theta[0], theta[1] / least_ratio)
        logs = [math.log(p) + bad @ np.log(theta[c]) + good @ np.log1p(-theta[c]) for c, p in ((0, share), (1, 1 - share))]
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -700, 700)))
        done = np.abs(new - q).max() < 1e-9
        q = new
        if done:
            break
    names = [r[0] for r in RULES] if theta.shape[1] == len(RULES) else [str(j) for j in range(theta.shape[1])]
    accuracy = {name: (float(1 - theta[0, j]), float(theta[1, j])) for j, name in enumerate(names)}
    return dict(zip(keys, q.tolist(), strict=True)), accuracy, share


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, th, FEATURES, votes, quality, base_failed, kept) for every row.

    kept is false where the base rules fail, else whether the posterior probability of quality is at least `threshold`.
    Votes are counted over all documents by pattern (a table of at most 3 ** rules rows, whatever the corpus). The model is fitted on the driver to
    the counts of those that pass the base rules, as the others are decided: else their kind of bad would hide all others. Null and empty texts have no words, fail the base and are not kept; rows with
    equal doc_ids are judged each for itself. An empty table gives an empty result.
    """
    rows = materialise(measure(docs).withColumn("votes", votes()), "quality")
    counted = {r["votes"]: r["n"] for r in rows.groupBy("votes").agg(F.count_if(~base_failed()).alias("n")).collect()}
    posterior, _, share = expectation_maximisation(counted)
    spark = rows.sparkSession
    table = spark.createDataFrame(list(posterior.items()) or [("", share)], "votes string, quality double")
    judged = rows.join(F.broadcast(table), "votes", "left")  # at most 3 ** len(RULES) rows
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, with all their columns. Equal texts get equal verdicts, so a document is found again by doc_id and text
    hash; rows that repeat both stay or go together. Columns of any names may be there; null and empty texts go."""
    bad = judge(docs, threshold).filter(~F.col("kept")).select(row_key(F.col("doc_id"), F.col("th")).alias("_key")).distinct()
    plain, (doc_id, text) = by_place(docs, "doc_id", "text")
    return plain.withColumn("_key", row_key(doc_id, F.xxhash64(text))).join(bad, "_key", "left_anti").drop("_key").toDF(*docs.columns)
