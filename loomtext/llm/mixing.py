"""Mixing sources to target weights by pivotal dependent rounding in a distributed reduction tree."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import WORD, by_place, materialise, pick, row_hash, row_key, session

#: Documents of one leaf, and residuals that meet in one node above the leaves.
FAN_IN = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, n, source_size, target) from rows (source, size): sources in code-point order (null last) weigh `weights`, repeating.

    All sizes together are shared by weight; a target stops at `most` times its source's size and the excess is shared again by
    weight, until none is above. Sources are numbered over ranges of them (one count a range comes to the driver) and a round of
    sharing is an aggregate of one row, so there may be any number of sources.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    per = materialise(per.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "mixranges")
    before, counts = 0, {}
    for r in per.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
        counts[r["_range"]], before = before, before + r["n"]
    first = F.element_at(F.create_map(*[F.lit(x) for kv in (counts or {0: 0}).items() for x in kv]), F.col("_range"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(order)) + first
    weight = F.element_at(F.array(*map(F.lit, weights)), ((number - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * float(most))
    per = materialise(per.drop("_range"), "mixsources")
    level, known = 0.0, None
    while True:
        above = F.col("cap") > F.col("weight") * level if known is not None else F.lit(True)
        total, capped, left = per.agg(F.sum("source_size"), F.sum(F.when(~above, F.col("cap"))), F.sum(F.when(above, F.col("weight")))).first()
        share = ((total or 0) - (capped or 0.0)) / left if left else 0.0
        if (capped, left) == known:
            break
        level, known = share, (capped, left)
    return per.select("source", "n", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def _pair_off(size: list[int], p: list[float], u: list[float], members: range) -> int:
    """Pairs of fractional members pass mass until one of the two is integral; returns the one left over, or -1."""
    at = -1
    for j in members:
        if not 0.0 < p[j] < 1.0:
            continue
        if at < 0:
            at = j
            continue
        a, b = size[at], size[j]
        room, have, gain, give = (1 - p[at]) * a, p[at] * a, (1 - p[j]) * b, p[j] * b
        up, down = min(room, give), min(have, gain)
        if u[j] * (up + down) < down:  # mass moves from j to at
            p[at], p[j] = (1.0 if room <= give else p[at] + up / a), (0.0 if give <= room else p[j] - up / b)
        else:
            p[at], p[j] = (0.0 if have <= gain else p[at] - down / a), (1.0 if gain <= have else p[j] + down / b)
        if not 0.0 < p[at] < 1.0:
            at = j if 0.0 < p[j] < 1.0 else -1
    return at


def settle(size: list[int], p: list[float], u: list[float], last: bool) -> list[float]:
    """Pivotal rounding of one group, given with falling sizes: size * p keeps its sum but for one document that may stay fractional.

    Every expectation stays as it was. A pair leaves its larger document fractional, so the smallest documents are set aside as far as
    their mass can make up for the largest one; the larger ones pair off, the one left over is settled against those set aside in
    equal shares, and then they pair off: what is left over is small. `last` rounds that one too.
    """
    p = [0.0 if s == 0 else x for s, x in zip(size, p, strict=True)]
    n = len(p)
    largest = max((s for s, x in zip(size, p, strict=True) if 0.0 < x < 1.0), default=0)
    aside, total, room = n, 0, 1.0
    while aside > 0 and room * total < largest:
        aside -= 1
        if 0.0 < p[aside] < 1.0:
            total += size[aside]
            room = min(room, p[aside], 1 - p[aside])
    if room * total < largest or aside == 0:
        aside = n
    at = _pair_off(size, p, u, range(aside))
    if at >= 0 and aside < n:
        up = (u[at] * 1048573.0) % 1.0 < p[at]
        move = ((p[at] - 1) if up else p[at]) * size[at] / total
        p[at] = 1.0 if up else 0.0
        for j in range(aside, n):
            if 0.0 < p[j] < 1.0:
                p[j] = min(1.0, max(0.0, p[j] + move))
        at = _pair_off(size, p, u, range(aside, n))
    if last and at >= 0:
        p[at] = 1.0 if (u[at] * 1048573.0) % 1.0 < p[at] else 0.0
    return p


def _node(last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def node(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "u", "doc_id", "th", "rh"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        pdf["p"] = settle(pdf["size"].tolist(), pdf["p"].tolist(), pdf["u"].tolist(), last)
        return pdf

    return node


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, th, size, source_size, target, copies, taken) for every row; th is a hash of the text, copies how often the mix takes it.

    A document of a source with ratio r = target / source_size is taken floor(r) or ceil(r) times, at most `most` times.
    Documents are dealt to leaves of about fan_in by a hash, so a source with a third of all rows is many leaves; each leaf and each
    node above hands on at most one fractional document. Everything random comes from hashes of seed, doc_id, text and source: reruns agree.
    Null texts have size 0 and take nothing; a null source is a source; null and repeated doc_ids are rows like others.
    """
    return _mix(pick(docs, "doc_id", "text", "source").withColumn("rh", F.lit(0).cast("long")), weights, most, seed, fan_in).drop("rh")


def _mix(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int, fan_in: int) -> DataFrame:
    session(docs)
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "rh", "source", words.cast("long").alias("size")), "mixrows")
    per = materialise(source_targets(rows.select("source", "size"), weights, most), "mixper").withColumnRenamed("source", "_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    chance = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 52)) / float(1 << 52)
    leaves = F.ceil(F.col("n") / float(fan_in)).cast("long")
    all_rows = rows.join(per, rows["source"].eqNullSafe(per["_source"])).select(
        "doc_id", "th", "rh", "source", "size", "source_size", "target", F.floor(ratio).cast("long").alias("base"), (ratio - F.floor(ratio)).alias("p"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "th", "source"), leaves).alias("node"), chance("doc_id", "th", "source").alias("u"),
    )
    whole, moving = all_rows.filter("p = 0 OR size = 0").drop("node", "u").withColumn("p", F.lit(0.0)), all_rows.filter("p > 0 AND size > 0")
    most_leaves = per.agg(F.max(leaves)).first()[0] or 1
    levels = 1 + (math.ceil(math.log(most_leaves, fan_in)) if most_leaves > 1 else 0)
    parts = [whole]
    for k in range(levels):
        last = k == levels - 1

        done = materialise(moving.groupBy("source", "node").applyInPandas(_node(last), moving.schema), f"mix{k}")
        parts.append(done.filter("p = 0 OR p = 1").drop("node", "u"))
        moving = done.filter("p > 0 AND p < 1").withColumn("node", F.floor(F.col("node") / fan_in)).withColumn("u", chance(F.lit(k + 2), "doc_id", "th", "source"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    copies = (F.col("base") + F.col("p").cast("long")).alias("copies")
    return out.select("doc_id", "th", "rh", "size", "source_size", "target", copies, (copies * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> DataFrame:
    """The documents of the mix with all their columns, whatever their names: a row is repeated as often as it is taken.

    A row is known by a hash of all its columns, so rows that differ in any of them, be it the source, are taken each for itself; of equal rows
    one is repeated as often as all of them are taken. Null and empty texts have no words, so their source's ratio never takes them
    in part; an empty table stays empty.
    """
    plain, (doc_id, text, source) = by_place(docs, "doc_id", "text", "source")
    plain = plain.withColumn("_rh", row_hash(plain))
    mixed = _mix(plain.select(doc_id.alias("doc_id"), text.alias("text"), source.alias("source"), F.col("_rh").alias("rh")), weights, most, seed, FAN_IN)
    taken = mixed.groupBy(row_key(F.col("doc_id"), F.col("th"), F.col("rh")).alias("_key")).agg(F.sum("copies").alias("_copies")).filter("_copies > 0")
    keyed = plain.withColumn("_key", row_key(doc_id, F.xxhash64(text), F.col("_rh")))
    one = keyed.join(taken, "_key").dropDuplicates(["_key"])
    return one.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_key", "_copies", "_copy", "_rh").toDF(*docs.columns)
