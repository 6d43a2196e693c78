"""A uniform shuffle into shards of exact sizes through a hypergeometric communication matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import by_place, materialise, pick, row_hash, session

_MASK = (1 << 64) - 1
#: Rows of a partition up to which its local permutation is drawn as a table; above, a keyed permutation gives each row its place.
LOCAL = 1 << 20


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` without replacement are good. Inversion from the mode outwards, for populations of any size."""
    if not (good and draws):
        return 0
    if not bad or draws == good + bad:
        return good if not bad and draws > good else min(good, draws)
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    ln = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(ln(good, mode) + ln(bad, draws - mode) - ln(good + bad, draws))
    u, a, b, pa, pb = rng.random() - p, mode, mode, p, p
    while u > 0 and (a > low or b < high):
        if b < high:
            pb *= (good - b) * (draws - b) / ((b + 1) * (bad - draws + b + 1))
            b += 1
            u -= pb
            if u <= 0:
                return b
        if a > low:
            pa *= a * (bad - draws + a) / ((good - a + 1) * (draws - a + 1))
            a -= 1
            u -= pa
            if u <= 0:
                return a
    return mode


class Communication:
    """The matrix of how many rows each partition sends to each shard: exact sums both ways, distributed as under a uniform shuffle of all rows.

    It is never made as a whole. Partitions are halved again and again; how many rows of each shard come from the first half is a
    multivariate hypergeometric draw, seeded by the range that is halved, so a task finds the row of its own partition on the way
    down, by as many draws as shards for each halving. All it needs is one count a partition.
    """

    def __init__(self, counts: list[int], shards: int, seed: int):
        self.before = np.concatenate(([0], np.cumsum(np.asarray(counts, np.int64))))
        self.shards, self.seed = shards, seed

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows that partition i sends to each shard, rows that the partitions before it send there)"""
        lo, hi = 0, len(self.before) - 1
        mine, base = np.array(shard_sizes(int(self.before[-1]), self.shards), np.int64), np.zeros(self.shards, np.int64)
        while hi - lo > 1:
            middle = (lo + hi) // 2
            rng = np.random.default_rng([self.seed, self.shards, lo, hi])
            rest, draws, first = int(mine.sum()), int(self.before[middle] - self.before[lo]), np.zeros(self.shards, np.int64)
            for j, have in enumerate(mine.tolist()):
                first[j] = hypergeometric(rng, have, rest - have, draws)
                rest, draws = rest - have, draws - int(first[j])
            if i < middle:
                hi, mine = middle, first
            else:
                lo, mine, base = middle, mine - first, base + first
        return mine, base


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Images of x under a keyed permutation of 0 .. n - 1: a Feistel network over the least even number of bits, walked until inside."""
    if n <= 1:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> np.uint64(half), v & low
        for r in range(6):
            a, b = b, a ^ (_mix(b, key + 0x9E3779B97F4A7C15 * (r + 1)) & low)
        return (a << np.uint64(half)) | b

    with np.errstate(over="ignore"):
        v = once(x.astype(np.uint64))
        while (out := v >= n).any():
            v[out] = once(v[out])
    return v.astype(np.int64)


def assign(rows: DataFrame, shards: int = 24, seed: int = 11) -> DataFrame:
    """The given rows (small columns only) with shard and slot: uniform over all ways to put them into shards of exact sizes.

    Rows are numbered within the partitions they lie in and written once; one count a partition comes to the driver and goes to the tasks.
    Each partition deals its rows by a local random permutation into the numbers that the communication matrix gives it, which
    gives each row its gapless place among those sent to its shard, and these places are permuted again within the shard. Large
    permutations are keyed ones that need no gathering, so rows are dealt where they lie, batch by batch, and no task ever holds a shard.
    """
    session(rows)
    columns = rows.columns
    at = F.monotonically_increasing_id()
    numbered = rows.withColumn("_at", at).withColumn("_pid", F.shiftright("_at", 33)).withColumn("_idx", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")
    numbered = materialise(numbered, "shardrows")
    counts = {r["_pid"]: r["n"] for r in numbered.groupBy("_pid").agg(F.count("*").alias("n")).collect()}
    pids = np.array(sorted(counts), np.int64)
    each = np.array([counts[p] for p in pids.tolist()], np.int64)
    schema = rows.select(*columns, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).schema

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, known = Communication(each.tolist(), shards, seed), {}
        sizes = shard_sizes(int(each.sum()), shards)
        for b in batches:
            pid, idx = b.column("_pid").to_numpy(), b.column("_idx").to_numpy()
            shard, slot = np.zeros(len(pid), np.int32), np.zeros(len(pid), np.int64)
            for p in np.unique(pid).tolist():
                i = int(np.searchsorted(pids, p))
                if i not in known:
                    small = each[i] <= LOCAL
                    known = {i: (*matrix.row(i), np.random.default_rng([seed, 1, p]).permutation(each[i]) if small else None)}
                sends, base, local = known[i]
                mine = np.flatnonzero(pid == p)
                place = local[idx[mine]] if local is not None else permute(idx[mine], int(each[i]), (seed << 40) + p)
                ends = np.cumsum(sends)
                shard[mine] = np.searchsorted(ends, place, side="right")
                slot[mine] = base[shard[mine]] + place - (ends - sends)[shard[mine]]
            for s in np.unique(shard).tolist():
                mine = shard == s
                slot[mine] = permute(slot[mine], sizes[s], (seed << 20) + s)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(shard), pa.array(slot)], names=[*columns, "shard", "slot"])

    return numbered.mapInArrow(deal, schema)


def exchange(assigned: DataFrame) -> DataFrame:
    """The rows where they belong: ranges of (shard, slot), in order; a shard may span several partitions."""
    return assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 11) -> DataFrame:
    """All columns of docs with shard and slot, moved to their shards in order.

    Only hashes of whole rows are dealt; the rows are fetched once by hash and exchanged once. Equal rows are interchangeable,
    so the shuffle stays uniform. Null columns, empty texts and repeated rows are rows like others; an empty table stays empty.
    A column already named shard or slot is replaced.
    """
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in ("shard", "slot")]
    plain, _ = by_place(docs)
    plain = plain.select(*[f"_{i}" for i in kept])
    keyed = plain.withColumn("_key", F.concat_ws(":", row_hash(plain), row_hash(plain, F.hash)))
    places = assign(keyed.select("_key"), shards, seed)
    placed = keyed.dropDuplicates(["_key"]).join(places, "_key").drop("_key")  # a row that is there k times meets its k places
    return exchange(placed).toDF(*[docs.columns[i] for i in kept], "shard", "slot")


def shard_table(docs: DataFrame, shards: int = 24, seed: int = 11) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row, laid out by shard. Law `rows`: counts at most one apart."""
    text = F.coalesce("text", F.lit(""))
    small = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return exchange(assign(small, shards, seed)).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
