"""SimHash near-duplicates found through a byte-position inverted index with count filtering; near copies by shingle similarity for the pipeline."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import by_place, connected_components, materialise, pick, row_hash, row_key, session

BITS, BYTES = 64, 8
#: Buckets over this size are dealt anew by one more byte.
SPLIT_OVER = 2048


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of one text: a bit is 1 if more than half of its shingles' XXH64 values have it (no words: 0)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    return _majority(h)


_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _majority(h: np.ndarray) -> int:
    n = len(h)
    if n < 512:
        counts = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:  # a histogram for each byte costs less than unpacking
        octets = h.astype("<u8").view(np.uint8).reshape(n, 8)
        counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _TABLE for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, th, fp long) for every row; fp is the fingerprint's 64 bits as a signed number, th a hash of the text. Null texts count as empty."""
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle, seed) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fps.view(np.int64))], names=["doc_id", "th", "fp"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


def byte_groups(max_bits: int) -> list[tuple[int, ...]]:
    """Groups of byte positions such that any pair within max_bits shares all bytes of at least one group.

    A pair that differs in d bits differs in d bytes at most and so matches in 8 - d positions: the guaranteed minimum.
    For d = 3 the 4-subsets of {0..7} whose indices XOR to zero suffice (14 planes: every 5 positions hold one), for d = 4
    triples of three parts in a ring, within a part or two and one of the next (20: every 4 positions hold one); otherwise all (8 - d)-subsets.
    """
    least = BYTES - max_bits
    if least < 1:
        raise ValueError("max_bits must be below 8")
    if max_bits == 3:
        return [c for c in combinations(range(BYTES), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
    if max_bits == 4:
        part = lambda c: sorted(i % 3 for i in c)
        return [c for c in combinations(range(BYTES), 3) if part(c) in ([0, 0, 0], [1, 1, 1], [0, 0, 1], [1, 1, 2], [0, 2, 2])]
    return list(combinations(range(BYTES), least))


def _key(fp, group: tuple[int, ...]):
    mask = sum(0xFF << (8 * i) for i in group)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long"))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _pairs_in_blocks(fps: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within max_bits: blocks against all, those that share too few positional bytes passed over before bits are counted."""
    n, least = len(fps), BYTES - max_bits
    octets = fps.view(np.uint8).reshape(n, BYTES)
    step = max(1, 2_000_000 // max(n, 1))
    for s in range(0, n, step):
        shared = np.zeros((min(step, n - s), n - s), np.uint8)
        for k in range(BYTES):
            shared += octets[s : s + step, k, None] == octets[None, s:, k]
        a, b = np.nonzero(shared >= least)
        near = (b > a) & (_popcount(fps[s + a] ^ fps[s + b]) <= max_bits)
        yield s + a[near], s + b[near]


def _pairs_by_flips(fps: np.ndarray, flips: list[int], max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, found by looking up each fingerprint with each set of bits flipped: time in proportion to the list. Shared bytes are tallied as well."""
    least = BYTES - max_bits
    for mask in flips:
        other = fps ^ np.uint64(mask)
        at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
        a = np.flatnonzero((fps[at] == other) & (other > fps))
        shared = (fps[a].view(np.uint8).reshape(-1, BYTES) == fps[at[a]].view(np.uint8).reshape(-1, BYTES)).sum(axis=1)
        yield a[shared >= least], at[a][shared >= least]


def bucket_edges(fps: np.ndarray, max_bits: int, flips_from: int = 4) -> list[tuple[int, int]]:
    """Edges that join exactly what all pairs within max_bits would join, from the fingerprints of one list; below one an element.

    A list that has over flips_from times as many fingerprints as there are sets of bits to flip, among those that differ in it, is
    searched by flips; others in blocks against all.
    """
    fps = np.unique(fps)
    n = len(fps)
    differing = int(np.bitwise_or.reduce(fps ^ fps[0])) if n else 0
    bits = [1 << i for i in range(64) if differing >> i & 1]
    number = sum(math.comb(len(bits), k) for k in range(1, max_bits + 1))
    found = _pairs_by_flips(fps, [sum(c) for k in range(1, max_bits + 1) for c in combinations(bits, k)], max_bits) if n > flips_from * number else _pairs_in_blocks(fps, max_bits)
    parent, edges = np.arange(n), []
    for a, b in found:
        while (parent[parent] != parent).any():
            parent = parent[parent]
        apart = parent[a] != parent[b]
        for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            x, y = i, j
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                edges.append((i, j))
    signed = fps.view(np.int64)
    return [(int(signed[i]), int(signed[j])) for i, j in edges]


def links(unique: DataFrame, max_bits: int = 3) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) with the same components as all pairs within max_bits.

    The inverted index has a posting list for each group of positional bytes and its value; a pair below the limit
    meets in one list at least. Lists of one vanish in a counting aggregate, lists of two are pairs at once
    (smallest and largest member), longer lists go to one task each, and lists over SPLIT_OVER are dealt by one
    more matching position and its byte first. In each, shared bytes are tallied, pairs short of the minimum dropped
    and the rest verified bit by bit.
    """
    session(unique)
    groups = byte_groups(max_bits)
    posted = unique.select("fp", F.posexplode(F.array(*[_key(F.col("fp"), g) for g in groups])).alias("g", "key"))
    lists = materialise(posted.groupBy("g", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "simlists")
    different = F.col("a").bitwiseXOR(F.col("b"))
    shared = reduce(Column.__add__, [(F.shiftrightunsigned(different, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(BYTES)])
    pairs = lists.filter("n = 2").filter((shared >= BYTES - max_bits) & (F.bit_count(different) <= max_bits)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    longer = posted.join(lists.filter("n > 2").select("g", "key", "n"), ["g", "key"])
    whole = longer.filter(F.col("n") <= SPLIT_OVER).select("g", F.lit(-1).alias("at"), "key", "fp")
    rest = F.array(*[F.array(*[F.struct(F.lit(i).alias("at"), _key(F.col("fp"), (*g, i)).alias("key")) for i in range(BYTES) if i not in g]) for g in groups])
    fine = longer.filter(F.col("n") > SPLIT_OVER).select("g", "fp", F.explode(F.element_at(rest, F.col("g") + 1)).alias("x")).select("g", "x.at", "x.key", "fp")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = bucket_edges(pdf["fp"].to_numpy(np.int64).view(np.uint64), max_bits)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    grouped = whole.unionByName(fine).groupBy("g", "at", "key").applyInPandas(run, "u long, v long")
    return pairs.unionByName(grouped)


def _components(docs: DataFrame, max_bits: int, shingle: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows, components): rows (doc_id, th, fp); components (fp, first), first being the first row of the component."""
    rows = materialise(fingerprints(docs, shingle, seed), "simfp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first")
    unique = rows.groupBy("fp").agg(first)
    roots = connected_components(links(unique.select("fp"), max_bits))
    named = materialise(unique.join(roots, unique["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simroots")
    small = named.groupBy("root").agg(F.min("first").alias("first"))
    return rows, named.select("fp", "root").join(small, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, max_bits: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Rows link if their fingerprints differ in max_bits bits or fewer; component_id is the smallest doc_id reachable.
    Equal fingerprints are one node, so copies never make pairs. Null or wordless texts have fingerprint zero and link
    like any other; null doc_ids are kept and are named only where all of a component are null; rows with the same
    doc_id are separate rows. An empty table gives an empty result.
    """
    rows, of = _components(docs, max_bits, shingle, seed)
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


#: Near copies of the pipeline: five-word shingles, a Jaccard similarity from 0.8. Bands of minima and the rows of each.
SHINGLE, BANDS, ROWS = 5, 32, 4
#: Near copies that the byte-position index finds share so many of the eight positions of their fingerprints and differ in so many bits at most.
SHARED, NEAR_BITS = 4, 12
#: Members of a list from which it is linked in one task; below, its pairs are joined.
LINK_FROM = 64
#: Sets of a long list that one task holds (two such blocks where lists are compared block against block).
BLOCK = 1024
_rng = np.random.default_rng(42)
_TIMES, _PLUS = (_rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 values of a text's shingles, sorted; a shorter text is one shingle, a wordless one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    places = zip(starts[: max(1, len(words) - shingle + 1)].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    return np.unique(np.array([xxhash.xxh64_intdigest(line[a:b], 7) for a, b in places], np.uint64))


def band_keys(h: np.ndarray) -> np.ndarray:
    """A key for each band: sets of similarity J share one of them with probability 1 - (1 - J^ROWS)^BANDS, at 0.8 all but 5e-8."""
    if not len(h):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(h), 1024):
        x = (h[lo : lo + 1024, None] ^ _PLUS) * _TIMES
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0), out=least)
    key = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + column
    return key.view(np.int64)


def similar(i, n, m):
    """Whether i common of n and m elements are a Jaccard similarity of 0.8 or more."""
    return 9 * i >= 4 * (n + m)


def set_edges(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that join what all pairs of similar sets would join: each set reached is held against those not reached yet."""
    size = np.array([len(x) for x in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(flat, np.cumsum(size)[:-1])
    mark = np.zeros(int(flat.max()) + 1, bool)
    left, edges, reached = np.arange(len(sets)), [], []
    while len(left):
        if not reached:
            reached, left = [int(left[0])], left[1:]
            flat = np.concatenate([parts[i] for i in left]) if len(left) else flat
        if not len(left):
            break
        at = reached.pop()
        mark[parts[at]] = True
        common = np.add.reduceat(mark[flat].astype(np.int64), np.cumsum(size[left]) - size[left])
        mark[parts[at]] = False
        near = similar(common, size[at], size[left])
        if near.any():
            edges += [(int(nodes[at]), int(nodes[i])) for i in left[near]]
            reached += left[near].tolist()
            left = left[~near]
            flat = np.concatenate([parts[i] for i in left]) if len(left) else flat
    return edges


_SETS = "doc_id long, th long, rh long, node long, n long, fp long, bands array<long>"


def _node(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes())


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, th, rh, node, n, fp, bands) for every row (doc_id, text, _rh); equal sets of shingles have equal nodes, fp is the SimHash of the
    set. The sets themselves are as large as the texts and are made again for those that need them."""
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                sets = [shingles(t) for t in b.column("text").to_pylist()]
                columns = [
                    b.column("doc_id"), b.column("th"), b.column("rh"), pa.array(list(map(_node, sets)), pa.uint64()).view(pa.int64()),
                    pa.array(list(map(len, sets)), pa.int64()), pa.array([_majority(x) for x in sets], pa.uint64()).view(pa.int64()),
                    pa.array([band_keys(x) for x in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "rh", "node", "n", "fp", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"), F.col("_rh").alias("rh"))
    return rows.mapInArrow(run, _SETS)


def _sets_of(texts: DataFrame) -> DataFrame:
    """(node, shingles) of rows (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                sets = [shingles(t) for t in whole.slice(lo, 1000).column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(list(map(_node, sets)), pa.uint64()).view(pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


def _long_lists(lists: DataFrame, texts: DataFrame, dealt: list[Column]) -> DataFrame:
    """Edges between the similar sets of long lists (g, key, node, many), each dealt to groups of about BLOCK sets, or two blocks of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(set_edges(pdf["node"].to_numpy(np.int64), [np.asarray(x, np.int64) for x in pdf["shingles"]]), columns=["u", "v"], dtype="int64")

    groups = lists.withColumn("blocks", F.ceil(F.col("many") / F.lit(BLOCK)))
    for i, c in enumerate(dealt):
        groups = groups.withColumn(f"at{i}", c)
    at = [f"at{i}" for i in range(len(dealt))][-2:]
    return groups.select("g", "key", *at, "node").join(texts, "node").groupBy("g", "key", *at).applyInPandas(run, "u long, v long")


def met_lists(unique: DataFrame) -> DataFrame:
    """(g, key, node, n, fp, many): the lists with more than one of the nodes (node, n, fp, bands). Those of the bands come first (g), then those of the
    byte-position index, of three positional bytes each: any SHARED equal positions hold one of the 20 triples."""
    index = F.array(*[_key(F.col("fp"), g) for g in byte_groups(BYTES - SHARED)])
    posted = unique.select("node", "n", "fp", F.posexplode(F.concat("bands", index)).alias("g", "key"))
    return materialise(posted.join(posted.groupBy("g", "key").agg(F.count("*").alias("many")).filter("many > 1"), ["g", "key"]), "nearlists")


def dealt_further(long: DataFrame) -> DataFrame:
    """Long lists of the index, rows with their component (root), by each fourth position and its byte; without those that lie in one component."""
    groups, fours = byte_groups(BYTES - SHARED), list(combinations(range(BYTES), SHARED))
    rest = F.array(*[F.array(*[F.struct(F.lit(BANDS + len(groups) + k).alias("g"), _key(F.col("fp"), f).alias("key")) for k, f in enumerate(fours) if set(g) < set(f)]) for g in groups])
    dealt = long.select("node", "n", "fp", "root", F.explode(F.element_at(rest, F.col("g") - BANDS + 1)).alias("x")).select("node", "n", "fp", "root", "x.g", "x.key").distinct()
    lists = dealt.groupBy("g", "key").agg(F.count("*").alias("many"), (F.min("root") != F.max("root")).alias("apart")).filter("apart").drop("apart")
    return materialise(dealt.join(lists, ["g", "key"]), "nearfine")


def candidates(short: DataFrame) -> DataFrame:
    """(u, v, nu, nv): pairs of two components that share a list and whose numbers of shingles allow the similarity. In lists of the byte-position
    index shared bytes are tallied and pairs with fewer than SHARED or more than NEAR_BITS differing bits dropped."""
    one, two = (short.select("g", "key", *[F.col(c).alias(f"{c}{x}") for c in ("n", "fp", "root")], F.col("node").alias(x)) for x in "uv")
    different = F.col("fpu").bitwiseXOR(F.col("fpv"))
    shared = reduce(Column.__add__, [(F.shiftrightunsigned(different, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(BYTES)])
    near = (F.col("g") < BANDS) | ((shared >= SHARED) & (F.bit_count(different) <= NEAR_BITS))
    sizes = (F.col("u") < F.col("v")) & (F.least("nu", "nv") * 5 >= F.greatest("nu", "nv") * 4) & (F.col("rootu") != F.col("rootv"))
    return one.join(two, ["g", "key"]).filter(sizes & near).select("u", "v", "nu", "nv").distinct()


def similar_sets(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges (u, v) between nodes with the same components as all pairs of similar sets; rows as of shingle_sets(docs).

    Candidates share a list of the byte-position index over their SimHash fingerprints. Sets at the least similarity mostly differ in more
    bytes than an index of 64 bits can ask for, so sets that share a band's key are candidates as well.
    Members of long lists are linked in their longest list first, in random blocks (twice, with other blocks, if there are several), so a large
    group of near copies comes together while each of its sets moves once or twice. Lists that lie in one component then have nothing to add; long
    ones of the index are dealt by one more byte. Of what is left every pair of two components is verified on the whole sets: short lists by
    a join, long ones block against block, so no task holds more than two blocks and many near copies never give all pairs.
    """
    keyed = docs.select("text", row_key(F.col("doc_id"), F.xxhash64("text"), F.col("_rh")).alias("_key"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        # of each node one row's text gives the set
        first = rows.join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "th", "rh")).alias("x"))
        first = first.select(row_key(F.col("x.doc_id"), F.col("x.th"), F.col("x.rh")).alias("_key"))
        return materialise(_sets_of(keyed.join(first, "_key", "left_semi").dropDuplicates(["_key"]).select("text")), "nearsets")

    unique = rows.filter("n > 0").groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"))
    met = met_lists(unique)
    longest = met.filter(F.col("many") > LINK_FROM).groupBy("node").agg(F.max(F.struct("many", "g", "key")).alias("x")).select("x.*", "node")
    rounds = longest.withColumn("round", F.explode(F.when(F.col("many") > BLOCK, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    texts = sets_of(longest.select("node"))
    linked = materialise(_long_lists(rounds, texts, [F.col("round"), F.pmod(F.xxhash64("node", "round"), F.col("blocks"))]), "nearlinks")
    rooted = met.join(connected_components(linked), "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rooted.groupBy("g", "key").agg((F.min("root") != F.max("root")).alias("apart")).filter("apart").select("g", "key")
    left = materialise(rooted.join(apart, ["g", "key"], "left_semi"), "nearleft")
    long = F.col("many") > LINK_FROM
    fine = dealt_further(left.filter(long & (F.col("g") >= BANDS)))
    pairs = materialise(candidates(left.filter(~long).unionByName(fine.filter(~long))), "nearpairs")
    long = left.filter(long & (F.col("g") < BANDS)).unionByName(fine.filter(long))
    texts = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).unionByName(long.select("node")))
    one, two = (texts.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "uv")
    edges = pairs.join(one, "u").join(two, "v").filter(similar(F.size(F.array_intersect("su", "sv")), F.col("nu"), F.col("nv"))).select("u", "v")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    both = [mine, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))]
    return linked.unionByName(edges).unionByName(_long_lists(long, texts, [*both, F.least("at0", "at1"), F.greatest("at0", "at1")]))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: texts link if the Jaccard similarity of their five-word shingles is 0.8 or more (see similar_sets).

    Of each component the row with the smallest doc_id stays (null last), of rows that repeat doc_id and text the one with the smallest hash of
    the whole row, once. Null and wordless texts are copies of each other. All columns stay, whatever their names; an empty table stays empty.
    """
    plain, (doc_id, text) = by_place(docs, "doc_id", "text")
    plain = plain.withColumn("_rh", row_hash(plain))
    mine = plain.select(doc_id.alias("doc_id"), text.alias("text"), "_rh")
    rows = materialise(shingle_sets(mine), "shingles")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "rh")).alias("first")
    named = rows.groupBy("node").agg(first).withColumnRenamed("node", "own")
    roots = connected_components(similar_sets(rows, mine))
    of = named.join(roots, named["own"] == roots["node"], "left").groupBy(F.coalesce("root", "own").alias("root")).agg(F.min("first").alias("first"))
    keep = of.select(row_key(F.col("first.doc_id"), F.col("first.th"), F.col("first.rh")).alias("_key")).distinct()
    keyed = plain.withColumn("_key", row_key(doc_id, F.xxhash64(text), F.col("_rh")))
    return keyed.join(keep, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key", "_rh").toDF(*docs.columns)
