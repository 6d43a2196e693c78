"""Token ids in a content-addressed store: rolling-hash chunks kept once, document recipes, Merkle manifest."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.common import fresh_path, pick, session

#: Chunks end where the low bits of a rolling hash over the last 16 ids are zero; about 2 ** CUT_BITS ids apart.
WIDTH, CUT_BITS, LEAST, MOST = 16, 9, 64, 4096
END_ID = 0
#: Distinct pieces a worker remembers: the first it meets, so the frequent ones; others are encoded anew (results don't depend on it).
CACHE = 600_000

#: White space next to white space or at an end, as RE2 pattern: every character that Unicode or Python counts as such.
_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = rf"{_SPACE}{_SPACE}|\A{_SPACE}|{_SPACE}\z"
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_MARKS = ".,%*&#$!"
_WORKER: dict = {}


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Whole texts to ids by a byte-level BPE file of the tokenizers library, as its plain call on each text gives them.

    The library's split pattern never joins across a single space or line break between two other characters, nor a letter or
    digit with marks after it. So texts are cut there, and the library encodes each distinct piece once: many new pieces in
    one call, told apart by the ids that begin with a space or line break, which stand at the start of a piece only.
    Texts with doubled white space are cut at single spaces only; those that hold a string which the tokenizer knows as a token of its own are not cut.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("the store keeps ids in 16 bits")
        space, line = (self.tokenizer.encode(c, add_special_tokens=False).tokens[0] for c in (" ", "\n"))
        self.begins = np.zeros(1 << 16, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith((space, line))]] = True
        self.known: dict[str, bytes] = {}
        self.line_ids = len(self.plain("\n"))

    def plain(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2")

    def _new(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without white space but for a leading line break; the others are led by a space."""
        out: list[bytes] = []
        for lo in range(0, len(pieces), 200):
            part = pieces[lo : lo + 200]
            ids = self.plain("x" + "".join([p if p[0] == "\n" else " " + p for p in part]))
            at = np.flatnonzero(self.begins[ids])
            if len(at) == len(part):
                data, cuts = ids.tobytes(), [*(2 * at).tolist(), 2 * len(ids)]
                out += [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            else:
                out += [self.plain(p if p[0] == "\n" else " " + p).tobytes() for p in part]
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, from what is remembered and else from the library: a word and the marks after it apart."""
        known = self.known
        out = list(map(known.get, pieces))
        missing = [i for i, x in enumerate(out) if x is None]
        bases, new = [], {}
        for i in missing:
            p = pieces[i]
            base = p.rstrip(_MARKS)
            if not base or not base[-1].isalnum():
                base = p
            bases.append(base)
            if base not in known:
                new[base] = None
        new = dict(zip(new, self._new(list(new)), strict=True))
        room, marks = CACHE - len(known), {}
        for i, base in zip(missing, bases, strict=True):
            p = pieces[i]
            ids = new[base] if base in new else known[base]
            if base != p:
                end = p[len(base) :]
                if end not in marks:
                    marks[end] = self.plain(end).tobytes()
                ids += marks[end]
            out[i] = ids
        if room > 0:
            known.update(new)
            known.update((pieces[i], out[i]) for i in missing[:room])
        return out

    def encode(self, texts: pa.StringArray) -> list[np.ndarray]:
        """The ids of each text (no nulls)."""
        odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        odd |= special
        out: list[np.ndarray | None] = [None] * len(texts)
        at = np.flatnonzero(~odd)
        if len(at):
            # each text gets a line break put in front, and so begins with an empty piece before it
            even = pc.binary_join_element_wise("\n", texts.filter(pa.array(~odd)), "")
            cut = pc.split_pattern(pc.replace_substring(even, "\n", " \n"), " ")
            coded = cut.flatten().dictionary_encode()
            codes, bounds = coded.indices.to_numpy(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
            values = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            none = values.index("")
            values[none] = "\n"
            ids = self._pieces(values)
            ids[none] = b""
            lengths = np.fromiter(map(len, ids), np.int32, len(ids)) >> 1
            pool, first = np.frombuffer(b"".join(ids), "<u2"), (np.cumsum(lengths) - lengths).astype(np.int32)
            n = lengths[codes]
            ends = np.cumsum(n)
            places = np.repeat((first[codes] - (ends - n)).astype(np.int32), n)
            places += np.arange(len(places), dtype=np.int32)
            whole = pool[places]
            ends = np.concatenate(([0], ends))[bounds]
            for i, a, b in zip(at.tolist(), (ends[:-1] + self.line_ids).tolist(), ends[1:].tolist(), strict=True):
                out[i] = whole[a:b]
        for i in np.flatnonzero(odd).tolist():
            text = texts[i].as_py()
            if special[i]:
                out[i] = self.plain(text)
                continue
            first_piece, *rest = _SINGLE.split(text) if text else [""]
            out[i] = np.concatenate([self.plain(first_piece), *[self.plain(" " + x) for x in rest]])
        return out


def _gear() -> np.ndarray:
    """A fixed random number for each id, by rule."""
    x = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(32)).astype(np.uint32)


def cut_points(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """For documents whose ids stand one after another (bounds: where each ends): the ends of each one's chunks, counted from its start.

    Equal passages are cut alike wherever they stand, but for their edges: no chunk is shorter than LEAST ids, so a window never
    reaches into the document before.
    """
    if "gear" not in _WORKER:
        _WORKER["gear"] = _gear()
    h = _WORKER["gear"][ids]
    w = 1
    while w < WIDTH:  # the sum of gear[id] << distance over a window, doubled step by step
        h[w:] = h[w:] + (h[:-w] << np.uint32(w))
        w *= 2
    marks = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    starts = np.concatenate(([0], bounds[:-1]))
    of = np.searchsorted(marks, starts, side="right"), np.searchsorted(marks, bounds, side="left")
    out = []
    for start, end, lo, hi in zip(starts.tolist(), bounds.tolist(), of[0].tolist(), of[1].tolist(), strict=True):
        n, ends, at = end - start, [], 0
        for m in [*(marks[lo:hi] - start).tolist(), n]:
            while m - at > MOST:
                at += MOST
                ends.append(at)
            if m - at >= LEAST or m == n and m > at:
                at = m
                ends.append(at)
        out.append(ends)
    return out


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def chunk_crc(payload: bytes) -> int:
    """crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.frombuffer(payload, "<u2").astype("<u4").tobytes())


def _shift_tables() -> np.ndarray:
    """[k][byte place][byte]: the effect on a crc32 of 2 ** k zero words (of 4 bytes) after it."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(4):
        basis = step[basis & 0xFF] ^ (basis >> np.uint32(8))
    tables = []
    for _ in range(40):
        bits = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1
        t = np.stack([np.bitwise_xor.reduce(np.where(bits == 1, basis[8 * i : 8 * i + 8][None, :], np.uint32(0)), axis=1) for i in range(4)]).astype(np.uint32)
        tables.append(t)
        basis = _apply(t, basis)
    return np.stack(tables)


def _apply(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t[0][c & 0xFF] ^ t[1][(c >> np.uint32(8)) & 0xFF] ^ t[2][(c >> np.uint32(16)) & 0xFF] ^ t[3][c >> np.uint32(24)]


def shift_crc(crc: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Each crc32 as it is after that many zero words; the crc32 of joined chunks is the XOR of theirs, each shifted by what follows."""
    if "shift" not in _WORKER:
        _WORKER["shift"] = _shift_tables()
    c, k = crc.astype(np.uint32), 0
    while (words >> k).any():
        on = ((words >> k) & 1).astype(bool)
        c[on] = _apply(_WORKER["shift"][k], c[on])
        k += 1
    return c


@dataclass(frozen=True)
class TokenStore:
    """Where a store lies. parts/kind=chunk: each distinct chunk once; parts/kind=ref: which document has which chunk where;
    recipes: documents in ascending doc_id order with their chunk hashes; manifest: a Merkle root for each recipe file, and over all."""

    spark: SparkSession
    path: str

    def chunks(self) -> DataFrame:
        return self._parts().filter("kind = 'chunk'").select("hash", "payload")

    def _parts(self) -> DataFrame:
        return self.spark.read.schema(_PARTS).parquet(f"{self.path}/parts")

    def references(self) -> DataFrame:
        return self._parts().filter("kind = 'ref'")

    def recipes(self) -> DataFrame:
        """(doc_id, rid, n_tokens, chunks array<(hash, n, tail)>, part, local_start, leaf)"""
        return self.spark.read.schema(_RECIPES).parquet(f"{self.path}/recipes")

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")

    def starts(self) -> DataFrame:
        """The recipes with `start`, the ids of all documents before. One row a recipe file meets in the window."""
        r = self.recipes()
        per = r.groupBy("part").agg(F.sum("n_tokens").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        per = per.select(F.col("part").alias("_part"), before.alias("_before"))
        return r.join(per, r["part"] == per["_part"]).withColumn("start", (F.col("_before") + F.col("local_start")).cast("long")).drop("_part", "_before")


_PARTS = "hash binary, payload binary, doc_id long, rid long, seq int, n int, tail long, kind string"
_RECIPES = "doc_id long, rid long, n_tokens long, chunks array<struct<hash: binary, n: int, tail: long>>, part int, local_start long, leaf binary"
_STAGED = "kind string, hash binary, payload binary, doc_id long, rid long, seq int, n int, tail long"


def write_store(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> TokenStore:
    """Encode whole texts (null: empty), end each document with id 0, and write the store.

    One exchange carries each chunk to the partition of its hash (a task sends a payload once), where only the first of equal chunks
    is written, and the references, spread by document so that a chunk that all documents share burdens no task. References then
    become recipes in ascending doc_id order (null first, rows with equal doc_id in any order). Empty tables give an empty store.
    """
    spark = session(docs)
    path = path or fresh_path(spark, "tokens")
    names = [x.split()[0] for x in _STAGED.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = tokenizer or _default_tokenizer()  # found where the task runs
        if _WORKER.get("path") != file:
            _WORKER.update(path=file, encoder=Encoder(file))
        encoder, sent = _WORKER["encoder"], set()
        end = np.asarray([END_ID], "<u2")
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                each = encoder.encode(part.column("text"))
                joined = np.concatenate([x for ids in each for x in (ids, end)])
                bounds = np.cumsum(np.fromiter(map(len, each), np.int64, len(each)) + 1)
                data, out, start = joined.tobytes(), [], 0
                for doc_id, rid, stop, ends in zip(part.column("doc_id").to_pylist(), part.column("rid").to_pylist(), bounds.tolist(), cut_points(joined, bounds), strict=True):
                    total, at = stop - start, 0
                    for seq, to in enumerate(ends):
                        payload = data[2 * (start + at) : 2 * (start + to)]
                        h = digest(payload)
                        if h not in sent:
                            if len(sent) > 500_000:
                                sent.clear()
                            sent.add(h)
                            out.append(("chunk", h, payload, None, None, None, None, None))
                        out.append(("ref", h, None, doc_id, rid, seq, to - at, total - to))
                        at = to
                    start = stop
                types = [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                columns = zip(*out, strict=True) if out else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            keep = []
            for kind, h in zip(b.column("kind").to_pylist(), b.column("hash").to_pylist(), strict=True):
                keep.append(kind == "ref" or h != before)
                if kind == "chunk":
                    before = h
            yield b.filter(pa.array(keep))

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.coalesce("text", F.lit("")).alias("text"))
    staged = rows.mapInArrow(encode, _STAGED)
    place = F.when(F.col("kind") == "chunk", F.xxhash64("hash")).otherwise(F.xxhash64("rid", "seq"))
    dealt = staged.withColumn("_place", place).repartition("_place").drop("_place").sortWithinPartitions("kind", "hash")
    dealt.mapInArrow(first_of_each, _STAGED).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/parts")

    store = TokenStore(spark, path)
    refs = store.references()
    chunks = F.transform(F.sort_array(F.collect_list(F.struct("seq", "hash", "n", "tail"))), lambda c: F.struct(c["hash"].alias("hash"), c["n"].alias("n"), c["tail"].alias("tail")))
    recipes = refs.groupBy("doc_id", "rid").agg(F.sum("n").cast("long").alias("n_tokens"), chunks.alias("chunks"))
    ordered = recipes.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("rid")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("rid")).withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            n = np.asarray(b.column("n_tokens").to_numpy(), np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            leaves = [_leaf(d, c) for d, c in zip(b.column("doc_id").to_pylist(), b.column("chunks").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts, pa.int64()), pa.array(leaves, pa.binary())], names=[*b.schema.names, "local_start", "leaf"])

    ordered.mapInArrow(number, _RECIPES).write.option("compression", "zstd").parquet(f"{path}/recipes")
    _roots(store).write.parquet(f"{path}/manifest")
    return store


def _leaf(doc_id: int | None, chunks: list[dict]) -> bytes:
    return digest(b"%d:" % (-1 if doc_id is None else doc_id) + b"".join(c["hash"] + int(c["n"]).to_bytes(4, "little") for c in chunks))


class Merkle:
    """A Merkle root over leaves that come one by one; only a branch is held."""

    def __init__(self) -> None:
        self.branch: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        for i, x in enumerate(self.branch):
            if x is None:
                self.branch[i] = leaf
                return
            self.branch[i], leaf = None, digest(x + leaf)
        self.branch.append(leaf)

    def root(self) -> bytes:
        held = [x for x in self.branch if x is not None]
        out = held[0] if held else digest(b"")
        for x in held[1:]:
            out = digest(x + out)
        return out


def _roots(store: TokenStore) -> DataFrame:
    """(part, documents, root) of each recipe file, and part -1 over those (one row a file comes to the driver)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Merkle()
        for leaf in pdf.sort_values("local_start")["leaf"]:
            tree.add(leaf)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "documents": [len(pdf)], "root": [tree.root()]})

    leaves = store.recipes().select("part", "local_start", "leaf")
    parts = leaves.groupBy("part").applyInPandas(one, "part int, documents long, root binary").orderBy("part").collect()
    top = Merkle()
    for r in parts:
        top.add(bytes(r["root"]))
    rows = [(r["part"], r["documents"], bytearray(r["root"])) for r in parts] + [(-1, sum(r["documents"] for r in parts), bytearray(top.root()))]
    return store.spark.createDataFrame(rows, "part int, documents long, root binary")


def _same_roots(store: TokenStore) -> bool:
    """Whether the manifest is that of the recipes' leaves. Both have a row a recipe file."""
    now, kept = (df.select("part", "documents", "root") for df in (_roots(store), store.manifest()))
    return now.exceptAll(kept).isEmpty() and kept.exceptAll(now).isEmpty()


def verify(store: TokenStore) -> bool:
    """Whether every chunk has the hash it is kept under, every recipe its leaf, and every file and the whole their Merkle roots."""

    def bad_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(digest(p) != h for h, p in zip(b.column("hash").to_pylist(), b.column("payload").to_pylist(), strict=True))], pa.int64())], names=["bad"])

    def bad_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(_leaf(d, c) != x for d, c, x in zip(b.column("doc_id").to_pylist(), b.column("chunks").to_pylist(), b.column("leaf").to_pylist(), strict=True))], pa.int64())], names=["bad"])

    bad = store.chunks().mapInArrow(bad_chunk, "bad long").unionByName(store.recipes().select("doc_id", "chunks", "leaf").mapInArrow(bad_leaf, "bad long"))
    return _same_roots(store) and not (bad.agg(F.sum("bad")).first()[0] or 0)


def read_documents(store: TokenStore) -> DataFrame:
    """(doc_id, ids array<int>) rebuilt from recipes and chunks, the end id included."""
    refs = store.recipes().select("doc_id", "rid", F.posexplode("chunks").alias("seq", "c")).select("doc_id", "rid", "seq", F.col("c.hash").alias("hash"))
    joined = refs.join(store.chunks(), "hash").groupBy("doc_id", "rid").agg(F.sort_array(F.collect_list(F.struct("seq", "payload"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(p["payload"] for p in parts), "<u2").astype(np.int32) for parts in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return joined.select("doc_id", "parts").mapInArrow(join, "doc_id long, ids array<int>")


def document_digests(store: TokenStore) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_chunks) from the files.

    The files are held against the manifest first: every recipe against its leaf, every recipe file and the whole against their Merkle
    roots; then every distinct chunk is read, held against its hash and summed once. A document's crc32 is the XOR of its chunks' crc32,
    each shifted by what follows, so ids need not be moved to where documents are. Files that are missing or altered make the query
    fail. Documents with equal doc_id are each a row; an empty store gives an empty result.
    """
    if not _same_roots(store):
        raise ValueError("the recipes aren't those of the manifest")

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if any(_leaf(d, c) != x for d, c, x in zip(b.column("doc_id").to_pylist(), b.column("chunks").to_pylist(), b.column("leaf").to_pylist(), strict=True)):
                raise ValueError("a recipe doesn't have the hash it is kept under")
            yield b

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, payloads = b.column("hash").to_pylist(), b.column("payload").to_pylist()
            if any(digest(p) != h for h, p in zip(hashes, payloads, strict=True)):
                raise ValueError("a chunk doesn't have the hash it is kept under")
            yield pa.RecordBatch.from_arrays([b.column("hash"), pa.array([chunk_crc(p) for p in payloads], pa.int64())], names=["hash", "crc"])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.column("crc").null_count:
                raise ValueError("a chunk is missing")
            c = shift_crc(b.column("crc").to_numpy().astype(np.uint32), b.column("tail").to_numpy())
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in ("doc_id", "rid", "start", "n_tokens")], pa.array(c.astype(np.int64))], names=["doc_id", "rid", "start", "n_tokens", "crc"])

    starts = store.starts()
    refs = starts.mapInArrow(leaves, starts.schema).select("doc_id", "rid", "start", "n_tokens", F.explode("chunks").alias("c")).select("doc_id", "rid", "start", "n_tokens", F.col("c.hash").alias("hash"), F.col("c.tail").alias("tail"))
    moved = refs.join(store.chunks().mapInArrow(sums, "hash binary, crc long"), "hash", "left").drop("hash").mapInArrow(shift, "doc_id long, rid long, start long, n_tokens long, crc long")
    out = moved.groupBy("doc_id", "rid", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"), F.count("*").alias("n_chunks"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks")
