"""Pieces that the operators of this subpackage share: column picking, words, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.sources.storage import drop_intermediates, fresh_path, materialise, shared_dir, spread, with_workers, written

__all__ = ["WORD", "by_place", "connected_components", "drop_intermediates", "fresh_path", "materialise", "pick", "read_table", "row_hash", "row_key", "session", "shared_dir", "spread", "written"]

#: A word: a run of characters other than the six ASCII white-space characters (fixed pattern of the contracts).
WORD = r"[^\x20\x09-\x0D]+"

def session(df: DataFrame) -> SparkSession:
    """The frame's session, with this repository on the import path of its Python workers."""
    return with_workers(df.sparkSession)


def by_place(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """The frame with its columns renamed by place (_0, _1, ...), and the named columns in it.

    Names are exact, else equal but for case; of equal names the first counts. Columns that differ only in case, repeat a name or are called
    like a helper column can't get in the way; toDF(*df.columns) gives the names back.
    """
    at: dict[str, int] = {}
    lower: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, i)
        lower.setdefault(c.lower(), i)
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain, [F.col(f"_{at[n] if n in at else lower[n.lower()]}") for n in names]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever the others are called (see by_place)."""
    plain, columns = by_place(df, *names)
    return plain.select(*[c.alias(n) for n, c in zip(names, columns, strict=True)])


def row_hash(plain: DataFrame, function: Callable[..., Column] = F.xxhash64) -> Column:
    """A hash of the whole row; nulls count by their place."""
    parts = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.struct(f.name) for f in plain.schema.fields]
    return function(*parts)


def row_key(doc_id: Column, *hashes: Column) -> Column:
    """One string for doc_id (null as well) and hashes of the text or the row."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")), *[h.cast("string") for h in hashes])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an undirected edge list (u long, v long); root is the smallest node reachable.

    Alternating large-star and small-star steps: each step replaces edges by edges to a local minimum, so their number
    never grows and the rounds are about the logarithm of the longest path. A step is one aggregate and one join on the node;
    a hub's neighbours are never gathered in one row, and adaptive skew joins may split them. Each round is written to
    the shared folder. Empty input gives an empty result; loops and repeated edges are harmless.
    """
    spark = session(edges)

    def star(e: DataFrame, large: bool) -> DataFrame:
        # e: u > v. large: every node with all neighbours; small: every node with its smaller neighbours.
        near = e if not large else e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = near.join(low, "u")
        moved = out.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")) if large else out.select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    e = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "cc")
    mark = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(e)
    while before[0]:
        e = materialise(star(star(e, True), False), "cc")
        now = mark(e)
        if now == before:
            break
        before = now
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
