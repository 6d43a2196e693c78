"""Changing an index: add, upsert, insert if absent, delete, update, undelete, merge, compact, persist. Each gives a new snapshot.

What is new becomes a segment of its own and what it replaces is marked by tombstones, so a change costs what it changes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.similarity import encode_norm
from loomtext.operators.index import ORDER, POSTINGS, Index, newest_version, write_dictionary, write_segment, write_version
from loomtext.operators.search import Searcher
from loomtext.plans.query import Query
from loomtext.sources.storage import fresh_path, materialise

#: Segments from which adding one looks for those to merge.
MERGE_FROM = 10


def _key(index: Index) -> Column:
    return F.lower(F.col(index.schema.key).cast("string"))


def _last_of_each(index: Index, new: DataFrame) -> DataFrame:
    """Of new rows with one key the one with the largest doc_id."""
    newest = new.groupBy(_key(index).alias("_k")).agg(F.max("doc_id").alias("_d"))
    return new.join(newest, new["doc_id"] == newest["_d"], "left_semi")


def _with_key(index: Index, keys: DataFrame) -> DataFrame:
    """doc_ids of the live documents whose key is among `keys` (column _k)."""
    return index.stored().select("doc_id", _key(index).alias("_k")).join(keys, "_k", "left_semi").select("doc_id")


def _tombstones(index: Index, gone: DataFrame) -> DataFrame:
    mine = gone.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(len(index.segments)).alias("below"))
    if index.tombstones is not None:
        mine = mine.unionByName(index.tombstones)
    return materialise(mine.groupBy("doc_id").agg(F.max("below").alias("below")), "tombstones")


def _appended(index: Index, docs: DataFrame, gone: DataFrame | None = None) -> Index:
    """The index with one more segment; `gone`: doc_ids of the documents that it replaces."""
    path = fresh_path(index.spark, "index")
    write_segment(docs, index.schema, path, index.similarity)
    tombstones = index.tombstones if gone is None else _tombstones(index, gone)
    return _merged_by_size(replace(index, segments=(*index.segments, path), tombstones=tombstones))


def add(index: Index, docs: DataFrame) -> Index:
    """Documents are appended as a segment. Their doc_ids are moved up together where they would clash with those that are there."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    top = index.read("stored", live=False).agg(F.max("doc_id")).first()[0]
    by = top + 1 - low if low is not None and top is not None and low <= top else 0
    return _appended(index, docs.withColumn("doc_id", (F.col("doc_id") + by).cast("long")) if by else docs)


def upsert(index: Index, docs: DataFrame) -> Index:
    """Documents replace those with the same key, without case; of several new ones with one key the last (by doc_id) counts."""
    last = _last_of_each(index, docs)
    return _appended(index, last, _with_key(index, last.select(_key(index).alias("_k"))))


def insert_if_absent(index: Index, docs: DataFrame) -> Index:
    """Documents whose key isn't there are added, the others passed over."""
    there = index.stored().select(_key(index).alias("_k"))
    fresh = _last_of_each(index, docs).withColumn("_k", _key(index)).join(there, "_k", "left_anti").drop("_k")
    return _appended(index, fresh)


def delete(index: Index, what: DataFrame | Query | str | int) -> Index:
    """Documents by number, by query, or by a table of doc_ids. They are marked; compact() removes them."""
    if isinstance(what, int):
        gone = index.spark.range(what, what + 1).withColumnRenamed("id", "doc_id")
    else:
        gone = what if isinstance(what, DataFrame) else Searcher(index).hits(what)
    return replace(index, tombstones=_tombstones(index, gone))


def undelete_all(index: Index) -> Index:
    return replace(index, tombstones=None)


def has_deletions(index: Index) -> bool:
    return index.tombstones is not None and not index.tombstones.isEmpty()


def deletion_count(index: Index) -> int:
    return index.max_doc() - index.num_docs()


def is_deleted(index: Index, doc_id: int) -> bool:
    """Whether the document was there and is no longer."""
    mine = lambda df: not df.filter(F.col("doc_id") == doc_id).isEmpty()
    return index.tombstones is not None and mine(index.tombstones) and not mine(index.stored().select("doc_id"))


def update(index: Index, what: Query | str | int, values: dict[str, object] | Callable[[DataFrame], DataFrame]) -> Index:
    """Matching documents get the given field values (or what the function makes of them); they keep their doc_id."""
    stored = index.stored()
    mine = stored.filter(F.col("doc_id") == what) if isinstance(what, int) else stored.join(Searcher(index).hits(what).select("doc_id"), "doc_id", "left_semi")
    mine = materialise(mine, "updated")
    changed = values(mine) if callable(values) else mine.withColumns({k: F.lit(v) for k, v in values.items()})
    return _appended(index, changed, mine.select("doc_id"))


def _write_merged(indexes: list[Index], path: str, after: int | None = None) -> None:
    """One segment with the live documents of several indexes; doc_ids are moved up where they would clash with earlier ones or reach no higher than `after`.

    Postings and norms are taken over as they are, without analysing any text again. Files of few segments without deletions keep their order
    when they are copied, so nothing is exchanged and their dictionaries are added up; else rows are sorted and the dictionary is counted anew.
    """
    shift, top = [], after
    for ix in indexes:
        low, high = ix.stored().agg(F.min("doc_id"), F.max("doc_id")).first()
        by = top + 1 - low if low is not None and top is not None and low <= top else 0
        shift.append(by)
        top = top if high is None else high + by if top is None else max(top, high + by)

    def together(of: Callable[[Index], DataFrame]) -> DataFrame:
        out = None
        for ix, by in zip(indexes, shift, strict=True):
            moved = of(ix).withColumn("doc_id", (F.col("doc_id") + by).cast("long"))
            out = moved if out is None else out.unionByName(moved, allowMissingColumns=True)
        return out

    whole = all(ix.tombstones is None for ix in indexes)
    in_order = whole and all(ix.own_norms is None for ix in indexes) and sum(len(ix.segments) for ix in indexes) < MERGE_FROM
    ordered = lambda df, *by: df if in_order else df.repartitionByRange(*by).sortWithinPartitions(*by)
    ordered(together(Index.stored), "doc_id").write.parquet(f"{path}/stored")
    ordered(together(Index.postings), *ORDER).write.parquet(f"{path}/postings")
    together(lambda ix: ix.norms().drop("norm")).write.parquet(f"{path}/norms")
    if whole:
        terms = reduce(DataFrame.unionByName, [ix.terms() for ix in indexes]).groupBy("field", "term").agg(F.sum("df").alias("df"))
        terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.parquet(f"{path}/terms")
    else:
        write_dictionary(indexes[0].spark.read.schema(POSTINGS).parquet(f"{path}/postings"), path)


def merge(indexes: list[Index]) -> Index:
    """One index of one segment with the live documents of several."""
    first = indexes[0]
    path = fresh_path(first.spark, "index")
    _write_merged(indexes, path)
    mixed = any(ix.mixed or ix.schema != first.schema for ix in indexes)
    return replace(first, segments=(path,), tombstones=None, own_norms=None, root=None, version=None, mixed=mixed)


def compact(index: Index) -> Index:
    """Deleted documents leave all tables, and statistics no longer count them."""
    return merge([index])


def segments_to_merge(sizes: list[int], factor: int = 10, least: int = 10) -> int | None:
    """From which segment on all are merged into one, or None: the last ones below a level (least, least * factor, ...), once they
    fill it. sizes: documents a segment, oldest first. So a document is rewritten about as often as the number of levels."""
    level = least
    while level <= factor * max(sum(sizes), least):
        first = len(sizes)
        while first > 0 and sizes[first - 1] < level:
            first -= 1
        if len(sizes) - first > 1 and sum(sizes[first:]) >= level:
            return first
        level *= factor
    return None


def _merged_by_size(index: Index) -> Index:
    if len(index.segments) < MERGE_FROM:
        return index
    sizes = [index.spark.read.parquet(f"{p}/stored").count() for p in index.segments]
    first = segments_to_merge(sizes)
    if first is None:
        return index
    tombstones = index.tombstones
    if tombstones is not None:  # those of the merged segments, with places counted from the first of them
        late = tombstones.withColumn("below", F.col("below") - first).filter("below > 0")
    path = fresh_path(index.spark, "index")
    _write_merged([replace(index, segments=index.segments[first:], tombstones=late if tombstones is not None else None)], path)
    if tombstones is not None:
        tombstones = tombstones.withColumn("below", F.least("below", F.lit(first))).filter("below > 0")
    return replace(index, segments=(*index.segments[:first], path), tombstones=tombstones)


def persist(index: Index, path: str, append: bool = False) -> Index:
    """The index at a folder of your own; append: after what is there already.

    The live documents are written as a new segment and then a version that names the segments, so a lost job leaves the version before.
    """
    spark = index.spark
    before = newest_version(spark, path) if append else None
    names = before[1] if before else []
    top = Index.open(spark, path, index.schema).read("stored", live=False).agg(F.max("doc_id")).first()[0] if names else None
    name = fresh_path(spark, "segment").rsplit("/", 1)[1]
    _write_merged([index], f"{path}/{name}", top)
    write_version(spark, path, [*names, name])
    return replace(Index.open(spark, path, index.schema), similarity=index.similarity, mixed=index.mixed)


def set_norm(index: Index, doc_id: int, field: str, value: float | int) -> Index:
    """One document's norm replaced: a float is encoded, an int is the byte itself. Searches use it from then on."""
    byte = value if isinstance(value, int) else encode_norm(value)
    mine = index.spark.createDataFrame([(doc_id, field, byte)], "doc_id long, field string, norm_byte int")
    if index.own_norms is not None:
        mine = index.own_norms.filter((F.col("doc_id") != doc_id) | (F.col("field") != field)).unionByName(mine)
    return replace(index, own_norms=materialise(mine, "norms"))


def apply_changes(index: Index, changes: DataFrame) -> Index:
    """A change feed: rows with `op` 'upsert' or 'delete' and the document's columns; the last of a key (by doc_id) counts."""
    last = materialise(_last_of_each(index, changes), "changes")
    gone = _with_key(index, last.select(_key(index).alias("_k")))
    return _appended(index, last.filter("op = 'upsert'").drop("op"), gone)
