"""A corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing and sharding, stage after stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm.common import drop_intermediates, materialise, read_table, written
from loomtext.llm.decontamination import drop_contaminated
from loomtext.llm.mixing import take_mix
from loomtext.llm.quality import keep_good
from loomtext.llm.sharding import shard_documents
from loomtext.llm.simhash import keep_representatives


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose posterior quality is below one half go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by a Jaccard similarity of 0.8 or more of their five-word shingles, the one with the smallest doc_id stays."""
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that aligns with an item of the benchmark go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come to their target weights."""
    return take_mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in uniform random order in shards of equal counts, with shard and slot."""
    return shard_documents(docs)


#: Each function takes (spark, docs, sf_dir); its result is written as Parquet and read again as the docs of the next.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Expectation-maximisation, XXH64 fingerprints and random rounding are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another. What a stage has written on its way is removed once its result is written; what the returned frame
    reads stays."""
    docs, mark = read_table(spark, sf_dir, "documents"), written()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
        drop_intermediates(spark, docs, mark)
    return docs
