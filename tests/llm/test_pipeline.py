"""The pipeline on a small table, each stage against what it should do."""

import numpy as np
import pytest

import corpus_pipeline
from loomtext.llm import decontamination, mixing, quality, simhash


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 5000, n))
    rows = [(i, text(int(rng.integers(25, 200))), "en", f"s{i % 4}", 0) for i in range(200)]
    rows += [(300 + i, rows[i][1], "en", "s0", 0) for i in range(10)] + [(400, None, None, None, None), (401, "short", "en", "s1", 5)]
    leak = text(40)
    rows += [(500, rows[3][1] + " " + leak, "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    start, counts = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
        counts[name] = len(rows)
        if name == "quality":
            kept = {r["doc_id"] for r in quality.judge(before).filter("kept").collect()}
            assert {d for d, _ in rows} == kept and 400 not in kept and 401 not in kept
        if name == "near_duplicates":
            found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(before).collect()}
            assert {d for d, _ in rows} == {d for d, c in found.items() if d == c} and not {300 + i for i in range(10)} & {d for d, _ in rows}
        if name == "decontamination":
            bad = {r["doc_id"] for r in decontamination.contaminated(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert bad == {500} and {d for d, _ in rows} == {r["doc_id"] for r in before.collect()} - bad
        if name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
            assert len(rows) == sum(copies.values())
        if name == "sharding":
            assert len(rows) == counts["mixing"]
        else:
            assert docs.columns == start.columns


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    sizes = [r["n"] for r in out.groupBy("shard").count().withColumnRenamed("count", "n").collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 1
