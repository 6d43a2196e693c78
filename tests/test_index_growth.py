"""Steps of the index whose cost once grew faster than their input, or moved more than they had to."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from loomtext.functions import analysis
from loomtext.functions.stemmer import stem
from loomtext.operators import abstracts, index, phrases
from loomtext.operators import maintenance as M
from loomtext.operators.index import FieldDef, Index, Schema, invert
from loomtext.streaming.append import start_indexing

KIND = "doc_id long, id string, content string"
SCHEMA = Schema((FieldDef("id", index="untokenized"), FieldDef("content")), analyzer="whitespace", key="id")
TEXTS = ["b a b c a b", None, "", "zz", " ".join(f"w{i % 97}" for i in range(3000))]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs_of(spark, start=0):
    return spark.createDataFrame([(start + i, f"k{start + i}", t) for i, t in enumerate(TEXTS)], KIND)


def expected(start=0):
    out = defaultdict(list)
    for i, t in enumerate(TEXTS):
        out["id", f"k{start + i}", start + i] = [0]
        for k, w in enumerate((t or "").split()):
            out["content", w, start + i].append(k)
    return dict(out)


def postings(df):
    rows = df.collect()
    got = {(r["field"], r["term"], r["doc_id"]): list(r["positions"]) for r in rows}
    assert len(got) == len(rows) and all(r["tf"] == len(r["positions"]) for r in rows)
    return got


def test_inversion_moves_nothing(spark):
    found = invert(docs_of(spark), SCHEMA)
    assert "Exchange" not in plan(found) and postings(found) == expected()
    several = spark.createDataFrame([(1, ["a b", None, "b"], ["u", None, "v"]), (2, None, None), (3, [], [None])], "doc_id long, content array<string>, id array<string>")
    assert postings(invert(several, SCHEMA)) == {("content", "a", 1): [0], ("content", "b", 1): [1, 2], ("id", "u", 1): [0], ("id", "v", 1): [1]}


def test_postings_lie_in_order(spark):
    path = Index.build(docs_of(spark), SCHEMA).segments[0]
    rows = spark.read.parquet(f"{path}/postings").select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"), "field", "term", "doc_id").collect()
    files = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["i"]):
        files[r["f"]].append((r["field"], r["term"], r["doc_id"]))
    assert all(x == sorted(x) for x in files.values())


def test_a_build_exchanges_no_texts_and_sorts_no_postings(spark, monkeypatch):
    written = {}
    keep = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (written.update({path.rsplit("/", 1)[1]: plan(self._df)}), keep(self, path, *a, **k))[1])
    one = Index.build(docs_of(spark), SCHEMA)
    assert "Exchange" not in written["stored"] + written["postings"] and "Sort" not in written["postings"]
    assert written["terms"].count("Exchange") == 1 and postings(one.postings()) == expected()
    assert {(r["field"], r["term"]): r["df"] for r in one.terms().collect()} == Counter((f, t) for f, t, _ in expected())


def test_a_streamed_file_is_shared_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "GROUP", 1 << 17)
    written = {}
    keep = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (written.update({path.rsplit("/", 1)[1]: plan(self._df)}), keep(self, path, *a, **k))[1])
    rng = random.Random(7)
    docs = [(i, f"k{i}", " ".join(f"{rng.getrandbits(40):x}" for _ in range(60)) + f" all w{i % 7}") for i in range(3000)]
    spark.createDataFrame(docs, KIND).coalesce(1).write.parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 18)
    try:
        stream = spark.readStream.schema(KIND).parquet(str(tmp_path / "docs"))
        start_indexing(stream, SCHEMA, str(tmp_path / "ix"), str(tmp_path / "checkpoint")).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    one = Index.open(spark, str(tmp_path / "ix"), SCHEMA)
    assert one.max_doc() == len(docs) and "Exchange" not in written["stored"] + written["postings"]
    found = one.postings().filter("field = 'content'")
    assert found.filter("term = 'all'").groupBy(F.input_file_name()).count().count() >= 4
    want = Counter(w for _, _, t in docs for w in t.split())
    assert {r["term"]: r["n"] for r in found.groupBy("term").agg(F.sum("tf").alias("n")).collect()} == want


def test_matches_that_are_never_empty_are_not_filtered(spark):
    texts = spark.createDataFrame([("a  b.c-1 é\n",), ("",), (None,), ("..",)], "t string")
    assert all(re.match(p, "") is None for p in analysis.NEVER_EMPTY)
    for pattern in (*analysis.NEVER_EMPTY, r"\w*"):
        found = texts.select("t", analysis.extract(pattern, F.col("t")).alias("x"))
        assert [r["x"] for r in found.collect()] == [[x.image for x in analysis.scan(pattern, r["t"] or "")] for r in found.collect()]
        assert ("lambda" in plan(found)) == (pattern == r"\w*")


def test_runs_are_bounded_and_in_order(monkeypatch):
    monkeypatch.setattr(index, "RUN", 40)
    tokens = [["b", None, "a", "b"], None, [], [None], ["\U0001d4b3", "\uffff", "é", "z", "é"], *[[f"w{(i * k) % 7}" for k in range(i)] for i in range(30)], [f"w{k % 97}" for k in range(300)]]
    ids = [9, 7, 8, *range(100, 100 + len(tokens) - 3)][::-1]
    schema = pa.schema([("doc_id", pa.int64()), ("norm_byte", pa.int32()), ("tokens", pa.list_(pa.string()))])
    rows = pa.table([ids, [None if i == 9 else i % 5 for i in ids], tokens], schema=schema)
    batches = [*rows.slice(0, 6).to_batches(), *rows.slice(0, 0).to_batches(), *rows.slice(6).to_batches(max_chunksize=20)]
    want = defaultdict(list)
    for i, ts in zip(ids, tokens, strict=True):
        for k, t in enumerate(ts or []):
            if t is not None:
                want[t, i].append(k)
    found = [b.to_pylist() for b in index.ordered_runs(iter(batches))]
    got = [r for b in found for r in b]
    assert {(r["term"], r["doc_id"]): r["positions"] for r in got} == want and len(got) == len(want)
    assert all(r["tf"] == len(r["positions"]) and r["norm_byte"] == (None if r["doc_id"] == 9 else r["doc_id"] % 5) for r in got)
    for b in found:
        keys = [(r["term"].encode(), r["doc_id"]) for r in b]
        assert keys == sorted(keys) and (sum(r["tf"] for r in b) <= 40 or len({r["doc_id"] for r in b}) == 1)
    assert 5 < len([b for b in found if b]) < len(tokens)
    assert list(index.ordered_runs(iter([]))) == []


def test_merging_and_persisting_move_no_postings(spark, tmp_path, monkeypatch):
    written = []
    keep = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (written.append((path, plan(self._df))), keep(self, path, *a, **k))[1])
    one = Index.build(docs_of(spark), SCHEMA)
    written.clear()
    both = M.merge([one, one])
    again = M.persist(M.persist(one, str(tmp_path / "ix")), str(tmp_path / "ix"), append=True)
    moved = [path for path, p in written if path.endswith(("/stored", "/postings")) and "Exchange" in p]
    assert len(written) == 12 and not moved
    for ix in (both, again):
        # a copy's doc_ids go up by the number of documents
        assert postings(ix.postings()) == expected() | {(f, t, d + len(TEXTS)): p for (f, t, d), p in expected().items()}
        df = {(r["field"], r["term"]): r["df"] for r in ix.terms().collect()}
        assert df == {k: 2 * n for k, n in Counter((f, t) for f, t, _ in expected()).items()}
    less = M.merge([M.delete(one, 0), one])
    assert {(r["term"]): r["df"] for r in less.terms().filter("field = 'content' AND term IN ('a', 'zz')").collect()} == {"a": 1, "zz": 2}


def test_vectors_move_nothing(spark):
    one = Index.build(docs_of(spark), SCHEMA)
    found = one.term_vector("content")
    assert "Exchange" not in plan(found)
    rows = found.collect()
    assert {("content", x["term"], r["doc_id"]): x["positions"] for r in rows for x in r["terms"]} == {k: p for k, p in expected().items() if k[0] == "content"}
    assert all([x["term"] for x in r["terms"]] == sorted(x["term"] for x in r["terms"]) for r in rows) and {r["doc_id"] for r in rows} == {0, 3, 4}
    assert [(x["term"], x["tf"]) for x in M.delete(one, 3).term_vector("content", 0).first()["terms"]] == [("a", 2), ("b", 3), ("c", 1)]
    other = Index.build(docs_of(spark, 10), Schema((FieldDef("id", index="untokenized"), FieldDef("content")), analyzer="letter"))
    assert M.merge([one, other]).mixed and {x["term"] for x in M.merge([one, other]).term_vector("content", 14).first()["terms"]} == {"w"}


def test_word_counts_stay_with_their_text(spark):
    rows = [(1, "Erin saw a river. River, erin x1 hill; hill"), (2, None), (3, ""), (4, "no core. Hill hill"), (5, " ".join(f"erin {chr(97 + i)}{chr(97 + i)}{chr(97 + j)}." for i in range(9) for j in range(i + 1) for _ in range(i + 1)))]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    counts, found = phrases.token_frequencies(texts, "text"), abstracts.abstract(texts, "text", "Erin")
    assert "Exchange" not in plan(counts) and "Exchange" not in plan(found)
    gathered = phrases.word_runs(texts, "text", "doc_id").groupBy("doc_id", F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert same(counts, gathered) and counts.count() > 5
    assert same(found, abstracts.abstract_words(abstracts.sentence_words(texts, "text"), "Erin")) and found.count() > 5
    twice = spark.createDataFrame([*rows, (1, "river erin river"), (None, "erin one"), (None, "erin two one")], "doc_id long, text string")
    gathered = phrases.word_runs(twice, "text", "doc_id").groupBy("doc_id", F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    assert same(phrases.token_frequencies(twice, "text"), gathered)


def test_stems_of_odd_words():
    for word, want in {"yyy": "yyi", "syzygies": "syzygi", "ate": "at", "sayings": "sai", "relational": "relat", "by": "by", "aliti": "aliti", "generalizations": "gener"}.items():
        assert stem(word) == want, word
