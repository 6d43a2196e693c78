from loomtext.functions.similarity import Similarity
from loomtext.operators import maintenance as M
from loomtext.operators.index import FieldDef, Index, Schema
from loomtext.operators.search import Searcher

SCHEMA = Schema((FieldDef("id", index="untokenized"), FieldDef("content")), analyzer="whitespace", key="id")


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_change_feed(spark):
    docs = spark.createDataFrame([(i, f"K{i}", f"content{i}") for i in range(5)], "doc_id long, id string, content string")
    index = Index.build(docs, SCHEMA)
    changes = spark.createDataFrame([(10, "k1", "fresh", "upsert"), (11, "K2", None, "delete"), (12, "K3", "old", "upsert"), (13, "k3", "newer", "upsert"), (14, "K9", "more", "upsert")], "doc_id long, id string, content string, op string")
    after = M.apply_changes(index, changes)
    s = Searcher(after, "content")
    assert ids(after.stored()) == [0, 4, 10, 13, 14]
    assert ids(s.hits("fresh")) == [10] and ids(s.hits("old")) == [] and ids(s.hits("newer")) == [13]
    assert ids(index.stored()) == [0, 1, 2, 3, 4]


def test_merge_policy():
    assert M.segments_to_merge([1] * 9) is None
    assert M.segments_to_merge([1] * 10) == 0
    assert M.segments_to_merge([500, 10] + [10] * 9) == 1
    assert M.segments_to_merge([100, 50, 3]) is None
    assert M.segments_to_merge([]) is None


def docs_of(spark, *rows):
    return spark.createDataFrame(rows, "doc_id long, id string, content string")


def test_changes_write_segments_only(spark):
    index = Index.build(docs_of(spark, *[(i, f"k{i}", f"content{i} all") for i in range(5)]), SCHEMA)
    up = M.upsert(index, docs_of(spark, (2, "K2", "fresh all"), (9, "k9", "fresh all")))
    assert len(up.segments) == 2 and up.segments[0] == index.segments[0]
    s = Searcher(up, "content")
    assert ids(s.hits("fresh")) == [2, 9] and ids(s.hits("content2")) == [] and ids(s.hits("all")) == [0, 1, 2, 3, 4, 9]
    assert M.is_deleted(up, 2) is False and M.deletion_count(up) == 1 and up.max_doc() == 7
    again = M.update(up, 2, {"content": "third all"})
    assert ids(Searcher(again, "content").hits("third")) == [2] and ids(Searcher(again, "content").hits("fresh")) == [9]
    assert ids(M.delete(again, 2).stored()) == [0, 1, 3, 4, 9] and M.is_deleted(M.delete(again, 2), 2)
    small = M.compact(again)
    assert small.max_doc() == 6 and len(small.segments) == 1 and ids(Searcher(small, "content").hits("all")) == [0, 1, 2, 3, 4, 9]
    same = lambda ix: {r["doc_id"]: round(r["score"], 9) for r in Searcher(ix, "content").hits("all content1").collect()}
    whole = Index.build(small.stored(), SCHEMA)
    assert same(small) == same(whole)


def test_many_additions_merge(spark, monkeypatch):
    monkeypatch.setattr(M, "MERGE_FROM", 3)
    index = Index.build(docs_of(spark, *[(i, f"k{i}", "all") for i in range(12)]), SCHEMA)
    for i in range(20, 30):
        index = M.upsert(index, docs_of(spark, (i, f"k{i % 25}", "all new")))
    assert len(index.segments) < 11
    assert ids(Searcher(index, "content").hits("all")) == ids(index.stored())
    assert ids(index.stored()) == sorted({*range(5, 12), *range(20, 30)})
    assert ids(Searcher(index, "content").hits("new")) == list(range(20, 30))


def test_versions(spark, tmp_path):
    root = str(tmp_path / "ix")
    one = M.persist(Index.build(docs_of(spark, (1, "x", "a")), SCHEMA), root)
    assert one.is_current() and one.newest() is one
    two = M.persist(Index.build(docs_of(spark, (1, "y", "a b")), SCHEMA), root, append=True)
    assert not one.is_current() and two.is_current() and ids(one.newest().stored()) == [1, 2] and ids(one.stored()) == [1]
    three = M.persist(M.delete(two, 1), root)
    assert ids(Index.open(spark, root, SCHEMA).stored()) == [2] and three.version == 3


def test_set_norm(spark):
    index = Index.build(docs_of(spark, (1, "x", "a"), (2, "y", "a")), SCHEMA)
    s = Searcher(M.set_norm(M.set_norm(index, 2, "content", 1.0), 2, "content", 4.0), "content")
    got = {r["doc_id"]: r["score"] for r in s.hits("a").collect()}
    assert got[2] == 4 * got[1]
    assert {r["doc_id"]: r["norm"] for r in M.compact(s.index).norms().filter("field = 'content'").collect()} == {1: 1.0, 2: 4.0}


def test_similarity_is_used(spark):
    class Flat(Similarity):
        def tf(self, freq):
            return freq * 0 + 1.0

        def length_norm(self, length):
            return length * 0 + 1.0

        def sloppy_freq(self, distance):
            return 1.0

    docs = docs_of(spark, (1, "x", "a b c d e a b"), (2, "y", "a b"), (3, "z", "a q b"))
    s = Searcher(Index.build(docs, SCHEMA, similarity=Flat()), "content")
    for q in ("a", "a b", '"a b"', '"a b"~2'):
        assert len({round(r["score"], 9) for r in s.hits(q).collect()}) == 1, q


def test_sizes_after_merges(spark):
    make = lambda *words: Index.build(spark.createDataFrame(list(enumerate(words)), "doc_id long, f string"), Schema((FieldDef("f"),)))
    one, two, three = make("zero", "one", "two"), make("three", "four", "five"), make("six", "seven", "eight")
    assert one.max_doc() == 3
    whole = M.merge([one, two, three])
    assert whole.max_doc() == 9
    assert [r["f"] for r in whole.stored().orderBy("doc_id").collect()] == ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight"]
    again = M.merge([whole, make("alpha", "beta", "charlie")])
    assert again.max_doc() == 12 and Searcher(again, "f").doc_number("charlie") == 11
