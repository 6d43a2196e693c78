import math

import pytest
from pyspark.sql import functions as F

from loomtext.functions.similarity import decode_norm, encode_norm
from loomtext.operators import maintenance as M
from loomtext.operators.highlight import annotated_documents
from loomtext.operators.index import FieldDef, Index, Schema, index_of_term, indexes_of_terms
from loomtext.operators.search import Searcher
from loomtext.plans.parser import Sort, SortField
from loomtext.plans.planner import sloppy_frequency
from loomtext.plans.query import Boolean, Fuzzy, Phrase, Regex, Term, TypedRange, TypedTerm

# The eighteen documents of the search fixture.
CORPUS = [
    (0, "20050930", "word1", "cat1/"), (1, "20051001", "word1 word2 the quick brown fox", "cat1/sub1"), (2, "20051002", "word1 word3", "cat1/sub1/subsub1"),
    (3, "20051003", "word1 word3", "cat1/sub2"), (4, "20051004", "word1 word2", "cat1/sub2/subsub2"), (5, "20051005", "word1", "cat2/sub1"),
    (6, "20051006", "word1 word3", "cat2/sub1"), (7, "20051007", "word1", "cat2/sub1"), (8, "20051008", "word1 word2 word3 the fast brown fox", "cat2/sub1"),
    (9, "20051009", "word1", "cat3/sub1"), (10, "20051010", "word1", "cat3/sub1"), (11, "20051011", "word1 word3 the quick red fox", "cat3/sub1"),
    (12, "20051012", "word1", "cat3/sub1"), (13, "20051013", "word1", "cat1/sub2"), (14, "20051014", "word1 word3 the quick hairy fox", "cat1/sub1"),
    (15, "20051015", "word1", "cat1/sub2/subsub1"), (16, "20051016", "word1 the quick fox is brown and hairy and a little red", "cat1/sub1/subsub2"),
    (17, "20051017", "word1 the brown fox is quick and red", "cat1/"),
]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(*r, r[0] + 1.0) for r in CORPUS], "doc_id long, date string, field string, cat string, boost double")
    return Index.build(docs, Schema((FieldDef("date"), FieldDef("field"), FieldDef("cat")), analyzer="whitespace", boost="boost", key="date"))


@pytest.fixture(scope="module")
def searcher(index):
    return Searcher(index, "field")


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


@pytest.mark.parametrize("text, expected", [
    ("field:word2^100", [1, 4, 8]), ("field:2342", []),
    ("+field:word1 +field:word3", [2, 3, 6, 8, 11, 14]),
    ("+field:word3 -field:word2", [2, 3, 6, 11, 14]), ("-field:word3", []),
    ("field:word3 field:word2", [1, 2, 3, 4, 6, 8, 11, 14]),
    ("+field:word1 field:word3 field:word2", list(range(18))),
    ('field:"quick"', [1, 11, 14, 16, 17]), ('field:"quick brown"', [1]), ('field:"quick brown fox"', [1]),
    ('field:"quick . fox"', [1, 11, 14]), ('field:"quick . fox"~1', [1, 11, 14, 16]), ('field:"quick . fox"~4', [1, 11, 14, 16, 17]),
    ('field:"the quick . fox"', [1, 11, 14]), ('field:"THE QUICK . fox"~4', [1, 11, 14, 16, 17]),
    ('field:"nothing here"', []), ('-field:"brown fox" field:word1', [0, *range(2, 8), *range(9, 17)]),
    ("date:[20051006 to 20051010]", [6, 7, 8, 9, 10]), ("date:{20051006 to 20051010]", [7, 8, 9, 10]), ("date:[20051006 to 20051010}", [6, 7, 8, 9]),
    ("date:{20051006 to 20051010}", [7, 8, 9]), ("date:[. to 20051003]", [0, 1, 2, 3]), ("date:[. to 20051003}", [0, 1, 2]),
    ("cat:cat1*", [0, 1, 2, 3, 4, 13, 14, 15, 16, 17]), ("cat:cat1*&slash;su??ub2", [4, 16]), ("cat:cat1*?su??ub2", [4, 16]),
    ('field:"quick fast"~4 field:"brown red hairy"~4 field:fox', [1, 8, 11, 14, 16, 17]),
])
def test_hits(searcher, text, expected):
    assert ids(searcher.hits(text)) == expected


def test_tops(searcher):
    top = lambda q: searcher.search(q).orderBy("rank").first()["doc_id"]
    assert top("+field:word1 +field:word3") == 14
    assert top("+field:word1 +field:word3 field:word2") == 8
    assert [r["doc_id"] for r in searcher.search("field:quick").orderBy("rank").collect()] == [14, 17, 11, 16, 1]


def test_pages(searcher):
    q = Term("field", "word1")
    assert searcher.total_hits(q) == 18
    assert searcher.search(q).count() == 10 and searcher.search(q, num=20).count() == 18
    every = [r["doc_id"] for r in searcher.search(q, num=20).orderBy("rank").collect()]
    part = searcher.search(q, first=5, num=4).orderBy("rank").collect()
    assert [r["doc_id"] for r in part] == every[5:9] and [r["rank"] for r in part] == [6, 7, 8, 9]
    assert searcher.search(q, first=100, num=5).count() == 0
    for bad in ({"first": -1}, {"num": 0}, {"num": -1}):
        with pytest.raises(ValueError):
            searcher.search(q, **bad)


def test_sorts(searcher):
    by = lambda *f, **k: [r["doc_id"] for r in searcher.search("field:word3", num=20, sort=Sort(tuple(f), **k)).orderBy("rank").collect()]
    assert by(SortField("document"), reverse=True) == [14, 11, 8, 6, 3, 2]
    assert by(SortField("cat")) == [14, 2, 3, 6, 8, 11]
    assert by(SortField("cat", True), SortField("date", True)) == [11, 8, 6, 3, 2, 14]
    assert [r["cat"] for r in searcher.documents("field:word3/cat:1,2[c*]").collect()] == ["cat1/sub1/subsub1", "cat1/sub2"]


def test_others(searcher, index, spark):
    assert searcher.exists("field:fox") and not searcher.exists("field:wolf")
    assert searcher.doc_number("field:fast") == 8 and searcher.doc_number("field:wolf") == -1
    assert ids(searcher.by_key("20051005")) == [5]
    assert ids(searcher.hits(Regex("field", "w(o)rd[23]"))) == [1, 2, 3, 4, 6, 8, 11, 14]
    assert ids(searcher.hits(Fuzzy("field", "quack", 0.7))) == [1, 11, 14, 16, 17]
    assert ids(searcher.hits("field:fox", restrict=spark.range(10).withColumnRenamed("id", "doc_id"))) == [1, 8]
    assert index.document(4).first()["cat"] == "cat1/sub2/subsub2" and index.max_doc() == 18
    got = searcher.explain("field:fox", 1)[0]
    assert got["value"] == pytest.approx(searcher.hits("field:fox").filter("doc_id = 1").first()["score"])
    assert got["details"][0]["df"] == 6
    assert searcher.extract_terms("field:a -field:b") == {("field", "a")}
    assert next(searcher.each("field:fast"))["doc_id"] == 8
    nested = Boolean.of(must=[Boolean.of(should=[Term("field", "word2"), Term("field", "word3")]), Term("field", "fox")])
    assert ids(searcher.hits(nested)) == [1, 8, 11, 14]
    assert ids(searcher.hits(Boolean.of(must=[Term("field", "fox")], must_not=[Term("field", "red"), Term("field", "fast")]))) == [1, 14]


def test_sloppy_frequency():
    f = {d: sloppy_frequency([[i for i, w in enumerate(t.split()) if w == "quick"], [i - 2 for i, w in enumerate(t.split()) if w == "fox"]], 4) for d, _, t, _ in CORPUS}
    assert {d: v for d, v in f.items() if v} == {1: 1, 11: 1, 14: 1, 16: 0.5, 17: 0.2}


def test_repeated_words(spark):
    docs = spark.createDataFrame([(1, "ha ha ha"), (2, "ha no ha"), (3, None)], "doc_id long, t string")
    s = Searcher(Index.build(docs, Schema((FieldDef("t"),), analyzer="whitespace")), "t")
    assert ids(s.hits(Phrase.of("t", ["ha", "ha"]))) == [1]


def test_annotations(searcher):
    got = {r["doc_id"]: r["annotations"]["field"] for r in annotated_documents(searcher, 'field:"quick . fox"', "<pre>", "</pre>").collect()}
    assert got[1] == "word1 word2 the <pre>quick brown fox</pre>"
    got = {r["doc_id"]: r["annotations"]["field"] for r in annotated_documents(searcher, "+field:fox field:th*").collect()}
    assert got[8] == "word1 word2 word3 <b>the</b> fast brown <b>fox</b>"


def test_changes(spark, index):
    s = lambda ix: Searcher(ix, "field")
    gone = M.delete(M.delete(index, 1), Term("field", "fast"))
    assert ids(s(gone).hits("field:fox")) == [11, 14, 16, 17]
    assert gone.num_docs() == 16 and gone.max_doc() == 18 and M.has_deletions(gone) and M.is_deleted(gone, 8)
    assert gone.doc_freq("field", "fox") == 6
    small = M.compact(gone)
    assert small.max_doc() == 16 and small.doc_freq("field", "fox") == 4 and not M.has_deletions(small)
    assert ids(s(M.undelete_all(gone)).hits("field:fox")) == [1, 8, 11, 14, 16, 17]
    changed = M.update(index, Term("field", "fast"), {"field": "slow cat"})
    assert ids(s(changed).hits("field:slow")) == [8] and ids(s(changed).hits("field:fast")) == []
    both = M.merge([index, index])
    assert both.max_doc() == 36 and ids(s(both).hits("field:fast")) == [8, 26]
    new = spark.createDataFrame([(100, "20051005", "wolf", "x", 1.0), (101, "20990101", "wolf", "y", 1.0)], "doc_id long, date string, field string, cat string, boost double")
    up, ins = M.upsert(index, new), M.insert_if_absent(index, new)
    assert ids(s(up).hits("field:wolf")) == [100, 101] and up.num_docs() == 19 and up.max_doc() == 20
    assert ids(s(ins).hits("field:wolf")) == [101] and ins.max_doc() == 19
    more = M.add(index, new)
    assert ids(s(more).hits("field:wolf")) == [100, 101] and more.max_doc() == 20


def test_persist(spark, index, tmp_path):
    path = str(tmp_path / "ix")
    one = M.persist(index, path)
    assert ids(Searcher(one).hits("field:fast")) == [8]
    two = M.persist(index, path, append=True)
    assert two.max_doc() == 36 and two.doc_freq("field", "fast") == 2


def test_reader(spark):
    texts = ["x", "read b c word3", "word3 word4 word1 word2 word1 word3 word4 word1 word3 word3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string")
    ix = Index.build(docs, Schema((FieldDef("body", term_vector="positions"),), analyzer="whitespace"))
    v = ix.term_vector("body", 2).first()["terms"]
    assert [(t["term"], t["tf"], t["positions"]) for t in v] == [("word1", 3, [2, 4, 7]), ("word2", 1, [3]), ("word3", 4, [0, 5, 8, 9]), ("word4", 2, [1, 6])]
    assert ix.term_positions("body", "word1", "word4").collect() == [(2, [1, 2, 4, 6, 7])]
    assert [r["term"] for r in ix.terms_from("body", "word2").collect()] == ["word2", "word3", "word4", "x"]
    assert ix.schema.names("positions") == ["body"]


def test_arrays_and_kinds(spark):
    rows = [(0, ["one two"], "A b"), (1, ["one", "three"], "A b"), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, f array<string>, u string")
    ix = Index.build(docs, Schema((FieldDef("f"), FieldDef("u", index="no_norms")), analyzer="standard"))
    s = Searcher(ix, "f")
    assert ids(s.hits(Phrase.of("f", ["one", "three"]))) == [1]
    assert ids(s.hits(Term("u", "A b"))) == [0, 1]
    assert ix.norms().filter("field = 'u'").count() == 0
    for bad in ({"stored": False, "index": None}, {"index": None, "term_vector": "yes"}, {"binary": True, "stored": False}, {"index": "other"}):
        with pytest.raises(ValueError):
            FieldDef("x", **bad)


def test_typed(spark):
    rows = [(1, "no 12 b", "2.5", "2015-02-28"), (2, "-5", "x", "2015-03-01"), (3, None, None, "never")]
    docs = spark.createDataFrame(rows, "doc_id long, n string, x string, d string")
    fields = (FieldDef("n", type="int"), FieldDef("x", type="float"), FieldDef("d", type="date"))
    s = Searcher(Index.build(docs, Schema(fields, analyzer="whitespace")), "n")
    assert ids(s.hits("n:[5 to 12]")) == [1, 2] and ids(s.hits("n:{5 to 12]")) == [1]
    assert ids(s.hits("x:<3")) == [1, 3] and ids(s.hits(TypedTerm("x", "float", "2.5"))) == [1]
    assert ids(s.hits("d:201502")) == [1] and ids(s.hits("d:>=20150301")) == [2]
    assert ids(s.hits("d:2015")) == [1, 2]


def test_numbers_are_compared_as_they_are(spark):
    docs = spark.createDataFrame([(1, -5, -0.5), (2, 5, 0.5), (3, None, None)], "doc_id long, n int, x double")
    s = Searcher(Index.build(docs, Schema((FieldDef("n", index=None, type="int"), FieldDef("x", index=None, type="float")))), "n")
    negative = s.hits(TypedRange("n", "int", "-10", "0"))
    assert ids(negative) == [1] and ids(s.hits(TypedRange("n", "int", "0", None))) == [2] and ids(s.hits(TypedTerm("n", "int", "-5"))) == [1]
    assert ids(s.hits(TypedRange("x", "float", "-1", "0"))) == [1]
    plan = negative._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n,-10)" in plan and "LessThanOrEqual(n,0)" in plan


def test_vector_lookup_and_offsets(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "x")], "doc_id long, t string")
    ix = Index.build(docs, Schema((FieldDef("t", term_vector="positions_offsets"),), analyzer="lowercase"))
    v = ix.term_vector("t", 1)
    assert [(t["term"], [tuple(o) for o in t["offsets"]]) for t in v.first()["terms"]] == [("fox", [(4, 7)]), ("red", [(0, 3), (8, 11)])]
    assert v.select(index_of_term(F.col("terms"), "red"), indexes_of_terms(F.col("terms"), ["fox", "wolf"])).first()[:] == (1, [0, -1])


def test_empty_index(spark):
    docs = spark.createDataFrame([], "doc_id long, t string")
    s = Searcher(Index.build(docs, Schema((FieldDef("t"),))), "t")
    assert ids(s.hits("word")) == [] and ids(s.hits("")) == [] and s.index.max_doc() == 0


def test_plans_reach_the_scan(index):
    plan = Searcher(index).hits(Term("field", "fox"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,fox)" in plan and "Join" not in plan and "Exchange" not in plan and "positions" not in plan.split("ReadSchema")[1].split(">")[0]


def test_scores_by_hand(searcher):
    idf = 1 + math.log(18 / 4)
    got = {r["doc_id"]: r["score"] for r in searcher.hits("field:word2").collect()}
    for d, n in ((1, 6), (4, 2), (8, 7)):
        assert got[d] == pytest.approx(idf * decode_norm(encode_norm((d + 1) / math.sqrt(n))))
