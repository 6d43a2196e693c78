import pytest
from pyspark.sql import functions as F

from loomtext.functions import analysis as A
from loomtext.functions.stemmer import stem, stem_terms

ADDRESS = "KRBaker@mail.com is My e-mail 523@#$ address. 23#@$"
MIXED = "D.Ba_l-n@gma-l.com AB&Sons Toys'r'us you're she's, #$%^$%*& job@dot I.B.M. the an AnD THEIR"


def test_letter_lowercase_whitespace():
    assert A.letter.terms(ADDRESS) == ["KRBaker", "mail", "com", "is", "My", "e", "mail", "address"]
    assert A.lowercase.terms(ADDRESS) == ["krbaker", "mail", "com", "is", "my", "e", "mail", "address"]
    assert A.whitespace.terms(ADDRESS) == ["KRBaker@mail.com", "is", "My", "e-mail", "523@#$", "address.", "23#@$"]


def test_standard():
    assert [t.image for t in A.scan(A.STANDARD, ADDRESS)] == ["KRBaker@mail.com", "is", "My", "e", "mail", "523", "address", "23"]
    assert A.standard().terms(MIXED) == ["d.ba_l-n@gma-l.com", "ab&sons", "toys'r'us", "job@dot", "ibm"]


def test_stop_offsets():
    got = [(t.image, t.start, t.end) for t in A.stop().twin("The Quick AND the DEAD the and to it there their")]
    assert got == [("quick", 4, 9), ("dead", 18, 22)]
    assert [(t.image, t.start, t.end) for t in A.stop(["john"]).twin("john baker")] == [("baker", 5, 10)]


def test_query_and_text_types():
    assert A.query().terms("john's x") == ["john", "'", "s", "x"]
    kinds = [(t.image, t.type) for t in A.text().twin("The fox, 12.")]
    assert kinds == [("The", "stopword"), (" ", "space"), ("fox", "word"), (",", "comma"), (" ", "space"), ("12", "number"), (".", "period")]
    assert [t.type for t in A.escape().twin("a?")] == ["word", "question-mark"]
    assert [t.type for t in A.operators(["and"]).twin("a and b")] == ["word", "operator", "word"]


@pytest.mark.parametrize("word, expected", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
    ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"),
    ("triplicate", "triplic"), ("hopeful", "hope"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"),
    ("BreatHed", "breath"), ("BREATHING", "breath"), ("at", "at"), ("x1y", "x1y"),
])
def test_stem(word, expected):
    assert stem(word) == expected


@pytest.mark.parametrize("name", ["base", "letter", "lowercase", "whitespace", "word", "stop", "standard", "text", "query", "escape", "porter"])
def test_column_equals_twin(spark, name):
    texts = [ADDRESS, MIXED, "", None, "Ünï çode_x 1.2.3 a-b\n\nNew line", "John's dog's I.B.M.'s x_y 12,000.50 a..b", "été ça K"]
    a = A.BY_NAME[name]()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", a.column(F.col("t")).alias("x")).collect()
    for r in rows:
        assert (r["x"] or []) == a.terms(texts[r["i"]]), texts[r["i"]]


def test_stem_terms(spark):
    assert spark.createDataFrame([("running",), (None,)], "t string").select(stem_terms(F.col("t"))).collect() == [("run",), (None,)]


def test_offsets(spark):
    df = spark.createDataFrame([(1, "Ab cd"), (2, None)], "doc_id long, t string")
    assert [tuple(r) for r in A.offsets(df, "t", A.lowercase).collect()] == [(1, 0, "ab", 0, 2, "word"), (1, 1, "cd", 3, 5, "word")]
