import pytest

from loomtext.functions import analysis
from loomtext.plans.parser import InvalidField, InvalidQuery, NoMatchingFields, Parser, Sort, SortField
from loomtext.plans.query import Boolean, Clause, Fuzzy, MatchAll, Nothing, Phrase, Range, Regex, Term, TypedRange, TypedTerm, Wildcard, extract_terms, rewrite


def clauses(text, parser=None):
    q = (parser or Parser(default_field="f", analyzer=analysis.whitespace)).parse(text).query
    return [(c.occur, c.query) for c in q.clauses]


@pytest.mark.parametrize("text, expected", [
    ("abc", [("should", Term("f", "abc"))]),
    ("abc def", [("should", Term("f", "abc")), ("should", Term("f", "def"))]),
    ("john's", [("should", Term("f", "john's"))]),
    ("mail-to", [("should", Term("f", "mail")), ("must_not", Term("f", "to"))]),
    ("krbaker@mail.com", [("should", Term("f", "krbaker@mail.com"))]),
    ("+abc", [("must", Term("f", "abc"))]),
    ("abc +def ghi", [("should", Term("f", "abc")), ("must", Term("f", "def")), ("should", Term("f", "ghi"))]),
    ("foo*", [("should", Wildcard("f", "foo*"))]),
    ("foo?bar", [("should", Wildcard("f", "foo?bar"))]),
    ("*foo*bar", [("should", Wildcard("f", "*foo*bar"))]),
    ("+*foo", [("must", Wildcard("f", "*foo"))]),
    ("!abc", [("must_not", Term("f", "abc"))]),
    ("abc !def", [("should", Term("f", "abc")), ("must_not", Term("f", "def"))]),
    ('"abc"', [("should", Term("f", "abc"))]),
    ('"abc def"', [("should", Phrase.of("f", ["abc", "def"]))]),
    ('foo* "bad dog"', [("should", Wildcard("f", "foo*")), ("should", Phrase.of("f", ["bad", "dog"]))]),
    ("field:value", [("should", Term("field", "value"))]),
    ("+field:abc x", [("must", Term("field", "abc")), ("should", Term("f", "x"))]),
    ('field:"1 2 3"', [("should", Phrase.of("field", ["1", "2", "3"]))]),
    ('!"ha ha" "ha ha"', [("must_not", Phrase.of("f", ["ha", "ha"])), ("should", Phrase.of("f", ["ha", "ha"]))]),
    ("heavy~", [("should", Fuzzy("f", "heavy", 0.5))]),
    ("heavy~0.8", [("should", Fuzzy("f", "heavy", 0.8))]),
    ("[abacus to calculator]", [("should", Range("f", "abacus", "calculator"))]),
    ("{abacus to calculator}", [("should", Range("f", "abacus", "calculator", False, False))]),
    ("{abacus TO calculator]", [("should", Range("f", "abacus", "calculator", False, True))]),
    ("[. to x}", [("should", Range("f", None, "x", True, False))]),
    (">a >=b <c <=d", [("should", Range("f", "a", None, False)), ("should", Range("f", "b", None)), ("should", Range("f", None, "c", True, False)), ("should", Range("f", None, "d"))]),
    ("'er(in|on)'", [("should", Regex("f", "er(in|on)"))]),
    ("a and b", [("should", Term("f", "a")), ("must", Term("f", "b"))]),
    ("a NOT b or c", [("should", Term("f", "a")), ("must_not", Term("f", "b")), ("should", Term("f", "c"))]),
    ("notable android", [("should", Term("f", "notable")), ("should", Term("f", "android"))]),
    ("a&slash;b &#x41;&#66;", [("should", Term("f", "a/b")), ("should", Term("f", "AB"))]),
    ('"quick . fox"~4', [("should", Phrase.of("f", ["quick", ".", "fox"], 4))]),
    ("abc^2.5", [("should", Term("f", "abc", boost=2.5))]),
    ("g:(a +b) c", [("should", Boolean((Clause(Term("g", "a")), Clause(Term("g", "b"), "must")))), ("should", Term("f", "c"))]),
])
def test_queries(text, expected):
    assert clauses(text) == expected


def test_query_analysis():
    p = Parser(default_field="f")
    assert clauses("john's", p) == [("should", Phrase.of("f", ["john", "'", "s"]))]


def test_tops():
    p = Parser({"f1": "text", "f2": "text", "field": "text"})
    assert isinstance(p.parse("").query, MatchAll)
    r = p.parse("/-document")
    assert isinstance(r.query, MatchAll) and r.sort == Sort((SortField("document"),), True)
    assert p.parse("/(f1 -f2)").sort == Sort((SortField("f1"), SortField("f2", True)))
    r = p.parse("/document:20,50")
    assert (r.first, r.num) == (20, 50)
    assert p.parse("boom/score[*]").fields == ("f1", "f2", "field")
    assert p.parse("boom/score[f1 f2]").fields == ("f1", "f2")
    every = p.parse("boom").query.clauses[0].query
    assert {c.query.field for c in every.clauses} == {"f1", "f2", "field"}
    assert {c.query.field for c in p.parse("f?:x").query.clauses[0].query.clauses} == {"f1", "f2"}


def test_errors():
    p = Parser({"f1": "text"}, "f1")
    for text, kind in (("nofield:x", InvalidField), ("z*:x", NoMatchingFields), ("/none", InvalidField), ("a/score[z*]", NoMatchingFields), ('"open', InvalidQuery), ("a)", InvalidQuery), ("&nosuchname;", InvalidQuery), ("/f1 f2", InvalidQuery)):
        with pytest.raises(kind):
            p.parse(text)


def test_typed():
    p = Parser({"n": "int", "x": "float", "d": "date"}, "n")
    assert clauses("x:1.5", p)[0][1] == TypedTerm("x", "float", "1.5")
    assert clauses('d:"2015 12 25"', p)[0][1] == TypedTerm("d", "date", "2015 12 25")
    assert clauses("n:[1 to 5}", p)[0][1] == TypedRange("n", "int", "1", "5", True, False)


def test_rewrite():
    assert rewrite(Boolean((Clause(Term("f", "a", boost=2)),), boost=3)) == Term("f", "a", boost=6)
    assert rewrite(Phrase("f", (("a", 0),), boost=2)) == Term("f", "a", boost=2)
    assert rewrite(Phrase("f", ())) == Nothing()
    assert rewrite(Range("n", "1", "2"), {"n": "int"}) == TypedRange("n", "int", "1", "2")
    q = Boolean.of(must=[Term("f", "a")], must_not=[Term("f", "b")])
    assert extract_terms(q) == {("f", "a")}
    with pytest.raises(ValueError):
        Range("f", None, None)
