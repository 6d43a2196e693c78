import pytest
from pyspark.sql import functions as F

from loomtext.functions import scalars as S
from loomtext.functions.analysis import Token
from loomtext.operators import abstracts, documents, phrases
from loomtext.operators.highlight import precis, sentences
from loomtext.operators.index import FieldDef, Index, Schema
from loomtext.operators.search import Searcher
from loomtext.sources import files
from loomtext.streaming.append import start_indexing


def one(spark, column, value="x", kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_phrases(spark):
    text = "red fox ran. red fox sat, red dog red fox"
    df = spark.createDataFrame([(1, text), (2, "a single line"), (3, None)], "doc_id long, t string")
    got = {(r["doc_id"], r["phrase"]): r["n"] for r in phrases.text_phrases(df, "t", stop_words=[]).collect()}
    assert got == {(1, "red fox"): 3}
    df = spark.createDataFrame([(1, "big red fox. big red fox")], "doc_id long, t string")
    rows = {r["phrase"]: (r["n"], r["redundant"]) for r in phrases.text_phrases(df, "t", stop_words=[]).collect()}
    assert rows == {"big red": (2, True), "big red fox": (2, False), "red fox": (2, False)}
    assert {r["phrase"] for r in phrases.text_phrases(df, "t", stop_words=[], drop_redundant=True).collect()} == {"big red fox", "red fox"}


def test_abstract(spark):
    df = spark.createDataFrame([(1, "Acid burns metal. Acid burns. Metal shines; water flows")], "doc_id long, t string")
    got = {r["word"]: (r["frequency"], r["overlap"], r["saturation"], r["core"]) for r in abstracts.abstract(df, "t", "Acid", stop_words=[]).collect()}
    assert got == {"acid": (2, 2, 1.0, True), "burns": (2, 2, 1.0, False), "metal": (2, 1, 0.5, False)}
    none = spark.createDataFrame([(1, "Metal shines; acids flow"), (2, None), (3, "")], "doc_id long, t string")
    assert abstracts.abstract(none, "t", "acid", stop_words=[]).isEmpty() and abstracts.wordmap(none, "t", "acid", stop_words=[]).isEmpty()
    assert spark.range(1).select(abstracts.colour(F.lit(1.0), F.lit(False)), abstracts.colour(F.lit(0.0), F.lit(True))).first()[:] == ("#000000", "#ff0000")


def test_word_map(spark):
    """Worked by hand: of thirteen words in the core's sentences the ninth's overlap is 1, so eleven others stay in order of overlap and word."""
    text = "Core aa bb cc. Core aa bb dd! core aa ee? Other zz core2. core ff gg hh ii jj kk ll mm; nn. gg without"
    df = spark.createDataFrame([(1, text)], "doc_id long, t string")
    got = {(r["parent"], r["word"]): (r["overlap"], r["saturation"]) for r in abstracts.wordmap(df, "t", "core", stop_words=[]).collect()}
    first = ["aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh", "ii", "jj", "kk"]
    assert {w for p, w in got if p == "core"} == {"core", *first}
    assert got["core", "core"] == (4, 1.0) and got["core", "aa"] == (3, 1.0) and got["core", "bb"] == (2, 1.0)
    # ll, mm and nn are left; the first word that shares a sentence with them takes them all
    assert {(p, w) for p, w in got if p != "core"} == {("ff", "ll"), ("ff", "mm"), ("ff", "nn")}


def test_long_phrases(spark):
    words = " ".join(f"{a}{b}" for a in "abcdefg" for b in "xyz")
    df = spark.createDataFrame([(1, f"{words}. {words}")], "doc_id long, t string")
    got = {r["phrase"]: r["words"] for r in phrases.text_phrases(df, "t", stop_words=[]).collect()}
    assert got[words] == 21 and len(got) == 20 * 21 // 2
    assert max(r["words"] for r in phrases.text_phrases(df, "t", stop_words=[], most_words=3).collect()) == 3
    rows = {r["phrase"]: r["redundant"] for r in phrases.text_phrases(spark.createDataFrame([(1, "go on. go on. go one. go one")], "doc_id long, t string"), "t", stop_words=[]).collect()}
    assert rows == {"go on": True, "go one": False}


def test_small_items(spark):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "n int, title string")
    assert files.empty_titles(df).first()[:] == (3, 2)
    assert one(spark, S.universal_time_text, S.UNIVERSAL_TO_UNIX + 86400, "long") == "1970-01-02 00:00:00"
    a, b = Token("b", 0, 3), Token("a", 2, 3, "x")
    assert a < b and sorted([b, a]) == [a, b] and Token("a", 2, 3) == b


def test_sentences(spark):
    assert one(spark, sentences, "One. Two? Three") == ["One. ", "Two? ", "Three"]
    assert one(spark, lambda c: precis(c, [r"\bfox\b"]), "A cat, a fox; b") == "a fox;"
    assert one(spark, lambda c: precis(c, [r"\bwolf\b"]), "A cat") is None


def test_scalars(spark):
    assert S.resolve_entities("&#47;&#x2f;&slash;&amp;") == "///&"
    with pytest.raises(S.UnknownEntity):
        S.resolve_entities("&nope;")
    assert one(spark, S.strip_html, "<p>a<b>b</b></p>") == "ab"
    assert one(spark, S.escape_html, '<a href="x">&') == "&lt;a href=&quot;x&quot;&gt;&amp;"
    assert S.wildcard_regex("a*b?.") == r"^a.*b.\.$" and S.literal_prefix("foo-b(a)") == "foo-b" and S.literal_prefix("fo+") == "fo" and S.literal_prefix("fo*") == "f"
    assert one(spark, S.int_value, "ab-12c3") == 12 and one(spark, S.int_value, "none") is None
    assert one(spark, S.float_value, None) == 0.0 and one(spark, S.float_value, "1.5") == 1.5 and one(spark, S.float_value, "x") is None
    assert S.common_prefix(["abcd", "abx", "ab"]) == "ab" and S.common_prefix([]) == ""
    assert S.wrap("aa bb ccc d", 5) == ["aa bb", "ccc d"]
    assert one(spark, lambda c: S.file_suffix(c), "/a/b/book-8.txt") == "8"


def test_dates(spark):
    iso = lambda i: [d.strftime("%Y-%m-%d %H:%M:%S") for d in i]
    assert iso(S.parse_query_date("2016").interval()) == ["2016-01-01 00:00:00", "2017-01-01 00:00:00"]
    assert iso(S.parse_query_date("201512").interval()) == ["2015-12-01 00:00:00", "2016-01-01 00:00:00"]
    assert iso(S.parse_query_date("20150228").interval()) == ["2015-02-28 00:00:00", "2015-03-01 00:00:00"]
    assert iso(S.parse_query_date("20151231T2359+0100").interval()) == ["2015-12-31 22:59:00", "2015-12-31 23:00:00"]
    assert iso(S.parse_query_date("2015 12 25").interval())[0] == "2015-12-25 00:00:00"
    for bad in ("x", "20151340"):
        with pytest.raises(S.InvalidDate):
            S.parse_query_date(bad)
    text = lambda v, f: str(one(spark, lambda c: S.date_value(c, f), v))
    assert text("on 2015-02-28.", S.YYYY_MM_DD) == "2015-02-28 00:00:00"
    assert text("28/02/2015", S.DDMMYYYY) == "2015-02-28 00:00:00" and text("02/28/2015", S.MMDDYYYY) == "2015-02-28 00:00:00"
    assert text("2015-02", S.ISO) == "2015-02-01 00:00:00" and text("2015-02-28T10:11:12.5", S.ISO) == "2015-02-28 10:11:12.500000"
    assert text("never", S.YYYY_MM_DD) == "None" and text("2015-13-40", S.YYYY_MM_DD) == "None"


def test_documents(spark):
    row = spark.createDataFrame([(["a", "b"], None)], "v array<string>, e array<string>").select(
        documents.add_value(F.col("v"), F.lit("c")), documents.add_value(F.col("e"), F.lit("c")), documents.remove_first(F.col("v")), documents.set_value(F.col("v"), F.lit("x")),
        documents.first_value(F.col("v")), documents.joined_values(F.col("v")), documents.set_value(F.col("e"), F.lit("x")),
    ).first()
    assert list(row) == [["a", "b", "c"], ["c"], ["b"], ["x", "b"], "a", "a b", ["x"]]
    row = spark.createDataFrame([({"b": ["1", "2"], "a": ["3"]},)], "m map<string,array<string>>").select(documents.field_names(F.col("m")), documents.entry_count(F.col("m"))).first()
    assert list(row) == [["a", "b"], 3]
    assert spark.createDataFrame([([b"ab", b"c"],)], "v array<binary>").select(documents.joined_bytes(F.col("v"))).first()[0] == b"abc"


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a-8.txt").write_bytes("Title: Été\nAuthor: X\n*** START OF IT\nbody\n*** END OF IT\nfoot".encode("latin-1"))
    (tmp_path / "b-0.txt").write_text("Head\nrest ü\nmore", encoding="utf-8")
    (tmp_path / "c.bin").write_text("no")
    root = str(tmp_path)
    rows = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in files.encoded_files(spark, root, "*.txt").collect()}
    assert rows["a-8.txt"].startswith("Title: Été") and "ü" in rows["b-0.txt"] and len(rows) == 2
    book = files.books(files.encoded_files(spark, root, "a-*.txt")).first()
    assert (book["title"], book["author"], book["language"], book["body"].strip(), book["footer"].strip()) == ("Été", "X", "", "body", "foot")
    news = files.news(files.text_files(spark, root, "b-*.txt")).first()
    assert (news["title"], news["body"]) == ("Head", "rest ü\nmore")
    assert [r["line"] for r in files.grep(spark, root, "rest", "*.txt").collect()] == ["rest ü"]
    assert {r["suffix"]: r["n"] for r in files.by_suffix(files.encoded_files(spark, root, "*.txt")).collect()} == {"8": 1, "0": 1}
    df = spark.createDataFrame([(1, "b-0.txt")], "doc_id long, p string")
    assert files.external_field(df, files.text_files(spark, root, "*.txt"), "body", "p", root).first()["body"].startswith("Head")
    assert files.survey(files.encoded_files(spark, root)).first()["files"] == 3
    posts = spark.createDataFrame([(1, "<b>x</b>"), (1, "<b>y</b>"), (2, "z")], "id int, t string")
    assert sorted(map(tuple, files.posts(posts, "id", "t").collect())) == [(1, "x"), (2, "z")]
    assert [r["id"] for r in files.not_loaded(posts, spark.createDataFrame([(1,)], "id int"), "id").collect()] == [2]


def test_streaming(spark, tmp_path):
    schema = Schema((FieldDef("t"),), analyzer="lowercase")
    source, path = str(tmp_path / "in"), str(tmp_path / "ix")
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox")], "doc_id long, t string")
    docs.write.parquet(source)
    start = lambda: start_indexing(spark.readStream.schema(docs.schema).parquet(source), schema, path, str(tmp_path / "cp")).awaitTermination()
    start()
    spark.createDataFrame([(3, "red dog")], "doc_id long, t string").write.mode("append").parquet(source)
    start()
    ix = Index.open(spark, path, schema)
    assert ix.doc_freq("t", "red") == 2 and len(ix.segments) == 2
    whole = Index.build(spark.read.parquet(source), schema)
    get = lambda i: sorted(map(tuple, Searcher(i, "t").hits("t:red t:fox").collect()))
    assert get(ix) == get(whole) and len(get(ix)) == 3
