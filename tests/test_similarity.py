import pytest
from pyspark.sql import functions as F

from loomtext.functions.similarity import NORMS, Similarity, decode_norm, decode_norm_column, encode_norm, encode_norm_column


def test_every_byte_comes_back():
    assert [encode_norm(v) for v in NORMS] == list(range(256))
    assert NORMS == sorted(NORMS)


def test_lengths():
    assert [encode_norm(n**-0.5) for n in range(1, 6)] == [124, 122, 121, 120, 120]
    assert [decode_norm(b) for b in (124, 122, 121, 120)] == [1.0, 0.75, 0.625, 0.5]


def test_columns(spark):
    values = [0.0, -1.0, 1e-30, 1e-9, 0.3, 1.0, 0.5773502691896258, 1e30, *NORMS, *[v * 1.0000001 for v in NORMS], *[v * 0.9999999 for v in NORMS], *[n**-0.5 for n in range(1, 500)]]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", encode_norm_column(F.col("v")).alias("b")).withColumn("d", decode_norm_column(F.col("b"))).collect()
    for r in rows:
        assert r["b"] == encode_norm(r["v"])
        assert r["d"] == pytest.approx(decode_norm(r["b"]))


def test_constants(spark):
    s = Similarity()
    one = spark.range(1).select(s.length_norm(F.lit(16)).alias("l"), s.tf(F.lit(9)).alias("t")).first()
    assert (one["l"], one["t"]) == (0.25, 3.0)
    assert s.query_norm(16) == 0.25
    assert s.sloppy_freq(9) == 0.1
    assert s.idf(9, 10) == 1.0
    assert s.coord(12, 3) == 4
