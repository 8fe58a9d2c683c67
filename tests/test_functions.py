import datetime

from pyspark.sql import functions as F

from sedimenta.functions import scalars as S


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr).first()[0]


def test_clean_string(spark):
    got = [one(spark, v, "string", S.clean_string("x")) for v in ("  a b ", "   ", "", None)]
    assert got == ["a b", None, None, None]


def test_parse_long_date(spark):
    got = [one(spark, v, "string", S.parse_long_date("x")) for v in (" July 27, 2026 ", "", "2026-07-27", None, "July 32, 2026")]
    assert got == [datetime.date(2026, 7, 27), None, None, None, None]


def test_parse_duration(spark):
    df = spark.createDataFrame([("90 min",), ("2 Seasons",), (" 90 min",), ("90",), (None,)], "x string").select(*S.parse_duration("x"))
    assert [tuple(r) for r in df.collect()] == [("90 min", 90, "min"), ("2 Seasons", 2, "Seasons"), ("90 min", None, "min"), ("90", 90, ""), (None, None, None)]


def test_row_hash_nulls(spark):
    df = spark.createDataFrame([(None, "b"), ("", "b"), ("a||b", ""), ("a", "b||")], "x string, y string")
    plain = [r[0] for r in df.select(S.row_hash(["x", "y"])).collect()]
    strict = [r[0] for r in df.select(S.row_hash(["x", "y"], strict=True)).collect()]
    assert plain[0] == plain[1] and len(set(strict)) == 4


def test_year_range(spark):
    as_of = F.lit("2024-05-01").cast("date")
    got = [one(spark, v, "int", S.year_in_range("x", 1900, as_of)) for v in (1899, 1900, 2025, 2026, None)]
    assert got == [False, True, True, False, False]


def test_base_name(spark):
    assert one(spark, "s3://a/b/c.csv", "string", S.base_name("x")) == "c.csv"
