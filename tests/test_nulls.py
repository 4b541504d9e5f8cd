"""Missing-value rules, one case per rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spellpanel.functions import dates as D
from spellpanel.functions import nulls as N


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def test_membership_is_false_for_missing(spark):
    assert one(spark, "a string", (None,), N.in_set("a", [1, 2])) is False
    assert one(spark, "a int", (11,), N.in_set("a", ["11"])) is True
    assert one(spark, "a string", ("x",), N.in_set("a", [])) is False


def test_search_is_false_for_missing(spark):
    assert one(spark, "a string", (None,), N.matches("a", "W05")) is False
    assert one(spark, "a string", ("W711,W052",), N.any_code("a", ["W05", "Y71"])) is True


def test_empty_code_is_refused():
    with pytest.raises(ValueError):
        N.any_code("a", ["W05", ""])
    with pytest.raises(ValueError):
        N.any_code("a", [])


def test_equality_stays_three_valued(spark):
    df = spark.createDataFrame([(None,)], "a string")
    eq = F.col("a") == "x"
    assert df.select((eq & F.lit(False)).alias("v")).first()["v"] is False
    assert df.select((eq | F.lit(True)).alias("v")).first()["v"] is True
    assert df.select(eq.alias("v")).first()["v"] is None
    assert df.filter(eq).count() == 0


def test_strict_aggregates_propagate_missing(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 4)], "k string, v int")
    got = {
        r["k"]: (r["s"], r["m"], r["lo"], r["p"], r["q"])
        for r in df.groupBy("k")
        .agg(
            N.strict_sum("v").alias("s"), N.strict_avg("v").alias("m"), N.strict_min("v").alias("lo"),
            N.strict_share(F.col("v") > 2).alias("p"), N.share(F.col("v") > 2).alias("q"),
        )
        .collect()
    }
    assert got["a"] == (None, None, None, None, 0.0)
    assert got["b"] == (6, 3.0, 2, 0.5, 0.5)


def test_division_by_zero_is_null(spark):
    assert one(spark, "a double, b double", (1.0, 0.0), N.ratio("a", "b")) is None


def test_cap_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (40,), (3,)], "a int")
    assert [r["v"] for r in df.select(N.cap_at("a", 37).alias("v")).collect()] == [None, 37, 3]
    assert [r["v"] for r in df.select(N.cap_at("a", None).alias("v")).collect()] == [None, 40, 3]


def test_row_sum_skips_missing(spark):
    df = spark.createDataFrame([(None, 2.0), (None, None)], "a double, b double")
    assert [r["v"] for r in df.select(N.row_sum(["a", "b"]).alias("v")).collect()] == [2.0, 0.0]


def test_sort_struct_puts_missing_last(spark):
    df = spark.createDataFrame([(None, 1), (2, None), (2, 5)], "a int, b int")
    first = df.agg(F.min(F.struct(N.sort_struct(["a", "b"]).alias("o"), "a", "b")).alias("m")).first()["m"]
    assert (first["a"], first["b"]) == (2, 5)


def test_sentinels_and_text(spark):
    d = dt.date(1801, 1, 1)
    assert one(spark, "a date", (d,), N.drop_sentinels("a", ["1801-01-01"])) is None
    assert one(spark, "a string", (None,), N.text_or_na("a")) == "NA"


def test_bad_date_is_null(spark):
    assert one(spark, "a string", ("31/02/2020",), D.parse_date("a", "dd/MM/yyyy")) is None
    assert one(spark, "a string", ("05/02/2020",), D.parse_date("a", "dd/MM/yyyy")) == dt.date(2020, 2, 5)


def test_study_calendar(spark):
    months = spark.range(1).select(D.STUDY.months().alias("m")).first()["m"]
    assert len(months) == 45
    df = spark.createDataFrame([(m,) for m in months] + [(dt.date(2020, 6, 1),)], "month date")
    rows = df.select(
        D.STUDY.contains("month").alias("c"), D.STUDY.index("month").alias("i"), D.STUDY.is_post("month").alias("p")
    ).collect()
    assert [r["i"] for r in rows[:45]] == list(range(1, 46))
    assert [r["p"] for r in rows[:45]] == [False] * 24 + [True] * 21
    assert (rows[45]["c"], rows[45]["i"], rows[45]["p"]) == (False, None, None)
