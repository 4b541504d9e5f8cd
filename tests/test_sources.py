import pytest
from pyspark.sql import functions as F

from spellpanel.sources import tables as Tab


def test_quoted_row_named_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text('"","unit","rate"\n"1","R,01",2.5\n"2","R02",NA\n"3","say ""x"""\n')
    rows = Tab.read_row_named_csv(spark, str(tmp_path / "f.csv"), "unit STRING, rate DOUBLE").collect()
    assert [tuple(r) for r in rows] == [("R,01", 2.5), ("R02", None), ('say "x"', None)]


def test_lookup_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("E1", 1), ("E2", None)], "LSOA11 string, imd_decile int")
    Tab.write_csv(df, str(tmp_path / "c"))
    assert Tab.read_lookup(spark, str(tmp_path / "c"), "area_deprivation").exceptAll(df).isEmpty()


def test_years_with_differing_columns(spark, tmp_path):
    spark.range(3).withColumn("a", F.lit(1)).write.parquet(str(tmp_path / "y1"))
    spark.range(3, 6).write.parquet(str(tmp_path / "y2"))
    out = Tab.read_years(spark, [str(tmp_path / "y1"), str(tmp_path / "y2")], ["id", "a"], F.col("id") > 1)
    assert sorted((r["id"], r["a"]) for r in out.collect() if r["id"] < 4) == [(2, 1), (3, None)]


def test_scan_is_pruned_and_filtered_at_the_source(spark, small):
    df = Tab.read_table(spark, f"{small}/lineitem.parquet", ["l_orderkey", "l_linestatus"]).filter("l_linestatus = 'O'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_linestatus:string>" in plan and "EqualTo(l_linestatus,O)" in plan


def test_preview_schema_and_required_columns(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (None, "c")], "k int, v string")
    assert [r["v"] for r in Tab.preview(df, ["k"], 2).collect()] == ["a", "b"]
    assert [tuple(r) for r in Tab.schema_table(df).collect()] == [("k", "int"), ("v", "string")]
    with pytest.raises(ValueError):
        Tab.require_columns(df, "k", "missing")
    assert len(Tab.SPELL_LAYOUT) == 44
