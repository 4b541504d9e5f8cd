import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spellpanel.operators import relational as Rel
from spellpanel.session import stage, stage_folder, stage_root


def skewed(spark, n=600):
    """A third of the rows under one key, a third under none."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 == 0, "hot").when(i % 3 == 1, F.concat(F.lit("k"), (i % 50).cast("string"))).alias("k"),
        (i * 7 % 11).cast("int").alias("a"),
        F.when(i % 13 != 0, (i * 5 % 17).cast("int")).alias("b"),
        i.alias("u"),
    )


def test_next_row_slices_give_the_window_result(spark):
    df = skewed(spark)
    order = ["a", "b", "u"]
    plain = Rel.next_row(df, "k", order, ["u"], None).select("u", F.col("_next.u").alias("n"))
    sliced = Rel.next_row(df, "k", order, ["u"], 20).select("u", F.col("_next.u").alias("n"))
    assert plain.exceptAll(sliced).isEmpty() and sliced.count() == 600


def test_row_numbers_do_not_depend_on_the_path(spark):
    df = skewed(spark)
    a = Rel.row_in_group(df, ["k"], ["a", "b", "u"], "n", None)
    b = Rel.row_in_group(df, ["k"], ["a", "b", "u"], "n", 20)
    assert a.select("u", "n").exceptAll(b.select("u", "n")).isEmpty()


def test_position_is_dense_and_layout_free(spark):
    df = skewed(spark)
    want = df.withColumn("p", F.row_number().over(Window.orderBy("u")).cast("bigint")).select("u", "p")
    for parts in (1, 7):
        got = Rel.with_position(df.repartition(parts), ["u"], "p").select("u", "p")
        assert got.exceptAll(want).isEmpty() and got.count() == 600


def test_group_ids_take_null_as_a_key(spark):
    df = skewed(spark)
    out = Rel.dense_group_id(df, ["k"], ["k"], "g")
    ids = {r["k"]: r["g"] for r in out.select("k", "g").distinct().collect()}
    assert sorted(ids.values()) == list(range(1, len(ids) + 1)) and None in ids
    assert ids[None] == len(ids)  # missing sorts last


def test_first_per_key_matches_window(spark):
    df = skewed(spark)
    got = Rel.first_per_key(df, ["k", "a"], ["b", "u"])
    w = Window.partitionBy("k", "a").orderBy(F.col("b").asc_nulls_last(), "u")
    want = df.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_null_safe_full_join(spark):
    a = spark.createDataFrame([("x", None, 1), ("y", 2.0, 2)], "k string, c double, a int")
    b = spark.createDataFrame([("x", None, 3), ("z", 2.0, 4)], "k string, c double, b int")
    out = Rel.join_null_safe(a, b, ["k", "c"], "full")
    got = sorted((r["k"], r["a"] or 0, r["b"] or 0) for r in out.collect())
    assert got == [("x", 1, 3), ("y", 2, 0), ("z", 0, 4)]


def test_group_extreme_strict(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 1), ("b", 3), ("b", None)], "k string, v int")
    assert sorted(tuple(r) for r in Rel.group_extreme(df, ["k"], "v").collect()) == [("a", 1), ("b", 3)]
    assert [tuple(r) for r in Rel.group_extreme(df, ["k"], "v", strict=True).collect()] == [("a", 1)]


def test_quantile_interpolates(spark):
    df = spark.range(101).select((F.col("id") * 10).cast("int").alias("v"))
    assert Rel.quantile(df, "v", 0.999).first()["q"] == pytest.approx(999.0)
    assert Rel.quantile(df, "v", 0.5, approx=True).first()["q"] == 500.0


def test_fan_out_and_uniqueness(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    assert [tuple(r) for r in Rel.fan_out(df, ["k"]).collect()] == [("a", 2)]
    with pytest.raises(ValueError):
        Rel.require_unique(df, ["k"])


def test_group_shares_sum_to_one_or_are_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None), ("c", 0.0)], "k string, v double")
    got = sorted(((r["k"], r["v"]), r["s"]) for r in Rel.group_shares(df, ["k"], "v", "s").filter("k <> 'b'").collect())
    assert got == [(("a", 1.0), 0.25), (("a", 3.0), 0.75), (("c", 0.0), None)]
    assert Rel.group_shares(df, ["k"], "v", "s").filter("k = 'b' and s is not null").isEmpty()


def test_count_steps(spark):
    df = spark.createDataFrame([("R1", True), ("R2", False), ("N1", True)], "u string, ok boolean")
    rows = Rel.count_steps(df, "u", {"all": F.lit(True), "r": F.col("u").startswith("R"), "ok": F.col("ok")}).collect()
    assert [(r["step"], r["label"], r["n_units"]) for r in rows] == [(1, "all", 3), (2, "r", 2), (3, "ok", 1)]


def test_stage_uses_the_named_folder(spark):
    root = stage_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir")
    out = stage(spark.range(5), "t")
    assert out.count() == 5 and stage_folder(spark) in out.inputFiles()[0] and root in stage_folder(spark)
