import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__ as entry
from spellpanel.operators.relational import SLICE, sliced, slices
from spellpanel.plans import chain
from spellpanel.session import stage_folder, staged_large
from spellpanel.sources import proxy


def shuffle_files(spark):
    """Shuffle files that this session's block manager holds on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in files.mkString("\n").split("\n") if "/shuffle_" in n and n.endswith(".data")}


def test_staged_panel_leaves_no_shuffle_files(spark, small):
    before = shuffle_files(spark)
    rows = chain.inputs(spark, small)
    assert not shuffle_files(spark) - before
    assert rows.count() > 0


def stage_tables(spark):
    folder = Path(stage_folder(spark).removeprefix("file:"))
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


def test_spell_table_leaves_one_stage_table(spark, small):
    """Nothing that the finished table was made of stays on disk, and reading it moves nothing."""
    files, tables = shuffle_files(spark), stage_tables(spark)
    rows = chain.finished_spells(spark, small)
    assert not shuffle_files(spark) - files
    assert [n.split("-")[0] for n in stage_tables(spark) - tables] == ["finished"]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 3788


def test_slices_hold_every_row_once(spark):
    """Also rows without a key; what a key joins is in its slice."""
    left = spark.createDataFrame([(i % 20 if i % 7 else None, i) for i in range(200)], "k int, a int")
    right = spark.createDataFrame([(i, -i) for i in range(0, 30, 2)] + [(None, 0)], "k int, b int")
    got = []
    with staged_large(sliced(left, "k"), "left", SLICE) as x, staged_large(sliced(right, "k"), "right", SLICE) as y:
        for p, q in slices(x, y):
            got += p.join(q, "k", "left").collect()
    assert sorted(map(str, got)) == sorted(map(str, left.join(right, "k", "left").collect()))


def test_spell_summary_reads_one_stage_table(spark, small):
    """Numbers and spans come from a stored table of numbered episodes, not from the joins that made it."""
    files = shuffle_files(spark)
    rows = entry.queries()["d05_spell_summary"](spark, small)
    assert not shuffle_files(spark) - files
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1


def test_episodes_move_as_lines(spark, small):
    """What goes to a person's task are the columns of the lines, once, not the episodes made of them."""
    plan = chain.prepared(spark, small)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning(" in x]
    assert sum("o_custkey" in x for x in moved) == 1 and not any("TOKEN_PERSON_ID" in x for x in moved)


def line(order, number, part=1, supp=1, price=1.0):
    return order, number, part, supp, price


def test_code_rows_of_odd_lines(spark, tmp_path):
    """Repeated lines and orders, lines without an order or with a missing value."""
    rows = [line(1, 1), line(1, 1), line(1, 2, part=5), line(1, 2, part=5), line(2, 1), line(None, 1), line(None, 2), line(3, 1),
            line(3, None), line(3, 2), line(4, 2, supp=3), line(4, 1, part=7), line(9, 1), line(9, 2)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    day = dt.datetime(2000, 1, 1)
    orders = [(1, 11, day), (1, 12, day), (2, 21, day), (3, 31, day), (4, None, day), (None, 1, day)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    got = proxy.px_long(spark, str(tmp_path)).select("id", F.substring("ord", 1, 3).alias("n"), "code").collect()
    part5, supp1 = proxy.PROCEDURES[5], proxy.PROCEDURES[1]
    want = [(f"{c}_1-1-1-1-100", "002", part5) for c in (11, 11, 12, 12)] + [("4-1-7-1-100", "002", supp1)]
    assert sorted(map(tuple, got)) == sorted(want)  # an order with a missing value has no first line
