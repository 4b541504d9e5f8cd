"""Registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from spellpanel.plans.registry import rounded
from spellpanel.plans.sql import rnd

TABLES = "region nation customer supplier part orders lineitem events".split()
SAMPLE = [
    "d01_transfer_flag", "d06_build_spells", "d12_ort_thr", "d14_activity_panel", "d18_final_panel", "t07_model_inputs",
    "j05_null_safe_full_join", "w05_row_id", "a12_quantile", "x16_normal_tail",
]


def canon(rows):
    return sorted(tuple(str(v + 0.0 if isinstance(v, float) else v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_twin(spark, small, db, name):
    got = entry.queries()[name](spark, small)
    cols = sorted(got.columns)
    rel = db.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})")
    assert canon(tuple(r) for r in got.select(cols).collect()) == canon(rel.fetchall())


def test_registry_is_complete():
    queries, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(queries)
    sizes = {"s": 12, "p": 16, "f": 13, "j": 11, "a": 21, "w": 13, "k": 4, "u": 4, "r": 6, "x": 18, "d": 22, "t": 7, "m": 7, "i": 11, "g": 3}
    for letter, n in sizes.items():
        for i in range(1, n + 1):
            assert any(q.startswith(f"{letter}{i:02d}") for q in queries), f"{letter}{i:02d}"


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns[:3] == ["PROCODE3", "month", "n_activity"] and out.count() > 0


def test_rounding_agrees_with_sql_at_halves(spark, db):
    halves = [k / 1e8 for k in range(50, 3_000_000, 100)] + [0.0642005, -0.1261665, -0.0, 1e300, float("inf"), None]
    df = spark.createDataFrame(list(enumerate(halves)), "k int, x double").repartition(8)
    got = dict(rounded(df).collect())
    for k, x in enumerate(halves):
        assert got[k] == db.execute(f"SELECT {rnd('?', 'x')}", [x]).fetchone()[0], x
    assert got[30_000] == 0.0642
    assert str(rounded(df.filter("k = 30002")).first()["x"]) == "0.0" and got[30_001] == -0.126166
