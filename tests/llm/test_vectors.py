"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest

import brute
from spellpanel.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def all_pairs(rows, threshold=0.93):
    """Sorted (vec_id, n_links, component) of every row, comparing all pairs."""
    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.asarray(v, dtype=np.float32).astype(float)
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if units[i] is not None and units[j] is not None
             and len(units[i]) == len(units[j]) and rows[i][2] is not None and rows[i][2] == rows[j][2]
             and units[i] @ units[j] >= threshold]
    n = np.bincount([x for p in links for x in p], minlength=len(rows))
    comp = brute.components(len(rows), links)
    low = {}
    for (vec_id, _, _), c in zip(rows, comp):
        if vec_id is not None:
            low[c] = min(low.get(c, vec_id), vec_id)
    return sorted(((r[0], int(k), low.get(c)) for r, k, c in zip(rows, n, comp)), key=str)


def got(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in df.collect()), key=str)


def cloud(seed, n=160, dim=24):
    """Single vectors, copies, chains of neighbours around the threshold and one dense group."""
    draw = np.random.default_rng(seed)
    base = [draw.normal(size=dim) for _ in range(n)]
    base += [base[k] + draw.normal(size=dim) * s for k in range(20) for s in (0.05, 0.2, 0.35, 0.4, 0.45)]
    core = draw.normal(size=dim)
    base += [core + draw.normal(size=dim) * 0.12 for _ in range(150)]
    base += [base[3]] * 12 + [2.0 * base[4]]
    return [(int(i), [float(np.float32(x)) for x in v], int(i % 3 if i < n else 1)) for i, v in enumerate(base)]


ODD = [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 24, 1), (9003, [1.0, None] * 12, 1), (9004, [float("nan")] * 24, 1),
       (9005, [float("inf")] * 24, 1), (9006, [1.0, 2.0], 1), (9007, [1.0, 2.0], None), (9008, [1.0, 2.0], 1), (None, [1.0, 2.1], 1),
       (None, [5.0, -1.0], 2), (None, [5.0, -1.1], 2), (7, [0.5, 0.25], 1), (7, [0.5, 0.25], 1), (9009, [1e38] * 2, 4), (9010, [3e38] * 2, 4)]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_all_pairs(spark, seed):
    rows = cloud(seed) + ODD
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA + ", did int, ball string").repartition(4)
    assert got(V.near_vectors(df, miss=1e-9)) == all_pairs(rows)


@pytest.mark.parametrize("block,balls", [(16, 1000), (40, 30), (7, 1)])
def test_blocks_and_balls_change_nothing(spark, block, balls):
    rows = cloud(3)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(V.near_vectors(df, miss=1e-9, block=block, balls=balls)) == all_pairs(rows)


def test_a_dense_group_gets_a_ball(spark):
    draw = np.random.default_rng(5)
    core = draw.normal(size=16)
    rows = [(i, [float(x) for x in core + draw.normal(size=16) * 0.05], 1) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    signed = V._signed(df.selectExpr("vec_id did", "1L w", "string(label) label", "size(embedding) dim", "embedding"), 8, 4, 1)
    placed = V._balls(signed.cache(), 200, 0.93, 20, 1000).cache()
    assert placed.filter("ball = 0").count() > 190
    assert V._comparisons(placed, 20).count() < 200 * 4 * 4  # the ball is not compared with itself
    assert got(V.near_vectors(df, block=20)) == all_pairs(rows)


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine of 0.93 exactly, the hardest ones, are lost as rarely as promised."""
    draw = np.random.default_rng(8)
    rows = []
    for k in range(1500):
        a, b = np.linalg.qr(draw.normal(size=(48, 2)))[0].T
        c = 0.9301
        rows += [(2 * k, a.tolist(), 1), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * b).tolist(), 1)]
    out = V.near_vectors(spark.createDataFrame(rows, SCHEMA))
    assert out.filter("n_links = 1").count() >= 0.995 * len(rows)


def test_empty_table_and_plan(spark):
    assert V.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    for n in (1, 10**4, 10**7, 10**9):
        bits, tables = V.hash_plan(n, 0.93)
        assert n / 2**bits <= 512 and (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** tables <= 1e-3


def test_whole_table_equals_all_pairs(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert got(V.near_vectors(df)) == all_pairs(rows)
