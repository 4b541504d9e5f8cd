import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from simulate import frame, panel

from spellpanel.functions.normal import two_sided_p, two_sided_p_exact, z_value
from spellpanel.operators import effects as E
from spellpanel.operators import inference as I
from spellpanel.operators import series as G
from spellpanel.session import stage
from spellpanel.sources import tables as Tab


@pytest.fixture(scope="module")
def cells(spark):
    return stage(
        frame(
            spark,
            panel("new|elect|rate"),
            panel("old|elect|rate", starts=(12, 12), seed=2),
            panel("new|elect|los.ip_avg", rank=2, n_co=60, months=30, starts=(15, 17, 20), seed=3),
            panel("new|hvlc|rate", slope=1.5, seed=5),
            panel("new|hvlc|los.ip_avg", n_co=1),
        ),
        "test_cells",
    )


@pytest.fixture(scope="module")
def fit(cells):
    asked = cells.select("model").unionByName(cells.sparkSession.createDataFrame([("new|x|rate",)], "model string"))
    return {k: stage(v, k) for k, v in E.fit_sweep(cells, models=asked).items()}


@pytest.fixture(scope="module")
def boot(cells, fit):
    return stage(E.bootstrap_effects(cells, fit["fit_meta"], draws=60, draws_per_task=20, pool_size=20), "test_boot")


@pytest.fixture(scope="module")
def table(cells, fit, boot):
    return stage(I.inference_table(fit, boot, cells, range(1, 5)), "test_table")


def test_planted_effect_and_rank_are_found(fit):
    meta = {r["model"]: r for r in fit["fit_meta"].collect()}
    assert meta["new|elect|rate"]["r_cv"] == 0 and meta["new|elect|los.ip_avg"]["r_cv"] == 2
    assert meta["new|hvlc|los.ip_avg"]["status"] == "failed: fewer than two controls"
    assert meta["new|x|rate"]["status"] == "failed: no eligible units"
    assert meta["new|elect|rate"]["sigma2"] == pytest.approx(0.01, rel=0.3)
    effects = {r["model"]: r["m"] for r in fit["fit_cells"].filter("d = 1").groupBy("model").agg(F.avg("eff").alias("m")).collect()}
    assert len(effects) == 4
    for model, m in effects.items():
        assert m == pytest.approx(2.0, abs=0.1), model


def test_rank_zero_equals_two_way_aggregates(cells):
    one = cells.filter("model = 'new|elect|rate'")
    a, b = E.fit_sweep(one, rank=0), E.did_counterfactual(one)
    gap = a["fit_cells"].alias("a").join(b["fit_cells"].alias("b"), ["model", "unit", "time"])
    assert gap.agg(F.max(F.abs(F.col("a.eff") - F.col("b.eff")))).first()[0] < 1e-9
    assert a["fit_meta"].first()["sigma2"] == pytest.approx(b["fit_meta"].first()["sigma2"])
    assert tuple(b["fit_meta"].first())[:4] == ("new|elect|rate", 24, 43, 3)


def test_slope_is_recovered_both_ways(cells):
    one = cells.filter("model = 'new|hvlc|rate'")
    assert E.slopes(one).first()["slope"] == pytest.approx(1.5, abs=0.05)
    assert E.covariate_slope(one).first()["slope"] == pytest.approx(E.slopes(one).first()["slope"], abs=1e-9)


def test_gram_does_not_depend_on_buckets(cells):
    one = cells.filter("model = 'new|hvlc|rate'")
    a, b = E.control_gram(one, 1000), E.control_gram(one, 7)
    gap = a.join(b.withColumnRenamed("v", "u"), ["model", "i", "j"]).agg(F.max(F.abs(F.col("v") - F.col("u"))), F.count("*"))
    assert gap.first()[0] < 1e-9 and gap.first()[1] == a.count() == b.count()


def test_bootstrap_does_not_depend_on_the_split(cells, fit, boot):
    again = E.bootstrap_effects(cells.repartition(3), fit["fit_meta"], draws=60, draws_per_task=60, pool_size=20)
    gap = boot.join(again.withColumnRenamed("eff", "e2"), ["model", "unit", "time", "draw"])
    row = gap.agg(F.max(F.abs(F.col("eff") - F.col("e2"))), F.count("*")).first()
    assert row[0] < 1e-9 and row[1] == boot.count() == again.count() == 60 * (3 * 24 + 2 * 24 + 3 * 30 + 3 * 24)


def test_fit_that_stops_early_says_so():
    y = np.random.default_rng(0).normal(size=(40, 12))
    x = np.random.default_rng(1).normal(size=(40, 12)) + y
    z = np.concatenate([y, x], axis=1)
    assert E.solve_gram(z.T @ z, 12, 2, tol=0.0, cap=3)[3] is False
    assert E.solve_gram(z.T @ z, 12, 2)[3] is True


def test_playing_controls_are_not_a_prefix(spark):
    """More controls than pool entries: renaming them in another order leaves the spread of errors alone."""
    p = panel("m", n_co=60, starts=(8,), months=12)
    cells = E.eligible_cells(frame(spark, p).drop("treated", "T0"))
    meta = E.fit_sweep(cells, rank=0)["fit_meta"]
    a = E.bootstrap_effects(cells, meta, draws=40, pool_size=20)
    b = E.bootstrap_effects(cells, meta, draws=40, pool_size=40)
    assert a.count() == b.count() > 0
    assert a.agg(F.stddev("eff")).first()[0] > 0


def test_eligibility(spark):
    p = panel("m", n_co=4, starts=(3, 8), months=12)
    p.loc[(p.unit == "u001") & (p.time == 5), "y"] = None
    p.loc[(p.unit == "u005") & (p.time == 9), "y"] = None  # its first treated month
    p.loc[(p.unit == "u002") & (p.time > 5), "y"] = None
    status = {r["unit"]: (r["n_cells"], r["n_pre"], r["T0"], r["status"]) for r in E.unit_status(frame(spark, p)).collect()}
    assert status == {"u000": (12, 12, 12, "kept"), "u001": (11, 11, 12, "kept"), "u002": (5, 5, 12, "few pre-periods"),
                      "u003": (12, 12, 12, "kept"), "u004": (12, 3, 3, "few pre-periods"), "u005": (11, 8, 8, "kept")}
    kept = E.eligible_cells(frame(spark, p).drop("treated", "T0"))
    assert {(r["unit"], r["T0"]) for r in E.fit_units(kept).collect()} == {("u005", 8)}


def gappy(seed, share=0.1, **kw):
    """A panel with a share of its cells missing, other than the treated units' last pre-months."""
    p = panel(seed=seed, **kw)
    drop = np.random.default_rng(seed).random(len(p)) < share
    return p[~drop].reset_index(drop=True)


def dense_two_way(p, slope):
    """Least squares with a column for every control unit, every month and the covariate."""
    co = p[p.treated == 0]
    units, times = sorted(co.unit.unique()), sorted(co.time.unique())
    a = np.column_stack([(co.unit.to_numpy()[:, None] == np.array(units)).astype(float),
                         (co.time.to_numpy()[:, None] == np.array(times)).astype(float),
                         *([np.array([x[0] for x in co.x])] if slope else [])])
    coef, _, rank, _ = np.linalg.lstsq(a, co.y.to_numpy(), rcond=None)
    sse = float(((co.y.to_numpy() - a @ coef) ** 2).sum())
    g, b = dict(zip(times, coef[len(units) : len(units) + len(times)])), coef[len(units) + len(times) :]
    out = {}
    for unit, rows in p[p.treated == 1].groupby("unit"):
        base = np.array([g[t] + (b[0] * x[0] if slope else 0.0) for t, x in zip(rows.time, rows.x)])
        shift = (rows.y.to_numpy() - base)[rows.d.to_numpy() == 0].mean()
        out |= {(unit, int(t)): float(v) for t, v in zip(rows.time, base + shift)}
    return out, b, sse / (len(co) - rank)


@pytest.mark.parametrize("slope", [None, 1.5])
def test_two_way_effects_of_unbalanced_panels_are_least_squares(spark, slope):
    p = gappy(11, n_co=30, slope=slope)
    cells = E.eligible_cells(frame(spark, p).drop("treated", "T0"))
    want, b, sigma2 = dense_two_way(p, slope)
    fits = [E.fit_sweep(cells, rank=0)] + ([] if slope else [E.did_counterfactual(cells)])
    for fit in fits:
        got = {(r["unit"], r["time"]): r["y_ct"] for r in fit["fit_cells"].collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6
        assert fit["fit_meta"].first()["sigma2"] == pytest.approx(sigma2, rel=1e-6)
        assert {r["T0"] for r in fit["fit_units"].collect()} == {12, 14, 16}
    if slope:
        assert E.covariate_slope(cells).first()["slope"] == pytest.approx(b[0], abs=1e-6)
    small = E.two_way_solution(cells, units_per_task=4).groupBy("model").agg(F.max("sse").alias("s")).first()["s"]
    assert small == pytest.approx(E.two_way_solution(cells).first()["sse"], rel=1e-9)


@pytest.mark.parametrize("rank,slope", [(1, None), (2, 0.7)])
def test_factors_of_panels_with_missing_cells(spark, rank, slope):
    """A tenth of the cells missing: the planted rank is chosen and the planted effect found."""
    p = gappy(21 + rank, n_co=60, months=30, starts=(15, 17, 20), rank=rank, slope=slope)
    cells = stage(E.eligible_cells(frame(spark, p).drop("treated", "T0")), "gappy")
    fit = E.fit_sweep(cells, max_rank=3)
    meta = fit["fit_meta"].first()
    assert (meta["status"], meta["r_cv"], meta["N"], meta["T"]) == ("ok", rank, 63, 30)
    assert meta["sigma2"] == pytest.approx(0.01, rel=0.25)
    assert fit["fit_cells"].filter("d = 1").agg(F.avg("eff")).first()[0] == pytest.approx(2.0, abs=0.1)
    assert fit["fit_cells"].count() == (p.treated == 1).sum()
    if slope:
        assert E.slopes(cells, rank).filter("pos = 1").first()["slope"] == pytest.approx(slope, abs=0.05)


def test_draws_of_panels_with_missing_cells(spark):
    """Only observed treated cells have draws, and their spread is that of the noise."""
    p = gappy(41, n_co=40, months=20, starts=(10, 12), rank=1)
    cells = stage(E.eligible_cells(frame(spark, p).drop("treated", "T0")), "gappy")
    meta = stage(E.fit_sweep(cells, rank=1)["fit_meta"], "gappy-meta")
    a = stage(E.bootstrap_effects(cells, meta, draws=60, draws_per_task=60, pool_size=30), "gappy-draws")
    b = E.bootstrap_effects(cells.repartition(5), meta, draws=60, draws_per_task=20, pool_size=30)
    assert a.count() == 60 * (p.treated == 1).sum()
    gap = a.join(b.withColumnRenamed("eff", "e2"), ["model", "unit", "time", "draw"]).agg(
        F.max(F.abs(F.col("eff") - F.col("e2"))), F.count("*")).first()
    assert gap[0] < 1e-9 and gap[1] == a.count()
    spread = a.groupBy("unit", "time").agg(F.stddev("eff").alias("s")).agg(F.avg("s")).first()[0]
    assert 0.08 < spread < 0.2


def test_missing_cells_end_at_observed_least_squares(spark):
    """Against an alternating fit over observed cells in numpy, whatever the buckets."""
    p = gappy(31, n_co=25, months=16, starts=(10,), rank=1)
    cells = stage(E.eligible_cells(frame(spark, p).drop("treated", "T0")), "gappy")
    flat = stage(E.two_way_solution(cells), "flat")
    a = E.missing_solutions(cells, [1], flat).first()
    b = E.missing_solutions(cells, [1], flat, units_per_task=3).first()
    assert a["status"] == b["status"] == "ok" and a["sse"] == pytest.approx(b["sse"], rel=1e-6)
    y = p[p.treated == 0].pivot(index="unit", columns="time", values="y").to_numpy()
    seen, y = ~np.isnan(y), np.nan_to_num(y)
    f, best = np.random.default_rng(0).normal(size=(16, 1)), None
    g = np.zeros(16)
    for _ in range(3000):  # unit coefficients given the months' values, then months given the units'
        h = np.column_stack([np.ones(16), f])
        c = np.array([np.linalg.lstsq(h[s], (v - g)[s], rcond=None)[0] for v, s in zip(y, seen)])
        for t in range(16):
            k = seen[:, t]
            g[t], f[t, 0] = np.linalg.lstsq(np.column_stack([np.ones(k.sum()), c[k, 1]]), y[k, t] - c[k, 0], rcond=None)[0]
        h = np.column_stack([np.ones(16), f])
        best = float((seen * (y - g - c @ h.T) ** 2).sum())
    assert a["sse"] == pytest.approx(best, rel=1e-4)


def test_row_counts_of_the_levels(table, fit):
    n = {(r["model"], r["level"]): r["count"] for r in table.groupBy("model", "level").count().collect()}
    for model, t, starts in (("new|elect|rate", 24, (12, 14, 16)), ("old|elect|rate", 24, (12, 12))):
        k = len(starts)
        assert n[model, "overall"] == 2 and n[model, "key"] == 2
        assert n[model, "time"] == max(starts) + t - min(starts)
        assert n[model, "unit"] == n[model, "unit_key"] == 2 * k and n[model, "cell"] == t * k


def test_identities_of_the_table(table):
    assert table.filter("pval < 0 or pval > 1").isEmpty()
    assert table.filter("att_mean < att_lower or att_mean > att_upper").isEmpty()
    assert table.filter("abs(out_tr - out_ct - att_mean) > 1e-9").isEmpty()
    assert table.filter("abs(att_se - out_ct_se) > 1e-9 or att_se is null").isEmpty()
    assert table.filter("period = 'pre' and size_tr <> 0").isEmpty()


def test_sizes_and_labels(table):
    rows = {(r["level"], r["period"], r["time"]): r for r in table.filter("model = 'new|elect|rate' and unit = 'Pooled'").collect()}
    over = rows["overall", "post", "1 - 12"]
    assert (over["size_tr"], over["size_ct"], over["size_period"], over["comparator"]) == (3, 40, 12, "new_hub")
    assert rows["overall", "pre", "-1 - -16"]["size_period"] == 16
    assert rows["key", "post", "1 - 4"]["size_period"] == 4 and rows["key", "pre", "-1 - -4"]["size_tr"] == 0
    # starts 12, 14, 16 of 24 months: 3 units to month 8, 2 to 10, 1 to 12
    assert [rows["time", "post", str(k)]["size_tr"] for k in (8, 9, 10, 11, 12)] == [3, 2, 2, 1, 1]
    assert table.filter("model = 'old|elect|rate'").first()["comparator"] == "old_hub"


def test_pooled_effect_is_a_mean_of_means(fit, table):
    c = I.stagger(fit["fit_cells"], fit["fit_units"]).filter("model = 'new|elect|rate' and period = 'post'")
    by_time = c.groupBy("event_time").agg(F.avg("eff").alias("e"))
    want = by_time.agg(F.avg("e")).first()[0]
    got = table.filter("model = 'new|elect|rate' and level = 'overall' and period = 'post'").first()["att_mean"]
    assert got == pytest.approx(want, abs=1e-12) and got != pytest.approx(c.agg(F.avg("eff")).first()[0], abs=1e-9)


def test_event_time_has_no_zero(fit):
    c = I.stagger(fit["fit_cells"], fit["fit_units"])
    assert c.filter("event_time = 0").isEmpty()
    assert c.filter("(period = 'pre') <> (event_time < 0)").isEmpty()


def test_unweighted_table(fit, boot):
    out = I.inference_table(fit, boot, None, range(1, 5)).filter("level = 'unit' and model = 'new|elect|rate'")
    c = I.stagger(fit["fit_cells"], fit["fit_units"])
    means = c.groupBy("model", "period", "unit").agg(F.avg("y_tr").alias("m"))
    assert out.join(means, ["model", "period", "unit"]).filter("abs(m - out_tr) > 1e-9").isEmpty()


def test_preconditions(fit, boot):
    for bad in ([0, 1], [1, 3], []):
        with pytest.raises(ValueError):
            I.inference_table(fit, boot, None, bad)
    with pytest.raises(ValueError):
        I.inference_table(fit, boot, None, range(1, 14))  # past the shortest post period
    for alpha in (0, 1, 1.5):
        with pytest.raises(ValueError):
            I.inference_table(fit, boot, None, range(1, 5), alpha)
    assert I.default_window(fit["fit_units"], fit["fit_meta"].filter("status = 'ok'")) == I.KeyWindow(1, 6)


def test_published_layout(table):
    out = I.published_layout(table)
    assert out.columns == I.INFERENCE_LAYOUT and len(out.columns) == 22
    assert {r["outcome"] for r in out.select("outcome").distinct().collect()} == {"rate", "los.ip_avg"}


def test_series(table):
    points = G.effect_series(table).filter("kind = 'point' and unit = 'Pooled' and cohort = 'old' and activity = 'elect'")
    assert points.count() == 24 and {r["outcome"] for r in points.collect()} == {"act"}
    assert G.outcome_series(table).count() == table.count()
    labels = G.delta_labels(table).filter("cohort = 'new' and activity = 'elect' and outcome = 'act' and kind = 'overall'")
    spans = {(r["unit"], r["period"]): r["span"] for r in labels.collect()}
    assert spans["Pooled", "post"] == "1 - 12" and spans["u040", "pre"] == "-1 - -12" and spans["u042", "post"] == "1 - 8"


def test_fit_tables_survive_storage(spark, fit, tmp_path):
    Tab.save_fit(fit, str(tmp_path / "fit"))
    back = Tab.load_fit(spark, str(tmp_path / "fit"), list(fit))
    for name, df in fit.items():
        cols = sorted(df.columns)
        assert sorted(back[name].columns) == cols and back[name].select(cols).exceptAll(df.select(cols)).isEmpty()


def test_normal_tail(spark):
    df = spark.createDataFrame([(z / 10,) for z in range(-60, 61)], "z double")
    rows = df.select("z", two_sided_p(F.col("z")).alias("p"), two_sided_p_exact("z").alias("q")).collect()
    for r in rows:
        assert r["q"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)))
        assert abs(r["p"] - r["q"]) < 2e-7
    assert z_value(0.05) == pytest.approx(1.959963984540054)
