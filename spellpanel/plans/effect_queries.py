"""Queries: counterfactuals, inference and series (M01-M07, I01-I11, G01-G03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spellpanel.operators import effects as E
from spellpanel.operators import inference as I
from spellpanel.operators import series as G
from spellpanel.plans import chain
from spellpanel.plans.registry import query
from spellpanel.plans.sql import rnd
from spellpanel.session import stage

KEY_TIMES = range(1, 7)
WINDOW = I.KeyWindow.of(KEY_TIMES)


def _r(names) -> str:
    return ", ".join(rnd(n, n) for n in names)


def _staggered(spark, sf):
    kept, fit = chain.fit(spark, sf)
    cells = I.with_weights(I.stagger(fit["fit_cells"], fit["fit_units"]), kept.select("model", "unit", "time", "w"))
    return kept, fit, stage(cells, "staggered")


def _draws(fit):
    return stage(chain.repeatable_draws(fit["fit_cells"]), "fit_boot")


def _table(spark, sf):
    kept, fit = chain.fit(spark, sf)
    return I.inference_table(fit, _draws(fit), kept, KEY_TIMES, skip_short=True)


# --------------------------------------------------------------------- models


@query("m01_did_counterfactual", f"SELECT model, unit, time, {_r(['y_tr', 'y_ct', 'eff'])}, d FROM fit_cells")
def m01(spark, sf):
    fit = E.did_counterfactual(chain.eligible(spark, sf))
    return fit["fit_cells"].select("model", "unit", "time", "y_tr", "y_ct", "eff", "d")


@query("m01_fit_meta", f"SELECT model, T, N, Ntr, {rnd('sigma2', 'sigma2')}, r_cv, status FROM meta")
def m01_meta(spark, sf):
    return E.did_counterfactual(chain.eligible(spark, sf))["fit_meta"]


@query(
    "m02_covariate_slope",
    """SELECT model, round(sum(e * ex) / sum(ex * ex), 6) + CAST(0 AS DOUBLE) AS slope FROM one_alternating
WHERE round = 300 GROUP BY model""",
)
def m02(spark, sf):
    outcome = E.Outcome("elect", "los.dc_ratio", "dc", "wt_n_activity", ("quintile_1_pct_ec",))
    return E.covariate_slope(chain.eligible(spark, sf, [outcome]))


@query(
    "m02_all_slopes",
    """SELECT model, pos, round(coalesce(slope / nullif(scale, 0), 0), 6) + CAST(0 AS DOUBLE) AS slope FROM (
  SELECT model, unnest(range(1, len(m) + 1))::INT AS pos, unnest(list_transform(m, lambda line: line[len(line)])) AS slope,
    unnest(list_transform(scales, lambda z: CASE WHEN z <= 1e-8 THEN 0 ELSE z END)) AS scale
  FROM elimination JOIN (SELECT model, count(*) - count(DISTINCT unit) - count(DISTINCT time) + 1 AS free FROM cov_controls
    WHERE v = 1 GROUP BY model) USING (model) WHERE step = len(m) AND free > len(m))""",
)
def m02_all(spark, sf):
    return E.slopes(chain.eligible(spark, sf, chain.outcomes(with_covariates=True)))


@query("m03_factor_counterfactual")
def m03(spark, sf):
    return E.fit_sweep(chain.eligible(spark, sf), rank=1)["fit_cells"]


@query("m04_fit_sweep")
def m04(spark, sf):
    cells = stage(chain.cells(spark, sf, chain.outcomes(with_covariates=True)), "cells")
    kept = stage(E.eligible_cells(cells), "eligible")
    return E.fit_sweep(kept, models=cells.select("model"))["fit_meta"]


@query("m05_choose_rank")
def m05(spark, sf):
    kept = chain.eligible(spark, sf)
    solution = stage(E.factor_solutions(kept, range(E.MAX_RANK + 1)), "solutions")
    return E.choose_rank(E.treated_fits(kept, solution))


@query("m06_bootstrap_effects")
def m06(spark, sf):
    kept = chain.eligible(spark, sf)
    fit = E.fit_sweep(kept, max_rank=2)
    boot = E.bootstrap_effects(kept, stage(fit["fit_meta"], "meta"), draws=200, draws_per_task=50)
    return boot.groupBy("model", "unit", "time").agg(
        F.count("*").alias("draws"), F.stddev_samp("eff").alias("se")
    )


@query("m07_eligibility", "SELECT model, unit, n_cells, n_pre, T0, treated, T, status FROM unit_states")
def m07(spark, sf):
    return E.unit_status(chain.cells(spark, sf)).select(
        "model", "unit", "n_cells", "n_pre", "T0", "treated", "T", "status"
    )


# ------------------------------------------------------------------ inference


@query("i01_stagger", f"SELECT model, unit, time, event_time, period, {_r(['y_tr', 'y_ct', 'eff'])} FROM staggered")
def i01(spark, sf):
    _, fit = chain.fit(spark, sf)
    return I.stagger(fit["fit_cells"], fit["fit_units"]).select(
        "model", "unit", "time", "event_time", "period", "y_tr", "y_ct", "eff"
    )


@query(
    "i02_weighted_outcomes",
    f"""SELECT model, period, 'time' AS margin, CAST(event_time AS VARCHAR) AS key, {rnd('out_tr', 'out_tr')} FROM time_means
UNION ALL SELECT model, period, 'unit', unit, {rnd('out_tr', 'out_tr')} FROM unit_means""",
)
def i02(spark, sf):
    cells = _staggered(spark, sf)[2]

    def margin(by):
        means = I.effect_means(cells, by, weighted=True)
        name = "time" if by == "event_time" else by
        return means.select("model", "period", F.lit(name).alias("margin"), F.col(by).cast("string").alias("key"), "out_tr")

    return margin("event_time").unionByName(margin("unit"))


@query("i03_att", f"SELECT model, period, event_time, {rnd('att_mean', 'att_mean')} FROM time_means")
def i03(spark, sf):
    cells = _staggered(spark, sf)[2]
    return I.effect_means(cells, "event_time", True).select("model", "period", "event_time", "att_mean")


@query(
    "i03_att_overall",
    f"SELECT model, period, {_r(['att_mean', 'out_tr', 'out_ct'])} FROM lvl_overall",
)
def i03_overall(spark, sf):
    return I.mean_of_means(I.effect_means(_staggered(spark, sf)[2], "event_time", True))


@query("i04_counterfactual_means", f"SELECT model, period, unit, {_r(['out_tr', 'out_ct'])} FROM unit_means")
def i04(spark, sf):
    return I.effect_means(_staggered(spark, sf)[2], "unit", True).select("model", "period", "unit", "out_tr", "out_ct")


@query("i05_draw_means", f"SELECT model, period, event_time, draw, {_r(['eff', 'ct'])} FROM draw_times")
def i05(spark, sf):
    _, fit, cells = _staggered(spark, sf)
    return I.draw_means(I.stagger_draws(_draws(fit), cells), ["event_time"])


_LEVELS = {
    "i06a_pooled_period": "overall", "i06b_pooled_time": "time", "i06c_pooled_window": "key",
    "i06d_unit_period": "unit", "i06e_unit_window": "unit_key", "i06f_unit_time": "cell",
}
_MEASURES = ["att_mean", "att_se", "out_tr", "out_ct", "out_ct_se"]


def _level(name, level):
    @query(
        name,
        f"SELECT model, period, unit, event_time, {_r(_MEASURES)} FROM levels WHERE level = '{level}'",
    )
    def run(spark, sf):
        _, fit, cells = _staggered(spark, sf)
        draws = I.stagger_draws(_draws(fit), cells)
        keys = ["level", "model", "period", "unit", "event_time"]
        rows = I.level_estimates(cells, True, WINDOW).join(I.level_spreads(draws, WINDOW), keys)
        return rows.filter(F.col("level") == level).drop("level")

    return run


for _name, _of in _LEVELS.items():
    _level(_name, _of)


@query(
    "i07_normal_inference",
    f"SELECT model, level, period, unit, time, {_r(['att_mean', 'att_se', 'att_lower', 'att_upper', 'pval'])} FROM inference",
)
def i07(spark, sf):
    return _table(spark, sf).select(
        "model", "level", "period", "unit", "time", "att_mean", "att_se", "att_lower", "att_upper", "pval"
    )


@query(
    "i08_percent_change",
    f"SELECT model, level, period, unit, time, {_r(['delta_mean', 'delta_lower', 'delta_upper'])} FROM inference",
)
def i08(spark, sf):
    return _table(spark, sf).select(
        "model", "level", "period", "unit", "time", "delta_mean", "delta_lower", "delta_upper"
    )


@query(
    "i09_diagnostics",
    f"""SELECT model, level, period, unit, time, comparator, {rnd('sigma2', 'sigma2')}, size_fct, size_period,
  size_tr, size_ct FROM inference""",
)
def i09(spark, sf):
    return _table(spark, sf).select(
        "model", "level", "period", "unit", "time", "comparator", "sigma2", "size_fct", "size_period", "size_tr", "size_ct"
    )


_ALL = [
    "att_mean", "att_se", "att_lower", "att_upper", "pval", "out_tr", "out_ct", "out_ct_se", "out_ct_lower",
    "out_ct_upper", "delta_mean", "delta_lower", "delta_upper", "sigma2",
]


@query(
    "i10_inference_table",
    f"""SELECT model, level, period, comparator, unit, time, {_r(_ALL)}, size_fct, size_period, size_tr, size_ct
FROM inference""",
)
def i10(spark, sf):
    return _table(spark, sf)


@query(
    "i11_key_window_check",
    """SELECT m.model, T - min_t0 AS post, 1 AS first, CAST(greatest((T - min_t0) // 2, 1) AS INT) AS last, T - min_t0 >= 6 AS fits
FROM meta m JOIN (SELECT model, min(T0) AS min_t0 FROM units GROUP BY model) t ON m.model = t.model""",
)
def i11(spark, sf):
    _, fit = chain.fit(spark, sf)
    windows = I.model_windows(fit["fit_units"], fit["fit_meta"])
    return windows.withColumn("fits", F.col("post") >= WINDOW.last)


# --------------------------------------------------------------------- series

_SERIES = """SELECT split_part(model, '|', 1) AS cohort, split_part(model, '|', 2) AS activity,
  CASE split_part(model, '|', 3) WHEN 'rate' THEN 'act' WHEN 'los.ip_avg' THEN 'los' ELSE 'dcr' END AS outcome,
  CASE split_part(model, '|', 3) WHEN 'rate' THEN 1 WHEN 'los.ip_avg' THEN 2 ELSE 3 END AS outcome_order,
  unit, CASE WHEN level IN ('overall', 'unit') THEN 'overall' WHEN level IN ('key', 'unit_key') THEN 'key' ELSE 'point' END AS kind,
  period, time, CASE WHEN level IN ('time', 'cell') THEN CAST(time AS INT) END AS event_time, """


@query(
    "g01_effect_series",
    _SERIES + _r(["att_mean", "att_lower", "att_upper", "delta_mean", "pval"]) + " FROM inference",
)
def g01(spark, sf):
    return G.effect_series(_table(spark, sf))


@query(
    "g02_outcome_series",
    _SERIES + _r(["out_tr", "out_ct", "out_ct_lower", "out_ct_upper", "delta_mean"]) + " FROM inference",
)
def g02(spark, sf):
    return G.outcome_series(_table(spark, sf))


@query(
    "g03_delta_labels",
    """SELECT split_part(model, '|', 1) AS cohort, split_part(model, '|', 2) AS activity,
  CASE split_part(model, '|', 3) WHEN 'rate' THEN 'act' WHEN 'los.ip_avg' THEN 'los' ELSE 'dcr' END AS outcome, unit,
  CASE WHEN level IN ('overall', 'unit') THEN 'overall' ELSE 'key' END AS kind, period,
  CASE WHEN level IN ('key', 'unit_key') THEN time WHEN period = 'pre' THEN '-1 - -' || size_period
       ELSE '1 - ' || size_period END AS span,
  CASE WHEN delta > 0 THEN printf('+%.1f%%', delta) ELSE printf('%.1f%%', delta) END AS label
FROM (SELECT *, round(delta_mean, 6) + CAST(0 AS DOUBLE) AS delta FROM inference) WHERE level IN ('overall', 'unit', 'key', 'unit_key')""",
)
def g03(spark, sf):
    return G.delta_labels(_table(spark, sf))
