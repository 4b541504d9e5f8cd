"""Queries: panels, exclusions, treatment and model inputs (D14-D22, T01-T07) and
the aggregates they are made of (A01-A21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spellpanel.functions.dates import month_of
from spellpanel.functions.nulls import cap_at, in_set, share, strict_share
from spellpanel.operators import codes as C
from spellpanel.operators import panel as P
from spellpanel.operators import relational as Rel
from spellpanel.operators import spells as S
from spellpanel.operators import treatment as T
from spellpanel.operators.recipes import SPECIALTIES
from spellpanel.plans import chain
from spellpanel.plans.registry import query
from spellpanel.plans.sql import (
    IN_STUDY,
    rnd,
    specialty_counts_sql,
    specialty_stay_sql,
)
from spellpanel.session import stage, stage_large
from spellpanel.sources import proxy

_COV = ["catchment_cat", "sex_male_pct", "white_pct", "age_65_plus_pct"]
_MIX = [
    "los_avg", "dc", "sex_male_pct_ec", "age_65_plus_pct_ec", "white_pct_ec",
    *[f"quintile_{q}_pct_ec" for q in range(1, 6)], "comorb_pct",
]
_COUNTS = [f"n_activity_{s}" for s in SPECIALTIES]
_RATES = [f"rate_{s}" for s in SPECIALTIES]
_STAYS = [f"{m}_{s}" for s in ["hvlc", *SPECIALTIES] for m in ("los_avg", "dc_prop")]


def _r(names) -> str:
    return ", ".join(rnd(n, n) for n in names)


@query(
    "d14_activity_panel",
    f"SELECT PROCODE3, month, n_activity, {_r([*_COV, 'el_rate'])} FROM activity",
)
def d14(spark, sf):
    return P.activity_panel(chain.elective(spark, sf), chain.features(spark, sf), proxy.LAST_REFERENCE_YEAR)


@query("d15_stay_panel", f"SELECT PROCODE3, month, {_r(_MIX)} FROM stay WHERE month >= DATE '1996-03-01'")
def d15(spark, sf):
    return P.stay_panel(chain.with_area(spark, sf), "1996-03-01")


_ANY_COUNT = "coalesce(" + ", ".join(_COUNTS) + ") IS NOT NULL"


@query(
    "d16_specialty_activity",
    f"""SELECT PROCODE3, month, {', '.join(_COUNTS)}, n_activity_hvlc,
  {_r([*_COV, *_RATES, 'hvlc_rate'])} FROM panel WHERE {_ANY_COUNT}""",
)
def d16(spark, sf):
    return P.specialty_activity(
        chain.flagged_spells(spark, sf), chain.features(spark, sf), proxy.LAST_REFERENCE_YEAR
    )


@query(
    "d17_specialty_stay",
    f"""SELECT PROCODE3, month, {_r(_STAYS)} FROM (
  SELECT PROCODE3, month, {specialty_stay_sql('true')} FROM panel_spells WHERE los >= 0 AND hvlc GROUP BY PROCODE3, month)""",
)
def d17(spark, sf):
    return P.specialty_stay(chain.flagged_spells(spark, sf))


@query(
    "d18_final_panel",
    f"""SELECT PROCODE3, month, year_month, n_activity, {', '.join(_COUNTS)}, n_activity_hvlc,
  {_r([*_COV, 'el_rate', *_MIX, *_RATES, 'hvlc_rate', *_STAYS])} FROM panel""",
)
def d18(spark, sf):
    return P.final_panel(
        chain.flagged_spells(spark, sf), chain.features(spark, sf), proxy.LAST_REFERENCE_YEAR, chain.STAY_FROM
    )


@query(
    "d19_apply_exclusions",
    f"SELECT PROCODE3, month, n_activity, {rnd('el_rate', 'el_rate')} FROM kept_panel",
)
def d19(spark, sf):
    kept = P.apply_exclusions(
        chain.overall_panel(spark, sf), proxy.peer_units(spark, sf), chain.features(spark, sf), proxy.exclude_units(spark, sf)
    )
    return kept.select("PROCODE3", "month", "n_activity", "el_rate")


@query("d20_unit_category", "SELECT PROCODE3, month, n_activity, elective_hub_cat FROM kept_panel")
def d20(spark, sf):
    return chain.kept_panel(spark, sf).select("PROCODE3", "month", "n_activity", "elective_hub_cat")


@query("d21_deprivation", "SELECT id, LSOA11, imd_decile FROM plain_spells")
def d21(spark, sf):
    return chain.with_area(spark, sf).select("id", "LSOA11", "imd_decile")


@query("d22_catchment_features", f"SELECT trust_code, year, {_r(_COV)} FROM features WHERE year IN (1997, 1998, 1999)")
def d22(spark, sf):
    return P.catchment_features(proxy.catchment(spark, sf), [1997, 1998, 1999])


# ------------------------------------------------------------------ treatment


@query("t01_earliest_start", "SELECT trust_code, hub_start_date FROM starts")
def t01(spark, sf):
    return T.earliest_start(proxy.unit_lookup(spark, sf))


@query("t02_study_calendar", f"SELECT PROCODE3, month, n_activity FROM activity WHERE {IN_STUDY}")
def t02(spark, sf):
    panel = P.activity_panel(chain.elective(spark, sf), chain.features(spark, sf), proxy.LAST_REFERENCE_YEAR)
    return T.in_study(panel, proxy.CALENDAR).select("PROCODE3", "month", "n_activity")


@query("t03_treatment_fixed", "SELECT PROCODE3, month, treated_unit, post, intervention FROM old_inputs")
def t03(spark, sf):
    panel = T.in_study(chain.kept_panel(spark, sf), proxy.CALENDAR)
    panel = panel.filter(F.col("elective_hub_cat").isin("old", "non_hub"))
    return T.assign_treatment_fixed(panel, "old", proxy.CALENDAR).select(
        "PROCODE3", "month", "treated_unit", "post", "intervention"
    )


@query("t04_treatment_staggered", "SELECT PROCODE3, month, hub_start_date, treated_unit, intervention FROM new_inputs")
def t04(spark, sf):
    panel = stage_large(chain.kept_panel(spark, sf), "panel")
    out = T.model_inputs(panel, proxy.unit_lookup(spark, sf), "new", proxy.CALENDAR)
    return out.select("PROCODE3", "month", "hub_start_date", "treated_unit", "intervention")


@query(
    "t05_time_index",
    f"""SELECT PROCODE3, month, row_number() OVER (PARTITION BY PROCODE3 ORDER BY month) AS time,
  CASE WHEN month <= DATE '1997-12-01' THEN datediff('month', DATE '1995-01-01', month) + 1
       ELSE datediff('month', DATE '1999-01-01', month) + 37 END AS calendar_index
FROM activity WHERE {IN_STUDY}""",
)
def t05(spark, sf):
    panel = P.activity_panel(chain.elective(spark, sf), chain.features(spark, sf), proxy.LAST_REFERENCE_YEAR)
    panel = T.in_study(panel, proxy.CALENDAR)
    return T.unit_time_index(panel, proxy.CALENDAR).select("PROCODE3", "month", "time", "calendar_index")


@query("t06_weights", f"SELECT cohort, PROCODE3, time, {_r(['wt_n_activity', 'wt_catchment_cat'])} FROM inputs")
def t06(spark, sf):
    return chain.inputs(spark, sf).select("cohort", "PROCODE3", "time", "wt_n_activity", "wt_catchment_cat")


@query(
    "t07_model_inputs",
    f"""SELECT cohort, PROCODE3, year_month, time, treated_unit, post, intervention, hub_start_date, n_activity,
  {_r([*_COV, 'el_rate', *_MIX, *_RATES, 'hvlc_rate', *_STAYS, 'wt_n_activity', 'wt_catchment_cat'])} FROM inputs""",
)
def t07(spark, sf):
    return chain.inputs(spark, sf).select(
        "cohort", "PROCODE3", "year_month", "time", "treated_unit", "post", "intervention", "hub_start_date",
        "n_activity", *_COV, "el_rate", *_MIX, *_RATES, "hvlc_rate", *_STAYS, "wt_n_activity", "wt_catchment_cat",
    )


# ----------------------------------------------------------------- aggregates

_ELECTIVE_MONTH = "CAST(date_trunc('month', ADMIDATE) AS DATE) AS month"


@query("a01_group_count", f"SELECT PROCODE3, {_ELECTIVE_MONTH}, count(*) AS n FROM elective GROUP BY ALL")
def a01(spark, sf):
    return (
        chain.elective(spark, sf).groupBy("PROCODE3", month_of("ADMIDATE").alias("month")).agg(F.count("*").alias("n"))
    )


@query(
    "a02_first_row_per_group",
    """SELECT order_key, EPIKEY, PROCODE3 FROM episodes
QUALIFY row_number() OVER (PARTITION BY order_key ORDER BY line_order) = 1""",
)
def a02(spark, sf):
    e = proxy.episodes(spark, sf).select("order_key", "line_order", "EPIKEY", "PROCODE3")
    return Rel.first_per_key(e, ["order_key"], ["line_order"]).select("order_key", "EPIKEY", "PROCODE3")


@query(
    "a03_group_min_max",
    "SELECT TOKEN_PERSON_ID, min(EPISTART) AS first_start, max(EPIEND) AS last_end FROM finished GROUP BY TOKEN_PERSON_ID",
)
def a03(spark, sf):
    e = S.finished_episodes(proxy.episodes(spark, sf))
    return e.groupBy("TOKEN_PERSON_ID").agg(F.min("EPISTART").alias("first_start"), F.max("EPIEND").alias("last_end"))


@query(
    "a04_first_per_key",
    """SELECT TOKEN_PERSON_ID, EPISTART, EPIORDER, EPIEND, EPIKEY FROM episodes_with_copies
QUALIFY row_number() OVER (PARTITION BY TOKEN_PERSON_ID, EPISTART, EPIORDER, EPIEND ORDER BY EPIKEY) = 1""",
)
def a04(spark, sf):
    keys = ["TOKEN_PERSON_ID", "EPISTART", "EPIORDER", "EPIEND"]
    e = proxy.episodes(spark, sf, copies=True).select(*keys, "EPIKEY")
    return Rel.first_per_key(e, keys, ["EPIKEY"])


@query("a05_distinct", "SELECT DISTINCT PROCODE3, PROCODET FROM episodes")
def a05(spark, sf):
    return proxy.episodes(spark, sf).select("PROCODE3", "PROCODET").distinct()


@query(
    "a06_conditional_counts",
    f"SELECT PROCODE3, month, {specialty_counts_sql()} FROM panel_spells GROUP BY PROCODE3, month",
)
def a06(spark, sf):
    spells = chain.flagged_spells(spark, sf)
    return spells.groupBy("PROCODE3", month_of("ADMIDATE").alias("month")).agg(*P.specialty_counts())


def _stay_query(name: str, sql_measure: str, measure, where: str = "los >= 0"):
    @query(
        name,
        f"SELECT PROCODE3, month, {rnd(sql_measure, 'value')} FROM plain_spells WHERE {where} GROUP BY PROCODE3, month",
    )
    def run(spark, sf):
        kept = P.with_stay(chain.with_area(spark, sf)).filter(where)
        return kept.groupBy("PROCODE3", "month").agg(measure().alias("value"))

    return run


_stay_query(
    "a07_conditional_mean",
    "avg(CASE WHEN los > 0 THEN least(los, 37) END)",
    lambda: F.avg(F.when(F.col("los") > 0, cap_at("los", 37))),
)
_stay_query(
    "a08_conditional_mean_uncapped",
    "avg(CASE WHEN los > 0 THEN los END)",
    lambda: F.avg(F.when(F.col("los") > 0, F.col("los"))),
)
_stay_query(
    "a09_proportion",
    "count(*) FILTER (WHERE los = 0) / CAST(count(*) AS DOUBLE)",
    lambda: share(F.col("los") == 0),
)
_stay_query(
    "a10_strict_proportion",
    "CASE WHEN count(SEX) = count(*) THEN count(*) FILTER (WHERE SEX = 1) / CAST(count(*) AS DOUBLE) END",
    lambda: strict_share(F.col("SEX") == 1),
)
_stay_query(
    "a11_set_proportion",
    "count(*) FILTER (WHERE imd_decile IN (1, 2)) / CAST(count(*) AS DOUBLE)",
    lambda: share(in_set("imd_decile", [1, 2])),
)


@query("a12_quantile", f"SELECT {rnd('quantile_cont(los, 0.999)', 'q')} FROM plain_spells WHERE los >= 0")
def a12(spark, sf):
    stays = P.with_stay(chain.elective(spark, sf)).filter("los >= 0")
    return Rel.quantile(stays, "los", 0.999)


@query(
    "a13_winsorise",
    f"""SELECT id, los, {rnd('least(los, q)', 'los_new')}
FROM plain_spells, (SELECT quantile_cont(los, 0.95) AS q FROM plain_spells WHERE los >= 0) WHERE los >= 0""",
)
def a13(spark, sf):
    stays = P.with_stay(chain.elective(spark, sf)).filter("los >= 0").select("id", "los")
    cap = Rel.quantile(stays, "los", 0.95)  # one row
    return stays.join(F.broadcast(cap)).select("id", "los", F.least(F.col("los").cast("double"), "q").alias("los_new"))


@query(
    "a14_sum_by_two_keys",
    f"SELECT PROCODE3, time, {rnd('sum(n_activity)', 'var_sum')} FROM old_inputs GROUP BY PROCODE3, time",
)
def a14(spark, sf):
    panel = stage_large(chain.kept_panel(spark, sf), "panel")
    old = T.model_inputs(panel, proxy.unit_lookup(spark, sf), "old", proxy.CALENDAR)
    return old.groupBy("PROCODE3", "time").agg(F.sum("n_activity").cast("double").alias("var_sum"))


@query(
    "a15_attrition",
    """WITH_STEPS SELECT 1 AS step, 'all units' AS label, count(*) AS n_units FROM u
UNION ALL SELECT 2, 'prefix', count(*) FILTER (WHERE a) FROM u
UNION ALL SELECT 3, 'peer list', count(*) FILTER (WHERE a AND b) FROM u
UNION ALL SELECT 4, 'catchment', count(*) FILTER (WHERE a AND b AND c) FROM u
UNION ALL SELECT 5, 'not excluded', count(*) FILTER (WHERE a AND b AND c AND d) FROM u""".replace(
        "WITH_STEPS", ""
    ).replace(
        "FROM u",
        """FROM (SELECT PROCODE3 LIKE 'R%' AS a, PROCODE3 IN (SELECT Procode FROM peer_units) AS b,
    PROCODE3 IN (SELECT trust_code FROM features) AS c,
    PROCODE3 NOT IN (SELECT PROCODE3 FROM exclude_units) AS d
  FROM (SELECT DISTINCT PROCODE3 FROM activity))""",
    ),
)
def a15(spark, sf):
    panel = P.activity_panel(chain.elective(spark, sf), chain.features(spark, sf), proxy.LAST_REFERENCE_YEAR)
    return P.attrition(panel, proxy.peer_units(spark, sf), chain.features(spark, sf), proxy.exclude_units(spark, sf))


@query("a16_global_max", "SELECT max(spell_id) AS max_spell_id, count(*) AS n FROM spells")
def a16(spark, sf):
    spells = S.build_spells(proxy.spell_inputs(spark, sf))
    return spells.agg(F.max("spell_id").alias("max_spell_id"), F.count("*").alias("n"))


@query(
    "a17_cross_tabulation",
    """SELECT MAINSPEF, TRETSPEF, """
    + ", ".join(
        f"count(*) FILTER (WHERE ADMIMETH = '{m}') AS method_{m}" for m in ("11", "12", "13", "21", "81", "2B")
    )
    + " FROM finished GROUP BY MAINSPEF, TRETSPEF",
)
def a17(spark, sf):
    methods = ["11", "12", "13", "21", "81", "2B"]
    e = S.finished_episodes(proxy.episodes(spark, sf)).select("MAINSPEF", "TRETSPEF", "ADMIMETH")
    wide = e.groupBy("MAINSPEF", "TRETSPEF").pivot("ADMIMETH", methods).agg(F.count(F.lit(1)))
    return wide.select(
        "MAINSPEF", "TRETSPEF", *[F.coalesce(F.col(f"`{m}`"), F.lit(0)).alias(f"method_{m}") for m in methods]
    )


@query(
    "a18_margin_means",
    f"""SELECT 'unit' AS margin, PROCODE3 AS key, {rnd('avg(el_rate)', 'mean')}, {rnd('sum(n_activity)', 'total')}
FROM activity GROUP BY PROCODE3
UNION ALL SELECT 'month', CAST(month AS VARCHAR), {rnd('avg(el_rate)', 'mean')}, {rnd('sum(n_activity)', 'total')}
FROM activity GROUP BY month""",
)
def a18(spark, sf):
    panel = stage(
        P.activity_panel(chain.elective(spark, sf), chain.features(spark, sf), proxy.LAST_REFERENCE_YEAR), "activity"
    )

    def margin(name: str, col: str):
        return panel.groupBy(F.lit(name).alias("margin"), F.col(col).cast("string").alias("key")).agg(
            F.avg("el_rate").alias("mean"), F.sum("n_activity").cast("double").alias("total")
        )

    return margin("unit", "PROCODE3").unionByName(margin("month", "month"))


@query(
    "a19_mean_of_means",
    f"""SELECT {rnd('avg(m)', 'mean_of_means')}, {rnd('sum(s) / sum(n)', 'pooled_mean')} FROM (
  SELECT avg(el_rate) AS m, sum(el_rate) AS s, count(el_rate) AS n FROM activity GROUP BY month)""",
)
def a19(spark, sf):
    panel = P.activity_panel(chain.elective(spark, sf), chain.features(spark, sf), proxy.LAST_REFERENCE_YEAR)
    by_month = panel.groupBy("month").agg(
        F.avg("el_rate").alias("m"), F.sum("el_rate").alias("s"), F.count("el_rate").alias("n")
    )
    return by_month.agg(F.avg("m").alias("mean_of_means"), (F.sum("s") / F.sum("n")).alias("pooled_mean"))


@query(
    "a20_sample_sd",
    f"SELECT PROCODE3, {rnd('stddev_samp(el_rate)', 'sd')}, count(*) AS n FROM activity GROUP BY PROCODE3",
)
def a20(spark, sf):
    panel = P.activity_panel(chain.elective(spark, sf), chain.features(spark, sf), proxy.LAST_REFERENCE_YEAR)
    return panel.groupBy("PROCODE3").agg(F.stddev_samp("el_rate").alias("sd"), F.count("*").alias("n"))


@query(
    "a21_occurrence_count",
    """SELECT max(num) AS max_num, count(*) FILTER (WHERE num = 1) AS n_ids, sum(num)::BIGINT AS sum_num FROM (
  SELECT row_number() OVER (PARTITION BY id ORDER BY ord, code) AS num FROM px_long)""",
)
def a21(spark, sf):
    numbered = C.number_codes(proxy.px_long(spark, sf))
    return numbered.agg(
        F.max("num").alias("max_num"), F.count_if(F.col("num") == 1).alias("n_ids"), F.sum("num").alias("sum_num")
    )
