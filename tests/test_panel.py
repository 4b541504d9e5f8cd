import datetime as dt

import pytest
from pyspark.sql import functions as F

from spellpanel.operators import panel as P
from spellpanel.operators import treatment as T
from spellpanel.operators.recipes import SPECIALTIES
from spellpanel.plans import chain
from spellpanel.plans.registry import rounded
from spellpanel.session import stage
from spellpanel.sources import proxy


@pytest.fixture(scope="module")
def spells(spark, small):
    return stage(chain.flagged_spells(spark, small), "test_spells")


@pytest.fixture(scope="module")
def features(spark, small):
    return stage(chain.features(spark, small), "test_features")


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(b.columns) == cols
    a, b = rounded(a.select(cols)), rounded(b.select(cols))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_single_pass_equals_join_cascade(spells, features):
    args = (features, proxy.LAST_REFERENCE_YEAR, "1996-03-01")
    same(P.final_panel(spells, *args), P.final_panel_by_joins(spells, *args))


def test_overall_panel_is_a_part_of_the_final_one(spells, features):
    args = (features, proxy.LAST_REFERENCE_YEAR, "1995-01-01")
    overall = P.overall_panel(spells, *args)
    same(overall, P.final_panel(spells, *args).select(*overall.columns))


def tiny(spark, rows):
    """Spells of one unit and month: (stay days, flags set)."""
    data = [
        ("R01", dt.date(2019, 5, 2), None if los is None else dt.date(2019, 5, 2) + dt.timedelta(days=los),
         sex, 70, "A", 1, 3, *[s in flags for s in SPECIALTIES], bool(flags))
        for los, sex, flags in rows
    ]
    spec = ", ".join(f"{s} boolean" for s in SPECIALTIES)
    return spark.createDataFrame(
        data,
        "PROCODE3 string, ADMIDATE date, DISDATE date, SEX int, STARTAGE int, ETHNOS string, imd_decile int, "
        f"nr_elix_h36 int, {spec}, hvlc boolean",
    )


def test_measures_by_hand(spark):
    df = tiny(spark, [(0, 1, {"ort"}), (50, 2, {"ent"}), (2, 1, {"ort"}), (-1, 1, {"gs"}), (None, None, set())])
    pop = spark.createDataFrame([("R01", 2019, 500.0, 0.5, 0.8, 0.2)],
                                "trust_code string, year int, catchment_cat double, sex_male_pct double, white_pct double, age_65_plus_pct double")
    r = P.final_panel(df, pop).first()
    assert (r["n_activity"], r["el_rate"], r["year_month"]) == (5, 10.0, "2019_05")
    assert r["los_avg"] == (37 + 2) / 2 and r["dc"] == pytest.approx(1 / 3)
    assert r["sex_male_pct_ec"] == pytest.approx(2 / 3)  # the missing sex has no known stay
    assert r["los_avg_ent"] == 50.0  # published without the cap
    assert (r["n_activity_ort"], r["n_activity_gs"], r["n_activity_uro"]) == (2, 1, None)
    assert (r["n_activity_hvlc"], r["hvlc_rate"]) == (4, 8.0)
    assert r["los_avg_gs"] is None and r["dc_prop_gs"] is None and r["los_avg_hvlc"] == (37 + 2) / 2
    assert P.final_panel(df, pop, uncapped=()).first()["los_avg_ent"] == 37.0


def test_missing_case_mix_propagates(spark):
    df = tiny(spark, [(1, 1, set()), (2, None, set())])
    r = P.stay_panel(df).first()
    assert r["sex_male_pct_ec"] is None and r["white_pct_ec"] == 1.0 and r["quintile_1_pct_ec"] == 1.0
    assert P.stay_panel(df, "2019-06-01").isEmpty()


def test_later_years_use_the_last_reference_year(spark):
    pop = spark.createDataFrame([("R01", 2020, 100.0)], "trust_code string, year int, catchment_cat double")
    panel = spark.createDataFrame([("R01", dt.date(2022, 3, 1)), ("R01", dt.date(2019, 3, 1))], "PROCODE3 string, month date")
    got = {r["month"].year: r["catchment_cat"] for r in P.attach_catchment(panel, pop).collect()}
    assert got == {2022: 100.0, 2019: None}


def test_exclusions_agree_with_attrition(spark, small, spells, features):
    panel = P.activity_panel(spells, features, proxy.LAST_REFERENCE_YEAR)
    args = (proxy.peer_units(spark, small), features, proxy.exclude_units(spark, small))
    steps = [r["n_units"] for r in P.attrition(panel, *args).orderBy("step").collect()]
    kept = P.apply_exclusions(panel, *args)
    assert steps == sorted(steps, reverse=True) and steps[0] > steps[-1]
    assert kept.select("PROCODE3").distinct().count() == steps[-1]
    assert kept.groupBy("PROCODE3", "month").count().filter("count > 1").isEmpty()


def test_ambiguous_lookups_are_refused(spark):
    panel = spark.createDataFrame([("R01",)], "PROCODE3 string")
    twice = spark.createDataFrame([("R01", "old"), ("R01", "new")], "trust_code string, elective_hub_cat string")
    with pytest.raises(ValueError):
        P.attach_unit_category(panel, twice)


def months(spark, rows):
    return spark.createDataFrame(
        [(u, dt.date.fromisoformat(m), c) for u, m, c in rows], "PROCODE3 string, month date, elective_hub_cat string"
    )


def test_fixed_treatment(spark):
    df = months(spark, [("a", "2021-04-01", "old"), ("a", "2020-03-01", "old"), ("a", "2020-08-01", "old"), ("b", "2022-01-01", "non_hub")])
    got = {(r["PROCODE3"], str(r["month"])): (r["treated_unit"], r["post"], r["intervention"])
           for r in T.assign_treatment_fixed(df).collect()}
    assert got == {("a", "2021-04-01"): (1, 1, 1), ("a", "2020-03-01"): (1, 0, 0),
                   ("a", "2020-08-01"): (1, None, None), ("b", "2022-01-01"): (0, 1, 0)}


def test_staggered_treatment(spark):
    df = months(spark, [("a", "2021-05-01", "new"), ("a", "2021-04-01", "new"), ("b", "2021-05-01", "new"), ("c", "2021-05-01", "non_hub")])
    df = df.withColumn("hub_start_date", F.when(F.col("PROCODE3") == "a", F.lit("2021-05-01").cast("date")))
    got = {(r["PROCODE3"], str(r["month"])): r["intervention"] for r in T.assign_treatment_staggered(df).collect()}
    assert got == {("a", "2021-05-01"): 1, ("a", "2021-04-01"): 0, ("b", "2021-05-01"): None, ("c", "2021-05-01"): 0}


def test_earliest_start_and_unreadable_dates(spark):
    lookup = spark.createDataFrame(
        [("a", "01/05/2021"), ("a", "01/04/2021"), ("b", "soon"), ("b", "01/06/2021"), ("c", None)],
        "trust_code string, hub_start_date string",
    )
    loose = {r["trust_code"]: str(r["hub_start_date"]) for r in T.earliest_start(lookup).collect()}
    strict = {r["trust_code"]: str(r["hub_start_date"]) for r in T.earliest_start(lookup, strict=True).collect()}
    assert loose == {"a": "2021-04-01", "b": "2021-06-01"} and strict == {"a": "2021-04-01"}


def test_time_index_drifts_after_a_gap(spark):
    df = months(spark, [("a", "2018-04-01", "old"), ("a", "2018-06-01", "old"), ("a", "2021-04-01", "old")])
    rows = T.unit_time_index(df).orderBy("month").collect()
    assert [r["time"] for r in rows] == [1, 2, 3] and [r["calendar_index"] for r in rows] == [1, 3, 25]


def test_weights_sum_to_one(spark, small):
    inputs = chain.inputs(spark, small)
    sums = inputs.groupBy("cohort", "treated_unit", "time").agg(F.sum("wt_n_activity").alias("s"))
    assert sums.filter("abs(s - 1) > 1e-9").isEmpty()
