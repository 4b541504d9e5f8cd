"""The engine's steps chained over the test tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spellpanel.operators import effects as E
from spellpanel.operators import panel as P
from spellpanel.operators import spells as S
from spellpanel.operators.codes import attach_codes
from spellpanel.operators.recipes import RECIPES, SPECIALTIES
from spellpanel.operators.relational import MAX_ROWS_PER_KEY, SLICE, sliced, slices
from spellpanel.operators.rules import flag_recipes_long
from spellpanel.operators.treatment import model_inputs
from spellpanel.session import drop_stages, stage, stage_large, staged_large
from spellpanel.sources import proxy
from spellpanel.sources.tables import EPISODE_COLUMNS

ATTRIBUTES = [
    "PROCODE3", "SEX", "STARTAGE", "ETHNOS", "LSOA11", "MAINSPEF", "TRETSPEF", "OPERTN_01", "DIAG_01",
    "nr_elix_h36",
]
# What the panel reads of a spell; nothing else travels through the shuffle.
PANEL_COLUMNS = [c for c in EPISODE_COLUMNS if c not in ("SUSRECID", "EPIDUR")] + ATTRIBUTES
# What flags and panel measures read of an elective spell.
FLAGGED_COLUMNS = ["id", "ADMIDATE", "DISDATE", *ATTRIBUTES, "imd_decile"]
YEARS = list(range(1995, 2000))
STAY_FROM = "1995-01-01"
# Columns of rate, mean stay and day-case ratio of each modelled activity; spinal pathways are not modelled.
MEASURES = {
    "elect": ("el_rate", "los_avg", "dc"),
    "hvlc": ("hvlc_rate", "los_avg_hvlc", "dc_prop_hvlc"),
    **{s: (f"rate_{s}", f"los_avg_{s}", f"dc_prop_{s}") for s in SPECIALTIES if s != "spn"},
}
RATE_COVARIATES = ("catchment_cat", "sex_male_pct", "white_pct", "age_65_plus_pct")
STAY_COVARIATES = (
    "catchment_cat", "sex_male_pct_ec", "white_pct_ec", "age_65_plus_pct_ec", "quintile_1_pct_ec", "comorb_pct",
)


def outcomes(with_covariates: bool = False) -> list[E.Outcome]:
    """The modelled outcomes of a cohort: eight activities by three measures."""
    rate, stay = (RATE_COVARIATES, STAY_COVARIATES) if with_covariates else ((), ())
    return [
        o
        for activity, (r, los, dc) in MEASURES.items()
        for o in (
            E.Outcome(activity, "rate", r, "wt_catchment_cat", rate),
            E.Outcome(activity, "los.ip_avg", los, "wt_n_activity", stay),
            E.Outcome(activity, "los.dc_ratio", dc, "wt_n_activity", stay),
        )
    ]


OUTCOMES = outcomes()


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    """Finished episodes with their transfer flag."""
    return S.transfer_flag(S.finished_episodes(proxy.episodes(spark, sf).select(*EPISODE_COLUMNS)))


def by_person(spark: SparkSession, sf: str, columns: list[str]) -> tuple[DataFrame, int | None]:
    """Episodes laid out by person, unless some person is too large for a task; and the bound left to check."""
    episodes = proxy.episodes(spark, sf).select(*columns)
    if S.crowded(episodes):
        return episodes, MAX_ROWS_PER_KEY
    return proxy.episodes(spark, sf, by=S.PERSON).select(*columns), None


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return S.prepared_episodes(*by_person(spark, sf, EPISODE_COLUMNS))


def elective(spark: SparkSession, sf: str) -> DataFrame:
    """Elective adult spells with the attributes of their first episode."""
    episodes, bound = by_person(spark, sf, PANEL_COLUMNS)
    spells = S.restrict_elective_adult(S.build_spells(episodes, with_ids=False, max_rows_per_person=bound))
    return spells.withColumn("id", F.concat_ws("_", "TOKEN_PERSON_ID", "EPIKEY"))


# Carried attributes that the test tables lack, as expressions that both engines read.
CARRIED = {
    "ADMINCAT": "'01'", "DISMETH": "'1'", "OPDATE_01": "EPISTART", "INTMANIG": "'1'", "DUPLICATE": "'0'",
    "CLASSPAT": "CASE WHEN EPIDUR = 0 THEN '2' ELSE '1' END", "ETHNIC5": "substr(ETHNOS, 1, 1)",
    "STARTAGE_CALC": "CAST(STARTAGE AS DOUBLE)", "GPPRAC": "concat('P', LSOA11)", "ELECDATE": "ADMIDATE",
    "ENCRYPTED_HESID": "md5(TOKEN_PERSON_ID)", "apc_order_id": "CAST(EPIORDER AS STRING)",
}


def finished_spells(spark: SparkSession, sf: str) -> DataFrame:
    """Spells with ids, the attributes of their first episode and its code lists: the whole chain of the spell table.

    The wide rows meet their attributes and their codes slice by slice, and a table goes once it is used.
    """
    codes = sliced(proxy.secondary_codes(spark, sf), "id")
    made = _enriched(spark, sf)
    with staged_large(made, "enriched", SLICE, spark) as spells, staged_large(codes, "codes", SLICE) as long:
        parts = (attach_codes(s, proxy.dx_rows(c), proxy.px_rows(c)) for s, c in slices(spells, long))
        return stage_large(parts, "finished", spark)


def _enriched(spark: SparkSession, sf: str) -> Iterator[DataFrame]:
    """Spells with ids and the attributes of their first episode, in parts, sliced by the spell's key."""
    episodes, bound = by_person(spark, sf, EPISODE_COLUMNS)
    spells = S.build_spells(episodes, max_rows_per_person=bound)
    carried = [F.expr(x).alias(c) for c, x in CARRIED.items()]
    attributes = proxy.episodes(spark, sf).select("SUSRECID", *ATTRIBUTES, *carried)
    with staged_large(sliced(spells, "SUSRECID"), "spells", SLICE) as some:
        drop_stages(spells)
        with staged_large(sliced(attributes, "SUSRECID"), "attributes", SLICE) as their:
            for s, a in slices(some, their):
                yield sliced(S.enrich_spells(s, a), "id")


def with_area(spark: SparkSession, sf: str) -> DataFrame:
    return P.attach_deprivation(elective(spark, sf), proxy.area_deprivation(spark, sf))


def flagged_spells(spark: SparkSession, sf: str) -> DataFrame:
    """Elective spells with area decile and specialty flags.

    The spells are staged, so that the shuffles they are built by are gone before the code tables move.
    """
    spells = stage_large(with_area(spark, sf).select(*FLAGGED_COLUMNS), "spells")
    return flag_recipes_long(spells, proxy.dx_long(spark, sf), proxy.px_long(spark, sf), RECIPES)


def coded(spark: SparkSession, sf: str) -> DataFrame:
    return attach_codes(
        proxy.coded_records(spark, sf), proxy.dx_long(spark, sf), proxy.px_long(spark, sf)
    )


def pathways(spark: SparkSession, sf: str) -> DataFrame:
    return flag_recipes_long(
        proxy.coded_records(spark, sf), proxy.dx_long(spark, sf), proxy.px_long(spark, sf), RECIPES, keep_pathways=True
    )


def features(spark: SparkSession, sf: str) -> DataFrame:
    return P.catchment_features(proxy.catchment(spark, sf), YEARS)


def overall_panel(spark: SparkSession, sf: str) -> DataFrame:
    return P.overall_panel(
        with_area(spark, sf), features(spark, sf), proxy.LAST_REFERENCE_YEAR, STAY_FROM
    )


def kept_panel(spark: SparkSession, sf: str) -> DataFrame:
    whole = P.final_panel(flagged_spells(spark, sf), features(spark, sf), proxy.LAST_REFERENCE_YEAR, STAY_FROM)
    kept = P.apply_exclusions(
        whole, proxy.peer_units(spark, sf), features(spark, sf), proxy.exclude_units(spark, sf)
    )
    return P.attach_unit_category(kept, proxy.unit_lookup(spark, sf))


def inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Model inputs of both cohorts; the panel is staged because both read it."""
    panel = stage_large(kept_panel(spark, sf), "panel")
    lookup = proxy.unit_lookup(spark, sf)
    old = model_inputs(panel, lookup, "old", proxy.CALENDAR)
    return old.unionByName(model_inputs(panel, lookup, "new", proxy.CALENDAR))


def cells(spark: SparkSession, sf: str, outcomes=None) -> DataFrame:
    return E.model_cells(inputs(spark, sf), outcomes or OUTCOMES)


def eligible(spark: SparkSession, sf: str, outcomes=None) -> DataFrame:
    """Cells of the models, staged: every estimator step reads them."""
    return stage(E.eligible_cells(cells(spark, sf, outcomes)), "eligible")


def fit(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Eligible cells and their two-way fixed-effects fit."""
    kept = eligible(spark, sf)
    return kept, {name: stage(df, name) for name, df in E.did_counterfactual(kept).items()}


def repeatable_draws(fit_cells: DataFrame, draws: int = 20) -> DataFrame:
    """Draws made by a formula, for comparison with SQL."""
    number = F.substring("unit", 2, 2).cast("int")
    t, d = F.col("time"), F.col("draw")
    noise = (t * 31 + d * 17 + number * 7 + t * d) % 101 - 50
    return fit_cells.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).select(
        "model", "unit", "time", "draw", (F.col("eff") + F.lit(0.01) * noise).alias("eff")
    )
