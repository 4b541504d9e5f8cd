"""Queries: episodes to spells, codes and pathway flags (D01-D13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spellpanel.functions.text import concat_key
from spellpanel.operators import codes as C
from spellpanel.operators import spells as S
from spellpanel.operators.recipes import RECIPES, SPECIALTIES
from spellpanel.operators.rules import flag_one
from spellpanel.plans import chain
from spellpanel.plans.registry import query
from spellpanel.plans.sql import PATHWAYS
from spellpanel.session import stage_large
from spellpanel.sources import proxy
from spellpanel.sources.tables import ATTRIBUTE_COLUMNS, EPISODE_COLUMNS

_SPELL = "TOKEN_PERSON_ID, PROCODET, ADMIDATE, disdate_for_spell"


@query("d01_transfer_flag", "SELECT EPIKEY, transit_nhsd FROM flagged")
def d01(spark, sf):
    return chain.flagged(spark, sf).select("EPIKEY", "transit_nhsd")


@query(
    "d02_dedup_episodes",
    """SELECT EPIKEY, TOKEN_PERSON_ID, EPISTART, EPIORDER, EPIEND, s.transit_nhsd FROM (
  SELECT *, CASE
    WHEN (NOT (ADMISORC IN ('51', '87')) OR NOT (ADMIMETH IN ('81', '2B')))
      AND coalesce(DISDEST IN ('52', '84'), false) THEN 1
    WHEN (ADMISORC IN ('51', '87') OR ADMIMETH IN ('81', '2B')) AND coalesce(DISDEST IN ('52', '84'), false) THEN 2
    WHEN (ADMISORC IN ('51', '87') OR ADMIMETH IN ('81', '2B')) AND NOT coalesce(DISDEST IN ('52', '84'), false) THEN 3
    ELSE 0 END AS transit_nhsd
  FROM episodes_with_copies WHERE EPISTAT = 3 AND ADMIDATE IS NOT NULL) s
QUALIFY row_number() OVER (PARTITION BY TOKEN_PERSON_ID, EPISTART, EPIORDER, EPIEND, s.transit_nhsd ORDER BY EPIKEY) = 1""",
)
def d02(spark, sf):
    episodes = proxy.episodes(spark, sf, copies=True).select(*EPISODE_COLUMNS)
    unique = S.dedup_episodes(S.transfer_flag(S.finished_episodes(episodes)))
    return unique.select("EPIKEY", "TOKEN_PERSON_ID", "EPISTART", "EPIORDER", "EPIEND", "transit_nhsd")


@query("d03_clean_discharge", "SELECT EPIKEY, DISDATE, disdate_for_spell FROM filled")
def d03(spark, sf):
    unique = S.dedup_episodes(chain.flagged(spark, sf))
    return S.clean_discharge(unique).select("EPIKEY", "DISDATE", "disdate_for_spell")


@query("d04_assign_spells", "SELECT EPIKEY, spell_id FROM numbered")
def d04(spark, sf):
    return S.assign_spells(chain.prepared(spark, sf)).select("EPIKEY", "spell_id")


@query("d05_spell_summary", "SELECT spell_id, EPIKEY, spellstartdate, spellenddate FROM spells")
def d05(spark, sf):
    episodes = chain.prepared(spark, sf).select(*dict.fromkeys([*S.SPELL_KEY, *S.SPELL_ORDER]))
    within = [c for c in S.SPELL_ORDER if c not in S.SPELL_KEY]
    numbered = stage_large(S.assign_spells(episodes).select("spell_id", *within), "numbered")
    return S.spell_summary(numbered).select("spell_id", "EPIKEY", "spellstartdate", "spellenddate")


@query(
    "d06_build_spells",
    """SELECT spell_id, TOKEN_PERSON_ID, PROCODET, ADMIDATE, DISDATE, disdate_for_spell, EPIKEY, EPISTART, EPIEND,
  transit_nhsd, spellstartdate, spellenddate, admmnth, admmyr FROM spells""",
)
def d06(spark, sf):
    spells = S.build_spells(proxy.spell_inputs(spark, sf))
    return spells.select(
        "spell_id", "TOKEN_PERSON_ID", "PROCODET", "ADMIDATE", "DISDATE", "disdate_for_spell", "EPIKEY",
        "EPISTART", "EPIEND", "transit_nhsd", "spellstartdate", "spellenddate", "admmnth", "admmyr",
    )


@query(
    "d07_enrich_spells",
    "SELECT id, EPIKEY, PROCODE3, SEX, STARTAGE, LSOA11, MAINSPEF, TRETSPEF, OPERTN_01, DIAG_01 FROM spells",
)
def d07(spark, sf):
    spells = S.build_spells(proxy.spell_inputs(spark, sf), with_ids=False)
    attributes = proxy.episodes(spark, sf).select(*ATTRIBUTE_COLUMNS)
    return S.enrich_spells(spells, attributes).select(
        "id", "EPIKEY", "PROCODE3", "SEX", "STARTAGE", "LSOA11", "MAINSPEF", "TRETSPEF", "OPERTN_01", "DIAG_01"
    )


@query("d08_elective_adult", "SELECT id, ADMIMETH, STARTAGE FROM elective")
def d08(spark, sf):
    return chain.elective(spark, sf).select("id", "ADMIMETH", "STARTAGE")


@query("d09_attach_codes", "SELECT id, tnrdiagall, tnrprocall FROM coded")
def d09(spark, sf):
    return chain.coded(spark, sf).select("id", "tnrdiagall", "tnrprocall")


@query(
    "d10_filter_by_code_list",
    """SELECT id, tnrprocall FROM coded
WHERE regexp_matches(tnrprocall, (SELECT string_agg(intermediate, '|') FROM code_list))""",
)
def d10(spark, sf):
    return C.filter_by_code_list(chain.coded(spark, sf), proxy.code_list(spark, sf)).select("id", "tnrprocall")


@query(
    "d11_flag_recipes",
    f"SELECT id, {', '.join(PATHWAYS)} FROM pathways",
)
def d11(spark, sf):
    return chain.pathways(spark, sf).select("id", *[r.name for r in RECIPES])


def _pathway(recipe):
    @query(
        f"d12_{recipe.name}",
        f"SELECT PROCODE3, {recipe.name}, count(*) AS n FROM pathways GROUP BY PROCODE3, {recipe.name}",
    )
    def run(spark, sf):
        flagged = flag_one(
            proxy.coded_records(spark, sf), proxy.dx_long(spark, sf), proxy.px_long(spark, sf), recipe
        )
        return flagged.groupBy("PROCODE3", recipe.name).agg(F.count("*").alias("n"))

    return run


for _recipe in RECIPES:
    _pathway(_recipe)


@query("d13_specialty_flags", f"SELECT id, {', '.join(SPECIALTIES)}, hvlc FROM specialties")
def d13(spark, sf):
    return chain.pathways(spark, sf).select("id", *SPECIALTIES, "hvlc")


@query(
    "p11_composite_key",
    "SELECT spell_id AS apc_order_id, TOKEN_PERSON_ID || '_' || EPIKEY AS id FROM spells",
)
def p11(spark, sf):
    spells = S.build_spells(proxy.spell_inputs(spark, sf))
    return spells.select(
        F.col("spell_id").alias("apc_order_id"),
        concat_key(F.col("TOKEN_PERSON_ID"), F.col("EPIKEY")).alias("id"),
    )
