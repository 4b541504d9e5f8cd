"""Shared table expressions of the SQL twins, written for DuckDB.

They restate the proxies and each pipeline step in SQL, independently of the
DataFrame code; only fixed code lists are shared.
"""

from __future__ import annotations

import re

from spellpanel.functions.text import expand_codes
from spellpanel.operators import recipes as R
from spellpanel.sources.proxy import DIAGNOSES, PROCEDURES


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def rnd(expr: str, name: str) -> str:
    """Rounded double without a negative zero."""
    return f"round(round(CAST({expr} AS DOUBLE), 8), 6) + CAST(0 AS DOUBLE) AS {name}"


def _pick(index: str, values) -> str:
    return f"([{quoted(values)}])[1 + CAST({index} AS INT)]"


def isin(col: str, text: str) -> str:
    return f"coalesce({col} IN ({quoted(expand_codes(text))}), false)"


def has(col: str, text: str) -> str:
    return f"coalesce(regexp_matches({col}, '{'|'.join(expand_codes(text))}'), false)"


_URO = "(main = '101' OR coalesce(treat IN ('101', '211'), false))"
_ENT = "(main = '120' OR coalesce(treat IN ('120', '215'), false))"
_GYN = "(coalesce(main IN ('500', '502'), false) OR coalesce(treat IN ('502', '503'), false))"
_NOT_HN = f"NOT {has('procs', R.HEAD_NECK_CANCER)}"
_NOT_GC = f"NOT {has('diags', R.GYNAE_CANCER)}"
_DECOMP = has("procs", R.LUMBAR_DECOMPRESSION)
_EXPLORE = f"({has('procs', R.LUMBAR_EXPLORATION)} AND {has('procs', R.LUMBAR_SITES)})"

PATHWAYS = {
    "ort_aclr": f"{isin('prim', 'W723 W742 W752 W748 W758 W841 W842')} AND {has('procs', 'Z845 Z846')}",
    "ort_thr": f"({isin('prim', 'W371 W379 W381 W389 W931 W939 W391 W399 W941 W949 W951 W959')}"
    f" OR ({isin('prim', 'W521 W529 W531 W539 W541 W549')} AND {has('procs', 'Z843')}))"
    f" AND NOT {has('procs', 'W05 Y713 Y716 Y717')} AND NOT {has('diags', 'C402')}",
    "ort_tkr": f"{isin('prim', 'O181 O189 W401 W409 W411 W419 W421 W429 O188 W408 W418 W428')}"
    f" AND NOT {has('procs', 'Y713 Y716 Y717 W05 Y031 Y032 Y033 Y034 Y035 Y036 Y037 Y038 Y039')}"
    f" AND NOT {has('diags', 'M932 M939 Q774')}"
    f" AND NOT {isin('pdiag', 'C400 C401 C402 C403 C408 C409 C492')}",
    "ort_ukr": f"prim = 'W581' AND {has('procs', 'Z845 Z846 Z132')}",
    "ort_bs": has("procs", "W791 W792 W151 W152 W153"),
    "ort_tsa": f"({isin('prim', 'W781 T791 O291 T794')} AND {has('procs', 'Y767')})"
    f" OR (prim = 'W844' AND {has('procs', 'Z682 Z812 Z813 Z814 Z891')})"
    f" OR ({isin('prim', 'T645 T702')} AND {has('procs', 'Z544')} AND {has('procs', 'Y767')})"
    " OR (prim = 'W784' AND "
    f"{has('procs', 'Z812 Z813 Z814 Z891 Z681 Z682 Z683 Z684 Z685 Z688 Z689 Z691 Z693')})",
    "opht_lccs": f"{has('procs', 'C71 C73 C74')} AND {has('procs', 'C751 C754 C758 C759')}"
    f" AND NOT {has('procs', R.EYE_EXCLUDED_PROCS)} AND NOT {has('diags', R.EYE_EXCLUDED_DIAGS)}",
    "gs_lc": f"{isin('prim', 'J181 J183')} AND {has('procs', 'Y752')} AND NOT {has('procs', 'J182')}",
    "gs_pihr": f"{has('procs', 'T201 T202 T203 T204 T208 T209')} AND NOT {has('procs', 'Y713 Y716 Y717')}"
    f" AND NOT {has('diags', 'C56 C570')}",
    "gs_puh": f"{isin('prim', 'T240-T243 T245-T249')} AND prim <> 'T244'",
    "uro_boo": f"{_URO} AND {isin('prim', 'M651 M653-M656 M658-M659 M662 M681 M683 M688-M689')}",
    "uro_btr": f"{_URO} AND prim = 'M421'",
    "uro_cp": f"{_URO} AND {isin('prim', 'M451-M455 M458-M459 M441-M442 M763-M764 M792 M814')}",
    "uro_usm": f"{_URO} AND "
    + isin("prim", "M071-M072 M078-M079 M271-M275 M277-M279 M306 M281-M283 M288-M289 M292-M293 M295"),
    "uro_mpss": f"{_URO} AND "
    + isin(
        "prim",
        "N303 N284 N111-N116 N118-N119 N132 N321 N081-N084 N088-N089 N091-N094 N098-N099 N191 "
        "N198-N199 M731 T193",
    ),
    "ent_ess": f"{_ENT} AND {isin('prim', 'E132-E133 E142-E143 E081 E148')} AND {has('procs', 'Y761')} AND {_NOT_HN}",
    "ent_tons": f"{_ENT} AND {isin('prim', 'F341-F345 F347-F349')} AND NOT {has('procs', 'D345 F346')} AND {_NOT_HN}",
    "ent_mir": f"{_ENT} AND {isin('prim', 'D141-D142 D148-D149')} AND {_NOT_HN}",
    "ent_sts": f"{_ENT} AND {isin('prim', 'E036 E041-E049')} AND {_NOT_HN}",
    "ent_srp": f"{_ENT} AND {isin('prim', 'E023-E024 E073')} AND {_NOT_HN}",
    "gm_ol": f"{_GYN} AND ({isin('prim', 'Q201 Q362 Q381-Q382 Q388-Q389 Q413 Q521-Q522')}"
    " OR coalesce(regexp_matches(prim, '^Q39|Q49|Q50|T42'), false))"
    f" AND NOT {has('procs', 'Q383')} AND {_NOT_GC}",
    "gm_lh": f"{_GYN} AND {has('procs', 'Q07 Q08')} AND {has('procs', 'Y751 Y752')} AND {_NOT_GC}",
    "gm_ea": f"{_GYN} AND {has('procs', 'Q162 Q163 Q164 Q165 Q166 Q176 Q177')} AND {_NOT_GC}",
    "gm_hs": f"{_GYN} AND ({isin('prim', 'Q161 Q167-Q169 Q171-Q175 Q178-Q179')}"
    " OR coalesce(regexp_matches(prim, '^Q18'), false))"
    f" AND NOT {has('procs', 'Y751 Y752 Y755 Q413')} AND {_NOT_GC}",
    "gm_vh": f"{_GYN} AND {has('procs', 'Q08 P22 P23 P24')} AND {_NOT_GC}",
    "spn_ld": f"({_DECOMP} OR {_EXPLORE}) AND NOT {has('procs', R.LUMBAR_REVISION)}"
    f" AND NOT {has('procs', R.LUMBAR_FUSION)}",
    "spn_pfs1": f"{_DECOMP} OR {_EXPLORE} AND NOT {has('procs', R.LUMBAR_REVISION)}"
    f" AND {has('procs', R.LUMBAR_FUSION)}",
    "spn_csd": f"({has('procs', 'V221 V222 V294 V295 V361')} OR ({has('procs', 'V368 V369')}"
    f" AND {has('procs', 'Z673 Z991')})) AND NOT {has('procs', R.CERVICAL_EXCLUDED)}",
    "spn_lmbb": "prim = 'V544'",
    "spn_lnrb": f"{isin('prim', 'A521-A522 A528-A529 A577')} OR prim = 'A735' AND {has('procs', 'Z07')}",
    "spn_pfs2": f"{has('procs', R.LUMBAR_FUSION)} AND NOT {has('procs', R.FUSION_REVISION)}",
}


def _flag_columns() -> str:
    cols = [f"({rule}) AS {name}" for name, rule in PATHWAYS.items()]
    return ",\n  ".join(cols)


def _specialty_columns() -> str:
    out = []
    for s in R.SPECIALTIES:
        out.append("(" + " OR ".join(n for n in PATHWAYS if n.split("_")[0] == s) + f") AS {s}")
    return ", ".join(out)


_ANY = " OR ".join(R.SPECIALTIES)
_SPELL_ORDER = (
    "EPISTART ASC NULLS LAST, EPIORDER ASC NULLS LAST, EPIEND ASC NULLS LAST, transit_nhsd, "
    "disdate_for_spell ASC NULLS LAST, PROCODET ASC NULLS LAST, EPIKEY"
)
_SPELL_KEY = "TOKEN_PERSON_ID, PROCODET, ADMIDATE, disdate_for_spell"
_EPISODE_KEY = "TOKEN_PERSON_ID, EPISTART, EPIORDER, EPIEND, transit_nhsd"
_TRANSFER = "('49', '50', '51', '52', '53', '87')"
_LEAVES = "('49', '50', '51', '52', '53', '84', '87')"

# Months of the study calendar used with the proxies, as a condition on a date.
IN_STUDY = (
    "((month BETWEEN DATE '1995-01-01' AND DATE '1997-12-01') OR "
    "(month BETWEEN DATE '1999-01-01' AND DATE '2001-07-01'))"
)


def _unit(nation: str) -> str:
    return f"(CASE WHEN {nation} % 8 = 7 THEN 'N' ELSE 'R' END) || lpad(CAST({nation} AS VARCHAR), 2, '0')"


def specialty_stay_sql(known: str) -> str:
    out = []
    for s in ["hvlc", *R.SPECIALTIES]:
        los = "los" if s == "ent" else "least(los, 37)"
        out.append(f"avg(CASE WHEN {known} AND {s} AND los > 0 THEN {los} END) AS los_avg_{s}")
        out.append(
            f"count(*) FILTER (WHERE {known} AND {s} AND los = 0) / "
            f"nullif(CAST(count(*) FILTER (WHERE {known} AND {s}) AS DOUBLE), 0) AS dc_prop_{s}"
        )
    return ", ".join(out)


def case_mix_sql(known: str) -> str:
    n = f"nullif(CAST(count(*) FILTER (WHERE {known}) AS DOUBLE), 0)"

    def strict(p: str) -> str:
        return (
            f"CASE WHEN count(*) FILTER (WHERE {known} AND ({p}) IS NULL) = 0 THEN "
            f"count(*) FILTER (WHERE {known} AND {p}) / {n} END"
        )

    out = [
        f"{strict('SEX = 1')} AS sex_male_pct_ec",
        f"{strict('STARTAGE >= 65')} AS age_65_plus_pct_ec",
        f"count(*) FILTER (WHERE {known} AND ETHNOS IN ('A', 'B', 'C')) / {n} AS white_pct_ec",
    ]
    for q in range(1, 6):
        out.append(
            f"count(*) FILTER (WHERE {known} AND imd_decile IN ({2 * q - 1}, {2 * q})) / {n} AS quintile_{q}_pct_ec"
        )
    out.append(f"{strict('nr_elix_h36 >= 2')} AS comorb_pct")
    return ", ".join(out)


def specialty_counts_sql() -> str:
    return ", ".join(
        f"nullif(count(*) FILTER (WHERE {s}), 0) AS n_activity_{s}" for s in R.SPECIALTIES
    )


_SUM_COUNTS = " + ".join(f"coalesce(n_activity_{s}, 0)" for s in R.SPECIALTIES)
_ANY_COUNT = "coalesce(" + ", ".join(f"n_activity_{s}" for s in R.SPECIALTIES) + ") IS NOT NULL"
RATES = (
    ", ".join(f"n_activity_{s} / nullif(catchment_cat, 0) * 1000 AS rate_{s}" for s in R.SPECIALTIES)
    + f", CASE WHEN {_ANY_COUNT} THEN {_SUM_COUNTS} END AS n_activity_hvlc"
    + f", CASE WHEN {_ANY_COUNT} THEN ({_SUM_COUNTS}) / nullif(catchment_cat, 0) * 1000 END AS hvlc_rate"
)
_CATCH_JOIN = (
    "LEFT JOIN features f ON p.PROCODE3 = f.trust_code AND least(year(p.month), 1999) = f.year"
)
_FEATURES = "f.catchment_cat, f.sex_male_pct, f.white_pct, f.age_65_plus_pct"

# Covariates of the three measures of an activity.
_STAY_COVARIATES = (
    "catchment_cat", "sex_male_pct_ec", "white_pct_ec", "age_65_plus_pct_ec", "quintile_1_pct_ec", "comorb_pct",
)
COVARIATES = (("catchment_cat", "sex_male_pct", "white_pct", "age_65_plus_pct"), _STAY_COVARIATES, _STAY_COVARIATES)
MODELLED = {
    "elect": ("el_rate", "los_avg", "dc"),
    "hvlc": ("hvlc_rate", "los_avg_hvlc", "dc_prop_hvlc"),
    "ort": ("rate_ort", "los_avg_ort", "dc_prop_ort"),
    "opht": ("rate_opht", "los_avg_opht", "dc_prop_opht"),
    "gs": ("rate_gs", "los_avg_gs", "dc_prop_gs"),
    "uro": ("rate_uro", "los_avg_uro", "dc_prop_uro"),
    "ent": ("rate_ent", "los_avg_ent", "dc_prop_ent"),
    "gm": ("rate_gm", "los_avg_gm", "dc_prop_gm"),
}

CTES = {
    "lines": """
SELECT * FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey""",
    "episodes": f"""
SELECT CAST(o_custkey AS VARCHAR) AS TOKEN_PERSON_ID,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS EPIKEY,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS SUSRECID,
  'R' || lpad(CAST(s_nationkey % 5 AS VARCHAR), 2, '0') AS PROCODET,
  {_unit('s_nationkey')} AS PROCODE3,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS ADMIDATE,
  CAST(l_shipdate AS DATE) AS EPISTART,
  CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) AS EPIEND,
  l_linenumber AS EPIORDER,
  CAST(l_quantity AS INT) AS EPIDUR,
  CASE WHEN l_linestatus = 'O' AND l_linenumber % 2 = 0 THEN 1 ELSE 3 END AS EPISTAT,
  CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linenumber = 7 THEN DATE '1801-01-01'
       ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 - 2 AS INT) END AS DISDATE,
  {_pick('o_orderkey % 6', ['11', '12', '13', '21', '81', '2B'])} AS ADMIMETH,
  {_pick('l_partkey % 4', ['19', '51', '87', '29'])} AS ADMISORC,
  CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE {_pick('l_suppkey % 4', ['19', '52', '84', '29'])} END AS DISDEST,
  CASE WHEN o_custkey % 101 = 0 THEN NULL ELSE 1 + o_custkey % 2 END AS SEX,
  CASE WHEN o_custkey % 50 = 0 THEN 7001 ELSE o_custkey % 95 END AS STARTAGE,
  substr('ABCDEFGHZ', 1 + CAST(o_custkey % 9 AS INT), 1) AS ETHNOS,
  'E' || lpad(CAST(o_custkey % 200 AS VARCHAR), 3, '0') AS LSOA11,
  {_pick('l_suppkey % 4', ['101', '120', '500', '110'])} AS MAINSPEF,
  {_pick('l_partkey % 4', ['211', '215', '502', '130'])} AS TRETSPEF,
  {_pick('l_partkey % 61', PROCEDURES)} AS OPERTN_01,
  {_pick('l_suppkey % 20', DIAGNOSES)} AS DIAG_01,
  o_custkey % 5 AS nr_elix_h36,
  l_orderkey AS order_key, l_partkey,
  lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || lpad(CAST(l_partkey AS VARCHAR), 14, '0') ||
    lpad(CAST(l_suppkey AS VARCHAR), 14, '0') ||
    lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 14, '0') AS line_order
FROM lines""",
    "episodes_with_copies": """
SELECT * FROM episodes UNION ALL BY NAME
SELECT * REPLACE (EPIKEY || '-b' AS EPIKEY) FROM episodes WHERE l_partkey % 50 = 0""",
    "finished": "SELECT * FROM episodes WHERE EPISTAT = 3 AND ADMIDATE IS NOT NULL",
    "flagged": f"""
SELECT *, CASE
  WHEN (NOT coalesce(ADMISORC IN {_TRANSFER}, false) OR NOT coalesce(ADMIMETH IN ('81', '2B'), false))
    AND coalesce(DISDEST IN {_LEAVES}, false) THEN 1
  WHEN (coalesce(ADMISORC IN {_TRANSFER}, false) OR coalesce(ADMIMETH IN ('81', '2B'), false))
    AND coalesce(DISDEST IN {_LEAVES}, false) THEN 2
  WHEN (coalesce(ADMISORC IN {_TRANSFER}, false) OR coalesce(ADMIMETH IN ('81', '2B'), false))
    AND NOT coalesce(DISDEST IN {_LEAVES}, false) THEN 3
  ELSE 0 END AS transit_nhsd
FROM finished""",
    "dedup": f"""
SELECT * FROM flagged
QUALIFY row_number() OVER (PARTITION BY {_EPISODE_KEY} ORDER BY EPIKEY) = 1""",
    "cleaned": """
SELECT * REPLACE (CASE WHEN DISDATE IN (DATE '1801-01-01', DATE '1800-01-01') THEN NULL ELSE DISDATE END AS DISDATE)
FROM dedup""",
    "filled": """
SELECT *, CASE WHEN DISDATE IS NULL
    AND TOKEN_PERSON_ID = lead(TOKEN_PERSON_ID) OVER w AND PROCODET = lead(PROCODET) OVER w
    AND ADMIDATE = lead(ADMIDATE) OVER w THEN lead(DISDATE) OVER w ELSE DISDATE END AS disdate_for_spell
FROM cleaned
WINDOW w AS (ORDER BY TOKEN_PERSON_ID ASC NULLS LAST, EPISTART ASC NULLS LAST, EPIORDER ASC NULLS LAST,
  EPIEND ASC NULLS LAST, transit_nhsd ASC NULLS LAST, EPIKEY ASC NULLS LAST)""",
    "numbered": f"""
SELECT *, dense_rank() OVER (ORDER BY first_row) AS spell_id FROM (
  SELECT *, min(row_no) OVER (PARTITION BY {_SPELL_KEY}) AS first_row FROM (
    SELECT *, row_number() OVER (ORDER BY TOKEN_PERSON_ID ASC NULLS LAST, ADMIDATE ASC NULLS LAST,
      {_SPELL_ORDER}) AS row_no FROM filled))""",
    "spells": """
SELECT * EXCLUDE (row_no, first_row, place), strftime(ADMIDATE, '%m') AS admmnth, strftime(ADMIDATE, '%Y') AS admmyr,
  TOKEN_PERSON_ID || '_' || EPIKEY AS id
FROM (
  SELECT *, min(EPISTART) OVER s AS spellstartdate, max(EPIEND) OVER s AS spellenddate,
    row_number() OVER (PARTITION BY spell_id ORDER BY row_no) AS place
  FROM numbered WINDOW s AS (PARTITION BY spell_id))
WHERE place = 1""",
    "elective": """
SELECT * FROM spells WHERE ADMIMETH IN ('11', '12', '13') AND STARTAGE >= 17 AND STARTAGE < 7000""",
    "ranked_lines": """
SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY line_order) AS place,
  first_value(TOKEN_PERSON_ID || '_' || EPIKEY) OVER (PARTITION BY order_key ORDER BY line_order) AS record_id
FROM episodes""",
    "records": """
SELECT record_id AS id, TOKEN_PERSON_ID, OPERTN_01, DIAG_01, MAINSPEF, TRETSPEF, PROCODE3, ADMIDATE
FROM ranked_lines WHERE place = 1""",
    "px_long": """
SELECT record_id AS id, line_order AS ord, OPERTN_01 AS code FROM ranked_lines WHERE place > 1""",
    "dx_long": """
SELECT record_id AS id, line_order AS ord, DIAG_01 AS code FROM ranked_lines WHERE place > 1""",
    "px_text": "SELECT id, string_agg(code, ',' ORDER BY ord) AS codes FROM px_long GROUP BY id",
    "dx_text": "SELECT id, string_agg(code, ',' ORDER BY ord) AS codes FROM dx_long GROUP BY id",
    "coded": """
SELECT r.*, concat_ws(',', r.DIAG_01, d.codes) AS tnrdiagall, concat_ws(',', r.OPERTN_01, p.codes) AS tnrprocall
FROM records r LEFT JOIN dx_text d ON r.id = d.id LEFT JOIN px_text p ON r.id = p.id""",
    "pathways": f"""
SELECT id, PROCODE3, ADMIDATE,
  {_flag_columns()}
FROM (SELECT *, OPERTN_01 AS prim, DIAG_01 AS pdiag, MAINSPEF AS main, TRETSPEF AS treat,
        tnrprocall AS procs, tnrdiagall AS diags FROM coded)""",
    "specialties": f"SELECT *, ({_ANY}) AS hvlc FROM (SELECT *, {_specialty_columns()} FROM pathways)",
    "code_list": f"""
SELECT DISTINCT {_pick('p_partkey % 61', PROCEDURES)} AS intermediate FROM part WHERE p_partkey % 61 % 3 = 0""",
    "area_deprivation": """
SELECT DISTINCT 'E' || lpad(CAST(c_custkey % 200 AS VARCHAR), 3, '0') AS LSOA11,
  CAST(1 + c_custkey % 200 % 10 AS INT) AS imd_decile
FROM customer WHERE c_custkey % 200 % 37 <> 0""",
    "catchment": f"""
SELECT {_unit('n_nationkey')} AS procode, CAST(y.year AS INT) AS year,
  1000.0::DOUBLE + 50 * coalesce(c.n, 0) AS catchment_cat,
  0.45::DOUBLE + 0.01::DOUBLE * (n_nationkey % 7) AS sex_m_cat,
  0.10::DOUBLE + 0.002::DOUBLE * (n_nationkey % 7) AS age_65_74_cat,
  CASE WHEN n_nationkey % 9 <> 8 THEN 0.08::DOUBLE + 0.002::DOUBLE * (n_nationkey % 5) END AS age_75_plus_cat,
  0.6::DOUBLE + 0.02::DOUBLE * (n_nationkey % 11) AS white,
  CAST(1 + n_nationkey % 10 AS INT) AS rank_1_is_most_deprived
FROM nation CROSS JOIN (SELECT unnest(range(1995, 2000)) AS year) y
LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) c ON n_nationkey = c.c_nationkey
WHERE n_nationkey <> 24""",
    "features": """
SELECT procode AS trust_code, year, catchment_cat, sex_m_cat AS sex_male_pct, white AS white_pct,
  coalesce(age_65_74_cat, 0) + coalesce(age_75_plus_cat, 0) AS age_65_plus_pct
FROM catchment WHERE year IN (1995, 1996, 1997, 1998, 1999)""",
    "unit_lookup": f"""
SELECT {_unit('n_nationkey')} AS trust_code,
  CASE WHEN n_nationkey % 4 = 1 THEN 'new' WHEN n_nationkey % 4 = 2 THEN 'old' ELSE 'non_hub' END AS elective_hub_cat,
  unnest(CASE WHEN n_nationkey % 4 = 1 AND n_nationkey % 3 = 0
           THEN ['01/' || lpad(CAST(n_nationkey % 12 + 1 AS VARCHAR), 2, '0') || '/2000', '01/06/2001']
         WHEN n_nationkey % 4 = 1 THEN ['01/' || lpad(CAST(n_nationkey % 12 + 1 AS VARCHAR), 2, '0') || '/2000']
         WHEN n_nationkey % 4 = 2 THEN ['01/06/1998'] ELSE [CAST(NULL AS VARCHAR)] END) AS hub_start_date
FROM nation""",
    "categories": "SELECT DISTINCT trust_code, elective_hub_cat FROM unit_lookup",
    "starts": """
SELECT trust_code, min(CAST(strptime(hub_start_date, '%d/%m/%Y') AS DATE)) AS hub_start_date
FROM unit_lookup WHERE hub_start_date IS NOT NULL GROUP BY trust_code""",
    "peer_units": f"SELECT {_unit('n_nationkey')} AS Procode FROM nation WHERE n_nationkey <> 3",
    "exclude_units": f"SELECT {_unit('n_nationkey')} AS PROCODE3 FROM nation WHERE n_nationkey IN (6, 11)",
    "panel_spells": f"""
SELECT e.*, a.imd_decile, CAST(date_trunc('month', e.ADMIDATE) AS DATE) AS month,
  e.DISDATE - e.ADMIDATE AS los, w.* EXCLUDE (id)
FROM elective e LEFT JOIN area_deprivation a ON e.LSOA11 = a.LSOA11
JOIN (SELECT id, {', '.join(R.SPECIALTIES)}, ({_ANY}) AS hvlc FROM (
  SELECT id, {_specialty_columns()} FROM (
    SELECT id, {_flag_columns()} FROM (
      SELECT x.id, OPERTN_01 AS prim, DIAG_01 AS pdiag, MAINSPEF AS main, TRETSPEF AS treat,
        concat_ws(',', OPERTN_01, p.codes) AS procs, concat_ws(',', DIAG_01, d.codes) AS diags
      FROM elective x LEFT JOIN px_text p ON x.id = p.id LEFT JOIN dx_text d ON x.id = d.id)))) w ON e.id = w.id""",
    "plain_spells": """
SELECT e.*, a.imd_decile, CAST(date_trunc('month', e.ADMIDATE) AS DATE) AS month, e.DISDATE - e.ADMIDATE AS los
FROM elective e LEFT JOIN area_deprivation a ON e.LSOA11 = a.LSOA11""",
    "activity": f"""
SELECT p.*, {_FEATURES}, p.n_activity / nullif(f.catchment_cat, 0) * 1000 AS el_rate FROM (
  SELECT PROCODE3, CAST(date_trunc('month', ADMIDATE) AS DATE) AS month, count(*) AS n_activity
  FROM elective GROUP BY ALL) p {_CATCH_JOIN}""",
    "stay": f"""
SELECT PROCODE3, month, avg(CASE WHEN los > 0 THEN least(los, 37) END) AS los_avg,
  count(*) FILTER (WHERE los = 0) / CAST(count(*) AS DOUBLE) AS dc, {case_mix_sql('true')}
FROM plain_spells WHERE los >= 0 AND month >= DATE '1995-01-01' GROUP BY PROCODE3, month""",
    "panel": f"""
SELECT p.*, {_FEATURES}, p.n_activity / nullif(f.catchment_cat, 0) * 1000 AS el_rate, {RATES},
  strftime(p.month, '%Y_%m') AS year_month
FROM (
  SELECT PROCODE3, month, count(*) AS n_activity,
    avg(CASE WHEN los >= 0 AND los > 0 THEN least(los, 37) END) AS los_avg,
    count(*) FILTER (WHERE los = 0) / nullif(CAST(count(*) FILTER (WHERE los >= 0) AS DOUBLE), 0) AS dc,
    {case_mix_sql('los >= 0')}, {specialty_counts_sql()}, {specialty_stay_sql('los >= 0')}
  FROM panel_spells GROUP BY PROCODE3, month) p {_CATCH_JOIN}""",
    "core_panel": f"""
SELECT a.*, s.* EXCLUDE (PROCODE3, month), strftime(a.month, '%Y_%m') AS year_month
FROM activity a LEFT JOIN stay s ON a.PROCODE3 = s.PROCODE3 AND a.month = s.month""",
    "kept_panel": """
SELECT p.*, c.elective_hub_cat FROM panel p LEFT JOIN categories c ON p.PROCODE3 = c.trust_code
WHERE p.PROCODE3 LIKE 'R%' AND p.PROCODE3 IN (SELECT Procode FROM peer_units)
  AND p.PROCODE3 IN (SELECT trust_code FROM features)
  AND p.PROCODE3 NOT IN (SELECT PROCODE3 FROM exclude_units)""",
    "old_inputs": f"""
SELECT *, CAST(CASE WHEN post IS NULL THEN NULL WHEN treated_unit = 1 AND post = 1 THEN 1 ELSE 0 END AS INT) AS intervention,
  row_number() OVER (PARTITION BY PROCODE3 ORDER BY month) AS time, 'old' AS cohort
FROM (SELECT p.*, s.hub_start_date, CAST(elective_hub_cat = 'old' AS INT) AS treated_unit,
    CAST(CASE WHEN month >= DATE '1999-01-01' THEN 1
              WHEN month BETWEEN DATE '1995-01-01' AND DATE '1997-12-01' THEN 0 END AS INT) AS post
  FROM kept_panel p LEFT JOIN starts s ON p.PROCODE3 = s.trust_code
  WHERE elective_hub_cat IN ('old', 'non_hub') AND {IN_STUDY})""",
    "new_inputs": f"""
SELECT *, CAST(CASE WHEN month >= hub_start_date AND elective_hub_cat = 'new' THEN 1
    WHEN month < hub_start_date AND elective_hub_cat = 'new' THEN 0
    WHEN elective_hub_cat = 'non_hub' THEN 0 END AS INT) AS intervention,
  row_number() OVER (PARTITION BY PROCODE3 ORDER BY month) AS time, 'new' AS cohort
FROM (SELECT p.*, s.hub_start_date, CAST(elective_hub_cat = 'new' AS INT) AS treated_unit, CAST(NULL AS INT) AS post
  FROM kept_panel p LEFT JOIN starts s ON p.PROCODE3 = s.trust_code
  WHERE elective_hub_cat IN ('new', 'non_hub') AND {IN_STUDY})""",
    "inputs": """
SELECT *, n_activity / nullif(sum(n_activity) OVER (PARTITION BY cohort, treated_unit, time), 0) AS wt_n_activity,
  CASE WHEN count(*) OVER (PARTITION BY cohort, treated_unit, time)
          = count(catchment_cat) OVER (PARTITION BY cohort, treated_unit, time)
    THEN catchment_cat / nullif(sum(catchment_cat) OVER (PARTITION BY cohort, treated_unit, time), 0) END AS wt_catchment_cat
FROM (SELECT * FROM old_inputs UNION ALL BY NAME SELECT * FROM new_inputs)""",
    "cells": " UNION ALL ".join(
        f"SELECT cohort || '|{a}|{m}' AS model, PROCODE3 AS unit, CAST(time AS INT) AS time, {y} AS y, intervention AS d, {w} AS w FROM inputs"
        for a, columns in MODELLED.items()
        for m, y, w in zip(
            ("rate", "los.ip_avg", "los.dc_ratio"), columns, ("wt_catchment_cat", "wt_n_activity", "wt_n_activity")
        )
    ),
    "complete": "SELECT * FROM cells WHERE y IS NOT NULL AND d IS NOT NULL",
    "unit_states": """
SELECT u.*, s.T0, s.treated, t.T, CASE WHEN n_pre < 6 THEN 'few pre-periods' ELSE 'kept' END AS status
FROM (SELECT model, unit, count(*) AS n_cells, count(*) FILTER (WHERE d = 0) AS n_pre FROM complete GROUP BY model, unit) u
JOIN (SELECT model, unit, coalesce(min(time) FILTER (WHERE d = 1) - 1, max(time)) AS T0, max(d) AS treated
      FROM cells WHERE d IS NOT NULL GROUP BY model, unit) s ON u.model = s.model AND u.unit = s.unit
JOIN (SELECT model, count(DISTINCT time) AS T FROM complete GROUP BY model) t ON u.model = t.model""",
    "eligible": """
SELECT c.*, s.treated, s.T0 FROM complete c
JOIN unit_states s ON c.model = s.model AND c.unit = s.unit WHERE s.status = 'kept'""",
    "units": "SELECT DISTINCT model, unit, CAST(T0 AS INT) AS T0 FROM eligible WHERE treated = 1",
    "sizes": """
SELECT model, CAST(max(time) AS INT) AS T, CAST(count(DISTINCT unit) AS INT) AS N,
  CAST(count(DISTINCT unit) FILTER (WHERE treated = 1) AS INT) AS Ntr FROM eligible GROUP BY model""",
    # unit and time effects of the controls by taking out unit and time means in turn until nothing is left
    "alternating": """
SELECT 0 AS round, model, unit, time, y AS e, 0::DOUBLE AS g FROM eligible WHERE treated = 0
UNION ALL
SELECT round + 1, model, unit, time, e - avg(e) OVER (PARTITION BY model, time), g + avg(e) OVER (PARTITION BY model, time)
FROM (SELECT round, model, unit, time, g, e - avg(e) OVER (PARTITION BY model, unit) AS e FROM alternating WHERE round < 300)""",
    "control_effect": "SELECT model, time, any_value(g) AS g FROM alternating WHERE round = 300 GROUP BY model, time",
    "fit_cells": """
SELECT model, unit, time, y AS y_tr, g + a AS y_ct, y - g - a AS eff, d, w, T0 FROM (
  SELECT e.*, m.g, avg(CASE WHEN d = 0 THEN y - g END) OVER (PARTITION BY e.model, e.unit) AS a
  FROM eligible e JOIN control_effect m ON e.model = m.model AND e.time = m.time WHERE treated = 1)""",
    "sigma": """
SELECT model, sum(e * e) / nullif(greatest(count(*) - count(DISTINCT unit) - count(DISTINCT time) + 1, 0), 0) AS sigma2
FROM alternating WHERE round = 300 GROUP BY model""",
    "one_cells": """
SELECT c.*, i.quintile_1_pct_ec AS x FROM complete c JOIN inputs i
  ON split_part(c.model, '|', 1) = i.cohort AND c.unit = i.PROCODE3 AND c.time = i.time
WHERE c.model LIKE '%|elect|los.dc_ratio' AND i.quintile_1_pct_ec IS NOT NULL""",
    "one_alternating": """
SELECT 0 AS round, c.model, c.unit, c.time, c.y AS e, c.x AS ex FROM one_cells c
JOIN (SELECT model, unit FROM one_cells GROUP BY model, unit HAVING count(*) FILTER (WHERE d = 0) >= 6 AND max(d) = 0) k
  ON c.model = k.model AND c.unit = k.unit
UNION ALL
SELECT round + 1, model, unit, time, e - avg(e) OVER (PARTITION BY model, time), ex - avg(ex) OVER (PARTITION BY model, time)
FROM (SELECT round, model, unit, time, e - avg(e) OVER (PARTITION BY model, unit) AS e, ex - avg(ex) OVER (PARTITION BY model, unit) AS ex
      FROM one_alternating WHERE round < 300)""",
    "cov_cells": " UNION ALL ".join(
        f"SELECT cohort || '|{a}|{m}' AS model, PROCODE3 AS unit, CAST(time AS INT) AS time, intervention AS d, "
        f"[{', '.join(f'CAST({c} AS DOUBLE)' for c in [y, *x])}] AS vals FROM inputs"
        for a, columns in MODELLED.items()
        for m, y, x in zip(("rate", "los.ip_avg", "los.dc_ratio"), columns, COVARIATES)
    ),
    "cov_controls": """
SELECT c.model, c.unit, c.time, unnest(c.vals) AS e, unnest(range(1, len(c.vals) + 1)) AS v
FROM (SELECT * FROM cov_cells WHERE d IS NOT NULL AND len(list_filter(vals, lambda z: z IS NULL)) = 0) c
JOIN (SELECT model, unit FROM cov_cells WHERE d IS NOT NULL GROUP BY model, unit HAVING max(d) = 0) s
  ON c.model = s.model AND c.unit = s.unit
JOIN (SELECT model, unit FROM cov_cells WHERE d = 0 AND len(list_filter(vals, lambda z: z IS NULL)) = 0
      GROUP BY model, unit HAVING count(*) >= 6) k ON c.model = k.model AND c.unit = k.unit""",
    "cov_alternating": """
SELECT 0 AS round, model, unit, time, v, e FROM cov_controls
UNION ALL
SELECT round + 1, model, unit, time, v, e - avg(e) OVER (PARTITION BY model, v, time)
FROM (SELECT round, model, unit, time, v, e - avg(e) OVER (PARTITION BY model, v, unit) AS e FROM cov_alternating WHERE round < 300)""",
    "cov_products": """
SELECT a.model, a.v AS i, b.v AS j, sum(a.e * b.e) AS p
FROM (SELECT * FROM cov_alternating WHERE round = 300) a JOIN (SELECT * FROM cov_alternating WHERE round = 300) b
  ON a.model = b.model AND a.unit = b.unit AND a.time = b.time GROUP BY ALL""",
    # normal equations by elimination; variables are scaled alike, and one without variance keeps a zero row
    "elimination": """
SELECT model, 0 AS step, list(line ORDER BY i) AS m, any_value(scales) AS scales FROM (
  SELECT q.model, q.i, any_value(z.scales) AS scales,
    list(CASE WHEN z.scales[q.i - 1] <= 1e-8 OR (q.j > 1 AND z.scales[q.j - 1] <= 1e-8) THEN 0
         ELSE q.p / z.scales[q.i - 1] / (CASE WHEN q.j > 1 THEN z.scales[q.j - 1] ELSE 1 END) END ORDER BY q.j = 1, q.j) AS line
  FROM cov_products q JOIN (SELECT model, list(sqrt(p) ORDER BY i) AS scales FROM cov_products WHERE i = j AND i > 1 GROUP BY model) z
    ON q.model = z.model
  WHERE q.i > 1 GROUP BY q.model, q.i) GROUP BY model
UNION ALL
SELECT model, step + 1, CASE WHEN m[step + 1][step + 1] = 0 THEN m ELSE list_transform(m, lambda line, i: list_transform(line, lambda c, j:
    CASE WHEN i = step + 1 THEN c / m[step + 1][step + 1]
         ELSE c - line[step + 1] * m[step + 1][j] / m[step + 1][step + 1] END)) END, scales
FROM elimination WHERE step < len(m)""",
    "meta": """
SELECT s.model, T, N, Ntr, sigma2, 0 AS r_cv, 'ok' AS status FROM sizes s LEFT JOIN sigma g ON s.model = g.model""",
    "staggered": """
SELECT *, CASE WHEN time <= T0 THEN time - T0 - 1 ELSE time - T0 END AS event_time,
  CASE WHEN time <= T0 THEN 'pre' ELSE 'post' END AS period FROM fit_cells""",
    "draws": """
SELECT s.model, s.unit, s.time, s.event_time, s.period, b.draw,
  eff + 0.01::DOUBLE * ((s.time * 31 + b.draw * 17 + CAST(substr(s.unit, 2, 2) AS INT) * 7 + s.time * b.draw) % 101 - 50) AS eff,
  y_tr - (eff + 0.01::DOUBLE * ((s.time * 31 + b.draw * 17 + CAST(substr(s.unit, 2, 2) AS INT) * 7 + s.time * b.draw) % 101 - 50)) AS ct
FROM staggered s CROSS JOIN (SELECT unnest(range(1, 21)) AS draw) b""",
    "frame": """
SELECT m.*, min_t0, max_t0, CASE WHEN min_t0 = max_t0 THEN 'old_hub' ELSE 'new_hub' END AS comparator
FROM meta m JOIN (SELECT model, min(T0) AS min_t0, max(T0) AS max_t0 FROM units GROUP BY model) t ON m.model = t.model
WHERE T - min_t0 >= 6""",
    "observed": """
SELECT k.model, k.event_time, count(*) FILTER (WHERE f.T - u.T0 >= k.event_time) AS n_observed
FROM (SELECT DISTINCT model, event_time FROM staggered WHERE event_time > 0) k
JOIN units u ON k.model = u.model JOIN sizes f ON k.model = f.model GROUP BY k.model, k.event_time""",
    "time_means": """
SELECT model, period, event_time, avg(eff) AS att_mean, sum(coalesce(w, 0) * y_tr) / nullif(sum(coalesce(w, 0)), 0) AS out_tr,
  sum(coalesce(w, 0) * y_tr) / nullif(sum(coalesce(w, 0)), 0) - avg(eff) AS out_ct
FROM staggered GROUP BY model, period, event_time""",
    "unit_means": """
SELECT model, period, unit, avg(eff) AS att_mean, sum(coalesce(w, 0) * y_tr) / nullif(sum(coalesce(w, 0)), 0) AS out_tr,
  sum(coalesce(w, 0) * y_tr) / nullif(sum(coalesce(w, 0)), 0) - avg(eff) AS out_ct
FROM staggered GROUP BY model, period, unit""",
    "draw_times": """
SELECT model, period, event_time, draw, avg(eff) AS eff, avg(ct) AS ct FROM draws GROUP BY model, period, event_time, draw""",
    "lvl_overall": """
SELECT 'overall' AS level, e.model, e.period, 'Pooled' AS unit, 0 AS event_time, att_mean, out_tr, out_ct, att_se, out_ct_se
FROM (SELECT model, period, avg(att_mean) AS att_mean, avg(out_tr) AS out_tr, avg(out_ct) AS out_ct
      FROM time_means GROUP BY model, period) e
JOIN (SELECT model, period, stddev_samp(eff) AS att_se, stddev_samp(ct) AS out_ct_se FROM (
      SELECT model, period, draw, avg(eff) AS eff, avg(ct) AS ct FROM draw_times GROUP BY ALL) GROUP BY model, period) s
ON e.model = s.model AND e.period = s.period""",
    "lvl_time": """
SELECT 'time' AS level, e.model, e.period, 'Pooled' AS unit, e.event_time, att_mean, out_tr, out_ct, att_se, out_ct_se
FROM time_means e JOIN (SELECT model, period, event_time, stddev_samp(eff) AS att_se, stddev_samp(ct) AS out_ct_se
  FROM draw_times GROUP BY model, period, event_time) s
ON e.model = s.model AND e.period = s.period AND e.event_time = s.event_time""",
    "lvl_key": """
SELECT 'key' AS level, e.model, e.period, 'Pooled' AS unit, 0 AS event_time, att_mean, out_tr, out_ct, att_se, out_ct_se
FROM (SELECT model, period, avg(att_mean) AS att_mean, avg(out_tr) AS out_tr, avg(out_ct) AS out_ct
      FROM time_means WHERE abs(event_time) BETWEEN 1 AND 6 GROUP BY model, period) e
JOIN (SELECT model, period, stddev_samp(eff) AS att_se, stddev_samp(ct) AS out_ct_se FROM (
      SELECT model, period, draw, avg(eff) AS eff, avg(ct) AS ct FROM draw_times
      WHERE abs(event_time) BETWEEN 1 AND 6 GROUP BY ALL) GROUP BY model, period) s
ON e.model = s.model AND e.period = s.period""",
    "lvl_unit": """
SELECT 'unit' AS level, e.model, e.period, e.unit, 0 AS event_time, att_mean, out_tr, out_ct, att_se, out_ct_se
FROM unit_means e JOIN (SELECT model, period, unit, stddev_samp(eff) AS att_se, stddev_samp(ct) AS out_ct_se FROM (
      SELECT model, period, unit, draw, avg(eff) AS eff, avg(ct) AS ct FROM draws GROUP BY ALL) GROUP BY model, period, unit) s
ON e.model = s.model AND e.period = s.period AND e.unit = s.unit""",
    "lvl_unit_key": """
SELECT 'unit_key' AS level, e.model, e.period, e.unit, 0 AS event_time, att_mean, out_tr, out_ct, att_se, out_ct_se
FROM (SELECT model, period, unit, avg(eff) AS att_mean, avg(y_tr) AS out_tr, avg(y_ct) AS out_ct
      FROM staggered WHERE abs(event_time) BETWEEN 1 AND 6 GROUP BY ALL) e
JOIN (SELECT model, period, unit, stddev_samp(eff) AS att_se, stddev_samp(ct) AS out_ct_se FROM (
      SELECT model, period, unit, draw, avg(eff) AS eff, avg(ct) AS ct FROM draws
      WHERE abs(event_time) BETWEEN 1 AND 6 GROUP BY ALL) GROUP BY model, period, unit) s
ON e.model = s.model AND e.period = s.period AND e.unit = s.unit""",
    "lvl_cell": """
SELECT 'cell' AS level, e.model, e.period, e.unit, e.event_time, eff AS att_mean, y_tr AS out_tr, y_ct AS out_ct, att_se, out_ct_se
FROM staggered e JOIN (SELECT model, period, unit, event_time, stddev_samp(eff) AS att_se, stddev_samp(ct) AS out_ct_se
  FROM draws GROUP BY model, period, unit, event_time) s
ON e.model = s.model AND e.period = s.period AND e.unit = s.unit AND e.event_time = s.event_time""",
    "levels": """
SELECT * FROM lvl_overall UNION ALL BY NAME SELECT * FROM lvl_time UNION ALL BY NAME SELECT * FROM lvl_key
UNION ALL BY NAME SELECT * FROM lvl_unit UNION ALL BY NAME SELECT * FROM lvl_unit_key UNION ALL BY NAME SELECT * FROM lvl_cell""",
    "inference": """
SELECT *, att_mean - z * att_se AS att_lower, att_mean + z * att_se AS att_upper,
  out_ct - z * out_ct_se AS out_ct_lower, out_ct + z * out_ct_se AS out_ct_upper,
  100 * att_mean / (CASE WHEN abs(out_ct) >= 1e-5 THEN out_ct END) AS delta_mean,
  100 * (att_mean - z * att_se) / (CASE WHEN abs(out_ct) >= 1e-5 THEN out_ct END) AS delta_lower,
  100 * (att_mean + z * att_se) / (CASE WHEN abs(out_ct) >= 1e-5 THEN out_ct END) AS delta_upper,
  ((((1.061405429::DOUBLE * t + -1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t + -0.284496736::DOUBLE) * t
    + 0.254829592::DOUBLE) * t * exp(-x * x) AS pval
FROM (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM (
  SELECT l.*, comparator, sigma2, r_cv AS size_fct, 1.959963984540054::DOUBLE AS z,
    abs(att_mean) / nullif(att_se, 0) / sqrt(2::DOUBLE) AS x,
    CASE WHEN level IN ('time', 'cell') THEN CAST(l.event_time AS VARCHAR)
      WHEN level IN ('key', 'unit_key') THEN (CASE WHEN l.period = 'pre' THEN '-1 - -6' ELSE '1 - 6' END)
      WHEN l.period = 'pre' THEN '-1 - -' || max_t0 ELSE '1 - ' || (T - min_t0) END AS time,
    CAST(least(CASE WHEN l.period = 'pre' THEN coalesce(u.T0, max_t0) ELSE T - coalesce(u.T0, min_t0) END,
      CASE WHEN level IN ('key', 'unit_key') THEN 6 ELSE 100000 END) AS INT) AS size_period,
    CAST(CASE WHEN l.period = 'pre' THEN 0 WHEN level IN ('overall', 'unit') THEN Ntr
      ELSE coalesce(o.n_observed, 0) END AS INT) AS size_tr,
    CAST(N - CASE WHEN l.period = 'pre' THEN 0 WHEN level IN ('overall', 'unit') THEN Ntr
      ELSE coalesce(o.n_observed, 0) END AS INT) AS size_ct
  FROM levels l JOIN frame f ON l.model = f.model
  LEFT JOIN units u ON l.model = u.model AND l.unit = u.unit
  LEFT JOIN observed o ON l.model = o.model
    AND o.event_time = CASE WHEN level IN ('key', 'unit_key') THEN 6 ELSE abs(l.event_time) END))""",
}


def with_ctes(body: str) -> str:
    """Prefix a query with the table expressions it names, directly or through others."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    if not needed:
        return body
    parts = [f"{n} AS ({CTES[n].strip()})" for n in CTES if n in needed]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
