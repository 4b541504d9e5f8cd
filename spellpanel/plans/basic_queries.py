"""Queries: scans, projections, filters, joins, windows, reshapes and scalar
functions, each over the domain tables it serves (S, P, F, J, W, K, U, R, X)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spellpanel.functions import dates as D
from spellpanel.functions import nulls as N
from spellpanel.functions import text as X
from spellpanel.functions.normal import two_sided_p, z_value
from spellpanel.operators import codes as C
from spellpanel.operators import effects as E
from spellpanel.operators import inference as I
from spellpanel.operators import panel as P
from spellpanel.operators import relational as Rel
from spellpanel.operators import spells as S
from spellpanel.operators.recipes import SPECIALTIES, SPECIALTY_NAMES
from spellpanel.plans import chain
from spellpanel.plans.registry import query, scratch
from spellpanel.plans.sql import IN_STUDY, rnd
from spellpanel.session import stage, stage_large
from spellpanel.sources import proxy
from spellpanel.sources import tables as Tab

_ACTIVITY = f"SELECT PROCODE3, month, n_activity, {rnd('el_rate', 'el_rate')} FROM activity"


def _activity(spark, sf):
    return P.activity_panel(chain.elective(spark, sf), chain.features(spark, sf), proxy.LAST_REFERENCE_YEAR)


def _finished(spark, sf):
    return S.finished_episodes(proxy.episodes(spark, sf))


# -------------------------------------------------------------- scans and sinks


@query("s01_scan", "SELECT l_linestatus, count(*) AS n, count(l_shipdate) AS n_dated FROM lineitem GROUP BY l_linestatus")
def s01(spark, sf):
    df = Tab.read_table(spark, f"{sf}/lineitem.parquet")
    return df.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.count("l_shipdate").alias("n_dated"))


@query("s02_pruned_scan", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem")
def s02(spark, sf):
    return Tab.read_table(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "s03_multi_year_load",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate IS NOT NULL",
)
def s03(spark, sf):
    path = scratch(spark, "orders_by_year")
    orders = proxy.table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    Tab.write_parquet(orders, path, ["year"])
    years = [r["year"] for r in orders.select("year").distinct().collect() if r["year"] is not None]  # one row a year
    paths = [f"{path}/year={y}" for y in sorted(years)]
    return Tab.read_years(spark, paths, ["o_orderkey", "o_custkey", "o_totalprice"])


@query("s04_csv_read", "SELECT LSOA11, imd_decile FROM area_deprivation")
def s04(spark, sf):
    path = scratch(spark, "areas")
    Tab.write_csv(proxy.area_deprivation(spark, sf), path)
    return Tab.read_lookup(spark, path, "area_deprivation")


@query(
    "s05_quoted_csv_read",
    """SELECT n_name || ', "' || n_nationkey || '"' AS label, count(*) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def s05(spark, sf):
    n = proxy.table(spark, sf, "nation")
    label = F.concat("n_name", F.lit(', "'), F.col("n_nationkey").cast("string"), F.lit('"'))
    c = proxy.table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.col("c_custkey").cast("string").alias("row"), label.alias("label"))
    path = scratch(spark, "quoted")
    Tab.write_csv(rows, path, quote_all=True)
    back = Tab.read_row_named_csv(spark, path, "label STRING")
    return back.groupBy("label").agg(F.count("*").alias("n"))


@query("s06_point_read", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def s06(spark, sf):
    return Tab.read_table(spark, f"{sf}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")


@query("s07_unit_list_read", "SELECT DISTINCT Procode FROM peer_units JOIN episodes ON Procode = PROCODE3")
def s07(spark, sf):
    path = scratch(spark, "peers")
    Tab.write_csv(proxy.peer_units(spark, sf), path)
    listed = Tab.read_lookup(spark, path, "peer_units").distinct()
    seen = proxy.episodes(spark, sf).select("PROCODE3")
    return listed.join(seen, listed["Procode"] == seen["PROCODE3"], "left_semi")


@query("s08_parquet_write", _ACTIVITY)
def s08(spark, sf):
    path = scratch(spark, "activity")
    Tab.write_parquet(_activity(spark, sf), path)
    return Tab.read_table(spark, path, ["PROCODE3", "month", "n_activity", "el_rate"])


@query("s09_csv_write", _ACTIVITY)
def s09(spark, sf):
    path = scratch(spark, "activity_csv")
    Tab.write_csv(_activity(spark, sf).select("PROCODE3", "month", "n_activity", "el_rate"), path, quote_all=True)
    schema = "PROCODE3 STRING, month DATE, n_activity BIGINT, el_rate DOUBLE"
    return spark.read.schema(schema).option("header", True).csv(path)


@query("s10_stage_table", "SELECT EPIKEY, transit_nhsd FROM flagged")
def s10(spark, sf):
    return stage(chain.flagged(spark, sf).select("EPIKEY", "transit_nhsd"), "flagged")


@query("s11_fit_tables", f"SELECT model, unit, time, {rnd('y_ct', 'y_ct')}, {rnd('eff', 'eff')} FROM fit_cells")
def s11(spark, sf):
    path = scratch(spark, "fit")
    Tab.save_fit(E.did_counterfactual(chain.eligible(spark, sf)), path)
    fit = Tab.load_fit(spark, path, ["fit_meta", "fit_units", "fit_cells"])
    return fit["fit_cells"].select("model", "unit", "time", "y_ct", "eff")


@query("s12_preview", "SELECT EPIKEY, ADMIDATE FROM finished ORDER BY ADMIDATE, EPIKEY LIMIT 1000")
def s12(spark, sf):
    return Tab.preview(_finished(spark, sf).select("EPIKEY", "ADMIDATE"), ["ADMIDATE", "EPIKEY"])


# ------------------------------------------------------------------ projections


@query("p01_project", "SELECT EPIKEY, PROCODET, EPISTART FROM episodes")
def p01(spark, sf):
    return proxy.episodes(spark, sf).select("EPIKEY", "PROCODET", "EPISTART")


@query("p02_project_lookup", "SELECT LSOA11, imd_decile FROM area_deprivation")
def p02(spark, sf):
    return proxy.area_deprivation(spark, sf).select("LSOA11", "imd_decile")


@query("p03_drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def p03(spark, sf):
    return proxy.table(spark, sf, "orders").drop("o_totalprice", "o_orderdate")


@query(
    "p04_rename",
    """SELECT EPIKEY, OPERTN_01 AS primproc, DIAG_01 AS primdiag, MAINSPEF AS mainspeccode, TRETSPEF AS treatfunctcode
FROM episodes""",
)
def p04(spark, sf):
    names = {"OPERTN_01": "primproc", "DIAG_01": "primdiag", "MAINSPEF": "mainspeccode", "TRETSPEF": "treatfunctcode"}
    return proxy.episodes(spark, sf).withColumnsRenamed(names).select("EPIKEY", *names.values())


_RENAMED = {"los_avg": "elect_los.ip_avg", "dc": "elect_los.dc_ratio", "el_rate": "elect_rate"}


@query(
    "p05_rename_measures",
    " UNION ALL ".join(
        f"SELECT PROCODE3, month, '{new}' AS measure, {rnd(old, 'value')} FROM core_panel WHERE {old} IS NOT NULL"
        for old, new in _RENAMED.items()
    ),
)
def p05(spark, sf):
    renamed = X.rename_measures(chain.overall_panel(spark, sf))
    measures = [c for c in renamed.columns if c.startswith("elect_")]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"`{c}`").alias("value")) for c in measures]))
    return renamed.select("PROCODE3", "month", pairs.alias("p")).select("PROCODE3", "month", "p.*").filter("value is not null")


_LAYOUT_SQL = f"""SELECT {", ".join(Tab.SPELL_LAYOUT)} FROM (
  SELECT s.*, concat_ws(',', s.DIAG_01, d.codes) AS tnrdiagall, concat_ws(',', s.OPERTN_01, p.codes) AS tnrprocall,
    {", ".join(f"{x.replace('STRING', 'VARCHAR')} AS {c}" for c, x in chain.CARRIED.items())}
  FROM spells s LEFT JOIN dx_text d ON s.id = d.id LEFT JOIN px_text p ON s.id = p.id)"""


@query("p06_layout", _LAYOUT_SQL)
def p06(spark, sf):
    return Tab.spell_layout(chain.finished_spells(spark, sf))


@query(
    "p07_derive",
    "SELECT EPIKEY, strftime(ADMIDATE, '%m') AS admmnth, DISDATE - ADMIDATE AS los, nr_elix_h36 >= 2 AS elix_2_or_more FROM finished",
)
def p07(spark, sf):
    return _finished(spark, sf).select(
        "EPIKEY",
        F.date_format("ADMIDATE", "MM").alias("admmnth"),
        D.stay_days("ADMIDATE", "DISDATE").alias("los"),
        (F.col("nr_elix_h36") >= 2).alias("elix_2_or_more"),
    )


@query("p08_nested_condition", "SELECT transit_nhsd, count(*) AS n FROM flagged GROUP BY transit_nhsd")
def p08(spark, sf):
    return chain.flagged(spark, sf).groupBy("transit_nhsd").agg(F.count("*").alias("n"))


@query(
    "p09_case_when",
    f"""SELECT PROCODE3, month, CASE WHEN month >= DATE '1999-01-01' THEN true
  WHEN month <= DATE '1997-12-01' THEN false END AS post FROM activity""",
)
def p09(spark, sf):
    return _activity(spark, sf).select("PROCODE3", "month", proxy.CALENDAR.is_post("month").alias("post"))


@query(
    "p10_sentinel_to_null",
    "SELECT EPIKEY, CASE WHEN DISDATE IN (DATE '1801-01-01', DATE '1800-01-01') THEN NULL ELSE DISDATE END AS DISDATE FROM episodes",
)
def p10(spark, sf):
    return proxy.episodes(spark, sf).select("EPIKEY", N.drop_sentinels("DISDATE", S.DATE_SENTINELS).alias("DISDATE"))


@query(
    "p12_split_text",
    """SELECT PROCODE3, split_part(strftime(ADMIDATE, '%Y_%m'), '_', 1) AS year,
  split_part(strftime(ADMIDATE, '%Y_%m'), '_', 2) AS month, count(*) AS n FROM elective GROUP BY ALL""",
)
def p12(spark, sf):
    parts = F.split(D.year_month("ADMIDATE"), "_")
    return (
        chain.elective(spark, sf)
        .groupBy("PROCODE3", parts.getItem(0).alias("year"), parts.getItem(1).alias("month"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "p13_row_sum",
    f"""SELECT procode, year,
  {rnd('coalesce(age_65_74_cat, 0) + coalesce(age_75_plus_cat, 0)', 'age_65_plus_pct')} FROM catchment""",
)
def p13(spark, sf):
    total = N.row_sum(["age_65_74_cat", "age_75_plus_cat"])
    return proxy.catchment(spark, sf).select("procode", "year", total.alias("age_65_plus_pct"))


_STATS = ["rate", "los.ip_avg", "los.dc_ratio"]


@query(
    "p14_name_product",
    f"""SELECT DISTINCT PROCODE3, s || '_' || m AS name FROM episodes,
  (VALUES {', '.join(f"('{s}')" for s in SPECIALTIES)}) a(s), (VALUES {', '.join(f"('{m}')" for m in _STATS)}) b(m)""",
)
def p14(spark, sf):
    names = F.array(*[F.lit(n) for n in X.name_product(SPECIALTIES, _STATS)])
    return proxy.episodes(spark, sf).select("PROCODE3").distinct().select("PROCODE3", F.explode(names).alias("name"))


@query("p15_carry_year", "SELECT PROCODE3, month, least(year(month), 1999) AS year2 FROM activity")
def p15(spark, sf):
    return _activity(spark, sf).select(
        "PROCODE3", "month", D.carry_year(F.year("month"), proxy.LAST_REFERENCE_YEAR).alias("year2")
    )


@query(
    "p16_percent_label",
    """SELECT PROCODE3, CASE WHEN change > 0 THEN printf('+%.1f%%', change) ELSE printf('%.1f%%', change) END AS label
FROM (SELECT PROCODE3, round(100 * (sum(n_activity) FILTER (WHERE month >= DATE '1999-01-01')
    / CAST(nullif(sum(n_activity) FILTER (WHERE month < DATE '1999-01-01'), 0) AS DOUBLE) - 1), 4) AS change
  FROM activity GROUP BY PROCODE3)""",
)
def p16(spark, sf):
    late = F.col("month") >= F.lit("1999-01-01").cast("date")
    totals = _activity(spark, sf).groupBy("PROCODE3").agg(
        F.sum(F.when(late, F.col("n_activity"))).alias("after"), F.sum(F.when(~late, F.col("n_activity"))).alias("before")
    )
    change = F.round((N.ratio("after", "before") - 1) * 100, 4)
    return totals.select("PROCODE3", X.signed_percent(change).alias("label"))


# ---------------------------------------------------------------------- filters


@query("f01_finished_filter", "SELECT EPIKEY, ADMIDATE FROM finished")
def f01(spark, sf):
    return _finished(spark, sf).select("EPIKEY", "ADMIDATE")


@query("f02_membership", "SELECT EPIKEY, coalesce(DISDEST IN ('52', '84'), false) AS leaves FROM episodes")
def f02(spark, sf):
    return proxy.episodes(spark, sf).select("EPIKEY", N.in_set("DISDEST", S.TRANSFER_DESTINATIONS).alias("leaves"))


@query("f03_range", "SELECT EPIKEY, STARTAGE FROM episodes WHERE STARTAGE >= 17 AND STARTAGE < 7000")
def f03(spark, sf):
    low, high = S.ADULT_AGE
    return proxy.episodes(spark, sf).select("EPIKEY", "STARTAGE").filter(
        (F.col("STARTAGE") >= low) & (F.col("STARTAGE") < high)
    )


@query(
    "f04_code_list_search",
    """SELECT PROCODE3, count(*) AS n FROM coded
WHERE regexp_matches(tnrprocall, (SELECT string_agg(intermediate, '|') FROM code_list)) GROUP BY PROCODE3""",
)
def f04(spark, sf):
    records = proxy.coded_records(spark, sf)
    with_text = C.attach_codes(records, proxy.dx_long(spark, sf), proxy.px_long(spark, sf))
    kept = C.filter_by_code_list(with_text.select("id", "PROCODE3", "tnrprocall"), proxy.code_list(spark, sf))
    return kept.groupBy("PROCODE3").agg(F.count("*").alias("n"))


@query(
    "f05_any_code",
    """SELECT PROCODE3, count(*) FILTER (WHERE regexp_matches(OPERTN_01, 'Z845|Z846|Y713')) AS n_any,
  count(*) FILTER (WHERE NOT regexp_matches(OPERTN_01, 'Z845|Z846|Y713')) AS n_none FROM episodes GROUP BY PROCODE3""",
)
def f05(spark, sf):
    hit = N.any_code("OPERTN_01", ["Z845", "Z846", "Y713"])
    return proxy.episodes(spark, sf).groupBy("PROCODE3").agg(
        F.count_if(hit).alias("n_any"), F.count_if(~hit).alias("n_none")
    )


@query(
    "f06_anchored_pattern",
    """SELECT OPERTN_01, count(*) AS n FROM episodes
WHERE regexp_matches(OPERTN_01, '^Q39|Q49|Q50|T42') OR regexp_matches(OPERTN_01, '^Q18') GROUP BY OPERTN_01""",
)
def f06(spark, sf):
    hit = N.matches("OPERTN_01", "^Q39|Q49|Q50|T42") | N.matches("OPERTN_01", "^Q18")
    return proxy.episodes(spark, sf).filter(hit).groupBy("OPERTN_01").agg(F.count("*").alias("n"))


@query(
    "f07_code_range",
    """SELECT OPERTN_01, count(*) AS n FROM episodes WHERE OPERTN_01 IN
  ('M651', 'M652', 'M653', 'M421', 'M422', 'M071', 'M072') GROUP BY OPERTN_01""",
)
def f07(spark, sf):
    codes = X.code_range("M", 651, 653) + X.code_range("M", 421, 422) + X.code_range("M", 71, 72)
    return (
        proxy.episodes(spark, sf).filter(N.in_set("OPERTN_01", codes)).groupBy("OPERTN_01").agg(F.count("*").alias("n"))
    )


@query("f08_prefix", "SELECT DISTINCT PROCODE3 FROM episodes WHERE starts_with(PROCODE3, 'R')")
def f08(spark, sf):
    return proxy.episodes(spark, sf).select("PROCODE3").filter(F.col("PROCODE3").startswith("R")).distinct()


@query(
    "f09_month_bound",
    "SELECT PROCODE3, strftime(month, '%Y_%m') AS year_month, n_activity FROM activity WHERE strftime(month, '%Y_%m') >= '1998_01'",
)
def f09(spark, sf):
    bound = F.col("month") >= F.lit("1998-01-01").cast("date")
    return _activity(spark, sf).filter(bound).select("PROCODE3", D.year_month("month").alias("year_month"), "n_activity")


@query("f10_calendar_filter", f"SELECT month, sum(n_activity)::BIGINT AS n FROM activity WHERE {IN_STUDY} GROUP BY month")
def f10(spark, sf):
    kept = _activity(spark, sf).filter(proxy.CALENDAR.contains("month"))
    return kept.groupBy("month").agg(F.sum("n_activity").alias("n"))


@query(
    "f11_group_extreme",
    """SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders
QUALIFY CAST(o_orderdate AS DATE) = min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey)""",
)
def f11(spark, sf):
    orders = proxy.table(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    return Rel.group_extreme(orders, ["o_custkey"], "day")


@query(
    "f12_adjacent_row",
    """SELECT EPIKEY FROM filled WHERE DISDATE IS NULL AND disdate_for_spell IS NOT NULL""",
)
def f12(spark, sf):
    return chain.prepared(spark, sf).filter("DISDATE is null and disdate_for_spell is not null").select("EPIKEY")


@query(
    "f13_cohort_subset",
    "SELECT PROCODE3, month, elective_hub_cat FROM kept_panel WHERE elective_hub_cat IN ('old', 'non_hub')",
)
def f13(spark, sf):
    kept = chain.kept_panel(spark, sf).filter(F.col("elective_hub_cat").isin("old", "non_hub"))
    return kept.select("PROCODE3", "month", "elective_hub_cat")


# ------------------------------------------------------------------------ joins


@query(
    "j01_left_join",
    "SELECT e.EPIKEY, a.imd_decile FROM episodes e LEFT JOIN area_deprivation a ON e.LSOA11 = a.LSOA11",
)
def j01(spark, sf):
    return proxy.episodes(spark, sf).join(proxy.area_deprivation(spark, sf), "LSOA11", "left").select("EPIKEY", "imd_decile")


@query(
    "j02_left_join_named_keys",
    f"SELECT PROCODE3, month, {rnd('catchment_cat', 'catchment_cat')} FROM activity",
)
def j02(spark, sf):
    counts = chain.elective(spark, sf).groupBy("PROCODE3", D.month_of("ADMIDATE").alias("month")).agg(F.count("*").alias("n"))
    return P.attach_catchment(counts, chain.features(spark, sf), proxy.LAST_REFERENCE_YEAR).select(
        "PROCODE3", "month", "catchment_cat"
    )


@query(
    "j03_left_join_expression",
    "SELECT a.PROCODE3, a.month, s.hub_start_date FROM activity a LEFT JOIN starts s ON a.PROCODE3 = s.trust_code",
)
def j03(spark, sf):
    from spellpanel.operators.treatment import earliest_start

    starts = earliest_start(proxy.unit_lookup(spark, sf))
    panel = _activity(spark, sf)
    return panel.join(starts, panel["PROCODE3"] == starts["trust_code"], "left").select("PROCODE3", "month", "hub_start_date")


_HALVES = """(SELECT PROCODE3, month, count(*) AS {n} FROM plain_spells WHERE {c} GROUP BY PROCODE3, month)"""


@query(
    "j04_full_join",
    f"""SELECT coalesce(a.PROCODE3, b.PROCODE3) AS PROCODE3, coalesce(a.month, b.month) AS month, n_day, n_stay
FROM {_HALVES.format(n='n_day', c='los = 0')} a FULL JOIN {_HALVES.format(n='n_stay', c='los IS DISTINCT FROM 0')} b
ON a.PROCODE3 = b.PROCODE3 AND a.month = b.month""",
)
def j04(spark, sf):
    spells = P.with_stay(chain.elective(spark, sf))

    def part(name, cond):
        return spells.filter(cond).groupBy("PROCODE3", "month").agg(F.count("*").alias(name))

    return Rel.join_null_safe(part("n_day", "los = 0"), part("n_stay", "NOT (los <=> 0)"), ["PROCODE3", "month"], "full")


@query(
    "j05_null_safe_full_join",
    """SELECT coalesce(a.PROCODE3, b.PROCODE3) AS PROCODE3, coalesce(a.month, b.month) AS month,
  round(coalesce(a.catchment_cat, b.catchment_cat), 6) + CAST(0 AS DOUBLE) AS catchment_cat, n_day, n_stay
FROM (SELECT x.*, c.catchment_cat FROM """
    + _HALVES.format(n="n_day", c="los = 0")
    + """ x LEFT JOIN features c ON x.PROCODE3 = c.trust_code AND least(year(x.month), 1999) = c.year) a
FULL JOIN (SELECT x.*, c.catchment_cat FROM """
    + _HALVES.format(n="n_stay", c="los IS DISTINCT FROM 0")
    + """ x LEFT JOIN features c ON x.PROCODE3 = c.trust_code AND least(year(x.month), 1999) = c.year) b
ON a.PROCODE3 IS NOT DISTINCT FROM b.PROCODE3 AND a.month IS NOT DISTINCT FROM b.month
  AND a.catchment_cat IS NOT DISTINCT FROM b.catchment_cat""",
)
def j05(spark, sf):
    spells = P.with_stay(chain.elective(spark, sf))
    features = chain.features(spark, sf)

    def part(name, cond):
        counts = spells.filter(cond).groupBy("PROCODE3", "month").agg(F.count("*").alias(name))
        return P.attach_catchment(counts, features, proxy.LAST_REFERENCE_YEAR).select("PROCODE3", "month", "catchment_cat", name)

    keys = ["PROCODE3", "month", "catchment_cat"]
    return Rel.join_null_safe(part("n_day", "los = 0"), part("n_stay", "NOT (los <=> 0)"), keys, "full")


@query("j06_semi_join", "SELECT id, ord, code FROM px_long WHERE id IN (SELECT id FROM elective)")
def j06(spark, sf):
    return C.keep_records(proxy.px_long(spark, sf), chain.elective(spark, sf))


@query("j07_restrict_to_list", "SELECT EPIKEY, PROCODE3 FROM episodes WHERE PROCODE3 IN (SELECT Procode FROM peer_units)")
def j07(spark, sf):
    listed = proxy.peer_units(spark, sf).select(F.col("Procode").alias("PROCODE3"))
    return proxy.episodes(spark, sf).select("EPIKEY", "PROCODE3").join(listed, "PROCODE3", "left_semi")


@query("j08_anti_join", "SELECT EPIKEY, PROCODE3 FROM episodes WHERE PROCODE3 NOT IN (SELECT PROCODE3 FROM exclude_units)")
def j08(spark, sf):
    return proxy.episodes(spark, sf).select("EPIKEY", "PROCODE3").join(proxy.exclude_units(spark, sf), "PROCODE3", "left_anti")


@query(
    "j09_colliding_columns",
    """SELECT coalesce(a.PROCODE3, b.PROCODE3) AS PROCODE3, a.n AS n_day, b.n AS n_stay
FROM (SELECT PROCODE3, count(*) AS n FROM plain_spells WHERE los = 0 GROUP BY PROCODE3) a
FULL JOIN (SELECT PROCODE3, count(*) AS n FROM plain_spells WHERE los IS DISTINCT FROM 0 GROUP BY PROCODE3) b ON a.PROCODE3 = b.PROCODE3""",
)
def j09(spark, sf):
    spells = P.with_stay(chain.elective(spark, sf))
    parts = {}
    for name, cond in (("n_day", "los = 0"), ("n_stay", "NOT (los <=> 0)")):
        parts[name] = spells.filter(cond).groupBy("PROCODE3").agg(F.count("*").alias("n")).withColumnRenamed("n", name)
    return Rel.join_null_safe(parts["n_day"], parts["n_stay"], ["PROCODE3"], "full")


@query(
    "j10_join_back_total",
    f"SELECT PROCODE3, month, {rnd('n_activity / sum(n_activity) OVER (PARTITION BY month)', 'share')} FROM activity",
)
def j10(spark, sf):
    return Rel.group_shares(_activity(spark, sf), ["month"], "n_activity", "share").select("PROCODE3", "month", "share")


@query(
    "j11_fan_out",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def j11(spark, sf):
    return Rel.fan_out(proxy.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------------- windows


@query(
    "w01_stable_sort",
    """SELECT EPIKEY, row_number() OVER (PARTITION BY TOKEN_PERSON_ID ORDER BY EPISTART NULLS LAST, EPIORDER NULLS LAST,
  EPIEND NULLS LAST, transit_nhsd, EPIKEY) AS place FROM flagged""",
)
def w01(spark, sf):
    order = ["EPISTART", "EPIORDER", "EPIEND", "transit_nhsd", "EPIKEY"]
    return Rel.row_in_group(chain.flagged(spark, sf), ["TOKEN_PERSON_ID"], order, "place").select("EPIKEY", "place")


@query("w02_lead_fill", "SELECT EPIKEY, disdate_for_spell FROM filled")
def w02(spark, sf):
    return chain.prepared(spark, sf).select("EPIKEY", "disdate_for_spell")


@query("w03_dense_group_id", "SELECT EPIKEY, dense_rank() OVER (ORDER BY TOKEN_PERSON_ID, PROCODET) AS gid FROM episodes")
def w03(spark, sf):
    e = proxy.episodes(spark, sf).select("EPIKEY", "TOKEN_PERSON_ID", "PROCODET")
    keys = ["TOKEN_PERSON_ID", "PROCODET"]
    return Rel.dense_group_id(e, keys, keys, "gid").select("EPIKEY", "gid")


@query("w04_row_number", "SELECT id, code, row_number() OVER (PARTITION BY id ORDER BY ord, code) AS num FROM px_long")
def w04(spark, sf):
    return C.number_codes(proxy.px_long(spark, sf)).select("id", "code", "num")


@query("w05_row_id", "SELECT EPIKEY, row_number() OVER (ORDER BY EPISTART, EPIKEY) AS row_id FROM episodes")
def w05(spark, sf):
    e = proxy.episodes(spark, sf).select("EPISTART", "EPIKEY")
    return Rel.with_position(e, ["EPISTART", "EPIKEY"], "row_id").select("EPIKEY", "row_id")


@query(
    "w06_group_share",
    f"""SELECT PROCODE3, month, {rnd('n_activity / sum(n_activity) OVER (PARTITION BY PROCODE3)', 'weight')} FROM activity""",
)
def w06(spark, sf):
    return Rel.group_shares(_activity(spark, sf), ["PROCODE3"], "n_activity", "weight").select("PROCODE3", "month", "weight")


_SUM7 = " + ".join(f"coalesce(n_activity_{s}, 0)" for s in SPECIALTIES)


@query(
    "w07_group_total",
    f"SELECT PROCODE3, month, {_SUM7} AS n_activity_hvlc FROM panel WHERE n_activity_hvlc IS NOT NULL",
)
def w07(spark, sf):
    panel = P.specialty_activity(chain.flagged_spells(spark, sf), chain.features(spark, sf), proxy.LAST_REFERENCE_YEAR)
    return panel.select("PROCODE3", "month", N.row_sum([f"n_activity_{s}" for s in SPECIALTIES]).alias("n_activity_hvlc"))


@query(
    "w08_group_minimum",
    "SELECT PROCODE3, month, min(month) OVER (PARTITION BY PROCODE3) AS first_month FROM activity",
)
def w08(spark, sf):
    w = Window.partitionBy("PROCODE3")  # at most one row per month
    return _activity(spark, sf).select("PROCODE3", "month", F.min("month").over(w).alias("first_month"))


_TIMED = """(SELECT i.PROCODE3, i.time, t.T0 FROM new_inputs i JOIN (SELECT PROCODE3, count(*) FILTER (WHERE intervention = 0) AS T0
  FROM new_inputs WHERE treated_unit = 1 GROUP BY PROCODE3) t ON i.PROCODE3 = t.PROCODE3)"""


def _timed(spark, sf):
    """Treated units of the staggered cohort with their own start."""
    from spellpanel.operators.treatment import model_inputs

    panel = stage_large(chain.kept_panel(spark, sf), "panel")
    new = model_inputs(panel, proxy.unit_lookup(spark, sf), "new", proxy.CALENDAR).filter("treated_unit = 1")
    starts = new.groupBy("PROCODE3").agg(F.count_if(F.col("intervention") == 0).alias("T0"))
    return new.join(starts, "PROCODE3")


@query(
    "w09_event_time",
    f"SELECT PROCODE3, time, CASE WHEN time <= T0 THEN time - T0 - 1 ELSE time - T0 END AS event_time FROM {_TIMED}",
)
def w09(spark, sf):
    return _timed(spark, sf).select("PROCODE3", "time", I.event_time().alias("event_time"))


@query(
    "w10_reverse_pre_period",
    f"SELECT PROCODE3, time, row_number() OVER (PARTITION BY PROCODE3 ORDER BY time DESC) AS back FROM {_TIMED} WHERE time <= T0",
)
def w10(spark, sf):
    pre = _timed(spark, sf).filter("time <= T0")
    return pre.select("PROCODE3", "time", (-I.event_time()).alias("back"))


@query(
    "w11_relative_weights",
    f"""SELECT model, unit, time, {rnd('w / sum(w) OVER (PARTITION BY model, period, event_time)', 'w_time')},
  {rnd('w / sum(w) OVER (PARTITION BY model, period, unit)', 'w_unit')} FROM staggered""",
)
def w11(spark, sf):
    kept, fit = chain.fit(spark, sf)
    cells = I.with_weights(I.stagger(fit["fit_cells"], fit["fit_units"]), kept)
    return I.relative_weights(cells).select("model", "unit", "time", "w_time", "w_unit")


@query("w12_draw_counterfactual", f"SELECT model, unit, time, draw, {rnd('ct', 'ct')} FROM draws")
def w12(spark, sf):
    _, fit = chain.fit(spark, sf)
    cells = stage(I.stagger(fit["fit_cells"], fit["fit_units"]), "staggered")
    return I.stagger_draws(chain.repeatable_draws(fit["fit_cells"]), cells).select("model", "unit", "time", "draw", "ct")


@query("w13_still_observed", "SELECT model, event_time, n_observed FROM observed")
def w13(spark, sf):
    _, fit = chain.fit(spark, sf)
    cells = I.stagger(fit["fit_cells"], fit["fit_units"])
    return I.still_observed(fit["fit_units"], fit["fit_meta"], cells)


# ------------------------------------------------------- sort, sets and reshapes


@query("k01_order_by", "SELECT EPIKEY, TOKEN_PERSON_ID, EPISTART FROM flagged ORDER BY TOKEN_PERSON_ID, EPISTART, EPIKEY")
def k01(spark, sf):
    return chain.flagged(spark, sf).select("EPIKEY", "TOKEN_PERSON_ID", "EPISTART").orderBy(
        *N.nulls_last(["TOKEN_PERSON_ID", "EPISTART", "EPIKEY"])
    )


@query("k02_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def k02(spark, sf):
    return Tab.preview(proxy.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query(
    "k03_top_per_group",
    "SELECT PROCODE3, min(EPISTART || EPIKEY) AS first_key, max(EPISTART || EPIKEY) AS last_key FROM finished GROUP BY PROCODE3",
)
def k03(spark, sf):
    key = F.concat(F.col("EPISTART").cast("string"), "EPIKEY")
    by = F.struct("EPISTART", "EPIKEY")
    return _finished(spark, sf).groupBy("PROCODE3").agg(
        F.min_by(key, by).alias("first_key"), F.max_by(key, by).alias("last_key")
    )


@query(
    "k04_contiguity",
    f"""SELECT PROCODE3, max(i) - min(i) + 1 = count(*) AS contiguous FROM (
  SELECT PROCODE3, CASE WHEN month <= DATE '1997-12-01' THEN datediff('month', DATE '1995-01-01', month) + 1
    ELSE datediff('month', DATE '1999-01-01', month) + 37 END AS i FROM activity WHERE {IN_STUDY}) GROUP BY PROCODE3""",
)
def k04(spark, sf):
    panel = _activity(spark, sf).filter(proxy.CALENDAR.contains("month")).withColumn("i", proxy.CALENDAR.index("month"))
    return panel.groupBy("PROCODE3").agg((F.max("i") - F.min("i") + 1 == F.count("*")).alias("contiguous"))


@query("u01_row_bind", "SELECT EPIKEY, PROCODE3 FROM episodes_with_copies")
def u01(spark, sf):
    return proxy.episodes(spark, sf, copies=True).select("EPIKEY", "PROCODE3")


@query("u02_bind_levels", "SELECT model, level, count(*) AS n FROM levels GROUP BY model, level")
def u02(spark, sf):
    kept, fit = chain.fit(spark, sf)
    cells = stage(I.with_weights(I.stagger(fit["fit_cells"], fit["fit_units"]), kept), "staggered")
    rows = I.level_estimates(cells, True, I.KeyWindow.of(range(1, 7)))
    return rows.groupBy("model", "level").agg(F.count("*").alias("n"))


@query("u03_union_years", "SELECT id, ord, code FROM dx_long")
def u03(spark, sf):
    long = proxy.dx_long(spark, sf)
    last = F.substring(F.col("id"), -1, 1).cast("int")
    return C.union_years([long.filter(last % 3 == k) for k in range(3)])


@query(
    "u04_set_difference",
    "SELECT PROCODE3 FROM (SELECT DISTINCT PROCODE3 FROM episodes EXCEPT SELECT PROCODE3 FROM exclude_units)",
)
def u04(spark, sf):
    return proxy.episodes(spark, sf).select("PROCODE3").distinct().exceptAll(proxy.exclude_units(spark, sf))


@query(
    "r01_long_to_wide",
    "SELECT id, "
    + ", ".join(f"max(CASE WHEN num = {i} THEN code END) AS code_{i}" for i in range(1, 24))
    + " FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord, code) AS num FROM px_long) GROUP BY id",
)
def r01(spark, sf):
    return C.codes_wide(proxy.px_long(spark, sf), 23, "code_")


@query("r02_codes_to_text", "SELECT id, codes FROM px_text")
def r02(spark, sf):
    arrays = C.code_arrays(proxy.px_long(spark, sf))
    return arrays.select("id", F.concat_ws(",", "codes").alias("codes"))


@query("r03_primary_first", "SELECT id, split_part(tnrprocall, ',', 1) AS first_code, OPERTN_01 FROM coded")
def r03(spark, sf):
    return chain.coded(spark, sf).select("id", F.split("tnrprocall", ",").getItem(0).alias("first_code"), "OPERTN_01")


_WIDE = ["n_activity", "el_rate"]


@query(
    "r04_wide_to_long",
    " UNION ALL ".join(
        f"SELECT PROCODE3, month, '{c}' AS measure, {rnd(c, 'value')} FROM activity WHERE {c} IS NOT NULL" for c in _WIDE
    ),
)
def r04(spark, sf):
    wide = _activity(spark, sf).select("PROCODE3", "month", *[F.col(c).cast("double").alias(c) for c in _WIDE])
    return wide.unpivot(["PROCODE3", "month"], _WIDE, "measure", "value").filter("value is not null")


# Units of the panel in the test data; a fixed list, so that no job runs while the plan is built.
_PANEL_UNITS = [f"R{k:02d}" for k in range(25) if k % 8 != 7]


@query(
    "r05_long_to_panel",
    "SELECT month, " + ", ".join(f"max(n_activity) FILTER (WHERE PROCODE3 = '{u}') AS {u}" for u in _PANEL_UNITS)
    + " FROM activity GROUP BY month",
)
def r05(spark, sf):
    return _activity(spark, sf).groupBy("month").pivot("PROCODE3", _PANEL_UNITS).agg(F.max("n_activity"))


@query(
    "r06_keyed_table",
    f"""SELECT split_part(model, '|', 1) AS cohort, split_part(model, '|', 2) AS activity, split_part(model, '|', 3) AS outcome,
  count(*) AS n, {rnd('avg(y)', 'mean_y')} FROM cells GROUP BY model""",
)
def r06(spark, sf):
    part = F.split("model", r"\|")
    return chain.cells(spark, sf).groupBy(
        part.getItem(0).alias("cohort"), part.getItem(1).alias("activity"), part.getItem(2).alias("outcome")
    ).agg(F.count("*").alias("n"), F.avg("y").alias("mean_y"))


# ------------------------------------------------------------- scalar functions


@query("x01_pattern_search", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE regexp_matches(o_orderpriority, 'H|LOW') GROUP BY ALL")
def x01(spark, sf):
    hit = N.matches("o_orderpriority", "H|LOW")
    return proxy.table(spark, sf, "orders").filter(hit).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "x02_substitute",
    r"SELECT EPIKEY, regexp_replace(EPIKEY, '^([0-9]+)-([0-9]+)-(.*)$', '\2:\1') AS swapped FROM episodes",
)
def x02(spark, sf):
    swapped = F.regexp_replace("EPIKEY", r"^([0-9]+)-([0-9]+)-(.*)$", "$2:$1")
    return proxy.episodes(spark, sf).select("EPIKEY", swapped.alias("swapped"))


@query(
    "x03_columns_by_pattern",
    " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n FROM core_panel" for c in ("los_avg", "dc", "el_rate")),
)
def x03(spark, sf):
    panel = chain.overall_panel(spark, sf)
    names = [c for c in panel.columns if X.measure_first(c) != c or c in ("dc", "los_avg", "el_rate")]
    counts = F.array(*[F.struct(F.lit(c).alias("name"), F.count(c).alias("n")) for c in names])
    return panel.agg(counts.alias("a")).select(F.inline("a"))


@query("x04_concatenate", "SELECT EPIKEY, TOKEN_PERSON_ID || '_' || EPIKEY AS id FROM episodes")
def x04(spark, sf):
    return proxy.episodes(spark, sf).select("EPIKEY", X.concat_key(F.col("TOKEN_PERSON_ID"), F.col("EPIKEY")).alias("id"))


@query(
    "x05_format_numbers",
    "SELECT l_linenumber, lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS padded, count(*) AS n FROM lineitem GROUP BY ALL",
)
def x05(spark, sf):
    padded = F.format_string("%03d", "l_linenumber")
    return proxy.table(spark, sf, "lineitem").groupBy("l_linenumber", padded.alias("padded")).agg(F.count("*").alias("n"))


@query("x06_starts_with", "SELECT PROCODE3, starts_with(PROCODE3, 'R') AS kept, count(*) AS n FROM episodes GROUP BY ALL")
def x06(spark, sf):
    kept = F.col("PROCODE3").startswith("R").alias("kept")
    return proxy.episodes(spark, sf).groupBy("PROCODE3", kept).agg(F.count("*").alias("n"))


@query(
    "x07_parse_date",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(NULL AS DATE) AS unreadable FROM orders""",
)
def x07(spark, sf):
    text = F.date_format("o_orderdate", "dd/MM/yyyy")
    return proxy.table(spark, sf, "orders").select(
        "o_orderkey", D.parse_date(text, "dd/MM/yyyy").alias("day"), D.parse_date(F.concat(text, F.lit("x"))).alias("unreadable")
    )


@query("x08_format_date", "SELECT strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS m, count(*) AS n FROM orders GROUP BY ALL")
def x08(spark, sf):
    o = proxy.table(spark, sf, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy").alias("y"), F.date_format("o_orderdate", "MM").alias("m")).agg(
        F.count("*").alias("n")
    )


@query("x09_date_difference", "SELECT EPIKEY, DISDATE - ADMIDATE AS los FROM finished WHERE DISDATE IS NOT NULL")
def x09(spark, sf):
    kept = _finished(spark, sf).filter("DISDATE is not null")
    return kept.select("EPIKEY", D.stay_days("ADMIDATE", "DISDATE").alias("los"))


@query(
    "x10_month_sequence",
    """SELECT PROCODE3, CAST(m AS DATE) AS month FROM (SELECT DISTINCT PROCODE3 FROM episodes),
  (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1997-12-01', INTERVAL 1 MONTH)) AS m
   UNION ALL SELECT unnest(generate_series(TIMESTAMP '1999-01-01', TIMESTAMP '2001-07-01', INTERVAL 1 MONTH)))""",
)
def x10(spark, sf):
    units = proxy.episodes(spark, sf).select("PROCODE3").distinct()
    return units.select("PROCODE3", F.explode(proxy.CALENDAR.months()).alias("month"))


@query("x11_missing", "SELECT PROCODE3, count(*) FILTER (WHERE DISDATE IS NULL) AS n_missing FROM episodes GROUP BY PROCODE3")
def x11(spark, sf):
    return proxy.episodes(spark, sf).groupBy("PROCODE3").agg(F.count_if(F.col("DISDATE").isNull()).alias("n_missing"))


@query("x12_cast", "SELECT ADMIMETH, TRY_CAST(ADMIMETH AS INT) AS method, count(*) AS n FROM episodes GROUP BY ALL")
def x12(spark, sf):
    method = F.col("ADMIMETH").try_cast("int").alias("method")
    return proxy.episodes(spark, sf).groupBy("ADMIMETH", method).agg(F.count("*").alias("n"))


@query(
    "x13_cap",
    "SELECT id, CASE WHEN los IS NULL THEN NULL ELSE least(los, 37) END AS los_new FROM plain_spells",
)
def x13(spark, sf):
    return P.with_stay(chain.elective(spark, sf)).select("id", N.cap_at("los", P.STAY_CAP).alias("los_new"))


@query(
    "x14_arithmetic",
    f"SELECT l_orderkey, l_linenumber, l_partkey, {rnd('abs(least(l_discount, l_tax) - l_quantity)', 'v')} FROM lineitem",
)
def x14(spark, sf):
    v = F.abs(F.least("l_discount", "l_tax") - F.col("l_quantity"))
    return proxy.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", v.alias("v"))


_PRICE = "avg(o_totalprice) AS m, stddev_samp(o_totalprice) / sqrt(count(*)) AS se"


@query(
    "x15_normal_quantile",
    f"""SELECT o_orderpriority, {rnd('m - 1.959963984540054::DOUBLE * se', 'lower')},
  {rnd('m + 1.959963984540054::DOUBLE * se', 'upper')}
FROM (SELECT o_orderpriority, {_PRICE} FROM orders GROUP BY o_orderpriority)""",
)
def x15(spark, sf):
    o = proxy.table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.avg("o_totalprice").alias("m"), (F.stddev_samp("o_totalprice") / F.sqrt(F.count(F.lit(1)))).alias("se")
    )
    z = F.lit(z_value(0.05))
    return o.select(
        "o_orderpriority", (F.col("m") - z * F.col("se")).alias("lower"), (F.col("m") + z * F.col("se")).alias("upper")
    )


@query(
    "x16_normal_tail",
    f"""SELECT o_orderkey, {rnd('''((((1.061405429::DOUBLE * t + -1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t
  + -0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-x * x)''', 'p')}
FROM (SELECT o_orderkey, x, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM (
  SELECT o_orderkey, abs(o_totalprice - 250000) / 100000 / sqrt(2::DOUBLE) AS x FROM orders))""",
)
def x16(spark, sf):
    z = (F.col("o_totalprice") - 250000) / 100000
    return proxy.table(spark, sf, "orders").select("o_orderkey", two_sided_p(z).alias("p"))


@query(
    "x17_sequences",
    "SELECT model, unit, unnest(range(-T0, 0)) AS back FROM units",
)
def x17(spark, sf):
    units = E.fit_units(chain.eligible(spark, sf))
    return units.select("model", "unit", F.explode(F.sequence(-F.col("T0"), F.lit(-1))).alias("back"))


@query(
    "x18_recode",
    "SELECT CASE s "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SPECIALTY_NAMES.items())
    + " END AS specialty, CASE s "
    + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(SPECIALTY_NAMES, 1))
    + " END AS place, n FROM ("
    + " UNION ALL ".join(f"SELECT '{s}' AS s, count(*) FILTER (WHERE {s}) AS n FROM specialties" for s in SPECIALTIES)
    + ")",
)
def x18(spark, sf):
    flagged = chain.pathways(spark, sf)
    rows = F.array(
        *[
            F.struct(F.lit(SPECIALTY_NAMES[s]).alias("specialty"), F.lit(i).alias("place"), F.count_if(F.col(s)).alias("n"))
            for i, s in enumerate(SPECIALTIES, 1)
        ]
    )
    return flagged.agg(rows.alias("r")).select(F.inline("r"))
