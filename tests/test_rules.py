import pytest
from pyspark.sql import functions as F

from spellpanel.functions import text as X
from spellpanel.operators import codes as C
from spellpanel.operators.recipes import RECIPES, SPECIALTIES, build_recipes
from spellpanel.operators.rules import compile_rule, flag_recipes, flag_recipes_long
from spellpanel.plans import chain
from spellpanel.sources import proxy

SCHEMA = "id string, OPERTN_01 string, DIAG_01 string, MAINSPEF string, TRETSPEF string, tnrprocall string, tnrdiagall string"
BY_NAME = {r.name: r for r in RECIPES}


def flag(spark, name, prim=None, pdiag=None, main=None, treat=None, procs="", diags="", recipes=BY_NAME):
    df = spark.createDataFrame([("1", prim, pdiag, main, treat, procs, diags)], SCHEMA)
    return df.select(compile_rule(recipes[name].rule).alias("f")).first()["f"]


# one positive and one excluded record per pathway: (fields, fields that break it)
CASES = {
    "ort_aclr": (dict(prim="W742", procs="W742,Z846"), dict(procs="W742")),
    "ort_thr": (dict(prim="W521", procs="W521,Z843"), dict(diags="C402")),
    "ort_tkr": (dict(prim="W401", procs="W401"), dict(procs="W401,Y035")),
    "ort_ukr": (dict(prim="W581", procs="W581,Z132"), dict(procs="W581")),
    "ort_bs": (dict(procs="W151"), dict(procs="W154")),
    "ort_tsa": (dict(prim="T645", procs="T645,Z544,Y767"), dict(procs="T645,Z544")),
    "opht_lccs": (dict(procs="C712,C751"), dict(procs="C712,C751,C801")),
    "gs_lc": (dict(prim="J183", procs="J183,Y752"), dict(procs="J183,Y752,J182")),
    "gs_pihr": (dict(procs="T201"), dict(diags="C570")),
    "gs_puh": (dict(prim="T249"), dict(prim="T244")),
    "uro_boo": (dict(prim="M655", main="101"), dict(main="100", treat="300")),
    "uro_btr": (dict(prim="M421", treat="211"), dict(prim="M422")),
    "uro_cp": (dict(prim="M814", treat="101"), dict(prim="M815")),
    "uro_usm": (dict(prim="M071", treat="211"), dict(prim="M073")),
    "uro_mpss": (dict(prim="N084", treat="211"), dict(prim="N085")),
    "ent_ess": (dict(prim="E081", main="120", procs="E081,Y761"), dict(procs="E081,Y761,C321")),
    "ent_tons": (dict(prim="F341", main="120"), dict(procs="F341,F346")),
    "ent_mir": (dict(prim="D149", treat="215"), dict(procs="D149,Z132")),
    "ent_sts": (dict(prim="E049", treat="120"), dict(prim="E050")),
    "ent_srp": (dict(prim="E073", treat="120"), dict(treat="110", main="110")),
    "gm_ol": (dict(prim="Q391", main="500"), dict(diags="C541")),
    "gm_lh": (dict(procs="Q071,Y752", treat="503"), dict(procs="Q071")),
    "gm_ea": (dict(procs="Q176", main="502"), dict(diags="D06")),
    "gm_hs": (dict(prim="Q181", main="502"), dict(procs="Q181,Q413")),
    "gm_vh": (dict(procs="P231", main="502"), dict(main="501")),
    "spn_ld": (dict(procs="V351,Z063"), dict(procs="V351,Z063,V553")),
    "spn_pfs1": (dict(procs="V351,Z063,V251"), dict(procs="V351,Z063")),
    "spn_csd": (dict(procs="V368,Z991"), dict(procs="V368,Z991,V411")),
    "spn_lmbb": (dict(prim="V544"), dict(prim="V545")),
    "spn_lnrb": (dict(prim="A735", procs="A735,Z073"), dict(procs="A735")),
    "spn_pfs2": (dict(procs="V404"), dict(procs="V404,V261")),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_pathway(spark, name):
    good, broken = CASES[name]
    assert flag(spark, name, **good) is True
    assert flag(spark, name, **{**good, **broken}) is False


def test_every_pathway_has_a_case():
    assert set(CASES) == set(BY_NAME) and len(RECIPES) == 31


def test_equality_gives_null_and_membership_false(spark):
    assert flag(spark, "spn_lmbb") is None
    assert flag(spark, "uro_btr", treat="211") is None
    assert flag(spark, "ort_aclr") is False
    assert flag(spark, "spn_lnrb") is False  # missing == code, but no Z07 either
    assert flag(spark, "ort_ukr", procs="Z845") is None


def test_missing_main_specialty_can_be_rescued(spark):
    assert flag(spark, "uro_btr", prim="M421", main=None, treat="101") is True
    assert flag(spark, "uro_btr", prim="M421", main=None, treat="300") is None


def test_precedence_of_unbracketed_rules(spark):
    assert flag(spark, "spn_pfs1", procs="V252,V553") is True  # exclusion binds to the second arm only
    assert flag(spark, "spn_lnrb", prim="A521") is True


def test_anchor_binds_to_first_branch(spark):
    assert flag(spark, "gm_ol", prim="XQ49", main="500") is True
    assert flag(spark, "gm_ol", prim="XQ39", main="500") is False


def test_corrected_rules_search_diagnoses(spark):
    fixed = {r.name: r for r in build_recipes(corrected=True)}
    cancer = dict(prim="F341", main="120", procs="F341", diags="C321")
    assert flag(spark, "ent_tons", **cancer) is True
    assert flag(spark, "ent_tons", recipes=fixed, **cancer) is False
    # the code without its letter matches any procedure that contains it
    assert flag(spark, "ent_mir", prim="D141", main="120", procs="D141,Z132") is False
    assert flag(spark, "ent_mir", recipes=fixed, prim="D141", main="120", procs="D141,Z132") is True


def test_text_and_long_forms_agree(spark, small):
    records, dx, px = (f(spark, small) for f in (proxy.coded_records, proxy.dx_long, proxy.px_long))
    shown = ["id", *[r.name for r in RECIPES], *SPECIALTIES, "hvlc"]
    a = flag_recipes(C.attach_codes(records, dx, px), RECIPES, keep_pathways=True).select(shown)
    b = flag_recipes_long(records, dx, px, RECIPES, keep_pathways=True).select(shown)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()
    assert "ort_thr" not in flag_recipes(C.attach_codes(records, dx, px), RECIPES).columns


def test_a_record_with_a_third_of_all_codes(spark, small):
    px = proxy.px_long(spark, small)
    hot = px.withColumn("id", F.when(F.xxhash64("ord") % 3 == 0, F.lit("hot")).otherwise(F.col("id")))
    brute = hot.groupBy("id").agg(F.bool_or(F.col("code").rlike("W05|Y713")).alias("x"), F.bool_or(F.col("code").rlike("Z")).alias("y"))
    assert C.code_hits(hot, {"x": "W05|Y713", "y": "Z"}).exceptAll(brute).isEmpty()
    assert C.number_codes(hot, None).exceptAll(C.number_codes(hot, 50).select("id", "ord", "code", "num")).isEmpty()


def test_more_patterns_than_one_mask_holds(spark, small):
    px = proxy.px_long(spark, small)
    names = {f"p{i}": code for i, code in enumerate(proxy.PROCEDURES * 2)}
    got = C.code_hits(px, names)
    brute = px.groupBy("id").agg(*[F.bool_or(F.col("code").rlike(p)).alias(n) for n, p in names.items()])
    assert got.exceptAll(brute).isEmpty() and len(got.columns) == 123


def test_code_list_filter(spark, small):
    records = chain.coded(spark, small).select("id", "tnrprocall")
    listed = proxy.code_list(spark, small).unionByName(spark.createDataFrame([("",), (None,)], "intermediate string"))
    records = records.unionByName(records.withColumn("id", F.lit(None).cast("string")).limit(50))
    got = C.filter_by_code_list(records, listed)
    pattern = "|".join(X.clean_codes(r[0] for r in listed.collect()))
    brute = records.filter(F.col("tnrprocall").rlike(pattern))
    assert got.count() == brute.count() > 0
    assert got.exceptAll(brute).isEmpty()


def test_codes_wide(spark):
    long = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "id string, ord int, code string")
    wide = {r["id"]: r for r in C.codes_wide(long, 3, "c").collect()}
    assert (wide["a"]["c1"], wide["a"]["c2"], wide["a"]["c3"], wide["b"]["c1"]) == ("x", "y", None, "z")
    records = spark.createDataFrame([("a", "P", None), ("c", None, "D")], "id string, OPERTN_01 string, DIAG_01 string")
    full = {r["id"]: r for r in C.attach_codes(records, long, long).collect()}
    assert full["a"]["tnrprocall"] == "P,x,y" and full["a"]["tnrdiagall"] == "x,y"
    assert full["c"]["tnrprocall"] == "" and full["c"]["tnrdiagall"] == "D"
    with pytest.raises(Exception, match="more than 1 values"):
        C.codes_wide(long, 1, "c").collect()


def test_code_text_helpers(spark):
    assert X.expand_codes("M653-M655 N081-N082 132") == ["M653", "M654", "M655", "N081", "N082", "132"]
    assert X.code_range("M", 71, 72) == ["M071", "M072"]
    assert X.clean_codes(["b", None, "", "a", "b"]) == ["a", "b"]
    assert X.name_product(["a", "b"], ["x"]) == ["a_x", "b_x"]
    names = {"rate_ort": "ort_rate", "los_avg_ort": "ort_los.ip_avg", "dc_prop_elect": "elect_los.dc_ratio",
             "elective_hub_cat": "cat_elective_hub", "n_activity": "n_activity", "sex_male_pct_ec": "sex_male_pct_ec"}
    assert {k: X.measure_first(k) for k in names} == names
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "el_rate double, los_avg double, dc double, hvlc_rate double")
    assert X.rename_measures(df).columns == ["elect_rate", "elect_los.ip_avg", "elect_los.dc_ratio", "hvlc_rate"]
    labels = spark.createDataFrame([(1.26,), (0.0,), (-3.04,)], "v double").select(X.signed_percent(F.col("v")).alias("l"))
    assert [r["l"] for r in labels.collect()] == ["+1.3%", "0.0%", "-3.0%"]


def test_no_percent_label_without_a_value(spark):
    labels = spark.createDataFrame([(1, None), (2, 0.04)], "k int, v double").select("k", X.signed_percent(F.col("v")).alias("l"))
    assert dict(labels.collect()) == {1: None, 2: "+0.0%"}
