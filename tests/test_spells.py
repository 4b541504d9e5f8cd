import datetime as dt

from pyspark.sql import functions as F

from spellpanel.operators import relational as Rel
from spellpanel.operators import spells as S
from spellpanel.sources import proxy

SCHEMA = (
    "TOKEN_PERSON_ID string, EPIKEY string, PROCODET string, ADMIDATE date, EPISTART date, EPIEND date, "
    "EPIORDER int, EPISTAT int, DISDATE date, ADMIMETH string, ADMISORC string, DISDEST string"
)


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def episode(person, key, provider="R01", adm=0, start=0, end=1, order=1, stat=3, dis=None, method="11", source="19", dest="19"):
    return (
        person, key, provider, None if adm is None else day(adm), day(start), day(end), order, stat,
        dis if isinstance(dis, dt.date) or dis is None else day(dis), method, source, dest,
    )


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_transfer_flag_arms(spark):
    rows = [
        ("19", "11", "52", 1), ("51", "11", "52", 1), ("19", "81", "84", 1), ("51", "81", "52", 2),
        ("87", "11", "19", 3), ("19", "2B", None, 3), ("19", "11", None, 0), (None, None, "49", 1),
    ]
    df = spark.createDataFrame(rows, "ADMISORC string, ADMIMETH string, DISDEST string, want int")
    assert S.transfer_flag(df).filter("transit_nhsd <> want").count() == 0


def test_fill_uses_only_the_next_row_of_the_same_admission(spark):
    df = frame(
        spark,
        episode("a", "1", start=0, dis=None), episode("a", "2", start=1, dis=5),  # filled
        episode("b", "1", start=0, dis=None), episode("b", "2", start=1, dis=None), episode("b", "3", start=2, dis=9),
        episode("c", "1", start=0, dis=None), episode("c", "2", start=1, provider="R02", dis=5),
        episode("d", "1", start=0, dis=None), episode("d", "2", start=1, adm=1, dis=5),
        episode("e", "1", start=0, dis=dt.date(1801, 1, 1)), episode("e", "2", start=1, dis=7),
        episode("f", "1", start=0, dis=None), episode("g", "1", start=1, dis=7),
    )
    got = {
        (r["TOKEN_PERSON_ID"], r["EPIKEY"]): r["disdate_for_spell"] for r in S.prepared_episodes(df).collect()
    }
    assert got[("a", "1")] == day(5)
    assert got[("b", "1")] is None and got[("b", "2")] == day(9)  # no chaining
    assert got[("c", "1")] is None and got[("d", "1")] is None and got[("f", "1")] is None
    assert got[("e", "1")] == day(7)


def test_only_finished_episodes_with_admission(spark):
    df = frame(spark, episode("a", "1", stat=1), episode("a", "2", adm=None), episode("a", "3"))
    assert [r["EPIKEY"] for r in S.finished_episodes(df).collect()] == ["3"]


def test_dedup_keeps_lowest_key(spark):
    df = S.transfer_flag(frame(spark, episode("a", "2"), episode("a", "1"), episode("a", "3", order=2)))
    assert sorted(r["EPIKEY"] for r in S.dedup_episodes(df).collect()) == ["1", "3"]
    assert sorted(r["EPIKEY"] for r in S.prepared_episodes(frame(spark, episode("a", "2"), episode("a", "1"))).collect()) == ["1"]


def test_spell_takes_first_episode_and_span(spark):
    df = frame(
        spark,
        episode("a", "x", start=3, end=9, order=2, dis=9), episode("a", "y", start=0, end=4, order=1, dis=9),
        episode("b", "z", dis=2),
    )
    spells = {r["TOKEN_PERSON_ID"]: r for r in S.build_spells(df).collect()}
    assert (spells["a"]["EPIKEY"], spells["a"]["spellstartdate"], spells["a"]["spellenddate"]) == ("y", day(0), day(9))
    assert {r["spell_id"] for r in spells.values()} == {1, 2}
    assert spells["a"]["spell_id"] == 1 and spells["a"]["admmnth"] == "01"


def test_crowded_persons_give_the_same_spells(spark, small):
    """Slicing a person's rows must not change anything."""
    episodes = proxy.spell_inputs(spark, small)
    usual, sliced = S.prepared_episodes(episodes), S.prepared_episodes(episodes, 3)
    assert usual.count() == 4670
    assert usual.exceptAll(sliced.select(usual.columns)).isEmpty()
    a, b = S.build_spells(episodes), S.build_spells(episodes, max_rows_per_person=3)
    assert a.count() == b.count() == 3788
    assert a.exceptAll(b.select(a.columns)).isEmpty()


def test_one_person_holding_a_third_of_all_rows(spark, small):
    episodes = proxy.spell_inputs(spark, small).withColumn(
        "TOKEN_PERSON_ID",
        F.when(F.xxhash64("EPIKEY") % 3 == 0, F.lit("1")).otherwise(F.col("TOKEN_PERSON_ID")),
    )
    a, b = S.build_spells(episodes), S.build_spells(episodes, max_rows_per_person=100)
    assert a.exceptAll(b.select(a.columns)).isEmpty() and a.count() == b.count()


def test_headline_counts(spark, small):
    e = proxy.spell_inputs(spark, small)
    flags = {r[0]: r[1] for r in S.transfer_flag(S.finished_episodes(e)).groupBy("transit_nhsd").count().collect()}
    assert flags == {0: 762, 1: 1956, 2: 440, 3: 1512}
    p = S.prepared_episodes(e)
    assert p.filter("disdate is null and disdate_for_spell is not null").count() == 40


def test_spell_ids_are_dense_and_constant_within_key(spark, small):
    prepared = S.prepared_episodes(proxy.spell_inputs(spark, small))
    ids = S.assign_spells(prepared)
    n = ids.agg(F.max("spell_id"), F.count_distinct("spell_id")).first()
    assert tuple(n) == (3788, 3788)
    assert ids.groupBy(*S.SPELL_KEY).agg(F.count_distinct("spell_id").alias("n")).filter("n > 1").isEmpty()
    built = S.build_spells(proxy.spell_inputs(spark, small)).select("EPIKEY", "spell_id")
    assert built.exceptAll(ids.select("EPIKEY", "spell_id")).isEmpty()
    summary = S.spell_summary(ids)
    assert summary.filter("spellstartdate > spellenddate").isEmpty() and summary.count() == 3788


def test_enrich_and_restrict(spark):
    spells = S.build_spells(frame(spark, episode("a", "1"), episode("b", "2", method="21")).withColumn("SUSRECID", F.col("EPIKEY")))
    extra = spark.createDataFrame([("1", 30), ("2", 40), ("3", 50)], "SUSRECID string, STARTAGE int")
    out = S.enrich_spells(spells, extra)
    assert sorted((r["id"], r["STARTAGE"]) for r in out.collect()) == [("a_1", 30), ("b_2", 40)]
    assert [r["id"] for r in S.restrict_elective_adult(out).collect()] == ["a_1"]


def test_plan_moves_rows_once(spark, small):
    """One exchange by person serves de-duplication, fill and spells."""
    df = S._prepare_by_person(S._ready(proxy.spell_inputs(spark, small)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(TOKEN_PERSON_ID") == 1
    spells = S.build_spells(proxy.spell_inputs(spark, small), with_ids=False)
    plan = spells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(TOKEN_PERSON_ID")
    assert Rel.keys_over(proxy.spell_inputs(spark, small), "TOKEN_PERSON_ID", 10_000) is None
