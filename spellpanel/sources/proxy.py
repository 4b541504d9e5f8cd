"""Stand-in inputs derived from the star-schema test tables.

Each function mirrors one input table of the engine (see FIXTURES.md), so every
operator can run on the test data at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spellpanel.functions.dates import StudyCalendar
from spellpanel.sources.tables import EPISODE_COLUMNS

CALENDAR = StudyCalendar("1995-01-01", "1997-12-01", "1999-01-01", "2001-07-01")
LAST_REFERENCE_YEAR = 1999
PANEL_FROM = "1995-01-01"

# Procedure and diagnosis codes assigned to lines.
PROCEDURES = (
    "W723 W742 Z845 W371 W379 W521 Z843 Y713 W401 W411 W581 Z132 W791 W151 W781 O291 "
    "Y767 W844 Z812 T645 Z544 C71 C751 C647 J181 Y752 J182 T201 T209 T240 M651 M421 "
    "M451 M071 N303 M731 E132 Y761 F341 D141 E036 E023 Q201 Q39 Q07 Y751 Q162 Q161 "
    "Q18 Q08 P22 V252 V351 Z063 V262 V251 V221 V544 A521 A735 Z07"
).split()
DIAGNOSES = (
    "C402 M932 C400 F00 H200 C56 C570 C51 D06 K409 K429 H251 M170 M161 J342 N359 N201 "
    "N920 M511 Z966"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, values: list[str]) -> Column:
    """Entry ``index`` (0-based) of a literal list."""
    return F.element_at(F.split(F.lit(",".join(values)), ","), (index + 1).cast("int"))


def unit_code(nation: Column) -> Column:
    return F.concat(
        F.when(nation % 8 == 7, "N").otherwise("R"), F.lpad(nation.cast("string"), 2, "0")
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with order and supplier attributes: the base of the episode proxy."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey)


def _pick(index: str, values: list[str]) -> str:
    """SQL for entry ``index`` (0-based) of a literal list."""
    return f"element_at(split('{','.join(values)}', ','), cast(1 + {index} as int))"


_LINE_KEY = (
    "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), "
    "cast(l_suppkey as string), cast(cast(round(l_extendedprice * 100) as bigint) as string))"
)
_ORDER_DAY = "cast(o_orderdate as date)"
_SHIP_DAY = "cast(l_shipdate as date)"
_ETHNIC = "substr('ABCDEFGHZ', cast(1 + o_custkey % 9 as int), 1)"

# Episode columns over the joined lines (see FIXTURES.md), and columns carried
# through without being read.
EPISODE_FIELDS = {
    "TOKEN_PERSON_ID": "cast(o_custkey as string)",
    "EPIKEY": _LINE_KEY,
    "SUSRECID": _LINE_KEY,
    "PROCODET": "concat('R', lpad(cast(s_nationkey % 5 as string), 2, '0'))",
    "PROCODE3": "concat(if(s_nationkey % 8 = 7, 'N', 'R'), lpad(cast(s_nationkey as string), 2, '0'))",
    "ADMIDATE": f"if(o_orderkey % 97 = 0, null, {_ORDER_DAY})",
    "EPISTART": _SHIP_DAY,
    "EPIEND": f"date_add({_SHIP_DAY}, cast(l_quantity as int))",
    "EPIORDER": "l_linenumber",
    "EPIDUR": "cast(l_quantity as int)",
    "EPISTAT": "if(l_linestatus = 'O' and l_linenumber % 2 = 0, 1, 3)",
    "DISDATE": "case when l_returnflag = 'R' then null when l_linenumber = 7 then date '1801-01-01' "
    f"else date_add({_ORDER_DAY}, cast(o_orderkey % 45 - 2 as int)) end",
    "ADMIMETH": _pick("o_orderkey % 6", ["11", "12", "13", "21", "81", "2B"]),
    "ADMISORC": _pick("l_partkey % 4", ["19", "51", "87", "29"]),
    "DISDEST": f"if(l_suppkey % 10 = 0, null, {_pick('l_suppkey % 4', ['19', '52', '84', '29'])})",
    "SEX": "if(o_custkey % 101 = 0, null, cast(1 + o_custkey % 2 as int))",
    "STARTAGE": "if(o_custkey % 50 = 0, 7001, cast(o_custkey % 95 as int))",
    "ETHNOS": _ETHNIC,
    "LSOA11": "concat('E', lpad(cast(o_custkey % 200 as string), 3, '0'))",
    "MAINSPEF": _pick("l_suppkey % 4", ["101", "120", "500", "110"]),
    "TRETSPEF": _pick("l_partkey % 4", ["211", "215", "502", "130"]),
    "OPERTN_01": _pick("l_partkey % 61", PROCEDURES),
    "DIAG_01": _pick("l_suppkey % 20", DIAGNOSES),
    "nr_elix_h36": "cast(o_custkey % 5 as int)",
    "ADMINCAT": "'01'",
    "CLASSPAT": "l_linestatus",
    "DISMETH": "l_returnflag",
    "DUPLICATE": "cast(null as string)",
    "ELECDATE": _ORDER_DAY,
    "ENCRYPTED_HESID": "cast(o_custkey as string)",
    "ETHNIC5": _ETHNIC,
    "GPPRAC": "cast(null as string)",
    "INTMANIG": "l_linestatus",
    "OPDATE_01": _SHIP_DAY,
    "STARTAGE_CALC": "cast(o_custkey % 95 as double)",
    "order_key": "l_orderkey",
    "line_order": "concat(lpad(cast(l_linenumber as string), 3, '0'), lpad(cast(l_partkey as string), 14, '0'), "
    "lpad(cast(l_suppkey as string), 14, '0'), "
    "lpad(cast(cast(round(l_extendedprice * 100) as bigint) as string), 14, '0'))",
}


def episodes(spark: SparkSession, sf_dir: str, copies: bool = False, by: str | None = None) -> DataFrame:
    """Episode records; ``copies`` adds duplicate episodes with another key.

    ``by`` lays them out by an episode column.  What moves is the lines, a third as wide as the
    episodes, whose fields are made where the lines arrive; a window or join on that column moves nothing then.
    """
    joined = lines(spark, sf_dir)
    if by is not None:
        joined = joined.repartition(F.expr(EPISODE_FIELDS[by]))
    fields = [f"{v} as {k}" for k, v in EPISODE_FIELDS.items()]
    base = joined.selectExpr(*fields)
    if not copies:
        return base
    doubled = joined.filter("l_partkey % 50 = 0").selectExpr(*fields)
    return base.unionByName(doubled.withColumn("EPIKEY", F.concat("EPIKEY", F.lit("-b"))))


def area_code(k: Column) -> Column:
    return F.concat(F.lit("E"), F.lpad(k.cast("string"), 3, "0"))


def spell_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the spell-building columns."""
    return episodes(spark, sf_dir).select(*EPISODE_COLUMNS)


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line of each order with the record id it stands for.

    Lines are reduced to one per order before they meet the other tables.
    """
    li = table(spark, sf_dir, "lineitem")
    wanted = [F.col("l_partkey"), F.col("l_suppkey"), F.expr(_LINE_KEY).alias("EPIKEY")]
    first = li.groupBy("l_orderkey").agg(F.min(F.struct(F.expr(EPISODE_FIELDS["line_order"]).alias("o"), *wanted)).alias("f"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return first.join(o, first.l_orderkey == o.o_orderkey).select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_custkey").cast("string").alias("TOKEN_PERSON_ID"),
        F.concat_ws("_", F.col("o_custkey").cast("string"), "f.EPIKEY").alias("id"),
        F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderdate").cast("date")).alias("ADMIDATE"),
        F.col("f.o").alias("first_line"),
        "f.l_partkey",
        "f.l_suppkey",
    )


def coded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per order: its first line, with primary codes and attributes."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    first = first_lines(spark, sf_dir)
    return first.join(s, first.l_suppkey == s.s_suppkey).select(
        "id",
        "TOKEN_PERSON_ID",
        pick(F.col("l_partkey") % 61, PROCEDURES).alias("OPERTN_01"),
        pick(F.col("l_suppkey") % 20, DIAGNOSES).alias("DIAG_01"),
        pick(F.col("l_suppkey") % 4, ["101", "120", "500", "110"]).alias("MAINSPEF"),
        pick(F.col("l_partkey") % 4, ["211", "215", "502", "130"]).alias("TRETSPEF"),
        unit_code(F.col("s_nationkey")).alias("PROCODE3"),
        "ADMIDATE",
    )


def secondary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long code rows (id, ord, proc, diag): every line of an order but its first,
    filed under the id of the first.

    Lines move once, by order and without texts; both code tables read that one shuffle.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    together = li.filter("l_orderkey is not null").repartition("l_orderkey").withColumn(
        "ord", F.expr(EPISODE_FIELDS["line_order"])
    )
    whole = F.struct("ord", "l_partkey", "l_suppkey", F.expr(_LINE_KEY).alias("EPIKEY"))
    first = together.withColumn("f", F.min(whole).over(Window.partitionBy("l_orderkey"))).filter("ord > f.ord")
    return first.join(o, first.l_orderkey == o.o_orderkey).select(
        F.concat_ws("_", F.col("o_custkey").cast("string"), "f.EPIKEY").alias("id"),
        "ord",
        pick(F.col("l_partkey") % 61, PROCEDURES).alias("proc"),
        pick(F.col("l_suppkey") % 20, DIAGNOSES).alias("diag"),
    )


def px_rows(codes: DataFrame) -> DataFrame:
    return codes.select("id", "ord", F.col("proc").alias("code"))


def dx_rows(codes: DataFrame) -> DataFrame:
    return codes.select("id", "ord", F.col("diag").alias("code"))


def px_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px_rows(secondary_codes(spark, sf_dir))


def dx_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dx_rows(secondary_codes(spark, sf_dir))


def code_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusion list: the codes of parts whose list position is a multiple of three."""
    return (
        table(spark, sf_dir, "part")
        .select((F.col("p_partkey") % 61).alias("k"))
        .filter(F.col("k") % 3 == 0)
        .select(pick(F.col("k"), PROCEDURES).alias("intermediate"))
        .distinct()
    )


def area_deprivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area to deprivation decile; some areas are missing on purpose."""
    k = F.col("c_custkey") % 200
    return (
        table(spark, sf_dir, "customer")
        .filter(k % 37 != 0)
        .select(area_code(k).alias("LSOA11"), (k % 10 + 1).cast("int").alias("imd_decile"))
        .distinct()
    )


def catchment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit x reference-year population features."""
    k = F.col("n_nationkey")
    per_nation = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return (
        table(spark, sf_dir, "nation")
        .filter(k != 24)
        .join(per_nation, k == F.col("c_nationkey"), "left")
        .select(
            unit_code(k).alias("procode"),
            F.explode(F.sequence(F.lit(1995), F.lit(LAST_REFERENCE_YEAR))).alias("year"),
            (F.lit(1000.0) + 50 * F.coalesce("n", F.lit(0))).alias("catchment_cat"),
            (F.lit(0.45) + 0.01 * (k % 7)).alias("sex_m_cat"),
            (F.lit(0.05) + 0.001 * (k % 3)).alias("age_00_04_cat"),
            (F.lit(0.10) + 0.001 * (k % 4)).alias("age_05_14_cat"),
            (F.lit(0.12) + 0.001 * (k % 5)).alias("age_15_24_cat"),
            (F.lit(0.50) + 0.001 * (k % 6)).alias("age_25_64_cat"),
            (F.lit(0.10) + 0.002 * (k % 7)).alias("age_65_74_cat"),
            F.when(k % 9 != 8, F.lit(0.08) + 0.002 * (k % 5)).alias("age_75_plus_cat"),
            (F.lit(0.6) + 0.02 * (k % 11)).alias("white"),
            (k % 10 + 1).cast("int").alias("rank_1_is_most_deprived"),
        )
    )


def unit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit category and start date text; even keys of new units have a second, later date."""
    k = F.col("n_nationkey")
    start = F.concat(F.lit("01/"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("/2000"))
    dates = (
        F.when((k % 4 == 1) & (k % 3 == 0), F.array(start, F.lit("01/06/2001")))
        .when(k % 4 == 1, F.array(start))
        .when(k % 4 == 2, F.array(F.lit("01/06/1998")))
        .otherwise(F.array(F.lit(None).cast("string")))
    )
    return table(spark, sf_dir, "nation").select(
        unit_code(k).alias("trust_code"),
        F.when(k % 4 == 1, "new").when(k % 4 == 2, "old").otherwise("non_hub").alias("elective_hub_cat"),
        F.explode(dates).alias("hub_start_date"),
    )


def peer_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").filter("n_nationkey <> 3").select(
        unit_code(F.col("n_nationkey")).alias("Procode")
    )


def exclude_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").filter("n_nationkey in (6, 11)").select(
        unit_code(F.col("n_nationkey")).alias("PROCODE3")
    )
