"""Declared schemas and the readers and writers of the engine's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spell-building columns of an episode extract.
EPISODE_COLUMNS = [
    "TOKEN_PERSON_ID", "SUSRECID", "EPIKEY", "PROCODET", "ADMIDATE", "EPISTART", "EPIEND",
    "EPIORDER", "EPIDUR", "EPISTAT", "DISDATE", "ADMIMETH", "ADMISORC", "DISDEST",
]
# Attribute columns joined to spells by record id.
ATTRIBUTE_COLUMNS = [
    "SUSRECID", "ADMINCAT", "CLASSPAT", "DIAG_01", "DISMETH", "DUPLICATE", "ELECDATE",
    "ENCRYPTED_HESID", "ETHNIC5", "ETHNOS", "GPPRAC", "INTMANIG", "LSOA11", "MAINSPEF",
    "OPDATE_01", "OPERTN_01", "PROCODE3", "SEX", "STARTAGE", "STARTAGE_CALC", "TRETSPEF",
]
# Column order of the finished spell table.
SPELL_LAYOUT = [
    "TOKEN_PERSON_ID", "spell_id", "SUSRECID", "spellstartdate", "spellenddate", "ADMIDATE",
    "admmnth", "admmyr", "ADMIMETH", "ADMINCAT", "ADMISORC", "DISDATE", "DISDEST", "DISMETH",
    "EPISTART", "EPIEND", "EPIORDER", "EPIKEY", "EPISTAT", "EPIDUR", "DIAG_01", "tnrdiagall",
    "OPERTN_01", "tnrprocall", "OPDATE_01", "CLASSPAT", "ETHNIC5", "ETHNOS", "SEX", "STARTAGE",
    "STARTAGE_CALC", "GPPRAC", "LSOA11", "PROCODE3", "PROCODET", "INTMANIG", "MAINSPEF",
    "TRETSPEF", "DUPLICATE", "ELECDATE", "ENCRYPTED_HESID", "apc_order_id", "transit_nhsd", "id",
]


def spell_layout(spells: DataFrame) -> DataFrame:
    """The finished spell table in its fixed column order; a column that no source supplied is a null string."""
    have = set(spells.columns)
    return spells.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in SPELL_LAYOUT])


# Declared schemas, as DDL text.
SCHEMAS = {
    "code_list": "intermediate STRING",
    "area_deprivation": "LSOA11 STRING, imd_decile INT",
    "unit_lookup": "trust_code STRING, elective_hub_cat STRING, hub_start_date STRING",
    "catchment": (
        "procode STRING, year INT, catchment_cat DOUBLE, sex_m_cat DOUBLE, age_00_04_cat DOUBLE,"
        " age_05_14_cat DOUBLE, age_15_24_cat DOUBLE, age_25_64_cat DOUBLE, age_65_74_cat DOUBLE,"
        " age_75_plus_cat DOUBLE, white DOUBLE, rank_1_is_most_deprived INT"
    ),
    "peer_units": "Procode STRING",
    "exclude_units": "PROCODE3 STRING",
    "fit_meta": (
        "model STRING, T INT, N INT, Ntr INT, sigma2 DOUBLE, r_cv INT, status STRING"
    ),
    "fit_units": "model STRING, unit STRING, T0 INT",
    "fit_cells": (
        "model STRING, unit STRING, time INT, y_tr DOUBLE, y_ct DOUBLE, eff DOUBLE, d INT"
    ),
    "fit_boot": "model STRING, unit STRING, time INT, draw INT, eff DOUBLE",
}


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Columnar scan, pruned to the named columns."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def read_years(
    spark: SparkSession, paths: Sequence[str], columns: Sequence[str], condition=None
) -> DataFrame:
    """Several extracts read with one projection and one filter, then bound by
    name; a column that an extract lacks is NULL there."""
    parts = []
    for path in paths:
        df = spark.read.parquet(path)
        df = df.select(*[c for c in columns if c in df.columns])
        parts.append(df)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out if condition is None else out.filter(condition)


def read_lookup(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Header CSV with the declared schema of a lookup table."""
    return (
        spark.read.schema(SCHEMAS[table])
        .option("header", True)
        .option("enforceSchema", False)
        .csv(path)
    )


def read_row_named_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV whose first column holds row names; short rows are filled with NULL."""
    return (
        spark.read.schema(f"_row_name STRING, {schema}")
        .option("header", True)
        .option("enforceSchema", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "NA")
        .option("mode", "PERMISSIVE")
        .csv(path)
        .drop("_row_name")
    )


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", quote_all)
        .option("escape", '"')
        .csv(path)
    )


def schema_table(df: DataFrame) -> DataFrame:
    """Column names and types of a table, as a table."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "name STRING, type STRING")


def preview(df: DataFrame, order: Sequence[str], n: int = 1000) -> DataFrame:
    """First rows in a named order."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)


def save_fit(fit: dict[str, DataFrame], path: str) -> None:
    """The tables of a set of fits, partitioned by model."""
    for name, df in fit.items():
        write_parquet(df, f"{path}/{name}", ["model"])


def load_fit(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.schema(SCHEMAS[n]).parquet(f"{path}/{n}") for n in names}
