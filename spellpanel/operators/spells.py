"""From episode records to spells (continuous admissions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spellpanel.functions.nulls import drop_sentinels, in_set, nulls_last
from spellpanel.operators.relational import (
    MAX_ROWS_PER_KEY,
    dense_group_id,
    first_per_key,
    first_row,
    first_values,
    keys_over,
    next_row,
    with_position,
)
from spellpanel.sources.tables import require_columns

PERSON = "TOKEN_PERSON_ID"
EPISODE_KEY = [PERSON, "EPISTART", "EPIORDER", "EPIEND", "transit_nhsd"]
SPELL_KEY = [PERSON, "PROCODET", "ADMIDATE", "disdate_for_spell"]
SPELL_ORDER = [
    PERSON, "ADMIDATE", "EPISTART", "EPIORDER", "EPIEND", "transit_nhsd", "disdate_for_spell",
    "PROCODET", "EPIKEY",
]

# Transfer codes of the national data dictionary, placeholder
# dates, elective admission methods and the adult age band.
TRANSFER_SOURCES = [49, 50, 51, 52, 53, 87]
TRANSFER_METHODS = ["81", "2B"]
TRANSFER_DESTINATIONS = [49, 50, 51, 52, 53, 84, 87]
DATE_SENTINELS = ["1801-01-01", "1800-01-01"]
ELECTIVE_METHODS = [11, 12, 13]
ADULT_AGE = (17, 7000)


def finished_episodes(df: DataFrame) -> DataFrame:
    """Finished episodes with a known admission date."""
    return df.filter((F.col("EPISTAT") == 3) & F.col("ADMIDATE").isNotNull())


def transfer_flag(df: DataFrame) -> DataFrame:
    """Transfer direction 0..3 from source, method and destination.

    The first arm holds unless source *and* method both say transfer-in, so
    code 2 needs both; that is how the flag is defined.
    """
    require_columns(df, "ADMISORC", "ADMIMETH", "DISDEST")
    source = in_set("ADMISORC", TRANSFER_SOURCES)
    method = in_set("ADMIMETH", TRANSFER_METHODS)
    leaves = in_set("DISDEST", TRANSFER_DESTINATIONS)
    return df.withColumn(
        "transit_nhsd",
        F.when((~source | ~method) & leaves, 1)
        .when((source | method) & leaves, 2)
        .when((source | method) & ~leaves, 3)
        .otherwise(0),
    )


def dedup_episodes(df: DataFrame) -> DataFrame:
    """One episode per (person, start, order, end, transfer); lowest key wins."""
    return first_per_key(df, EPISODE_KEY, ["EPIKEY"])


def clean_discharge(df: DataFrame, max_rows_per_person: int | None = MAX_ROWS_PER_KEY) -> DataFrame:
    """Placeholder discharge dates to NULL, then ``disdate_for_spell``: a missing
    date takes the next row's if that row is the same person, provider and
    admission.  Only the immediately next row counts."""
    df = df.withColumn("DISDATE", drop_sentinels("DISDATE", DATE_SENTINELS))
    df = next_row(
        df, PERSON, [*EPISODE_KEY[1:], "EPIKEY"], [PERSON, "PROCODET", "ADMIDATE", "DISDATE"],
        max_rows_per_person,
    )
    return _fill_from_next(df)


def _fill_from_next(df: DataFrame) -> DataFrame:
    same = F.col("DISDATE").isNull()
    for c in (PERSON, "PROCODET", "ADMIDATE"):
        same = same & (F.col(c) == F.col(f"_next.{c}"))
    filled = F.when(same, F.col("_next.DISDATE")).otherwise(F.col("DISDATE"))
    return df.withColumn("disdate_for_spell", filled).drop("_next")


def assign_spells(df: DataFrame) -> DataFrame:
    """Dense spell id by (person, provider, admission, effective discharge)."""
    return dense_group_id(df, SPELL_KEY, SPELL_ORDER, "spell_id")


def spell_summary(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First episode of each spell with the spell's first start and last end."""
    keys = keys or ["spell_id"]
    order = [c for c in SPELL_ORDER if c not in SPELL_KEY]  # the key is constant within a spell
    out = df.groupBy(*keys).agg(
        first_row(df, keys, order).alias("f"),
        F.min("EPISTART").alias("spellstartdate"),
        F.max("EPIEND").alias("spellenddate"),
    )
    return out.select(*keys, *first_values(df, keys, order), "spellstartdate", "spellenddate")


def _ready(episodes: DataFrame) -> DataFrame:
    return transfer_flag(finished_episodes(episodes)).withColumn(
        "DISDATE", drop_sentinels("DISDATE", DATE_SENTINELS)
    )


def crowded(episodes: DataFrame, max_rows_per_person: int | None = MAX_ROWS_PER_KEY) -> bool:
    """Whether some person has more finished episodes than one task may hold."""
    return max_rows_per_person is not None and (
        keys_over(finished_episodes(episodes), PERSON, max_rows_per_person) is not None
    )


def _prepare_by_person(flagged: DataFrame) -> DataFrame:
    """De-duplicate and fill in one sorted pass per person: an episode repeats the
    one before it or not, and the next one may lend its discharge date."""
    w = Window.partitionBy(PERSON).orderBy(*nulls_last([*EPISODE_KEY[1:], "EPIKEY"]))
    key = F.struct(*EPISODE_KEY[1:])
    unique = (
        flagged.withColumn("_same", F.lag(key).over(w).eqNullSafe(key)).filter(~F.col("_same")).drop("_same")
    )
    values = F.struct(PERSON, "PROCODET", "ADMIDATE", "DISDATE")
    return _fill_from_next(unique.withColumn("_next", F.lead(values).over(w)))


def prepared_episodes(
    episodes: DataFrame, max_rows_per_person: int | None = MAX_ROWS_PER_KEY
) -> DataFrame:
    """Finished, flagged, de-duplicated episodes with their effective discharge.

    While no person exceeds the bound, rows move once, partitioned by person.
    Otherwise copies are combined before the shuffle and large persons sliced.
    """
    if crowded(episodes, max_rows_per_person):
        return clean_discharge(dedup_episodes(_ready(episodes)), max_rows_per_person)
    return _prepare_by_person(_ready(episodes))


def build_spells(
    episodes: DataFrame,
    with_ids: bool = True,
    max_rows_per_person: int | None = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """Episodes to spells: first-episode row, spell span and admission month parts.

    Spells are grouped by their key directly; the dense id is numbered on the
    finished spell table, so no join back to the episodes is needed.  In the
    usual case the partitioning by person serves all three steps and the rows
    move once; with a crowded person, spells are combined before the shuffle.
    """
    if crowded(episodes, max_rows_per_person):
        prepared = clean_discharge(dedup_episodes(_ready(episodes)), max_rows_per_person)
        spells = spell_summary(prepared, SPELL_KEY)
    else:
        within = Window.partitionBy(*SPELL_KEY)
        first = within.orderBy(*nulls_last([c for c in SPELL_ORDER if c not in SPELL_KEY]))
        spells = (
            _prepare_by_person(_ready(episodes))
            .withColumns(
                {
                    "_place": F.row_number().over(first),
                    "spellstartdate": F.first("EPISTART").over(first),
                    "spellenddate": F.max("EPIEND").over(within),
                }
            )
            .filter("_place = 1")
            .drop("_place")
        )
    spells = spells.withColumns(
        {
            "admmnth": F.date_format("ADMIDATE", "MM"),
            "admmyr": F.date_format("ADMIDATE", "yyyy"),
        }
    )
    if with_ids:
        spells = with_position(spells, SPELL_ORDER, "spell_id")
    return spells


def enrich_spells(spells: DataFrame, attributes: DataFrame) -> DataFrame:
    """Attach attribute columns by record id and the person-episode key ``id``."""
    extra = [c for c in attributes.columns if c not in spells.columns]
    out = spells.join(attributes.select("SUSRECID", *extra), "SUSRECID", "left")
    return out.withColumn(
        "id",
        F.concat_ws(
            "_",
            F.coalesce(F.col(PERSON).cast("string"), F.lit("NA")),
            F.coalesce(F.col("EPIKEY").cast("string"), F.lit("NA")),
        ),
    )


def restrict_elective_adult(df: DataFrame) -> DataFrame:
    """Elective admission methods, ages 17 and over without infant pseudo-ages."""
    return df.filter(
        in_set("ADMIMETH", ELECTIVE_METHODS)
        & (F.col("STARTAGE") >= ADULT_AGE[0])
        & (F.col("STARTAGE") < ADULT_AGE[1])
    )
