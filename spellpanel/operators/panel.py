"""From flagged spells to the unit-by-month panel, its exclusions and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellpanel.functions.dates import carry_year, month_of, stay_days, year_month
from spellpanel.functions.nulls import cap_at, in_set, ratio, row_sum, share, strict_share
from spellpanel.operators.recipes import SPECIALTIES
from spellpanel.operators.relational import count_steps, join_null_safe, require_unique

UNIT = "PROCODE3"
PANEL_KEY = [UNIT, "month"]
COVARIATES = ["catchment_cat", "sex_male_pct", "white_pct", "age_65_plus_pct"]

# Stay cap in days (99.9th percentile of the study), first month
# of the overall stay panel, ethnic groups counted as white, last year with
# population figures.
STAY_CAP = 37
STAY_FROM = "2018-01-01"
WHITE_GROUPS = ["A", "B", "C"]
LAST_REFERENCE_YEAR = 2020
REFERENCE_YEARS = [2018, 2019, 2020]
# The ENT mean stay is published without the cap.
UNCAPPED = ("ent",)


def attach_deprivation(spells: DataFrame, areas: DataFrame) -> DataFrame:
    """Deprivation decile by area code; a lookup with repeated areas is refused."""
    return spells.join(require_unique(areas, ["LSOA11"]), "LSOA11", "left")


def catchment_features(catchment: DataFrame, years: Sequence[int] = REFERENCE_YEARS) -> DataFrame:
    """Population features per unit and reference year, with the 65+ share."""
    return catchment.filter(F.col("year").isin(list(years))).select(
        F.col("procode").alias("trust_code"),
        "year",
        "catchment_cat",
        F.col("sex_m_cat").alias("sex_male_pct"),
        F.col("white").alias("white_pct"),
        row_sum(["age_65_74_cat", "age_75_plus_cat"]).alias("age_65_plus_pct"),
    )


def attach_catchment(panel: DataFrame, features: DataFrame, last_year: int = LAST_REFERENCE_YEAR) -> DataFrame:
    """Features of the month's year; later years use the last reference year."""
    dim = features.withColumnsRenamed({"trust_code": "_unit", "year": "_year"})
    year = carry_year(F.year("month"), last_year)
    return panel.join(dim, (panel[UNIT] == dim["_unit"]) & (year == dim["_year"]), "left").drop("_unit", "_year")


def per_thousand(count: Column | str, base: str = "catchment_cat") -> Column:
    return ratio(count, base) * 1000


def with_stay(spells: DataFrame) -> DataFrame:
    return spells.withColumns({"month": month_of("ADMIDATE"), "los": stay_days("ADMIDATE", "DISDATE")})


def activity_panel(spells: DataFrame, features: DataFrame, last_year: int = LAST_REFERENCE_YEAR) -> DataFrame:
    """Count and rate per 1,000 population by unit and month."""
    counts = (
        spells.groupBy(UNIT, month_of("ADMIDATE").alias("month")).agg(F.count(F.lit(1)).alias("n_activity"))
    )
    return attach_catchment(counts, features, last_year).withColumn("el_rate", per_thousand("n_activity"))


def _mean_stay(where: Column, cap: int | None) -> Column:
    """Mean of positive stays; NULL when there is none."""
    return F.avg(F.when(where & (F.col("los") > 0), cap_at("los", cap)))


def _day_case(where: Column) -> Column:
    return F.try_divide(
        F.count_if(where & (F.col("los") == 0)).cast("double"), F.count_if(where).cast("double")
    )


def stay_measures() -> list[Column]:
    """Mean stay, day-case ratio and case mix of a group of spells with a known stay."""
    every = F.lit(True)
    out = [
        _mean_stay(every, STAY_CAP).alias("los_avg"),
        share(F.col("los") == 0).alias("dc"),
        strict_share(F.col("SEX") == 1).alias("sex_male_pct_ec"),
        strict_share(F.col("STARTAGE") >= 65).alias("age_65_plus_pct_ec"),
        share(in_set("ETHNOS", WHITE_GROUPS)).alias("white_pct_ec"),
    ]
    for q in range(1, 6):
        out.append(share(in_set("imd_decile", [2 * q - 1, 2 * q])).alias(f"quintile_{q}_pct_ec"))
    out.append(strict_share(F.col("nr_elix_h36") >= 2).alias("comorb_pct"))
    return out


def stay_panel(spells: DataFrame, first_month: str = STAY_FROM) -> DataFrame:
    """Stay and case-mix measures by unit and month; unknown and negative stays
    and months before the first one are left out."""
    kept = with_stay(spells).filter(
        (F.col("los") >= 0) & (F.col("month") >= F.lit(first_month).cast("date"))
    )
    return kept.groupBy(*PANEL_KEY).agg(*stay_measures())


def specialty_counts(specialties: Sequence[str] = SPECIALTIES) -> list[Column]:
    """One conditional count per specialty, NULL where a group has no such spell."""
    return [
        F.expr(f"nullif(count_if({s}), 0)").alias(f"n_activity_{s}") for s in specialties
    ]


def add_specialty_rates(panel: DataFrame, specialties: Sequence[str] = SPECIALTIES) -> DataFrame:
    """Rates per specialty, combined count and combined rate."""
    counts = [f"n_activity_{s}" for s in specialties]
    panel = panel.withColumns({f"rate_{s}": per_thousand(f"n_activity_{s}") for s in specialties})
    return panel.withColumn(
        "n_activity_hvlc", F.when(F.coalesce(*counts).isNotNull(), row_sum(counts))
    ).withColumn("hvlc_rate", per_thousand("n_activity_hvlc"))


def specialty_activity(
    spells: DataFrame, features: DataFrame, last_year: int = LAST_REFERENCE_YEAR
) -> DataFrame:
    """Counts and rates of the seven specialties and of all together, in one pass."""
    counts = (
        spells.groupBy(UNIT, month_of("ADMIDATE").alias("month"))
        .agg(*specialty_counts())
        .filter(F.coalesce(*[F.col(f"n_activity_{s}") for s in SPECIALTIES]).isNotNull())
    )
    return add_specialty_rates(attach_catchment(counts, features, last_year))


def specialty_stay_measures(uncapped: Sequence[str] = UNCAPPED, known: Column | None = None) -> list[Column]:
    """Mean stay and day-case ratio for any pathway and for each specialty."""
    out = []
    for s in ["hvlc", *SPECIALTIES]:
        where = F.coalesce(F.col(s), F.lit(False))
        if known is not None:
            where = where & known
        cap = None if s in uncapped else STAY_CAP
        out += [_mean_stay(where, cap).alias(f"los_avg_{s}"), _day_case(where).alias(f"dc_prop_{s}")]
    return out


def specialty_stay(spells: DataFrame, uncapped: Sequence[str] = UNCAPPED) -> DataFrame:
    """Eight pairs of stay measures in one pass over flagged spells with a known stay."""
    kept = with_stay(spells).filter((F.col("los") >= 0) & F.col("hvlc"))
    return kept.groupBy(*PANEL_KEY).agg(*specialty_stay_measures(uncapped))


def _mean_where(value: Column, where: Column, strict: bool) -> Column:
    """Share of TRUE among the rows that meet a condition."""
    n = F.count_if(where)
    total = F.sum(F.when(where, value.cast("int")))
    if strict:
        total = F.when(F.count_if(where & value.isNotNull()) == n, total)
    return F.try_divide(total.cast("double"), n.cast("double"))


def overall_measures(in_range: Column) -> list[Column]:
    """Count of all spells, and stay and case mix of those in range."""
    out = [
        F.count(F.lit(1)).alias("n_activity"),
        _mean_stay(in_range, STAY_CAP).alias("los_avg"),
        _day_case(in_range).alias("dc"),
        _mean_where(F.col("SEX") == 1, in_range, True).alias("sex_male_pct_ec"),
        _mean_where(F.col("STARTAGE") >= 65, in_range, True).alias("age_65_plus_pct_ec"),
        _mean_where(in_set("ETHNOS", WHITE_GROUPS), in_range, False).alias("white_pct_ec"),
    ]
    for q in range(1, 6):
        decile = in_set("imd_decile", [2 * q - 1, 2 * q])
        out.append(_mean_where(decile, in_range, False).alias(f"quintile_{q}_pct_ec"))
    out.append(_mean_where(F.col("nr_elix_h36") >= 2, in_range, True).alias("comorb_pct"))
    return out


def _panel(
    spells: DataFrame, features: DataFrame, last_year: int, first_month: str, extra: Sequence[Column]
) -> DataFrame:
    known = F.coalesce(F.col("los") >= 0, F.lit(False))
    in_range = known & (F.col("month") >= F.lit(first_month).cast("date"))
    counts = with_stay(spells).groupBy(*PANEL_KEY).agg(*overall_measures(in_range), *extra)
    return (
        attach_catchment(counts, features, last_year)
        .withColumn("el_rate", per_thousand("n_activity"))
        .withColumn("year_month", year_month("month"))
    )


def overall_panel(
    spells: DataFrame,
    features: DataFrame,
    last_year: int = LAST_REFERENCE_YEAR,
    first_month: str = STAY_FROM,
) -> DataFrame:
    """Overall measures only (activity and stay panels together), in one pass."""
    return _panel(spells, features, last_year, first_month, [])


def final_panel(
    spells: DataFrame,
    features: DataFrame,
    last_year: int = LAST_REFERENCE_YEAR,
    first_month: str = STAY_FROM,
    uncapped: Sequence[str] = UNCAPPED,
) -> DataFrame:
    """All panel measures from one scan and one aggregate.

    Each measure carries its own condition: the counts take every spell, the
    stays only known ones, and the month bound applies to the overall stay
    measures alone.
    """
    known = F.coalesce(F.col("los") >= 0, F.lit(False))
    extra = [*specialty_counts(), *specialty_stay_measures(uncapped, known)]
    return add_specialty_rates(_panel(spells, features, last_year, first_month, extra))


def final_panel_by_joins(
    spells: DataFrame,
    features: DataFrame,
    last_year: int = LAST_REFERENCE_YEAR,
    first_month: str = STAY_FROM,
    uncapped: Sequence[str] = UNCAPPED,
) -> DataFrame:
    """The same panel as a chain of null-safe full joins of its four parts."""
    overall = join_null_safe(
        activity_panel(spells, features, last_year), stay_panel(spells, first_month), PANEL_KEY, "full"
    )
    flagged = join_null_safe(
        specialty_activity(spells, features, last_year), specialty_stay(spells, uncapped), PANEL_KEY, "full"
    )
    out = join_null_safe(overall, flagged, [*PANEL_KEY, *COVARIATES], "full")
    return out.withColumn("year_month", year_month("month"))


def exclusion_flags(
    units: DataFrame, peers: DataFrame, features: DataFrame, excluded: DataFrame, prefix: str = "R"
) -> DataFrame:
    """One row per unit with the outcome of each exclusion test."""

    def mark(df: DataFrame, col: str, name: str) -> DataFrame:
        return df.select(F.col(col).alias(UNIT)).distinct().withColumn(name, F.lit(True))

    out = units.select(UNIT).distinct()
    for lookup in (
        mark(peers, "Procode", "is_peer"),
        mark(features, "trust_code", "has_catchment"),
        mark(excluded, UNIT, "is_excluded"),
    ):
        out = out.join(lookup, UNIT, "left")
    return out.select(
        UNIT,
        F.coalesce(F.col(UNIT).startswith(prefix), F.lit(False)).alias("has_prefix"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("is_peer", "has_catchment", "is_excluded")],
    )


def attrition(
    panel: DataFrame, peers: DataFrame, features: DataFrame, excluded: DataFrame, prefix: str = "R"
) -> DataFrame:
    """Units left after each exclusion step."""
    flags = exclusion_flags(panel, peers, features, excluded, prefix)
    return count_steps(
        flags,
        UNIT,
        {
            "all units": F.lit(True),
            "prefix": F.col("has_prefix"),
            "peer list": F.col("is_peer"),
            "catchment": F.col("has_catchment"),
            "not excluded": ~F.col("is_excluded"),
        },
    )


def apply_exclusions(
    panel: DataFrame, peers: DataFrame, features: DataFrame, excluded: DataFrame, prefix: str = "R"
) -> DataFrame:
    """Keep units with the prefix, on the peer list, with catchment data, not excluded."""
    return (
        panel.filter(F.col(UNIT).startswith(prefix))
        .join(peers.select(F.col("Procode").alias(UNIT)), UNIT, "left_semi")
        .join(features.select(F.col("trust_code").alias(UNIT)), UNIT, "left_semi")
        .join(excluded.select(UNIT), UNIT, "left_anti")
    )


def unit_categories(lookup: DataFrame) -> DataFrame:
    return lookup.select(F.col("trust_code").alias(UNIT), "elective_hub_cat").distinct()


def attach_unit_category(panel: DataFrame, lookup: DataFrame) -> DataFrame:
    """Unit category; a unit with two categories is refused."""
    return panel.join(require_unique(unit_categories(lookup), [UNIT]), UNIT, "left")
