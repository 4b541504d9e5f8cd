"""Treatment assignment: start dates, study months, event flags and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spellpanel.functions.dates import STUDY, StudyCalendar, parse_date
from spellpanel.operators.panel import UNIT
from spellpanel.operators.relational import group_extreme, group_shares


def earliest_start(lookup: DataFrame, strict: bool = False) -> DataFrame:
    """Earliest start date per unit.  ``strict`` drops units with any unreadable date."""
    dated = lookup.select("trust_code", parse_date("hub_start_date", "dd/MM/yyyy").alias("hub_start_date"))
    return group_extreme(dated, ["trust_code"], "hub_start_date", strict)


def in_study(panel: DataFrame, calendar: StudyCalendar = STUDY) -> DataFrame:
    return panel.filter(calendar.contains("month"))


def unit_time_index(panel: DataFrame, calendar: StudyCalendar = STUDY) -> DataFrame:
    """``time``: row number of the month within its unit; ``calendar_index``:
    position of the month in the study.  They differ after a missing month."""
    w = Window.partitionBy(UNIT).orderBy(F.col("month").asc_nulls_last())
    return panel.withColumns(
        {"time": F.row_number().over(w), "calendar_index": calendar.index("month")}
    )


def add_weights(panel: DataFrame, var: str, name: str | None = None) -> DataFrame:
    """Share of a variable within (treated_unit, time)."""
    return group_shares(panel, ["treated_unit", "time"], var, name or f"wt_{var}")


def assign_treatment_fixed(panel: DataFrame, category: str = "old", calendar: StudyCalendar = STUDY) -> DataFrame:
    """One common start: treated from the end of the calendar gap."""
    treated = (F.col("elective_hub_cat") == category).cast("int")
    post = calendar.is_post("month").cast("int")
    return panel.withColumns({"treated_unit": treated, "post": post}).withColumn(
        "intervention",
        F.when(F.col("post").isNull(), None)
        .when((F.col("treated_unit") == 1) & (F.col("post") == 1), 1)
        .otherwise(0),
    )


def assign_treatment_staggered(panel: DataFrame, category: str = "new", never: str = "non_hub") -> DataFrame:
    """Own start dates: treated from the unit's start; NULL while the start is unknown."""
    cat, start = F.col("elective_hub_cat"), F.col("hub_start_date")
    return panel.withColumns(
        {
            "treated_unit": (cat == category).cast("int"),
            "intervention": F.when((F.col("month") >= start) & (cat == category), 1)
            .when((F.col("month") < start) & (cat == category), 0)
            .when(cat == never, 0),
        }
    )


def model_inputs(
    panel: DataFrame, lookup: DataFrame, cohort: str, calendar: StudyCalendar = STUDY
) -> DataFrame:
    """Model-ready panel of one cohort (``old`` fixed date, ``new`` staggered)."""
    starts = earliest_start(lookup).withColumnRenamed("trust_code", "_unit")
    df = panel.filter(F.col("elective_hub_cat").isin(cohort, "non_hub"))
    df = df.join(starts, df[UNIT] == starts["_unit"], "left").drop("_unit")
    df = in_study(df, calendar)
    if cohort == "old":
        df = assign_treatment_fixed(df, "old", calendar)
    else:
        df = assign_treatment_staggered(df, cohort).withColumn("post", F.lit(None).cast("int"))
    df = unit_time_index(df, calendar).withColumn("cohort", F.lit(cohort))
    return add_weights(add_weights(df, "n_activity"), "catchment_cat")
