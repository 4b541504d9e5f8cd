"""Plot-ready series taken from the inference table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellpanel.functions.text import signed_percent

# Short outcome names and their order in plots.
OUTCOME_CODES = {"rate": ("act", 1), "los.ip_avg": ("los", 2), "los.dc_ratio": ("dcr", 3)}

_SEGMENT_LEVELS = {"overall": "overall", "key": "key", "unit": "overall", "unit_key": "key"}


def with_keys(table: DataFrame) -> DataFrame:
    """Split the model id into cohort, activity and outcome code."""
    part = F.split("model", r"\|")
    measure = part.getItem(2)
    code, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, (short, order) in OUTCOME_CODES.items():
        code = F.when(measure == name, short).otherwise(code)
        rank = F.when(measure == name, order).otherwise(rank)
    return table.withColumns(
        {"cohort": part.getItem(0), "activity": part.getItem(1), "outcome": code, "outcome_order": rank}
    )


def _rows(table: DataFrame) -> DataFrame:
    kind: Column = F.lit("point")
    for level, name in _SEGMENT_LEVELS.items():
        kind = F.when(F.col("level") == level, name).otherwise(kind)
    return with_keys(table).withColumns(
        {"kind": kind, "event_time": F.when(kind == "point", F.col("time").cast("int"))}
    )


_KEYS = ["cohort", "activity", "outcome", "outcome_order", "unit", "kind", "period", "time", "event_time"]


def effect_series(table: DataFrame) -> DataFrame:
    """Effects with bounds by event time, plus overall and key-window segments."""
    return _rows(table).select(*_KEYS, "att_mean", "att_lower", "att_upper", "delta_mean", "pval")


def outcome_series(table: DataFrame) -> DataFrame:
    """Observed and counterfactual outcomes by event time, plus segments."""
    return _rows(table).select(*_KEYS, "out_tr", "out_ct", "out_ct_lower", "out_ct_upper", "delta_mean")


def delta_labels(table: DataFrame) -> DataFrame:
    """Signed percent-change label per unit and span (own whole span and key window).

    A unit's whole-period label names its own span even though the value is
    stored under the overall one.
    """
    spans = _rows(table).filter("kind <> 'point'")
    own = F.when(
        (F.col("kind") == "overall") & (F.col("period") == "pre"),
        F.concat(F.lit("-1 - -"), F.col("size_period").cast("string")),
    ).when(F.col("kind") == "overall", F.concat(F.lit("1 - "), F.col("size_period").cast("string")))
    return spans.select(
        "cohort", "activity", "outcome", "unit", "kind", "period",
        F.coalesce(own, F.col("time")).alias("span"),
        # an effect that is zero up to floating-point noise has no sign
        signed_percent(F.round("delta_mean", 6)).alias("label"),
    )
