"""Event-time effects, standard errors and the inference table.

Works on the four fit tables for any number of models in one plan.  ``cells``
below are staggered cells: ``model, unit, period ('pre'/'post'), event_time,
y_tr, y_ct, eff, w`` and ``boot`` the same per draw.  Event time runs
..., -2, -1, 1, 2, ... from each unit's own start, without a zero.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spellpanel.functions.normal import two_sided_p, z_value
from spellpanel.functions.nulls import ratio
from spellpanel.session import stage

# Column order of the inference table and the key months.
INFERENCE_LAYOUT = [
    "comparator", "outcome", "time", "unit", "att_mean", "att_se", "att_ci.lower", "att_ci.upper",
    "pval", "out_tr", "out_ct", "out_ct_se", "out_ct_ci.lower", "out_ct_ci.upper", "delta_mean",
    "delta_ci.lower", "delta_ci.upper", "sigma2", "size_fct", "size_period", "size_tr", "size_ct",
]
KEY_TIMES = list(range(1, 13))
POOLED = "Pooled"
#: Counterfactuals nearer to zero have no percent change.
SMALLEST_BASE = 1e-5


def event_time(time: Column | str = "time", start: Column | str = "T0") -> Column:
    t = F.col(time) if isinstance(time, str) else time
    s = F.col(start) if isinstance(start, str) else start
    return F.when(t <= s, t - s - 1).otherwise(t - s)


def stagger(cells: DataFrame, units: DataFrame) -> DataFrame:
    """Add ``event_time`` and ``period`` from each unit's own start."""
    return cells.join(units, ["model", "unit"]).withColumns(
        {
            "event_time": event_time(),
            "period": F.when(F.col("time") <= F.col("T0"), "pre").otherwise("post"),
        }
    )


def with_weights(cells: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Attach outcome weights by (model, unit, time); no table means unweighted.
    A missing weight counts as zero."""
    if weights is None:
        return cells.withColumn("w", F.lit(None).cast("double"))
    joined = cells.join(weights.select("model", "unit", "time", "w"), ["model", "unit", "time"], "left")
    return joined.withColumn("w", F.coalesce("w", F.lit(0.0)))


def relative_weights(cells: DataFrame) -> DataFrame:
    """Weights relative to their event time and to their unit."""
    by_time = cells.groupBy("model", "period", "event_time").agg(F.sum("w").alias("_wt"))
    by_unit = cells.groupBy("model", "period", "unit").agg(F.sum("w").alias("_wu"))
    return (
        cells.join(by_time, ["model", "period", "event_time"])
        .join(by_unit, ["model", "period", "unit"])
        .withColumns({"w_time": ratio("w", "_wt"), "w_unit": ratio("w", "_wu")})
        .drop("_wt", "_wu")
    )


def _observed_mean(weighted: bool) -> Column:
    return ratio(F.sum(F.col("w") * F.col("y_tr")), F.sum("w")) if weighted else F.avg("y_tr")


def effect_means(cells: DataFrame, by: str, weighted: bool) -> DataFrame:
    """Observed mean, effect mean and implied counterfactual by ``event_time`` or ``unit``.

    The observed mean is weighted, the effect mean is not.
    """
    out = cells.groupBy("model", "period", by).agg(
        F.avg("eff").alias("att_mean"), _observed_mean(weighted).alias("out_tr")
    )
    return out.withColumn("out_ct", F.col("out_tr") - F.col("att_mean"))


def mean_of_means(by_time: DataFrame) -> DataFrame:
    """Mean over event times of the per-time means."""
    return by_time.groupBy("model", "period").agg(
        *[F.avg(c).alias(c) for c in ("att_mean", "out_tr", "out_ct")]
    )


def stagger_draws(boot: DataFrame, cells: DataFrame) -> DataFrame:
    """Draws in event time, with the counterfactual each draw implies."""
    base = cells.select("model", "unit", "time", "event_time", "period", "y_tr")
    return boot.join(base, ["model", "unit", "time"]).withColumn("ct", F.col("y_tr") - F.col("eff"))


def draw_means(draws: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per-draw means of effect and counterfactual by the given keys."""
    return draws.groupBy("model", "period", *by, "draw").agg(F.avg("eff").alias("eff"), F.avg("ct").alias("ct"))


def spread(means: DataFrame, by: Sequence[str]) -> DataFrame:
    """Standard deviation over draws."""
    return means.groupBy("model", "period", *by).agg(
        F.stddev_samp("eff").alias("att_se"), F.stddev_samp("ct").alias("out_ct_se")
    )


def add_intervals(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Normal intervals, two-sided p-value and percent change."""
    z = z_value(alpha)

    def bound(est: str, se: str, sign: int) -> Column:
        return F.col(est) + F.lit(sign * z) * F.col(se)

    def percent(c: str) -> Column:
        base = F.when(F.abs("out_ct") >= SMALLEST_BASE, F.col("out_ct"))  # a zero that rounding moved is still zero
        return ratio(F.lit(100.0) * F.col(c), base)

    df = df.withColumns(
        {
            "att_lower": bound("att_mean", "att_se", -1),
            "att_upper": bound("att_mean", "att_se", 1),
            "pval": two_sided_p(ratio(F.abs("att_mean"), "att_se")),
            "out_ct_lower": bound("out_ct", "out_ct_se", -1),
            "out_ct_upper": bound("out_ct", "out_ct_se", 1),
        }
    )
    return df.withColumns(
        {
            "delta_mean": percent("att_mean"),
            "delta_lower": percent("att_lower"),
            "delta_upper": percent("att_upper"),
        }
    )


@dataclass(frozen=True)
class KeyWindow:
    """Consecutive key event times, mirrored before the start."""

    first: int
    last: int

    @classmethod
    def of(cls, times: Sequence[int]) -> KeyWindow:
        times = sorted(times)
        if not times or times[0] < 1 or times != list(range(times[0], times[-1] + 1)):
            raise ValueError("key times must be consecutive positive integers")
        return cls(times[0], times[-1])

    @property
    def length(self) -> int:
        return self.last - self.first + 1

    def holds(self, time: str = "event_time") -> Column:
        return F.abs(F.col(time)).between(self.first, self.last)


def model_windows(units: DataFrame, meta: DataFrame) -> DataFrame:
    """Per model: length of its shortest post period, and the default window, the first half of it (at least one month)."""
    reach = units.groupBy("model").agg(F.min("T0").alias("t0")).join(meta, "model").select("model", (F.col("T") - F.col("t0")).alias("post"))
    half = F.greatest(F.floor(F.col("post") / 2), F.lit(1)).cast("int")
    return reach.select("model", "post", F.lit(1).alias("first"), half.alias("last"))


def models_with_window(window: KeyWindow, units: DataFrame, meta: DataFrame) -> DataFrame:
    """The models whose every treated unit has the whole window after its start; an error if there is none.

    A model with too short a post period is left out by itself and does not keep the others from their table.
    """
    able = model_windows(units, meta).filter(F.col("post") >= window.last).select("model")
    if able.isEmpty():
        raise ValueError("key times reach past the post period")
    return able


def default_window(units: DataFrame, meta: DataFrame) -> KeyWindow:
    """First half of the shortest post period among the models (at least one month)."""
    last = model_windows(units, meta).agg(F.min("last")).first()[0]
    return KeyWindow.of(range(1, (last or 1) + 1))


def model_frame(units: DataFrame, meta: DataFrame) -> DataFrame:
    """Per model: start range, sizes and comparator label."""
    t0 = units.groupBy("model").agg(F.min("T0").alias("min_t0"), F.max("T0").alias("max_t0"))
    return meta.join(t0, "model").withColumn(
        "comparator", F.when(F.col("min_t0") == F.col("max_t0"), "old_hub").otherwise("new_hub")
    )


def still_observed(units: DataFrame, meta: DataFrame, times: DataFrame) -> DataFrame:
    """Units observed at least ``event_time`` periods after their start.

    Unit counts per post length are accumulated from the longest down, so no
    unit is paired with every time.
    """
    lengths = (
        units.join(meta.select("model", "T"), "model")
        .groupBy("model", (F.col("T") - F.col("T0")).alias("event_time"))
        .agg(F.count("*").alias("ends"))
    )
    steps = times.filter("event_time > 0").select("model", "event_time").distinct()
    w = Window.partitionBy("model").orderBy(F.col("event_time").desc())
    every = steps.join(lengths, ["model", "event_time"], "full").withColumn(
        "n_observed", F.sum(F.coalesce("ends", F.lit(0))).over(w)
    )
    return every.join(steps, ["model", "event_time"], "left_semi").select("model", "event_time", "n_observed")


def span_label(first: Column, last: Column) -> Column:
    return F.concat(first.cast("string"), F.lit(" - "), last.cast("string"))


LEVELS = ["overall", "time", "key", "unit", "unit_key", "cell"]
_NO_TIME = 0  # event time of levels that span several times; zero is never used


def _two_spans(df: DataFrame, keys: Sequence[str], levels: tuple[str, str], measures: Sequence[str]) -> DataFrame:
    """Split ``c`` / ``c_key`` column pairs into a whole-period and a key-window row."""

    def row(level: str, suffix: str) -> Column:
        return F.struct(F.lit(level).alias("level"), *[F.col(c + suffix).alias(c) for c in measures])

    spans = F.explode(F.array(row(levels[0], ""), row(levels[1], "_key")))
    out = df.select(*keys, spans.alias("s")).select("s.level", *keys, *[f"s.{c}" for c in measures])
    return out.withColumn("event_time", F.lit(_NO_TIME))


def level_estimates(cells: DataFrame, weighted: bool, window: KeyWindow) -> DataFrame:
    """Effect, observed and counterfactual means of all six levels, one long table.

    Pooled rows average the per-time means; a unit's whole-period row uses
    weighted observed outcomes, its key-window row unweighted ones.
    """
    measures = ["att_mean", "out_tr", "out_ct"]
    key = window.holds()
    by_time = effect_means(cells, "event_time", weighted)
    pooled = by_time.groupBy("model", "period").agg(
        *[F.avg(c).alias(c) for c in measures],
        *[F.avg(F.when(key, F.col(c))).alias(f"{c}_key") for c in measures],
    )
    raw = {"att_mean": "eff", "out_tr": "y_tr", "out_ct": "y_ct"}
    by_unit = (
        cells.groupBy("model", "period", "unit")
        .agg(
            F.avg("eff").alias("att_mean"),
            _observed_mean(weighted).alias("out_tr"),
            *[F.avg(F.when(key, F.col(v))).alias(f"{c}_key") for c, v in raw.items()],
        )
        .withColumn("out_ct", F.col("out_tr") - F.col("att_mean"))
    )
    head = ["level", "model", "period", "unit", "event_time"]
    parts = [
        by_time.withColumns({"level": F.lit("time"), "unit": F.lit(POOLED)}),
        _two_spans(pooled, ["model", "period"], ("overall", "key"), measures).withColumn("unit", F.lit(POOLED)),
        _two_spans(by_unit, ["model", "period", "unit"], ("unit", "unit_key"), measures),
        cells.select(
            F.lit("cell").alias("level"), "model", "period", "unit", "event_time",
            *[F.col(v).alias(c) for c, v in raw.items()],
        ),
    ]
    return _bind([p.select(*head, *measures) for p in parts]).filter("att_mean is not null")


def level_spreads(draws: DataFrame, window: KeyWindow) -> DataFrame:
    """Standard errors of all six levels, one long table.

    Each draw is averaged the way its level averages the estimates, then the
    standard deviation is taken over draws.
    """
    key = window.holds()

    def means(df: DataFrame, by: Sequence[str]) -> DataFrame:
        return df.groupBy("model", "period", *by, "draw").agg(
            *[F.avg(c).alias(c) for c in ("eff", "ct")],
            *[F.avg(F.when(key, F.col(c))).alias(f"{c}_key") for c in ("eff", "ct")],
        )

    def both(df: DataFrame, by: Sequence[str]) -> DataFrame:
        return df.groupBy("model", "period", *by).agg(
            F.stddev_samp("eff").alias("att_se"),
            F.stddev_samp("ct").alias("out_ct_se"),
            F.stddev_samp("eff_key").alias("att_se_key"),
            F.stddev_samp("ct_key").alias("out_ct_se_key"),
        )

    measures = ["att_se", "out_ct_se"]
    by_time = draw_means(draws, ["event_time"])
    head = ["level", "model", "period", "unit", "event_time"]
    parts = [
        spread(by_time, ["event_time"]).withColumns({"level": F.lit("time"), "unit": F.lit(POOLED)}),
        _two_spans(both(means(by_time, []), []), ["model", "period"], ("overall", "key"), measures).withColumn(
            "unit", F.lit(POOLED)
        ),
        _two_spans(
            both(means(draws, ["unit"]), ["unit"]), ["model", "period", "unit"], ("unit", "unit_key"), measures
        ),
        spread(draws, ["unit", "event_time"]).withColumn("level", F.lit("cell")),
    ]
    return _bind([p.select(*head, *measures) for p in parts])


def _bind(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def add_diagnostics(
    table: DataFrame, fit: dict[str, DataFrame], cells: DataFrame, window: KeyWindow
) -> DataFrame:
    """Time label, comparator, residual variance and the four size columns."""
    units, meta = fit["fit_units"], fit["fit_meta"]
    frame = model_frame(units, meta)
    observed = still_observed(units, meta, cells)
    is_key = F.col("level").isin("key", "unit_key")
    one_time = F.col("level").isin("time", "cell")
    pre = F.col("period") == "pre"
    table = (
        table.join(frame, "model")
        .join(units, ["model", "unit"], "left")
        .withColumn("_look", F.when(is_key, window.last).otherwise(F.abs("event_time")))
        .join(observed.withColumnRenamed("event_time", "_look"), ["model", "_look"], "left")
    )
    length = F.when(pre, F.coalesce("T0", "max_t0")).otherwise(
        F.col("T") - F.coalesce("T0", "min_t0")
    )
    size = F.when(pre, 0).when(is_key | one_time, F.coalesce("n_observed", F.lit(0))).otherwise(F.col("Ntr"))
    sign = F.when(pre, -1).otherwise(1)
    reach = F.when(pre, F.col("max_t0")).otherwise(F.col("T") - F.col("min_t0"))
    label = (
        F.when(one_time, F.col("event_time").cast("string"))
        .when(is_key, span_label(sign * window.first, sign * window.last))
        .otherwise(span_label(sign, sign * reach))
    )
    return table.select(
        "model", "level", "period", "comparator", label.alias("time"), "unit",
        "att_mean", "att_se", "out_tr", "out_ct", "out_ct_se", "sigma2",
        F.col("r_cv").alias("size_fct"),
        F.when(is_key, F.least(length, F.lit(window.length))).otherwise(length).cast("int").alias("size_period"),
        size.cast("int").alias("size_tr"),
        (F.col("N") - size).cast("int").alias("size_ct"),
    )


def inference_table(
    fit: dict[str, DataFrame],
    boot: DataFrame,
    weights: DataFrame | None = None,
    key_times: Sequence[int] | None = KEY_TIMES,
    alpha: float = 0.05,
    skip_short: bool = False,
) -> DataFrame:
    """All six levels of every model, with intervals, p-values and percent change.

    ``boot`` is read several times, so pass a stored table.  The staggered cells
    (treated units by months) are staged once; as a stored table their size is
    known to the planner, which broadcasts them to the draws only if they are
    small.

    Keyed by ``model``, ``level`` and ``period``; :func:`published_layout` gives
    the 22-column form.  Key times past the post period of a model are an error; with ``skip_short`` that
    model has no rows and the others keep theirs.
    """
    z_value(alpha)
    units, meta = fit["fit_units"], fit["fit_meta"]
    if key_times is None:
        window = default_window(units, meta)
    else:
        window = KeyWindow.of(key_times)
        able = models_with_window(window, units, meta)
        if not skip_short and not model_windows(units, meta).filter(F.col("post") < window.last).isEmpty():
            raise ValueError("key times reach past the post period of a model")
        fit = {name: df.join(able, "model", "left_semi") for name, df in fit.items()}
        units, boot = fit["fit_units"], boot.join(able, "model", "left_semi")
    cells = stage(with_weights(stagger(fit["fit_cells"], units), weights), "staggered_cells")
    draws = stagger_draws(boot, cells)
    keys = ["level", "model", "period", "unit", "event_time"]
    rows = level_estimates(cells, weights is not None, window).join(level_spreads(draws, window), keys, "left")
    return add_intervals(add_diagnostics(rows, fit, cells, window), alpha)


def published_layout(table: DataFrame) -> DataFrame:
    """The 22 published columns, in order."""
    named = {
        "att_ci.lower": "att_lower", "att_ci.upper": "att_upper",
        "out_ct_ci.lower": "out_ct_lower", "out_ct_ci.upper": "out_ct_upper",
        "delta_ci.lower": "delta_lower", "delta_ci.upper": "delta_upper",
    }
    table = table.withColumn("outcome", F.split("model", r"\|").getItem(2))
    return table.select(*[F.col(named.get(c, c)).alias(c) for c in INFERENCE_LAYOUT])
