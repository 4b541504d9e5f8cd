"""Counterfactual estimation on unit-by-time panels.

All functions take long *model cells*: ``model, unit, time, y, d, w, x`` with
``d`` the treatment indicator, ``w`` an outcome weight and ``x`` an array of
covariates (possibly empty).  Many models run in one plan, keyed by ``model``.

The estimator is the interactive fixed-effects counterfactual of Xu (2017) and
Bai (2009).  What the controls contribute is a Gram matrix over months, so the
work spreads over units and only month-sized matrices meet in one place.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spellpanel.session import stage

MIN_PRE_PERIODS = 6
MAX_RANK = 5
DRAWS = 10_000
SEED = 42
UNITS_PER_TASK = 2_000


@dataclass(frozen=True)
class Outcome:
    """One modelled outcome of a panel: its column, weight and covariates."""

    activity: str
    measure: str
    column: str
    weight: str | None = None
    covariates: tuple[str, ...] = ()


def model_cells(panel: DataFrame, outcomes: Sequence[Outcome], unit: str = "PROCODE3") -> DataFrame:
    """Panel to model cells, all outcomes in one pass; ``model`` is
    ``cohort|activity|measure``."""

    def cell(o: Outcome) -> Column:
        weight = F.col(o.weight) if o.weight else F.lit(None)
        x = F.array(*[F.col(c).cast("double") for c in o.covariates]).cast("array<double>")
        return F.struct(
            F.concat_ws("|", F.col("cohort"), F.lit(o.activity), F.lit(o.measure)).alias("model"),
            F.col(f"`{o.column}`").cast("double").alias("y"),
            weight.cast("double").alias("w"),
            x.alias("x"),
        )

    return panel.select(
        F.explode(F.array(*[cell(o) for o in outcomes])).alias("c"),
        F.col(unit).alias("unit"),
        F.col("time").cast("int").alias("time"),
        F.col("intervention").cast("int").alias("d"),
    ).select("c.model", "unit", "time", "c.y", "d", "c.w", "c.x")


def complete_cells(cells: DataFrame) -> DataFrame:
    """List-wise deletion of cells with a missing outcome, treatment or covariate."""
    return cells.filter(
        F.col("y").isNotNull() & F.col("d").isNotNull() & ~F.exists("x", lambda v: v.isNull())
    )


def unit_status(cells: DataFrame, min_pre: int = MIN_PRE_PERIODS) -> DataFrame:
    """Per model and unit: complete cells, how many of them untreated, start, treated or not, and whether it stays.

    ``T0`` is the last time before the unit's first treated one (its last time, if never treated), whether
    or not its outcome is known.  A unit stays with at least ``min_pre`` complete untreated cells; missing
    times by themselves drop no unit.
    """
    complete = complete_cells(cells)
    times = complete.select("model", "time").distinct().groupBy("model").agg(F.count("*").alias("T"))
    starts = cells.filter("d is not null").groupBy("model", "unit").agg(
        F.coalesce(F.min(F.when(F.col("d") == 1, F.col("time"))) - 1, F.max("time")).alias("T0"), F.max("d").alias("treated")
    )
    units = complete.groupBy("model", "unit").agg(
        F.count("*").alias("n_cells"), F.count_if(F.col("d") == 0).alias("n_pre")
    )
    return units.join(starts, ["model", "unit"]).join(times, "model").withColumn(
        "status", F.when(F.col("n_pre") < min_pre, "few pre-periods").otherwise("kept")
    )


def eligible_cells(cells: DataFrame, min_pre: int = MIN_PRE_PERIODS) -> DataFrame:
    """Cells of kept units, with ``treated`` and ``T0``."""
    kept = unit_status(cells, min_pre).filter("status = 'kept'").select("model", "unit", "treated", "T0")
    return complete_cells(cells).join(kept, ["model", "unit"])


def fit_units(cells: DataFrame) -> DataFrame:
    """Treated units with their number of pre-periods."""
    return (
        cells.filter("treated = 1")
        .select("model", "unit", F.col("T0").cast("int").alias("T0"))
        .distinct()
    )


def panel_sizes(cells: DataFrame) -> DataFrame:
    """Last time, units and treated units per model; times are numbered from 1."""
    units = cells.groupBy("model", "unit").agg(F.max("treated").alias("treated"), F.max("time").alias("last"))
    return units.groupBy("model").agg(
        F.max("last").cast("int").alias("T"),
        F.count("*").cast("int").alias("N"),
        F.sum("treated").cast("int").alias("Ntr"),
    )


def did_counterfactual(cells: DataFrame) -> dict[str, DataFrame]:
    """Two-way fixed effects without factors and covariates, on balanced and unbalanced panels.

    The counterfactual of a treated cell is the time effect of the controls (:func:`two_way_solution`)
    plus the unit's mean pre-period distance from those effects.
    """
    plain = cells.withColumn("x", F.array().cast("array<double>"))
    solution = stage(two_way_solution(plain), "two-way")
    effects = solution.filter("status = 'ok'").select("model", "time", "g")
    treated = cells.filter("treated = 1").join(effects, ["model", "time"])
    level = treated.groupBy("model", "unit").agg(
        F.avg(F.when(F.col("d") == 0, F.col("y") - F.col("g"))).alias("a")
    )
    out = treated.join(level, ["model", "unit"]).select(
        "model",
        "unit",
        "time",
        F.col("y").alias("y_tr"),
        (F.col("g") + F.col("a")).alias("y_ct"),
        (F.col("y") - F.col("g") - F.col("a")).alias("eff"),
        "d",
    )
    spread = solution.groupBy("model").agg(
        F.try_divide(F.max("sse"), F.nullif(F.max(_free(F.lit(0))), F.lit(0)).cast("double")).alias("sigma2")
    )
    meta = (
        panel_sizes(cells)
        .join(spread, "model", "left")
        .select("model", "T", "N", "Ntr", "sigma2", F.lit(0).alias("r_cv"), F.lit("ok").alias("status"))
    )
    return {"fit_meta": meta, "fit_units": fit_units(cells), "fit_cells": out}


def _free(rank: Column) -> Column:
    """Control cells less what the effects, the factors and the slopes take; at least zero."""
    k = F.size("b")
    taken = F.col("n_co") + F.col("n_times") - 1 + rank * (F.col("n_co") + F.col("n_times") - rank) + k
    return F.greatest(F.col("n_cells") - taken, F.lit(0))


def _in_buckets(co: DataFrame, units_per_task: int) -> DataFrame:
    """Control cells with ``vals`` (outcome and covariates) and a bucket of at most about ``units_per_task`` units."""
    per_model = co.select("model", "unit").distinct().groupBy("model").agg(F.count("*").alias("n"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / units_per_task)).cast("int")
    return co.join(per_model.select("model", buckets.alias("_b")), "model").select(
        "model", "unit", "time", F.concat(F.array("y"), F.col("x")).alias("vals"),
        F.expr("pmod(hash(unit), _b)").alias("bucket"),
    )


def _cube(pdf: pd.DataFrame, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units by variables by times, NaN where a cell is missing, and the units."""
    units, at = np.unique(pdf["unit"].to_numpy().astype(str), return_inverse=True)
    vals = np.stack(pdf["vals"].to_numpy())
    cube = np.full((len(units), vals.shape[1], len(times)), np.nan)
    cube[at, :, np.searchsorted(times, pdf["time"].to_numpy())] = vals
    return cube, units


def two_way_moments(cells: DataFrame, units_per_task: int = UNITS_PER_TASK) -> DataFrame:
    """What the normal equations of unit and time effects need of the observed control cells.

    With each unit's own mean taken out, what remains is month-sized: rows ``(model, kind, i, j, v)`` hold
    how months share units (``L``), sums by variable and month (``r``), products of variables (``W``), cells
    and units (``n``).  Buckets of units shrink to these sums before they move.
    """
    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.unique(pdf["time"].to_numpy())
        z, units = _cube(pdf, times)
        seen = ~np.isnan(z[:, 0, :])
        share = seen / seen.sum(axis=1, keepdims=True)
        z = np.where(seen[:, None, :], z - np.nanmean(z, axis=2, keepdims=True), 0.0)
        links = np.diag(seen.sum(axis=0)) - seen.T.astype(float) @ share
        sums, products = z.sum(axis=0), np.einsum("uat,ubt->ab", z, z)
        k1, m = sums.shape
        ti, tj = np.meshgrid(times, times, indexing="ij")
        vi, vt = np.meshgrid(np.arange(k1), times, indexing="ij")
        wi, wj = np.meshgrid(np.arange(k1), np.arange(k1), indexing="ij")
        return pd.DataFrame({
            "model": pdf["model"].iloc[0],
            "kind": np.repeat(["L", "r", "W", "n"], [m * m, k1 * m, k1 * k1, 2]),
            "i": np.r_[ti.ravel(), vi.ravel(), wi.ravel(), 0, 1],
            "j": np.r_[tj.ravel(), vt.ravel(), wj.ravel(), 0, 0],
            "v": np.r_[links.ravel(), sums.ravel(), products.ravel(), seen.sum(), len(units)].astype(float),
        })

    rows = _in_buckets(cells.filter("treated = 0"), units_per_task)
    parts = rows.groupBy("model", "bucket").applyInPandas(partial, "model string, kind string, i int, j int, v double")
    return parts.groupBy("model", "kind", "i", "j").agg(F.sum("v").alias("v"))


SOLUTION = (
    "model string, r int, time int, g double, xg array<double>, f array<double>, b array<double>, "
    "sse double, n_co int, n_times int, n_cells int, status string"
)


def two_way_solution(cells: DataFrame, units_per_task: int = UNITS_PER_TASK) -> DataFrame:
    """Least squares of unit effects, time effects and slopes over the observed control cells.

    One row a model and time: time effect ``g`` (up to a constant of the model), slopes ``b``, residual sum of
    squares.  Units are taken out in closed form, so that a system of one equation a month is left,
    solved once for the outcome and every covariate; missing cells need no iteration.
    """
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        model, part = pdf["model"].iloc[0], dict(list(pdf.groupby("kind")))
        times = np.unique(part["L"]["i"].to_numpy())
        at = lambda v: np.searchsorted(times, v.to_numpy())
        n_cells, n_co = part["n"].sort_values("i")["v"].to_numpy()
        k1 = int(part["W"]["i"].max()) + 1
        links, sums, w = np.zeros((len(times),) * 2), np.zeros((k1, len(times))), np.zeros((k1, k1))
        links[at(part["L"]["i"]), at(part["L"]["j"])] = part["L"]["v"]
        sums[part["r"]["i"], at(part["r"]["j"])] = part["r"]["v"]
        w[part["W"]["i"], part["W"]["j"]] = part["W"]["v"]
        inverse = np.linalg.pinv(links, rcond=1e-12, hermitian=True)
        c = w - sums @ inverse @ sums.T
        b = scaled_solve(c[1:, 1:], c[1:, 0])
        g = inverse @ (sums[0] - b @ sums[1:])
        sse = max(float(c[0, 0] - b @ c[1:, 0]), 0.0)
        return pd.DataFrame({
            "model": model, "r": 0, "time": times, "g": g, "xg": [[0.0] * (k1 - 1)] * len(times), "f": [[]] * len(times),
            "b": [b.tolist()] * len(times), "sse": sse, "n_co": int(n_co), "n_times": len(times), "n_cells": int(n_cells), "status": "ok"})

    return two_way_moments(cells, units_per_task).groupBy("model").applyInPandas(solve, SOLUTION)


def scaled_solve(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Solution of the normal equations with variables scaled alike; a variable without variance gets zero."""
    scale = np.sqrt(np.clip(np.diag(a), 0, None))
    inv = np.where(scale > 1e-8, 1 / np.where(scale > 1e-8, scale, 1), 0)
    return inv * (np.linalg.pinv(a * np.outer(inv, inv), rcond=1e-10) @ (c * inv))


# ---------------------------------------------------------------- covariates


def covariate_slope(cells: DataFrame) -> DataFrame:
    """Slope of the first covariate beside unit and time effects of the controls, other covariates left out."""
    one = cells.withColumn("x", F.slice("x", 1, 1))
    return two_way_solution(one).groupBy("model").agg(F.max(F.element_at("b", 1)).alias("slope"))


def slopes(cells: DataFrame, rank: int = 0) -> DataFrame:
    """Covariate slopes (model, position, slope) at a given number of factors.

    A model whose effects, factors and slopes leave no degree of freedom has none.
    """
    known = factor_solutions(cells, [rank]).filter("status = 'ok'").filter(_free(F.col("r")) > 0)
    sol = known.groupBy("model").agg(F.max("b").alias("b"))
    return sol.select("model", F.posexplode("b").alias("pos", "slope")).withColumn("pos", F.col("pos") + 1)


# -------------------------------------------------------------- factor model

# Row kinds of the cross-product table besides the products themselves.
_SUM, _VARS, _TIME = -1, -2, -3


def control_gram(cells: DataFrame, units_per_task: int = UNITS_PER_TASK) -> DataFrame:
    """Cross-products over time of the unit-demeaned control series of complete panels.

    Rows ``(model, i, j, v)`` over positions ``variable * T + time``.  Negative
    ``i`` mark column sums with the unit count, the number of variables and the
    times, the last two scaled by the unit count so that they add up too.
    Buckets of units shrink to month-sized partial sums before they move.
    """
    rows = _in_buckets(cells.filter("treated = 0"), units_per_task)

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["unit", "time"])
        n = pdf["unit"].nunique()
        k1 = len(pdf["vals"].iloc[0])
        z = np.stack(pdf["vals"].to_numpy()).reshape(n, -1, k1)
        times = pdf["time"].to_numpy()[: z.shape[1]]
        z = z - z.mean(axis=1, keepdims=True)
        z = z.transpose(0, 2, 1).reshape(n, -1)
        size = z.shape[1]
        i, j = np.indices((size, size))
        return pd.DataFrame(
            {
                "model": pdf["model"].iloc[0],
                "i": np.r_[i.ravel(), np.full(size + 1, _SUM), _VARS, np.full(len(times), _TIME)],
                "j": np.r_[j.ravel(), np.arange(size), -1, -1, np.arange(len(times))],
                "v": np.r_[(z.T @ z).ravel(), z.sum(axis=0), n, n * k1, n * times].astype(float),
            }
        )

    parts = rows.groupBy("model", "bucket").applyInPandas(partial, "model string, i int, j int, v double")
    return parts.groupBy("model", "i", "j").agg(F.sum("v").alias("v"))


def solve_gram(gram: np.ndarray, months: int, rank: int, tol: float = 1e-5, cap: int = 500, start=None):
    """Slopes, factors, residual sum of squares and whether ``cap`` rounds were enough, from control cross-products.

    Alternates least squares for the slopes given the factors with the leading
    eigenvectors given the slopes, both from the same cross-product blocks; ``start`` may give slopes and factors.
    """
    k = gram.shape[0] // months - 1
    blocks = gram.reshape(k + 1, months, k + 1, months)

    def residual_gram(b):
        c = np.r_[1.0, -b]
        return np.einsum("a,atbs,b->ts", c, blocks, c, optimize=True)

    b, f = start or (np.zeros(k), np.zeros((months, 0)))
    settled = False
    for _ in range(cap):
        off = np.eye(months) - f @ f.T / months
        new = b
        if k:
            a = np.einsum("atbs,ts->ab", blocks, off, optimize=True)
            new = scaled_solve(a[1:, 1:], a[1:, 0])
        if rank:
            _, vec = np.linalg.eigh(residual_gram(new))
            f = vec[:, ::-1][:, :rank] * np.sqrt(months)
        moved = np.abs(new - b).max() if k else 0.0
        b = new
        settled = bool(moved < tol)
        if settled:
            break
    sse = float(np.trace((np.eye(months) - f @ f.T / months) @ residual_gram(b)))
    return b, f, max(sse, 0.0), settled


def solve_models(gram: DataFrame, ranks: Sequence[int]) -> DataFrame:
    """Time effects, factors ``f``, slopes ``b`` and ``sse`` per model, rank and time (layout ``SOLUTION``).

    Each model's cross-products (months by months, whatever the number of
    units) meet in one task; a model that cannot be solved yields a status row.
    """
    ranks = list(ranks)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        model, out = pdf["model"].iloc[0], []
        try:
            kind, pos, v = (pdf[c].to_numpy() for c in ("i", "j", "v"))
            n = v[(kind == _SUM) & (pos == -1)][0]
            k1 = int(round(v[kind == _VARS][0] / n))
            at = (kind == _SUM) & (pos >= 0)
            size = int(at.sum())
            sums = np.zeros(size)
            sums[pos[at]] = v[at]
            times = np.zeros(size // k1)
            at = kind == _TIME
            times[pos[at]] = v[at] / n
            g = np.zeros((size, size))
            at = kind >= 0
            g[kind[at], pos[at]] = v[at]
            g -= np.outer(sums, sums) / n
            means = (sums / n).reshape(k1, -1)
            for r in ranks:
                if r and r >= min(n, len(times)):
                    continue
                b, f, sse, settled = solve_gram(g, len(times), r)
                state = "ok" if settled else f"failed: rank {r} did not converge"
                out.append(_solution_rows(model, r, np.round(times).astype(int), means, f, b, sse, n, n * len(times), state))
        except (np.linalg.LinAlgError, ValueError, IndexError) as error:
            out.append(pd.DataFrame([(model, 0, -1, None, [], [], [], None, 0, 0, 0, f"failed: {error}")], columns=_SOLUTION_NAMES))
        return pd.concat(out, ignore_index=True)

    return gram.groupBy("model").applyInPandas(solve, SOLUTION)


_SOLUTION_NAMES = [c.split()[0] for c in SOLUTION.split(", ")]


def _solution_rows(model, r, times, means, f, b, sse, n_co, n_cells, status) -> pd.DataFrame:
    """A row a time; ``means`` are the time effects of the outcome and of each covariate."""
    return pd.DataFrame({
        "model": model, "r": r, "time": times, "g": means[0], "xg": means[1:].T.tolist(), "f": np.asarray(f).tolist(),
        "b": [np.asarray(b).tolist()] * len(times), "sse": sse, "n_co": int(n_co), "n_times": len(times), "n_cells": int(n_cells),
        "status": status})[_SOLUTION_NAMES]


# ------------------------------------------------------- factors with missing cells

#: Rounds at most, and the change in a round (relative to the spread of the outcome) that ends them.
ROUNDS, SETTLED = 100, 1e-6
_STATE = (
    "model string, r int, times array<int>, g array<double>, xg array<double>, f array<double>, b array<double>, sse double, "
    "n_co int, n_cells int, settled boolean"
)
_STATE_NAMES = [c.split()[0] for c in _STATE.split(", ")]


@dataclass(frozen=True)
class _Round:
    """Where the rounds of one model and rank stand: time effects of the variables, factors, slopes."""

    g: np.ndarray  # months
    xg: np.ndarray  # covariates x months
    f: np.ndarray  # months x rank
    b: np.ndarray
    sse: float = np.nan
    moved: float = np.inf


def fill_missing(y: np.ndarray, x: np.ndarray, seen: np.ndarray, at: _Round) -> np.ndarray:
    """Unseen cells of units by months from each unit's own least squares on a constant and the factors."""
    base = at.g + np.einsum("k,nkt->nt", at.b, x - at.xg)
    a = np.column_stack([np.ones(len(at.g)), at.f])
    out = np.where(seen, y, 0.0)
    for u in np.flatnonzero(~seen.all(axis=1)):
        s = seen[u]
        coef = np.linalg.pinv(a[s], rcond=1e-10) @ (out[u, s] - base[u, s])
        out[u, ~s] = base[u, ~s] + a[~s] @ coef
    return out


def _products(y: np.ndarray, xd: np.ndarray) -> np.ndarray:
    """Units, sums and cross-products of one bucket's filled outcome, with itself and with the covariates, end to end."""
    y = y - y.mean(axis=1, keepdims=True)
    return np.r_[len(y), y.sum(axis=0), (y.T @ y).ravel(), (y.T @ xd).ravel()]


def _fixed_products(xd: np.ndarray) -> np.ndarray:
    """The same of the covariates alone, which no round changes."""
    return np.r_[xd.sum(axis=0), (xd.T @ xd).ravel()]


def _flat_covariates(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=2, keepdims=True)).reshape(len(x), -1)


def next_round(at: _Round, v: np.ndarray, fixed: np.ndarray) -> _Round:
    """Time effects, factors and slopes from the cross-products of the filled panel."""
    months, k, rank = len(at.g), len(at.b), at.f.shape[1]
    km, n = k * months, v[0]
    gram = np.zeros((months + km,) * 2)
    gram[:months, :months] = v[1 + months : 1 + months + months * months].reshape(months, months)
    gram[:months, months:] = v[1 + months + months * months :].reshape(months, km)
    gram[months:, :months] = gram[:months, months:].T
    gram[months:, months:] = fixed[km:].reshape(km, km)
    total = np.r_[v[1 : 1 + months], fixed[:km]]
    gram -= np.outer(total, total) / n
    b, f, sse, _ = solve_gram(gram, months, rank, cap=2, start=(at.b, at.f))
    means = total / n
    spread = np.sqrt(max(np.trace(gram[:months, :months]) / (n * months), 1e-300))
    shift = means[:months] - at.g
    slopes = np.abs(b - at.b) * np.sqrt(np.diag(gram)[months:].reshape(k, months).mean(axis=1) / n) if k else np.zeros(0)
    moved = max(np.abs(f @ f.T - at.f @ at.f.T).max() / months, np.abs(shift - shift.mean()).max() / spread, slopes.max(initial=0.0) / spread)
    return _Round(means[:months], means[months:].reshape(k, months), f, b, sse, float(moved))


def _plain_round(y: np.ndarray, at: _Round) -> _Round:
    """:func:`next_round` without covariates, from the filled series themselves (fewer units than months make this cheap)."""
    n, months, rank = *y.shape, at.f.shape[1]
    z = y - y.mean(axis=1, keepdims=True)
    means = z.mean(axis=0)
    z = z - means
    _, size, v = np.linalg.svd(z, full_matrices=False)
    f = v[:rank].T * np.sqrt(months)
    shift, spread = means - at.g, max(np.sqrt((z * z).sum() / (n * months)), 1e-150)
    moved = max(np.abs(f @ f.T - at.f @ at.f.T).max() / months, np.abs(shift - shift.mean()).max() / spread)
    return _Round(means, at.xg, f, at.b, float((size[rank:] ** 2).sum()), float(moved))


def rounds_in_memory(y: np.ndarray, x: np.ndarray, seen: np.ndarray, at: _Round, rounds: int, tol: float) -> _Round:
    """All rounds over one array of units, as many as settle it."""
    if not len(at.b):
        for _ in range(rounds):
            at = _plain_round(fill_missing(y, x, seen, at), at)
            if at.moved < tol:
                break
        return at
    xd = _flat_covariates(x)
    fixed = _fixed_products(xd)
    for _ in range(rounds):
        at = next_round(at, _products(fill_missing(y, x, seen, at), xd), fixed)
        if at.moved < tol:
            break
    return at


def _series(pdf: pd.DataFrame, times: np.ndarray):
    """Outcome, covariates (a unit's own mean where unseen) and what is seen, units by months."""
    z, units = _cube(pdf, times)
    seen = ~np.isnan(z[:, 0])
    x = np.where(seen[:, None], z[:, 1:], np.nanmean(z[:, 1:], axis=2, keepdims=True) if z.shape[1] > 1 else 0.0)
    return z[:, 0], x, seen, units


def _round_of(job) -> _Round:
    months = len(job.times)
    return _Round(np.asarray(job.g), np.asarray(job.xg, dtype=float).reshape(-1, months), np.asarray(job.f, dtype=float).reshape(months, -1),
                  np.asarray(job.b, dtype=float))


def _state_row(job, at: _Round, tol: float) -> tuple:
    return (job.model, job.r, job.times, at.g, at.xg.ravel(), at.f.ravel(), at.b, at.sse, job.n_co, job.n_cells, bool(at.moved < tol))


def missing_solutions(cells: DataFrame, ranks: Sequence[int], start: DataFrame, rounds: int = ROUNDS,
                      tol: float = SETTLED, units_per_task: int = UNITS_PER_TASK) -> DataFrame:
    """Factors of panels with missing control cells, by expectation and maximisation (layout ``SOLUTION``).

    Each round fills a unit's missing cells with what its observed ones and the current time effects, slopes and
    factors say (its own least squares on a constant and the factors), sums the cross-products of the filled
    series by bucket of units, and solves for new factors as in complete panels.  Filled cells fit exactly once
    nothing moves, so the fixed point is least squares over observed cells.  ``start`` is
    :func:`two_way_solution`.  Where one bucket holds all units of a model, its rounds run in that task; the same
    rounds of other models are passes over the cells, with the state (one row a model and rank) stored after
    each, and what has settled left out of later ones.  What does not settle in ``rounds`` gets a failed status; a
    rank that leaves no degree of freedom is not tried.
    """
    co = stage(_in_buckets(cells.filter("treated = 0"), units_per_task), "em-cells")
    tasks = stage(co.select("model", "bucket").distinct().withColumn(
        "alone", F.count("*").over(Window.partitionBy("model")) == 1), "em-tasks")
    first = start.filter("status = 'ok'").groupBy("model").agg(
        F.array_sort(F.collect_list(F.struct("time", "g"))).alias("at"), F.max("b").alias("b"), F.max("n_co").alias("n_co"),
        F.max("n_cells").alias("n_cells"))
    zero = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    state = first.select(
        "model", F.explode(F.array(*[F.lit(int(r)) for r in ranks])).alias("r"), "at", "b", "n_co", "n_cells").filter(
        "r < n_co and r < size(at) and n_cells > n_co + size(at) - 1 + r * (n_co + size(at) - r) + size(b)").select(
        "model", "r", F.col("at.time").alias("times"), F.col("at.g").alias("g"), zero(F.size("b") * F.size("at")).alias("xg"),
        zero(F.col("r") * F.size("at")).alias("f"), "b", F.lit(None).cast("double").alias("sse"), "n_co", "n_cells",
        F.lit(False).alias("settled"))
    state = stage(state, "em-state")

    def alone(key, pdf: pd.DataFrame, jobs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) and len(jobs):
            y, x, seen, _ = _series(pdf, np.asarray(jobs["times"].iloc[0]))
            out = [_state_row(job, rounds_in_memory(y, x, seen, _round_of(job), rounds, tol), tol) for job in jobs.itertuples()]
        return pd.DataFrame(out, columns=_STATE_NAMES)

    def fill(key, pdf: pd.DataFrame, jobs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) and len(jobs):
            y, x, seen, _ = _series(pdf, np.asarray(jobs["times"].iloc[0]))
            xd = _flat_covariates(x)
            out = [(key[0], -1, _fixed_products(xd).tobytes())]
            out += [(key[0], int(job.r), _products(fill_missing(y, x, seen, _round_of(job)), xd).tobytes()) for job in jobs.itertuples()]
        return pd.DataFrame(out, columns=["model", "r", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v) for v in pdf["sums"])
        return pd.DataFrame({"model": pdf["model"].iloc[:1], "r": pdf["r"].iloc[:1], "sums": [total.tobytes()]})

    def solve(key, sums: pd.DataFrame, jobs: pd.DataFrame) -> pd.DataFrame:
        found = {int(r): np.frombuffer(v) for r, v in zip(sums["r"], sums["sums"])}
        return pd.DataFrame([_state_row(job, next_round(_round_of(job), found[int(job.r)], found[-1]), tol) for job in jobs.itertuples()],
                            columns=_STATE_NAMES)

    def jobs(state: DataFrame, which: str) -> DataFrame:
        return state.join(tasks.filter(which).select("model", "bucket"), "model").select(*state.columns, "bucket")

    one = jobs(state, "alone")
    done = [stage(co.groupBy("model", "bucket").cogroup(one.groupBy("model", "bucket")).applyInPandas(alone, _STATE), "em-state")]
    state = state.join(tasks.filter("alone").select("model"), "model", "left_anti")
    for _ in range(rounds):
        if state.isEmpty():
            break
        parts = co.groupBy("model", "bucket").cogroup(jobs(state, "not alone").groupBy("model", "bucket")).applyInPandas(
            fill, "model string, r int, sums binary")
        # in two steps, so that no task holds the products of all buckets
        few = parts.groupBy("model", "r", F.expr("pmod(xxhash64(sums), 64)").alias("_p")).applyInPandas(add, "model string, r int, sums binary")
        merged = few.groupBy("model", "r").applyInPandas(add, "model string, r int, sums binary")
        moved = stage(merged.groupBy("model").cogroup(state.groupBy("model")).applyInPandas(solve, _STATE), "em-state")
        done.append(moved.filter("settled"))
        state = moved.filter("not settled")
    every = state
    for part in done:
        every = every.unionByName(part)
    months, at = F.size("times"), F.col("pos")
    status = F.when(F.col("settled"), "ok").otherwise(F.concat(F.lit("failed: rank "), F.col("r").cast("string"), F.lit(" did not converge")))
    own = F.when(F.size("b") > 0, F.transform(F.sequence(F.lit(1), F.size("b")), lambda q: F.get("xg", (q - 1) * months + at))).otherwise(
        F.array().cast("array<double>"))
    return every.select("*", F.posexplode("times").alias("pos", "time")).select(
        "model", "r", "time", F.get("g", at).alias("g"), own.alias("xg"), F.slice("f", at * F.col("r") + 1, F.col("r")).alias("f"),
        "b", "sse", "n_co", months.alias("n_times"), "n_cells", status.alias("status"))


def factor_solutions(cells: DataFrame, ranks: Sequence[int]) -> DataFrame:
    """Solutions of every model at every rank, whether or not cells of its controls are missing (layout ``SOLUTION``).

    Complete panels are solved from one set of cross-products; the others by :func:`two_way_solution` without
    factors and by :func:`missing_solutions` with them.
    """
    ranks = list(ranks)
    co = cells.filter("treated = 0")
    months = co.select("model", "time").distinct().groupBy("model").agg(F.count("*").alias("months"))
    shape = stage(co.groupBy("model", "unit").agg(F.count("*").alias("n")).groupBy("model").agg(F.min("n").alias("least")).join(
        months, "model").select("model", (F.col("least") < F.col("months")).alias("gaps")), "panel-shapes")
    gaps = cells.join(shape.filter("gaps").select("model"), "model", "left_semi")
    found = stage(solve_models(control_gram(cells.join(shape.filter("not gaps").select("model"), "model", "left_semi")), ranks), "factors")
    if shape.filter("gaps").isEmpty():
        return found
    flat = stage(two_way_solution(gaps), "two-way")
    if 0 in ranks:
        found = found.unionByName(flat)
    if any(ranks):
        found = found.unionByName(missing_solutions(gaps, [r for r in ranks if r], flat))
    return found


def treated_fits(cells: DataFrame, solution: DataFrame) -> DataFrame:
    """Counterfactual of each treated unit at each candidate rank.

    Per unit, the pre-period gap to the time effects is regressed on a constant
    and the factors.  ``held_out`` is the squared error of a pre-period cell
    when it is left out of that regression.
    """
    rows = (
        cells.filter("treated = 1")
        .join(solution.filter("status = 'ok'"), ["model", "time"])
        .select("model", "unit", "time", "r", "y", "d", "g", "x", "xg", "f", "b")
    )

    def fit_unit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time")
        y, g = pdf["y"].to_numpy(), pdf["g"].to_numpy()
        b = np.asarray(pdf["b"].iloc[0])
        if len(b):
            g = g + (np.stack(pdf["x"].to_numpy()) - np.stack(pdf["xg"].to_numpy())) @ b
        f = np.stack(pdf["f"].to_numpy()).reshape(len(y), -1)
        pre = pdf["d"].to_numpy() == 0
        gap, held_out = fit_gap(y - g, f, pre)
        return pd.DataFrame(
            {
                "model": pdf["model"],
                "unit": pdf["unit"],
                "time": pdf["time"],
                "r": pdf["r"],
                "y": y,
                "y_ct": g + gap,
                "d": pdf["d"],
                "held_out": held_out,
            }
        )

    return rows.groupBy("model", "unit", "r").applyInPandas(
        fit_unit,
        "model string, unit string, time int, r int, y double, y_ct double, d int, held_out double",
    )


def fit_gap(gap: np.ndarray, f: np.ndarray, pre: np.ndarray):
    """Fitted gap at all times and squared leave-one-out errors at pre times.

    NaN throughout when there are too few pre-periods for the rank.
    """
    a = np.column_stack([np.ones(len(gap)), f])
    held_out = np.full(len(gap), np.nan)
    if pre.sum() < a.shape[1] + 1:
        return np.full(len(gap), np.nan), held_out
    inverse = np.linalg.pinv(a[pre])
    coef = inverse @ gap[pre]
    leverage = np.einsum("ij,ji->i", a[pre], inverse)
    error = gap[pre] - a[pre] @ coef
    held_out[pre] = (error / np.maximum(1 - leverage, 1e-12)) ** 2
    return a @ coef, held_out


def choose_rank(fits: DataFrame) -> DataFrame:
    """Rank with the least mean held-out error per model; ties go to fewer factors.

    A rank that some treated unit has too few pre-periods for is not considered.
    """
    err = F.when(~F.isnan("held_out"), F.col("held_out"))
    scored = (
        fits.groupBy("model", "r")
        .agg(F.avg(err).alias("mspe"), F.max(F.isnan("y_ct")).alias("infeasible"))
        .filter(~F.col("infeasible") & F.col("mspe").isNotNull())
    )
    best = scored.groupBy("model").agg(F.min(F.struct("mspe", "r")).alias("best"))
    return best.select("model", F.col("best.r").alias("r"), F.col("best.mspe").alias("mspe"))


def fit_sweep(
    cells: DataFrame,
    max_rank: int = MAX_RANK,
    rank: int | None = None,
    models: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Fit every model in ``cells`` (see :func:`eligible_cells`) in one plan.

    The rank is cross-validated over ``0..max_rank`` unless given.  A model
    without treated units, with fewer than two controls or without a usable
    rank yields a ``fit_meta`` row whose status says so; so does one of the
    asked-for ``models`` that has no eligible cells at all.
    """
    ranks = range(max_rank + 1) if rank is None else [rank]
    solution = stage(factor_solutions(cells, ranks), "solutions")
    fits = stage(treated_fits(cells, solution), "treated_fits")
    sizes = panel_sizes(cells)
    usable = sizes.filter("Ntr > 0 and N - Ntr >= 2").select("model")
    best = choose_rank(fits).join(usable, "model", "left_semi")
    chosen = fits.join(best.select("model", "r"), ["model", "r"], "left_semi")
    fit_cells = chosen.select(
        "model",
        "unit",
        "time",
        F.col("y").alias("y_tr"),
        "y_ct",
        (F.col("y") - F.col("y_ct")).alias("eff"),
        "d",
    )
    spread = solution.groupBy("model", "r").agg(
        F.max("sse").alias("sse"), F.max(_free(F.col("r"))).alias("free"), F.max("status").alias("solved")
    )
    failed = spread.filter("solved <> 'ok'").select("model", F.col("solved").alias("error"))
    meta = (
        sizes.join(best, "model", "left")
        .join(spread.select("model", "r", "sse", "free"), ["model", "r"], "left")
        .join(failed, "model", "left")
        .select(
            "model",
            "T",
            "N",
            "Ntr",
            F.try_divide(F.col("sse"), F.when(F.col("free") > 0, F.col("free")).cast("double")).alias("sigma2"),
            F.col("r").alias("r_cv"),
            F.when(F.col("r").isNotNull(), "ok")
            .when(F.col("error").isNotNull(), F.col("error"))
            .when(F.col("Ntr") == 0, "failed: no treated units")
            .when(F.col("N") - F.col("Ntr") < 2, "failed: fewer than two controls")
            .otherwise("failed: no usable rank")
            .alias("status"),
        )
    )
    if models is not None:
        meta = models.select("model").distinct().join(meta, "model", "left").withColumn(
            "status", F.coalesce("status", F.lit("failed: no eligible units"))
        )
    units = fit_units(cells).join(best.select("model"), "model", "left_semi")
    return {"fit_meta": meta, "fit_units": units, "fit_cells": fit_cells}


# ------------------------------------------------------------------ bootstrap


def _two_way_in_memory(y: np.ndarray, x: np.ndarray, seen: np.ndarray) -> _Round:
    """Time effects and slopes over the seen cells of one array of units (:func:`two_way_solution` for one task)."""
    z = np.where(seen[:, None], np.concatenate([y[:, None], x], axis=1), np.nan)
    z = np.where(seen[:, None], z - np.nanmean(z, axis=2, keepdims=True), 0.0)
    links = np.diag(seen.sum(axis=0)) - seen.T.astype(float) @ (seen / seen.sum(axis=1, keepdims=True))
    inverse, sums = np.linalg.pinv(links, rcond=1e-12, hermitian=True), z.sum(axis=0)
    c = np.einsum("uat,ubt->ab", z, z) - sums @ inverse @ sums.T
    b = scaled_solve(c[1:, 1:], c[1:, 0])
    return _Round(inverse @ (sums[0] - b @ sums[1:]), np.zeros((len(b), y.shape[1])), np.zeros((y.shape[1], 0)), b, moved=0.0)


def _refit(y_co, x_co, seen, y_tr, x_tr, pre, rank, start=None):
    """Fitted control series, counterfactuals of treated series and the rounds' end, all units by months.

    ``seen`` and ``pre`` say which control cells and which untreated cells of treated units are known.  ``start``
    is where a fit to much the same data ended; a draw goes on from there.
    """
    n, months = y_co.shape
    rank = min(rank, n - 1, months - 1)
    if rank == 0:
        at = _two_way_in_memory(y_co, x_co, seen)
    elif seen.all() and not len(x_co[0]):
        at = _plain_round(y_co, _Round(np.zeros(months), np.zeros((0, months)), np.zeros((months, rank)), np.zeros(0)))
    elif seen.all():
        xd = _flat_covariates(x_co)
        z = np.concatenate([y_co - y_co.mean(axis=1, keepdims=True), xd], axis=1)
        means = z.mean(axis=0)
        b, f, _, _ = solve_gram((z - means).T @ (z - means), months, rank, start=start and (start.b, start.f))
        at = _Round(means[:months], means[months:].reshape(-1, months), f, b)
    else:
        if start is None or start.f.shape[1] != rank:
            flat = _two_way_in_memory(y_co, x_co, seen)
            start = _Round(flat.g, flat.xg, np.zeros((months, rank)), flat.b)
        at = rounds_in_memory(y_co, x_co, seen, start, 30, 1e-4)
    a = np.column_stack([np.ones(months), at.f])

    def fitted(y, x, known):
        base = at.g + np.einsum("k,nkt->nt", at.b, x - at.xg)
        whole = known.all(axis=1)
        out = np.empty_like(base)
        out[whole] = base[whole] + (y[whole] - base[whole]) @ np.linalg.pinv(a).T @ a.T
        for u in np.flatnonzero(~whole):
            s = known[u]
            out[u] = base[u] + a @ (np.linalg.pinv(a[s], rcond=1e-10) @ (y[u, s] - base[u, s]))
        return out

    return fitted(y_co, x_co, seen), fitted(y_tr, x_tr, pre), at


def _rng(seed: int, *key) -> np.random.Generator:
    return np.random.default_rng([seed, *[zlib.crc32(str(k).encode()) for k in key]])


def bootstrap_effects(
    cells: DataFrame,
    fit_meta: DataFrame,
    draws: int = DRAWS,
    seed: int = SEED,
    draws_per_task: int = 250,
    pool_size: int = 500,
) -> DataFrame:
    """Parametric bootstrap: effects by model, unit, time and draw.

    Each draw resamples whole residual series (controls from their own, treated
    units from prediction errors of controls that play treated), adds them to
    the fitted values without effect and refits at the chosen rank, over the cells each unit has; a residual
    that a donor lacks is zero.  The errors of ``pool_size`` plays are worked out first, in tasks of their own; who
    plays is drawn from all controls, whatever their names or number.  A model's panel is months by units
    and travels whole to each block of plays and draws.  Generators are seeded by (seed, model,
    draw), so the result does not depend on how the work is split.
    """
    ranked = fit_meta.filter("status = 'ok'").select("model", F.col("r_cv").alias("rank"))

    def dealt(count: int, per_task: int) -> DataFrame:
        blocks = -(-count // per_task)
        return (
            cells.join(ranked, "model")
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            .select("model", "block", "unit", "time", F.concat(F.array("y"), F.col("x")).alias("vals"), "treated", "T0", "rank")
        )

    def arrays(pdf: pd.DataFrame):
        control, treat = pdf[pdf["treated"] == 0], pdf[pdf["treated"] == 1]
        times = np.unique(control["time"].to_numpy())
        treat = treat[np.isin(treat["time"].to_numpy(), times)]
        y_co, x_co, seen, _ = _series(control, times)
        y_tr, x_tr, seen_tr, units = _series(treat, times)
        starts = treat.groupby(treat["unit"].astype(str))["T0"].first().loc[units].to_numpy()
        fit = _refit(y_co, x_co, seen, y_tr, x_tr, seen_tr & (times <= starts[:, None]), int(pdf["rank"].iloc[0]))
        return times, (y_co, x_co, seen), (y_tr, x_tr, seen_tr, units, starts), fit

    plays_per_task = max(1, -(-pool_size // 4))

    def play(pdf: pd.DataFrame) -> pd.DataFrame:
        model, first, rank = pdf["model"].iloc[0], int(pdf["block"].iloc[0]) * plays_per_task, int(pdf["rank"].iloc[0])
        times, (y_co, x_co, seen), (*_, starts), (_, _, end) = arrays(pdf)
        distinct, n, out = np.unique(starts), len(y_co), []
        for p in range(first, min(first + plays_per_task, pool_size)):
            rng = _rng(seed, model, "pool", p)
            plays = int(rng.integers(n))
            rest = rng.choice(np.delete(np.arange(n), plays), n - 1)
            played = np.repeat(y_co[plays][None], len(distinct), axis=0)
            played_x = np.repeat(x_co[plays][None], len(distinct), axis=0)
            before = seen[plays] & (times <= distinct[:, None])
            _, fitted, _ = _refit(y_co[rest], x_co[rest], seen[rest], played, played_x, before, rank, end)
            out.append((model, p, np.where(seen[plays], played - fitted, 0.0).tobytes()))
        return pd.DataFrame(out, columns=["model", "p", "errors"])

    pool = stage(dealt(pool_size, plays_per_task).groupBy("model", "block").applyInPandas(play, "model string, p int, errors binary"), "boot-pool")

    def run(key, pdf: pd.DataFrame, errors: pd.DataFrame) -> pd.DataFrame:
        model, block, rank = key[0], int(key[1]), int(pdf["rank"].iloc[0])
        times, (y_co, x_co, seen), (y_tr, x_tr, seen_tr, units, starts), (co_fit, tr_fit, end) = arrays(pdf)
        n, months = y_co.shape
        residual = np.where(seen, y_co - co_fit, 0.0)
        pre = seen_tr & (times <= starts[:, None])
        start_at = np.searchsorted(np.unique(starts), starts)
        played = np.stack([np.frombuffer(v).reshape(-1, months) for v in errors.sort_values("p")["errors"]])
        first = block * draws_per_task
        count = min(draws_per_task, draws - first)
        eff = np.empty((count, len(units), months))
        for d in range(count):
            rng = _rng(seed, model, first + d)
            y_star = co_fit + residual[rng.integers(0, n, n)]
            t_star = tr_fit + played[rng.integers(0, pool_size, len(units)), start_at]
            _, fitted, _ = _refit(y_star, x_co, seen, t_star, x_tr, pre, rank, end)
            eff[d] = t_star - fitted
        d, u, t = np.nonzero(np.broadcast_to(seen_tr, eff.shape))
        return pd.DataFrame(
            {"model": model, "unit": units[u], "time": times[t], "draw": first + d + 1, "eff": eff[d, u, t]}
        )

    every = pool.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // draws_per_task) - 1))))
    return dealt(draws, draws_per_task).groupBy("model", "block").cogroup(every.groupBy("model", "block")).applyInPandas(
        run, "model string, unit string, time int, draw int, eff double"
    )
