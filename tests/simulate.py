"""Simulated panels with a planted effect (inputs of the estimator tests)."""

import numpy as np
import pandas as pd

CELLS = "model string, unit string, time int, y double, d int, w double, x array<double>, treated int, T0 int"


def panel(model="m", n_co=40, starts=(12, 14, 16), months=24, rank=0, effect=2.0, noise=0.1, seed=1, slope=None):
    """Unit + month + factor structure, effect added after each treated unit's start."""
    rng = np.random.default_rng(seed)
    units = n_co + len(starts)
    f = rng.normal(size=(months, rank))
    load = rng.normal(size=(units, rank)) + 0.5
    y = rng.normal(size=(units, 1)) + rng.normal(size=(1, months)) + load @ f.T
    y = y + noise * rng.normal(size=(units, months))
    x = rng.normal(size=(units, months))
    if slope is not None:
        y = y + slope * x
    rows = []
    for u in range(units):
        start = starts[u - n_co] if u >= n_co else months
        for t in range(1, months + 1):
            d = int(t > start)
            rows.append(
                (model, f"u{u:03d}", t, float(y[u, t - 1] + effect * d), d, float(10 + u % 7),
                 [float(x[u, t - 1])] if slope is not None else [], int(u >= n_co), start)
            )
    return pd.DataFrame(rows, columns=["model", "unit", "time", "y", "d", "w", "x", "treated", "T0"])


def frame(spark, *panels):
    return spark.createDataFrame(pd.concat(panels, ignore_index=True), CELLS)
