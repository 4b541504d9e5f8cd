"""Normal distribution pieces that Spark SQL lacks."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def z_value(alpha: float) -> float:
    """Upper quantile for a two-sided interval at level 1 - alpha."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie strictly between 0 and 1")
    return NormalDist().inv_cdf(1 - alpha / 2)


def two_sided_p(z: Column) -> Column:
    """``2 * P(Z > |z|)`` by the Abramowitz-Stegun 7.1.26 polynomial.

    Stays inside code generation; absolute error below 1.5e-7.  Use
    :func:`two_sided_p_exact` where tiny p-values matter.
    """
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    # Coefficients of formula 7.1.26.
    coef = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
    poly = F.lit(0.0)
    for a in reversed(coef):
        poly = (poly + F.lit(a)) * t
    return poly * F.exp(-x * x)


@F.pandas_udf(DoubleType())
def two_sided_p_exact(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if v is not None and v == v else None)
