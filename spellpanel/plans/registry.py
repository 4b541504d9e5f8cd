"""Query registry: a Spark callable and, where SQL can say it, a SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spellpanel.plans.sql import with_ctes
from spellpanel.session import stage_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def binary_round(c: Column, digits: int) -> Column:
    """The double rounded to whole units of the last place, as SQL engines do it; ``F.round`` goes by its decimal digits.

    The two differ at a half: 0.0642005 times 1e6 is a little below 64200.5 and becomes 64200.
    A value too large to be scaled stays as it is.
    """
    unit = F.lit(10.0**digits)
    scaled = F.round(c * unit) / unit
    return F.when(F.abs(scaled) < float("inf"), scaled).otherwise(c)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, first to some more, so that summation order hardly shows at a half."""
    return df.select(
        *[binary_round(binary_round(F.col(f"`{n}`"), digits + 2), digits).alias(n) if t == "double" else F.col(f"`{n}`")
          for n, t in df.dtypes]
    )


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may name any of the shared table expressions."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for a table that a query writes and reads back."""
    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
