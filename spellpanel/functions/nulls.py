"""Predicates and aggregates with explicit missing-value rules.

Clinical flags need three-valued logic in some places (plain equality) and
two-valued logic in others (membership, pattern search).  Every helper here
names which of the two it gives, so recipes never depend on a default.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_text(value: str) -> str:
    """A SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def in_set(c: Column | str, values: Iterable) -> Column:
    """Membership that is FALSE (never NULL) for a missing value; compares as text.

    A column given by name is written as one SQL expression: rule sets hold
    hundreds of codes, and one literal at a time is slow to build.
    """
    texts = [str(v) for v in values]
    if not texts:
        return F.lit(False)
    if isinstance(c, str):
        return F.expr(f"coalesce(cast(`{c}` as string) in ({', '.join(map(sql_text, texts))}), false)")
    return F.coalesce(c.cast("string").isin(texts), F.lit(False))


def matches(c: Column | str, pattern: str) -> Column:
    """Regular-expression search that is FALSE for a missing value."""
    if isinstance(c, str):
        return F.expr(f"coalesce(`{c}` rlike {sql_text(pattern)}, false)")
    return F.coalesce(c.rlike(pattern), F.lit(False))


def any_code(c: Column | str, codes: Iterable[str]) -> Column:
    """TRUE when any of the codes occurs in the text; an empty code is refused
    because it would match every row."""
    codes = list(codes)
    if not codes or any(not code for code in codes):
        raise ValueError("code list must hold at least one code and no empty ones")
    return matches(c, "|".join(codes))


def strict_sum(c: Column | str) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    c = as_col(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))


def strict_avg(c: Column | str) -> Column:
    """Mean that is NULL as soon as one input is NULL."""
    c = as_col(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.avg(c))


def strict_min(c: Column | str) -> Column:
    """Minimum that is NULL as soon as one input is NULL."""
    c = as_col(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.min(c))


def share(predicate: Column) -> Column:
    """Proportion of the group's rows for which the predicate is TRUE."""
    return F.try_divide(F.count_if(predicate).cast("double"), F.count(F.lit(1)).cast("double"))


def strict_share(predicate: Column) -> Column:
    """Proportion that is NULL when the predicate is NULL for any row."""
    return F.try_divide(
        strict_sum(predicate.cast("int")).cast("double"), F.count(F.lit(1)).cast("double")
    )


def ratio(a: Column | str, b: Column | str) -> Column:
    """Division that gives NULL for a zero divisor."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def cap_at(c: Column | str, cap: float | None) -> Column:
    """Upper cap that leaves NULL as NULL (``least`` alone would return the cap)."""
    c = as_col(c)
    return c if cap is None else F.when(c > cap, F.lit(cap)).otherwise(c)


def row_sum(cols: Iterable[str]) -> Column:
    """Sum across columns of one row, skipping NULLs; all-NULL gives 0."""
    total = F.lit(0)
    for name in cols:
        total = total + F.coalesce(F.col(name), F.lit(0))
    return total


def drop_sentinels(c: Column | str, sentinels: Iterable[str]) -> Column:
    """Replace placeholder dates by NULL."""
    c = as_col(c)
    hit = F.lit(False)
    for s in sentinels:
        hit = hit | (c == F.lit(s).cast("date"))
    return F.when(~F.coalesce(hit, F.lit(False)), c)


def text_or_na(c: Column | str) -> Column:
    """Text form of a value with a missing one spelled ``NA``."""
    return F.coalesce(as_col(c).cast("string"), F.lit("NA"))


def nulls_last(cols: Iterable[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in cols]


def sort_struct(cols: Iterable[str]) -> Column:
    """A struct whose natural order is the given columns ascending, NULLs last."""
    parts = []
    for i, c in enumerate(cols):
        parts += [F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"k{i}")]
    return F.struct(*parts)
