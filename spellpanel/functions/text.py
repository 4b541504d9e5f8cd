"""Code lists, column-name rules and label formatting."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def code_range(letter: str, first: int, last: int, width: int = 3) -> list[str]:
    """Consecutive codes of one chapter letter, zero-padded."""
    return [f"{letter}{n:0{width}d}" for n in range(first, last + 1)]


def expand_codes(text: str) -> list[str]:
    """Codes written as blank-separated text; ``M653-M656`` stands for the range."""
    out: list[str] = []
    for token in text.split():
        if "-" in token:
            lo, hi = token.split("-")
            out += code_range(lo[0], int(lo[1:]), int(hi[1:]), len(lo) - 1)
        else:
            out.append(token)
    return out


def name_product(left: Sequence[str], right: Sequence[str], sep: str = "_") -> list[str]:
    """All combinations of two name lists, first list varying fastest."""
    return [f"{a}{sep}{b}" for b in right for a in left]


def measure_first(name: str) -> str:
    """Panel column naming used by the models.

    Columns about day cases, elective work, stays or rates move their trailing
    alphabetic part to the front (``rate_ort`` -> ``ort_rate``), then take the
    measure names ``los.dc_ratio`` and ``los.ip_avg``.
    """
    if not re.search("dc|elect|los|rate", name):
        return name
    head, _, tail = name.rpartition("_")
    if head and re.fullmatch("[A-Za-z]+", tail):
        name = f"{tail}_{head}"
    return name.replace("dc_prop", "los.dc_ratio", 1).replace("los_avg", "los.ip_avg", 1)


def rename_measures(df: DataFrame) -> DataFrame:
    """Apply the two panel naming rules: overall measures first get an
    ``elect`` / ``hvlc`` suffix, then :func:`measure_first` is applied."""
    # Names of the overall measures in the panel.
    overall = {
        "el_rate": "rate_elect",
        "los_avg": "los_avg_elect",
        "dc": "dc_prop_elect",
        "hvlc_rate": "rate_hvlc",
    }
    return df.toDF(*[measure_first(overall.get(c, c)) for c in df.columns])


def signed_percent(c: Column) -> Column:
    """One-decimal percent label; a plus sign only for values above zero, and no label without a value."""
    label = F.format_string("%.1f%%", c)  # writes a null as text
    return F.when(c > 0, F.concat(F.lit("+"), label)).when(c.isNotNull(), label)


def concat_key(*cols: Column, sep: str = "_") -> Column:
    """Composite text key; a missing part is spelled ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("NA")) for c in cols])


def clean_codes(codes: Iterable[str | None]) -> list[str]:
    """Distinct non-empty codes of a lookup column, sorted."""
    return sorted({c.strip() for c in codes if c and c.strip()})
