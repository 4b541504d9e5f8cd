"""Dates, months and the study calendar."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from spellpanel.functions.nulls import as_col


def parse_date(c: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    """Text to date; text that does not parse becomes NULL."""
    return F.try_to_timestamp(as_col(c), F.lit(fmt)).cast("date")


def month_of(c: Column | str) -> Column:
    """First day of the month."""
    return F.trunc(as_col(c), "month").cast("date")


def year_month(c: Column | str) -> Column:
    """``YYYY_MM`` text of a date."""
    return F.date_format(as_col(c), "yyyy_MM")


def month_from_text(c: Column | str) -> Column:
    """First day of a ``YYYY_MM`` text month."""
    return parse_date(F.concat(as_col(c), F.lit("_01")), "yyyy_MM_dd")


def stay_days(admitted: Column | str, discharged: Column | str) -> Column:
    return F.datediff(as_col(discharged), as_col(admitted))


def carry_year(c: Column | str, last_year: int) -> Column:
    """Years after the last reference year use that last year."""
    return F.least(as_col(c), F.lit(last_year))


@dataclass(frozen=True)
class StudyCalendar:
    """Months of a study with one block of months left out.

    ``start``..``before_gap`` and ``after_gap``..``end``, all first-of-month
    dates written ``YYYY-MM-DD`` and all inclusive.
    """

    start: str
    before_gap: str
    after_gap: str
    end: str

    def contains(self, month: Column | str) -> Column:
        m = as_col(month)
        return m.between(F.lit(self.start).cast("date"), F.lit(self.before_gap).cast("date")) | m.between(
            F.lit(self.after_gap).cast("date"), F.lit(self.end).cast("date")
        )

    def months(self) -> Column:
        """Array of all months, in order."""

        def run(a: str, b: str) -> Column:
            return F.sequence(F.lit(a).cast("date"), F.lit(b).cast("date"), F.expr("interval 1 month"))

        return F.concat(run(self.start, self.before_gap), run(self.after_gap, self.end))

    def index(self, month: Column | str) -> Column:
        """1-based position of a month within the calendar, NULL outside it."""
        m = as_col(month)

        def since(a: str) -> Column:
            d = F.lit(a).cast("date")
            return (F.year(m) - F.year(d)) * 12 + F.month(m) - F.month(d)

        first_run = (int(self.before_gap[:4]) - int(self.start[:4])) * 12 + int(self.before_gap[5:7]) - int(
            self.start[5:7]
        )
        return (
            F.when(m.between(F.lit(self.start).cast("date"), F.lit(self.before_gap).cast("date")), since(self.start) + 1)
            .when(
                m.between(F.lit(self.after_gap).cast("date"), F.lit(self.end).cast("date")),
                since(self.after_gap) + first_run + 2,
            )
            .cast("int")
        )

    def is_post(self, month: Column | str) -> Column:
        """TRUE from the end of the gap on, FALSE in the first run, NULL elsewhere."""
        m = as_col(month)
        return F.when(m >= F.lit(self.after_gap).cast("date"), F.lit(True)).when(
            m.between(F.lit(self.start).cast("date"), F.lit(self.before_gap).cast("date")), F.lit(False)
        )


# The published study window.
STUDY = StudyCalendar("2018-04-01", "2020-03-01", "2021-04-01", "2022-12-01")
