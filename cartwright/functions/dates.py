"""Calendar expressions. All timestamps are zone-less (``timestamp_ntz``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole elapsed 24-hour units, truncated toward zero; not calendar days.

    The difference of two zone-less timestamps is an exact interval, so the result does not
    depend on the session time zone or on daylight saving.
    """
    return F.extract(F.lit("DAY"), end - start).cast("bigint")


def iso_weekday(c: Column) -> Column:
    """Monday = 1 ... Sunday = 7."""
    return F.weekday(c) + 1


def month_start(c: Column) -> Column:
    return F.trunc(c, "month")


def months_apart(first: Column, later: Column) -> Column:
    return (F.year(later) - F.year(first)) * 12 + (F.month(later) - F.month(first))


def month_number(c: Column) -> Column:
    """Months since January of the year 0, as a whole number."""
    return F.year(c) * 12 + F.month(c) - 1


def month_of(number: Column) -> Column:
    """The first day of the month of that number."""
    return F.make_date(F.floor(number / 12).cast("int"), F.pmod(number, F.lit(12)).cast("int") + 1, F.lit(1))


def month_label(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def period_label(year: Column, month: Column) -> Column:
    return F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"))


def reference_instant(as_of: str | None) -> Column:
    """The instant recency is measured from: a fixed one, or the wall clock."""
    return F.localtimestamp() if as_of is None else F.lit(as_of).cast("timestamp_ntz")
