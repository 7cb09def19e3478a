"""Null-guarded ratios and sums that carry a row multiplicity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` in double; NULL when ``b`` is 0 or NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def total(value: Column, weight: Column) -> Column:
    """Sum of ``value`` over rows that each stand for ``weight`` equal rows."""
    return F.sum(value * weight)


def rows_with(value: Column, weight: Column) -> Column:
    """Number of rows with a value, each row standing for ``weight`` rows."""
    return F.coalesce(F.sum(F.when(value.isNotNull(), weight)), F.lit(0)).cast("bigint")


def mean(value: Column, weight: Column) -> Column:
    return ratio(total(value, weight), rows_with(value, weight))


#: A quotient of exact numbers that is a half differs from it by less than this share in double.
HALF_SLACK = 2.0**-50


def rounded(c: Column, digits: int) -> Column:
    """Round half up, once, to so many decimal places.

    A quotient in double lies within half a unit of its last place of the true one. The slack of
    two units brings true halves back (0.05625 computed as 0.056249999999999994) and reaches no
    other quotient of numbers below 2**49.
    """
    unit = 10.0**digits
    number = c.cast("double")
    steps = F.floor(F.abs(number) * unit * (1 + HALF_SLACK) + 0.5)
    return F.signum(number) * (steps / unit) + F.lit(0.0)


def money(c: Column) -> Column:
    """Report form of an exact decimal amount."""
    return F.round(c, 2).cast("double")
