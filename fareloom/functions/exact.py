"""Aggregates whose value does not depend on how rows were split over tasks.

Double addition is not associative, so a plain ``sum`` changes in its last digits with the
partitioning. Money, hours and kilometres are summed as decimals with six fractional digits and
turned into doubles once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNIT = "decimal(18,6)"


def dec(c: Column | str) -> Column:
    return _col(c).cast(UNIT)


def total(c: Column | str) -> Column:
    """Sum as double; an all-null or empty input sums to 0."""
    return F.coalesce(F.sum(dec(c)).cast("double"), F.lit(0.0))


def product_total(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.sum(dec(a) * dec(b)).cast("double"), F.lit(0.0))


def mean(c: Column | str) -> Column:
    """Mean of the non-null values, NULL if there are none."""
    return ratio(F.sum(dec(c)).cast("double"), F.count(_col(c)))


def std(c: Column | str) -> Column:
    """Sample standard deviation (NULL below two values), to six digits."""
    return F.bround(F.stddev_samp(_col(c)), 6)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that gives NULL instead of an error for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """Division guarded the way a report guards it: 0 unless the denominator is positive."""
    return F.when(denominator > 0, ratio(numerator, denominator)).otherwise(F.lit(0.0))


def half_even(c: Column, digits: int = 2) -> Column:
    return F.bround(c, digits)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
