"""Scalar expressions: parsing, labels and guards. All of them are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECONDS_PER_UNIT = {"s": 1, "min": 60, "h": 3600}

# Weekday names in ISO order, Monday first.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def duration_divisor(unit: str) -> int:
    """How many seconds one ``unit`` has; ``raw`` leaves durations unconverted."""
    return 1 if unit == "raw" else SECONDS_PER_UNIT[unit]


def number_or_null(c: Column) -> Column:
    """Lenient numeric parse. NaN and infinities become NULL so that no aggregate meets them."""
    value = c.try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def number_from_text(c: Column, strict: bool = True) -> Column:
    """Number in text with thousands commas and blanks around it."""
    text = F.trim(F.regexp_replace(c.cast("string"), ",", ""))
    return text.cast("double") if strict else number_or_null(text)


def weekday_name(ts: Column) -> Column:
    names = F.array(*[F.lit(name) for name in WEEKDAYS])
    return F.element_at(names, F.weekday(ts) + 1)


def hour_span_label(hour: Column) -> Column:
    """``08:00 - 08:59``"""
    return F.format_string("%02d:00 - %02d:59", hour, hour)


def hour_to_next_label(hour: Column) -> Column:
    """``08:00 - 09:00``; the last hour of the day ends at 24:00."""
    return F.format_string("%02d:00 - %02d:00", hour, hour + 1)


def hour_label(hour: Column) -> Column:
    return F.format_string("%02d:00", hour)


def euro_text(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("N/A")).otherwise(F.format_string("€%.2f", c))


def clip(c: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]; NULL stays NULL."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def quotient_inf_as_null(numerator: Column, denominator: Column) -> Column:
    """x/0 (infinite) becomes NULL and 0/0 becomes 0."""
    return (
        F.when((denominator == 0) & (numerator == 0), F.lit(0.0))
        .otherwise(F.try_divide(numerator.cast("double"), denominator.cast("double")))
    )


def quotient_inf_as_zero(numerator: Column, denominator: Column) -> Column:
    """x/0 (infinite) becomes 0 and 0/0 becomes NULL."""
    return (
        F.when((denominator == 0) & (numerator != 0), F.lit(0.0))
        .otherwise(F.try_divide(numerator.cast("double"), denominator.cast("double")))
    )


def grid_cell(c: Column, size: float) -> Column:
    """Index of the grid cell, truncated toward zero."""
    return (c / F.lit(size)).cast("bigint")
