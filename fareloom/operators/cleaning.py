"""Repair of raw shift and auction tables whose columns are text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fareloom.functions.scalars import number_from_text

SHIFT_TIMES = ("shift_date", "shift_start_time", "shift_end_time")
AUCTION_TIMES = ("auction_start_time", "auction_end_time")


def clean_shifts(shifts: DataFrame, rate: str = "hourly_rate_eur", strict: bool = True,
                 key: str = "shift_id") -> DataFrame:
    """Number from text, lenient timestamps, starting hour, unused hours; incomplete rows go."""
    out = _times(shifts, SHIFT_TIMES)
    if rate in out.columns:
        out = out.withColumn("hourly_rate_eur", number_from_text(F.col(rate), strict))
        out = out.drop(rate) if rate != "hourly_rate_eur" else out
    out = out.withColumn("hour_of_day", _hour(out, "shift_start_time", key))
    if {"shift_working_hours", "hours_used"} <= set(out.columns):
        out = out.withColumn("unused_hours", F.col("shift_working_hours") - F.col("hours_used"))
    known = [c for c in ("hourly_rate_eur",) if c in out.columns]
    return out.dropna(subset=[*known, "hour_of_day"])


def clean_auctions(auctions: DataFrame, strict: bool = True,
                   key: str = "booking_uuid") -> DataFrame:
    out = _times(auctions, AUCTION_TIMES).withColumn(
        "auction_winning_price", number_from_text(F.col("auction_winning_price"), strict))
    return out.withColumn("hour_of_day", _hour(out, "auction_start_time", key)).dropna(
        subset=["auction_winning_price", "hour_of_day"])


def _times(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.withColumns(
        {c: F.col(c).try_cast("timestamp_ntz") for c in names if c in df.columns})


def _hour(df: DataFrame, start: str, key: str) -> Column:
    """Hour of the start time. Only a table without that column gets a repeatable spread of its
    rows over the day instead."""
    if start in df.columns:
        return F.hour(start)
    number = isinstance(df.schema[key].dataType, T.IntegralType)
    return F.pmod(F.col(key) if number else F.xxhash64(key), F.lit(24)).cast("int")
