"""What the pre-purchased shifts offer, by day and by hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fareloom.functions.calendar import on_hours
from fareloom.functions.exact import half_even, mean, product_total, ratio, std, total


def supply_daily(shifts: DataFrame) -> DataFrame:
    return shifts.dropna(subset=["shift_date"]).groupBy("shift_date").agg(
        F.count("shift_id").alias("total_shifts"),
        total("shift_working_hours").alias("total_hours"),
        mean("hourly_rate_eur").alias("avg_rate"),
    )


def supply_daily_stats(shifts: DataFrame) -> DataFrame:
    return shifts.dropna(subset=["shift_date"]).groupBy("shift_date").agg(
        F.count("shift_id").alias("total_shifts"),
        total("shift_working_hours").alias("total_hours"),
        mean("hourly_rate_eur").alias("avg_rate"),
        std("hourly_rate_eur").alias("std_rate"),
    )


def supply_totals(shifts: DataFrame) -> DataFrame:
    return shifts.agg(
        total("shift_working_hours").alias("total_hours"),
        mean("hourly_rate_eur").alias("avg_hourly_rate"),
        F.count_distinct("chauffeur_uuid").alias("unique_chauffeurs"),
    )


def shift_rate_by_day_hour(shifts: DataFrame, start: str = "shift_date") -> DataFrame:
    """``shift_date`` has no time of day, so its hour is 0; pass ``shift_start_time`` for real
    starting hours."""
    return shifts.dropna(subset=[start]).groupBy(
        F.weekday(start).alias("weekday"), F.hour(start).alias("hour")
    ).agg(
        mean("hourly_rate_eur").alias("avg_rate"), F.count("hourly_rate_eur").alias("n")
    )


def hourly_supply(shifts: DataFrame, start: str = "shift_date") -> DataFrame:
    by_hour = shifts.dropna(subset=[start]).groupBy(F.hour(start).alias("hour")).agg(
        half_even(total("shift_working_hours")).alias("working_hours"),
        half_even(product_total("shift_working_hours", "hourly_rate_eur")).alias("shift_cost"),
        half_even(mean("hourly_rate_eur")).alias("avg_rate"),
        half_even(std("hourly_rate_eur")).alias("std_rate"),
    )
    return on_hours(by_hour)


def shift_summary(shifts: DataFrame) -> DataFrame:
    cost = product_total("shift_working_hours", "hourly_rate_eur")
    hours = total("shift_working_hours")
    return shifts.agg(
        F.count("*").alias("total_shifts"),
        hours.alias("total_hours"),
        mean("shift_working_hours").alias("avg_hours_per_shift"),
        mean("hourly_rate_eur").alias("avg_hourly_rate"),
        cost.alias("total_cost"),
        ratio(cost, hours).alias("cost_per_hour"),
    )


def hours_by_start_hour(shifts: DataFrame) -> DataFrame:
    return shifts.dropna(subset=["shift_start_time"]).groupBy(
        F.hour("shift_start_time").alias("hour")
    ).agg(total("shift_working_hours").alias("shift_hours"))
