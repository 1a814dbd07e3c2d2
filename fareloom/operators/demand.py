"""What guests book, by day and by hour, and the bookings that earned nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fareloom.functions.calendar import on_days, on_hours
from fareloom.functions.exact import dec, half_even, mean, ratio, ratio_or_zero, std, total
from fareloom.functions.scalars import duration_divisor


def _dated(bookings: DataFrame) -> DataFrame:
    return bookings.dropna(subset=["booked_start_at"]).withColumn(
        "booking_date", F.to_date("booked_start_at"))


def demand_daily(bookings: DataFrame) -> DataFrame:
    return _dated(bookings).groupBy("booking_date").agg(
        F.count("booking_uuid").alias("total_bookings"),
        total("gross_revenue_eur").alias("total_revenue"),
        F.coalesce(mean("booked_duration"), F.lit(0.0)).alias("avg_duration"),
        F.coalesce(mean("booked_distance"), F.lit(0.0)).alias("avg_distance"),
    )


def demand_date_spine(bookings: DataFrame) -> DataFrame:
    """``demand_daily`` with a zero row for every day without bookings."""
    return on_days(demand_daily(bookings), "booking_date")


def demand_daily_stats(bookings: DataFrame) -> DataFrame:
    return _dated(bookings).groupBy("booking_date").agg(
        F.count("booking_uuid").alias("total_bookings"),
        total("gross_revenue_eur").alias("total_revenue"),
        mean("gross_revenue_eur").alias("avg_revenue"),
        mean("booked_duration").alias("avg_duration"),
        std("booked_duration").alias("std_duration"),
        mean("booked_distance").alias("avg_distance"),
        std("booked_distance").alias("std_distance"),
    )


def demand_totals(bookings: DataFrame) -> DataFrame:
    return bookings.agg(
        total("gross_revenue_eur").alias("total_revenue"),
        mean("booked_duration").alias("avg_trip_duration"),
        mean("booked_distance").alias("avg_trip_distance"),
    )


def hourly_demand(bookings: DataFrame, duration_unit: str = "h") -> DataFrame:
    """Durations are rounded as seconds and converted afterwards."""
    divisor = F.lit(float(duration_divisor(duration_unit)))
    by_hour = bookings.dropna(subset=["booked_start_at"]).groupBy(
        F.hour("booked_start_at").alias("hour")
    ).agg(
        F.count("booking_uuid").alias("booking_count"),
        half_even(total("gross_revenue_eur")).alias("revenue_sum"),
        half_even(mean("gross_revenue_eur")).alias("revenue_mean"),
        half_even(std("gross_revenue_eur")).alias("revenue_std"),
        half_even(total("booked_duration")).alias("booked_duration"),
    )
    return on_hours(by_hour).withColumn("booked_duration", F.col("booked_duration") / divisor)


def hourly_utilization(bookings: DataFrame, duration_unit: str = "min") -> DataFrame:
    divisor = F.lit(float(duration_divisor(duration_unit)))
    return bookings.dropna(subset=["booked_start_at"]).groupBy(
        F.hour("booked_start_at").alias("hour")
    ).agg(
        half_even(total("booked_duration") / divisor).alias("hours_used_sum"),
        F.count("booked_duration").alias("hours_used_count"),
        half_even(total("gross_revenue_eur")).alias("gross_revenue_eur"),
    )


def lost_revenue(bookings: DataFrame) -> DataFrame:
    """Zero-revenue bookings and what they might have earned at the average revenue per minute.

    One row, or none if every booking earned something. One pass over the bookings.
    """
    lost = F.col("gross_revenue_eur") == 0
    earned = F.col("gross_revenue_eur") > 0

    def avg_where(condition, c):
        kept = F.when(condition, F.col(c))
        return ratio(F.sum(dec(kept)).cast("double"), F.count(kept))

    summed = bookings.agg(
        F.count_if(lost).alias("total_cases"),
        total(F.when(lost, F.col("booked_duration"))).alias("lost_seconds"),
        avg_where(lost, "booked_distance").alias("avg_distance_km"),
        (avg_where(lost, "booked_duration") / 60).alias("avg_duration_minutes"),
        avg_where(earned, "gross_revenue_eur").alias("earned_revenue"),
        (avg_where(earned, "booked_duration") / 60).alias("earned_minutes"),
    ).where("total_cases > 0")
    per_minute = ratio_or_zero(F.col("earned_revenue"), F.col("earned_minutes"))
    return summed.select(
        "total_cases",
        (F.col("lost_seconds") / 3600).alias("total_hours"),
        "avg_distance_km",
        "avg_duration_minutes",
        (per_minute * (F.col("lost_seconds") / 60)).alias("estimated_lost_revenue"),
    )


def lost_revenue_details(bookings: DataFrame) -> DataFrame:
    return bookings.where(F.col("gross_revenue_eur") == 0).select(
        "booking_uuid",
        F.date_format("booked_start_at", "yyyy-MM-dd HH:mm").alias("start_time"),
        F.col("booked_distance").alias("distance_km"),
        (F.col("booked_duration") / 60).alias("duration_min"),
    )
