"""How much of what each chauffeur was scheduled for was driven."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fareloom.functions.exact import half_even, mean, product_total, ratio, total
from fareloom.functions.scalars import duration_divisor


def shift_utilization_by_chauffeur(shifts: DataFrame, bookings: DataFrame,
                                   duration_unit: str = "min") -> DataFrame:
    """Both sides are summed per chauffeur before the join, so it is one row to one row."""
    divisor = F.lit(float(duration_divisor(duration_unit)))
    scheduled = shifts.dropna(subset=["chauffeur_uuid"]).groupBy("chauffeur_uuid").agg(
        half_even(total("shift_working_hours")).alias("shift_working_hours"),
        half_even(mean("hourly_rate_eur")).alias("hourly_rate_eur"),
    )
    driven = bookings.dropna(subset=["chauffeur_uuid"]).groupBy("chauffeur_uuid").agg(
        half_even(total("booked_duration") / divisor).alias("booked_hours"),
        half_even(total("gross_revenue_eur")).alias("gross_revenue_eur"),
    )
    joined = scheduled.join(driven, "chauffeur_uuid", "left").na.fill(
        0.0, subset=["shift_working_hours", "hourly_rate_eur", "booked_hours",
                     "gross_revenue_eur"])
    hours = F.col("shift_working_hours")
    return joined.select(
        "*",
        (hours - F.col("booked_hours")).alias("unused_hours"),
        half_even(ratio(F.col("booked_hours"), hours) * 100).alias("utilization_rate"),
        F.col("hourly_rate_eur").alias("cost_per_hour"),
        half_even(ratio(F.col("gross_revenue_eur"), hours)).alias("revenue_per_hour"),
    )


def utilization_totals(shifts: DataFrame, bookings: DataFrame) -> DataFrame:
    hours, used = total("shift_working_hours"), total("booked_hours")
    return shift_utilization_by_chauffeur(shifts, bookings).agg(
        hours.alias("total_scheduled_hours"),
        used.alias("total_actual_hours"),
        total("unused_hours").alias("total_unused_hours"),
        half_even(ratio(used, hours) * 100).alias("average_utilization_rate"),
        product_total("hourly_rate_eur", "shift_working_hours").alias("total_cost"),
        total("gross_revenue_eur").alias("total_revenue"),
        F.count("*").alias("total_chauffeurs"),
    )


def performers(shifts: DataFrame, bookings: DataFrame, k: int = 5,
               best: bool = True) -> DataFrame:
    """The k chauffeurs with the highest (or lowest) utilization in (0, 100]."""
    order = F.desc("utilization_rate") if best else F.asc("utilization_rate")
    return shift_utilization_by_chauffeur(shifts, bookings).where(
        (F.col("utilization_rate") > 0) & (F.col("utilization_rate") <= 100)
    ).orderBy(order, "chauffeur_uuid").limit(k)
