"""Spines: the fixed axes (hours, weekdays, days) that results are laid out on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fareloom.functions.scalars import WEEKDAYS


def hour_spine(spark: SparkSession) -> DataFrame:
    return spark.range(0, 24, 1, 1).select(F.col("id").cast("int").alias("hour"))


def weekday_spine(spark: SparkSession) -> DataFrame:
    names = F.array(*[F.lit(name) for name in WEEKDAYS])
    return spark.range(0, 7, 1, 1).select(
        F.col("id").cast("int").alias("weekday"),
        F.element_at(names, F.col("id").cast("int") + 1).alias("day_of_week"),
    )


def on_hours(by_hour: DataFrame, fill_zero: bool = True) -> DataFrame:
    """Lay an hourly result out on all 24 hours; absent hours get 0 (or NULL)."""
    measures = [c for c in by_hour.columns if c != "hour"]
    laid = hour_spine(by_hour.sparkSession).join(by_hour, "hour", "left")
    return laid.na.fill(0, subset=measures) if fill_zero else laid


def on_days(by_day: DataFrame, day: str) -> DataFrame:
    """Fill the gaps between the first and the last day with zero rows."""
    measures = [c for c in by_day.columns if c != day]
    days = by_day.agg(F.min(day).alias("first"), F.max(day).alias("last")).select(
        F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias(day)
    )
    return days.join(by_day, day, "left").na.fill(0, subset=measures)
