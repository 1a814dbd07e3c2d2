"""When guests book: weekdays, hours and both together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fareloom.functions.calendar import weekday_spine
from fareloom.functions.exact import ratio
from fareloom.functions.scalars import WEEKDAYS, hour_label

START = "booked_start_at"


def in_dates(bookings: DataFrame, start=None, end=None) -> DataFrame:
    """Bookings whose date lies in [start, end]; an open end takes all.

    The bounds are put on the timestamp itself, so they reach the parquet scan.
    """
    if start is not None:
        bookings = bookings.where(F.col(START) >= F.lit(start).cast("date").cast("timestamp_ntz"))
    if end is not None:
        next_day = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
        bookings = bookings.where(F.col(START) < next_day)
    return bookings.dropna(subset=[START])


def _by_weekday(bookings: DataFrame) -> DataFrame:
    counts = bookings.dropna(subset=[START]).groupBy(
        F.weekday(START).alias("weekday")).agg(F.count("*").alias("bookings"))
    return weekday_spine(bookings.sparkSession).join(counts, "weekday", "left")


def bookings_by_weekday(bookings: DataFrame) -> DataFrame:
    """Monday to Sunday; a weekday without bookings has NULL."""
    return _by_weekday(bookings).orderBy("weekday")


def bookings_by_hour(bookings: DataFrame) -> DataFrame:
    return bookings.dropna(subset=[START]).groupBy(F.hour(START).alias("hour")).agg(
        F.count("*").alias("bookings")).orderBy("hour")


def weekday_hour_heatmap(bookings: DataFrame, absent_day_as_zero: bool = False) -> DataFrame:
    """Seven rows by 24 columns of booking counts; an absent weekday has NULLs."""
    hours = [f"h{h:02d}" for h in range(24)]
    counts = (
        bookings.dropna(subset=[START])
        .select("booking_uuid", F.weekday(START).alias("weekday"),
                F.format_string("h%02d", F.hour(START)).alias("hour"))
        .groupBy("weekday").pivot("hour", hours)
        .agg(F.count("booking_uuid"))
        .na.fill(0, subset=hours)
    )
    laid = weekday_spine(bookings.sparkSession).join(counts, "weekday", "left")
    if absent_day_as_zero:
        laid = laid.na.fill(0, subset=hours)
    return laid.select("weekday", "day_of_week", *hours).orderBy("weekday")


def seasonality_summary(bookings: DataFrame, start=None, end=None) -> DataFrame:
    """Totals in a date range and the busiest hour (the earlier one on a tie).

    Counting per (date, hour) first leaves a small table for the distinct and the mode.
    """
    cells = in_dates(bookings, start, end).groupBy(
        F.to_date(START).alias("date"), F.hour(START).alias("hour")
    ).agg(F.count("*").alias("n"))
    peak = cells.groupBy("hour").agg(F.sum("n").alias("n")).agg(
        F.max_by("hour", F.struct(F.col("n"), -F.col("hour"))).alias("hour"))
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_bookings"),
        ratio(F.sum("n"), F.count_distinct("date")).alias("avg_daily_bookings"),
    ).select(
        "total_bookings", "avg_daily_bookings",
        hour_label(peak.scalar()).alias("peak_hour"),
    )


def weekday_insights(bookings: DataFrame) -> DataFrame:
    n, order = F.col("bookings"), -F.col("weekday")

    def avg_of(days: Column) -> Column:
        return F.avg(F.when(days, n))

    known = n.isNotNull()
    return _by_weekday(bookings).agg(
        F.max_by(F.when(known, F.col("day_of_week")), F.when(known, F.struct(n, order)))
        .alias("busiest_day"),
        F.max("bookings").alias("busiest_bookings"),
        F.min_by(F.when(known, F.col("day_of_week")), F.when(known, F.struct(n, F.col("weekday"))))
        .alias("quietest_day"),
        F.min("bookings").alias("quietest_bookings"),
        ratio(avg_of(F.col("weekday") >= len(WEEKDAYS) - 2),
              avg_of(F.col("weekday") < len(WEEKDAYS) - 2)).alias("weekend_weekday_ratio"),
    )


def hour_insights(bookings: DataFrame, k: int = 3) -> DataFrame:
    """The k busiest and k quietest hours, best first; the earlier hour wins a tie."""
    counts = bookings_by_hour(bookings)
    ranked = counts.agg(
        F.sort_array(F.collect_list(F.struct((-F.col("bookings")).alias("key"), "hour")))
        .alias("busy"),
        F.sort_array(F.collect_list(F.struct(F.col("bookings").alias("key"), "hour")))
        .alias("quiet"),
    )

    def first(name: str, kind: str) -> DataFrame:
        return ranked.select(
            F.lit(kind).alias("kind"), F.posexplode(F.slice(name, 1, k)).alias("pos", "cell")
        ).select("kind", (F.col("pos") + 1).alias("rank"), F.col("cell.hour").alias("hour"),
                 F.abs("cell.key").alias("bookings"))

    return first("busy", "peak").unionByName(first("quiet", "off_peak"))
