"""Canonical tables of the marketplace and how raw columns are brought onto them.

Timestamps are naive (``timestamp_ntz``), as in the input files: an hour of day must not depend
on the session time zone. Durations are seconds.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F, types as T

from fareloom.functions.scalars import SECONDS_PER_UNIT, number_or_null

BOOKINGS = T.StructType([
    T.StructField("booking_uuid", T.StringType()),
    T.StructField("chauffeur_uuid", T.StringType()),
    T.StructField("booked_start_at", T.TimestampNTZType()),
    T.StructField("booking_end_time", T.TimestampNTZType()),
    T.StructField("booked_duration", T.DoubleType()),
    T.StructField("booked_distance", T.DoubleType()),
    T.StructField("gross_revenue_eur", T.DoubleType()),
    T.StructField("pickup_longitude", T.DoubleType()),
    T.StructField("pickup_latitude", T.DoubleType()),
    T.StructField("dropoff_longitude", T.DoubleType()),
    T.StructField("dropoff_latitude", T.DoubleType()),
])

AUCTIONS = T.StructType([
    T.StructField("booking_uuid", T.StringType()),
    T.StructField("auction_winning_price", T.DoubleType()),
    T.StructField("auction_corridor_min_price", T.DoubleType()),
    T.StructField("auction_corridor_max_price", T.DoubleType()),
    T.StructField("auction_time", T.TimestampNTZType()),
    T.StructField("auction_start_time", T.TimestampNTZType()),
    T.StructField("auction_end_time", T.TimestampNTZType()),
    T.StructField("booked_duration", T.DoubleType()),
])

SHIFTS = T.StructType([
    T.StructField("shift_id", T.StringType()),
    T.StructField("chauffeur_uuid", T.StringType()),
    T.StructField("shift_date", T.DateType()),
    T.StructField("shift_working_hours", T.DoubleType()),
    T.StructField("hourly_rate_eur", T.DoubleType()),
    T.StructField("shift_start_time", T.TimestampNTZType()),
    T.StructField("shift_end_time", T.TimestampNTZType()),
    T.StructField("hours_used", T.DoubleType()),
])

WEATHER = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("weather_condition", T.StringType()),
    T.StructField("temperature", T.IntegerType()),
])

CALENDAR = T.StructType([
    T.StructField("event_date", T.DateType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("event_name", T.StringType()),
])

# Other names the same column goes by in the input files.
OTHER_NAMES = {
    "booked_start_at": ["booking_start_time", "pickup_time"],
    "booked_distance": ["distance_km"],
    "shift_id": ["shift_uuid"],
    "shift_date": ["date"],
    "shift_working_hours": ["duration"],
    "shift_start_time": ["start_time"],
}


def conform(df: DataFrame, schema: T.StructType, lenient: bool = False,
            duration_unit: str = "s") -> DataFrame:
    """Select the canonical columns, renamed and cast; a column the input lacks becomes NULL.

    Strict casts fail the job on a bad value, lenient ones give NULL.
    """
    def source(field: T.StructField) -> Column:
        for name in [field.name, *OTHER_NAMES.get(field.name, [])]:
            if name in df.columns:
                return cast(F.col(name), field)
        return F.lit(None).cast(field.dataType)

    def cast(c: Column, field: T.StructField) -> Column:
        if isinstance(field.dataType, T.DoubleType):
            value = number_or_null(c) if lenient else c.cast("double")
            value = F.when(~F.isnan(value), value)
            if field.name == "booked_duration" and duration_unit != "s":
                value = value * F.lit(SECONDS_PER_UNIT[duration_unit])
            return value
        if isinstance(field.dataType, T.DateType):
            return F.to_date(c.try_cast("timestamp_ntz") if lenient else c.cast("timestamp_ntz"))
        return c.try_cast(field.dataType) if lenient else c.cast(field.dataType)

    columns = [source(f).alias(f.name) for f in schema.fields]
    if "shift_date" in schema.fieldNames() and not {"shift_date", "date"} & set(df.columns):
        start = F.to_date(source(schema["shift_start_time"])).alias("shift_date")
        columns[schema.fieldNames().index("shift_date")] = start
    return df.select(*columns)


def require(df: DataFrame, *columns: str) -> None:
    """Fail early, by name, when an analysis lacks a column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
