"""Auction prices against time, weather and calendar events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fareloom.functions.exact import ratio
from fareloom.functions.joins import left_join_small
from fareloom.functions.keys import key_names, null_key
from fareloom.functions.scalars import weekday_name
from fareloom.functions.stats import correlation, numeric_columns, rough_means
from fareloom.operators.auctions import PRICE, weighted_mean, repeated, keyed_auctions, timed_auctions

START = "booked_start_at"


def price_by_hour(bookings: DataFrame, auctions: DataFrame) -> DataFrame:
    return timed_auctions(auctions, bookings, F.hour(START).alias("hour")).groupBy("hour").agg(
        weighted_mean("sum_price", "n_price").alias("avg_price"),
        F.sum(repeated("repeats", "n_price")).alias("n"),
    )


def price_by_weekday(bookings: DataFrame, auctions: DataFrame) -> DataFrame:
    return timed_auctions(
        auctions, bookings, weekday_name(START).alias("day_of_week")
    ).groupBy("day_of_week").agg(weighted_mean("sum_price", "n_price").alias("avg_price"))


def _daily_prices(bookings: DataFrame, auctions: DataFrame) -> DataFrame:
    """Price counts and sums per booking date: what weather and calendar are joined to."""
    return keyed_auctions(auctions, bookings, F.to_date(START).alias("date")).groupBy("date").agg(
        F.sum(repeated("repeats", "n_price")).alias("n"),
        F.sum(repeated("repeats", "sum_price")).alias("sum_price"),
    )


def _with_weather(daily: DataFrame, weather: DataFrame | None) -> DataFrame:
    if weather is None:
        return daily.withColumns({
            "weather_condition": F.lit(None).cast("string"),
            "temperature": F.lit(None).cast("int")})
    return daily.join(weather.dropna(subset=["date"]), "date", "left")


def _with_calendar(daily: DataFrame, calendar: DataFrame | None) -> DataFrame:
    if calendar is None:
        return daily.withColumn("event_type", F.lit(None).cast("string"))
    events = calendar.dropna(subset=["event_date"]).select(
        F.col("event_date").alias("date"), "event_type")
    return daily.join(events, "date", "left")


def _avg_by(df: DataFrame, key: Column | str) -> DataFrame:
    return df.groupBy(key).agg(
        ratio(F.sum("sum_price"), F.sum("n")).alias("avg_price"), F.sum("n").alias("n"))


def price_by_weather(bookings: DataFrame, auctions: DataFrame, weather: DataFrame | None,
                     calendar: DataFrame | None = None) -> DataFrame:
    """A day with several calendar events counts its auctions once per event."""
    daily = _with_calendar(_with_weather(_daily_prices(bookings, auctions), weather), calendar)
    return _avg_by(daily.dropna(subset=["weather_condition"]), "weather_condition")


def price_by_event_type(bookings: DataFrame, auctions: DataFrame, weather: DataFrame | None,
                        calendar: DataFrame | None) -> DataFrame:
    daily = _with_calendar(_with_weather(_daily_prices(bookings, auctions), weather), calendar)
    return _avg_by(daily.dropna(subset=["event_type"]), "event_type")


def price_event_vs_regular(bookings: DataFrame, auctions: DataFrame, weather: DataFrame | None,
                           calendar: DataFrame | None) -> DataFrame:
    daily = _with_calendar(_with_weather(_daily_prices(bookings, auctions), weather), calendar)
    label = F.when(F.col("event_type").isNotNull(), "Event Day").otherwise("Regular Day")
    return _avg_by(daily, label.alias("has_event"))


def temperature_price_points(bookings: DataFrame, auctions: DataFrame, weather: DataFrame | None,
                         calendar: DataFrame | None = None) -> DataFrame:
    """Points of the temperature-price scatter, ``n`` auctions each."""
    priced = auctions.dropna(subset=[PRICE]).groupBy(
        *null_key(auctions, "booking_uuid"), PRICE).agg(F.count("*").alias("n"))
    dated = bookings.dropna(subset=["booked_start_at"]).groupBy(
        *null_key(bookings, "booking_uuid"), F.to_date(START).alias("date")).agg(
        F.count("*").alias("repeats"))
    daily = priced.join(dated, key_names("booking_uuid")).groupBy("date", PRICE).agg(
        F.sum(F.col("n") * F.col("repeats")).alias("n"))
    return _with_calendar(_with_weather(daily, weather), calendar).dropna(
        subset=["temperature"]).groupBy("temperature", PRICE).agg(F.sum("n").alias("n"))


# Identifiers are not measurements, whatever their type.
IDENTIFIERS = ("booking_uuid", "chauffeur_uuid")


def merged_context(bookings: DataFrame, auctions: DataFrame, weather: DataFrame | None,
                   calendar: DataFrame | None) -> DataFrame:
    """Auctioned bookings with the weather and the events of their day, one row per combination."""
    shared = set(bookings.columns) & set(auctions.columns) - {"booking_uuid"}
    merged = bookings.select("*", *null_key(bookings, "booking_uuid")).join(
        auctions.select("*", *null_key(auctions, "booking_uuid")).drop("booking_uuid", *shared),
        key_names("booking_uuid")).drop(*key_names("booking_uuid")).withColumns({
        "hour_of_day": F.hour(START), "date": F.to_date(START)})
    if weather is not None:
        merged = left_join_small(merged, weather, "date")
    if calendar is not None:
        merged = left_join_small(
            merged, calendar.withColumnRenamed("event_date", "date"), "date")
    return merged


def correlation_matrix(bookings: DataFrame, auctions: DataFrame, weather: DataFrame | None,
                       calendar: DataFrame | None,
                       columns: Sequence[str] | None = None) -> DataFrame:
    merged = merged_context(bookings, auctions, weather, calendar)
    columns = list(columns or numeric_columns(merged, IDENTIFIERS))
    # Joins repeat and leave out rows; the means before them are near enough.
    centres: dict[str, float] = {}
    for table in (bookings.withColumn("hour_of_day", F.hour(START)), auctions, weather, calendar):
        own = [c for c in columns if table is not None and c in table.columns and c not in centres]
        if own:
            centres |= rough_means(table, own)
    return correlation(merged, columns, centres)
