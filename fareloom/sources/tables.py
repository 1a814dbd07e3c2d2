"""Marketplace tables derived from the benchmark tables (events, orders, nation).

Each column is a deterministic expression of its source row, so the tables scale with the data
and hold the awkward cases on purpose: auctions without a booking, unknown prices and chauffeurs,
bookings without revenue, days without shifts or weather, days with several calendar events.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

AUCTIONED = ("click", "view", "purchase")

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
ORDERS = T.StructType([
    T.StructField("o_orderkey", T.LongType()),
    T.StructField("o_custkey", T.LongType()),
])
NATION = T.StructType([
    T.StructField("n_nationkey", T.IntegerType()),
    T.StructField("n_name", T.StringType()),
    T.StructField("n_regionkey", T.IntegerType()),
])


class DerivedMarketplace:
    """The tables of a ``Marketplace``, each built when it is first asked for.

    The file schemas are given, so no job reads footers to infer them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self._table("events", EVENTS)

    @cached_property
    def bookings(self) -> DataFrame:
        return bookings_of(self.events)

    @cached_property
    def auctions(self) -> DataFrame:
        return auctions_of(self.events)

    @cached_property
    def shifts(self) -> DataFrame:
        return shifts_of(self._table("orders", ORDERS))

    @cached_property
    def weather(self) -> DataFrame:
        return weather_of(self.events)

    @cached_property
    def calendar(self) -> DataFrame:
        return calendar_of(self._table("nation", NATION))


def bookings_of(events: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    return events.select(
        F.col("event_id").alias("booking_uuid"),
        F.when(F.col("event_id") % 13 != 0, F.col("user_id")).alias("chauffeur_uuid"),
        F.col("ts").alias("booked_start_at"),
        (600 + (F.col("event_id") * 37 % 110) * 60).cast("double").alias("booked_duration"),
        (1 + k).cast("double").alias("booked_distance"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value"))
        .alias("gross_revenue_eur"),
        ((k - 50) * F.lit(0.013)).alias("pickup_longitude"),
        (F.lit(52.4) + (F.col("user_id") % 25) * F.lit(0.0101)).alias("pickup_latitude"),
        ((k - 30) * F.lit(0.011)).alias("dropoff_longitude"),
        (F.lit(52.3) + (F.col("event_id") % 40) * F.lit(0.0103)).alias("dropoff_latitude"),
    )


def auctions_of(events: DataFrame) -> DataFrame:
    value = F.col("value")
    return events.where(F.col("event_type").isin(*AUCTIONED)).select(
        F.when(F.col("event_id") % 97 == 0, -F.col("event_id") - 1)
        .otherwise(F.col("event_id")).alias("booking_uuid"),
        F.when(F.col("event_id") % 11 != 0, 5 + value * 0.8).alias("auction_winning_price"),
        (value * 0.5).alias("auction_corridor_min_price"),
        (5 + value * 1.2).alias("auction_corridor_max_price"),
        (F.col("ts") - F.expr("interval 15 minutes")).alias("auction_start_time"),
        (F.col("ts") - F.expr("interval 5 minutes")).alias("auction_end_time"),
    )


def shifts_of(orders: DataFrame) -> DataFrame:
    key, chauffeur = F.col("o_orderkey"), F.col("o_custkey")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (key % 28).cast("int"))
    rate = 35 + chauffeur % 20
    return orders.select(
        key.alias("shift_id"),
        chauffeur.alias("chauffeur_uuid"),
        day.alias("shift_date"),
        (4 + (key % 13) * 0.5).alias("shift_working_hours"),
        F.when(key % 41 != 0, rate.cast("double")).alias("hourly_rate_eur"),
        (day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (6 + key % 12).cast("int")))
        .alias("shift_start_time"),
        F.when(key % 50 == 0, "n/a").when(key == 1, "1,035.50").when(key == 2, " 42 ")
        .otherwise(F.concat(rate.cast("string"), F.lit(".00"))).alias("hourly_rate_raw"),
    )


def weather_of(events: DataFrame) -> DataFrame:
    day = F.dayofmonth("date")
    return events.select(F.to_date("ts").alias("date")).distinct().where(
        ~F.dayofmonth("date").isin(7, 14)
    ).select(
        "date",
        F.concat(F.lit("W"), (day % 3).cast("string")).alias("weather_condition"),
        (day * 7 % 15).cast("int").alias("temperature"),
    )


def calendar_of(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_nationkey") % 20).cast("int"))
        .alias("event_date"),
        F.concat(F.lit("TYPE_"), F.col("n_regionkey").cast("string")).alias("event_type"),
        F.col("n_name").alias("event_name"),
    )
