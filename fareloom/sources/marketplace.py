"""The tables of one marketplace, from CSV files, from parquet or from existing DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T

from fareloom.sources import schema as S


@dataclass(frozen=True)
class Marketplace:
    bookings: DataFrame
    shifts: DataFrame
    auctions: DataFrame
    weather: DataFrame | None = None
    calendar: DataFrame | None = None

    @classmethod
    def from_csv(cls, spark: SparkSession, shifts: str, bookings: str, auctions: str,
                 weather: str | None = None, calendar: str | None = None,
                 lenient: bool = False, duration_unit: str = "s") -> "Marketplace":
        """Read header CSV files. Weather and calendar are optional: a path that does not exist
        leaves the table out."""
        def table(path: str, kind: T.StructType) -> DataFrame:
            return S.conform(read_csv(spark, path), kind, lenient, duration_unit)

        return cls(
            bookings=table(bookings, S.BOOKINGS),
            shifts=table(shifts, S.SHIFTS),
            auctions=table(auctions, S.AUCTIONS),
            weather=optional(lambda: table(weather, S.WEATHER)) if weather else None,
            calendar=optional(lambda: table(calendar, S.CALENDAR)) if calendar else None,
        )

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, lenient: bool = False,
                     duration_unit: str = "s") -> "Marketplace":
        """Read ``bookings``, ``shifts``, ``auctions`` and, if there, ``weather`` and ``calendar``
        below one folder."""
        def table(name: str, kind: T.StructType) -> DataFrame:
            return S.conform(spark.read.parquet(f"{folder}/{name}"), kind, lenient, duration_unit)

        return cls(
            bookings=table("bookings", S.BOOKINGS),
            shifts=table("shifts", S.SHIFTS),
            auctions=table("auctions", S.AUCTIONS),
            weather=optional(lambda: table("weather", S.WEATHER)),
            calendar=optional(lambda: table("calendar", S.CALENDAR)),
        )

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> "Marketplace":
        """Keep the parsed tables for a session that runs many analyses on them."""
        tables = {
            name: table.persist(level)
            for name in ("bookings", "shifts", "auctions", "weather", "calendar")
            if (table := getattr(self, name)) is not None
        }
        return replace(self, **tables)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text: types come from the canonical schema, never from sampling."""
    return spark.read.option("header", True).option("mode", "FAILFAST").csv(path)


def optional(load) -> DataFrame | None:
    """The table, or None when its path does not exist."""
    try:
        return load()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
