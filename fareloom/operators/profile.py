"""Row and NULL counts per column, and the repairs applied to shifts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from fareloom.functions.stats import median


def column_profile(df: DataFrame, entity: str) -> DataFrame:
    """One row per column, from a single pass."""
    row = df.agg(F.count("*").alias("n_rows"),
                 *[F.count(c).alias(f"known_{i}") for i, c in enumerate(df.columns)])
    cells = [
        F.struct(F.lit(entity).alias("entity"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("type"),
                 F.col("n_rows"), F.col(f"known_{i}").alias("non_null"),
                 (F.col("n_rows") - F.col(f"known_{i}")).alias("nulls"))
        for i, f in enumerate(df.schema.fields)
    ]
    return row.select(F.inline(F.array(*cells)))


def data_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    profiles = [column_profile(df, name) for name, df in tables.items()]
    result = profiles[0]
    for other in profiles[1:]:
        result = result.unionByName(other)
    return result


def impute_shifts(shifts: DataFrame, default_hours: float = 8.0) -> DataFrame:
    """Unknown rates take the exact median rate, unknown working hours eight hours."""
    middle = median(shifts, F.col("hourly_rate_eur"))
    return shifts.withColumn(
        "hourly_rate_eur", F.coalesce(F.col("hourly_rate_eur"), middle.scalar())
    ).na.fill(default_hours, subset=["shift_working_hours"])
