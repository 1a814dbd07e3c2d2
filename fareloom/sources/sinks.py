"""Writing result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def write_result(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write one result as a folder of header CSV (or parquet) files."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(kind).save(path)


def write_results(results: Mapping[str, DataFrame], folder: str, kind: str = "csv") -> None:
    for name, df in results.items():
        write_result(df, f"{folder.rstrip('/')}/{name}", kind)


def read_result(spark: SparkSession, path: str, schema, kind: str = "csv") -> DataFrame:
    if kind == "csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.format(kind).schema(schema).load(path)
