"""Distribution statistics over whole columns, weighted where rows stand for many."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fareloom.functions.exact import dec, half_even, ratio, std
from fareloom.functions.ordered import quantile_row, quantiles


def statistic_matrix(df: DataFrame, columns: Mapping[str, Column],
                     statistics: Sequence[str]) -> DataFrame:
    """Rows ``metric`` x chosen statistics (mean, std, min, max, count), in one pass."""
    make = {
        "mean": lambda c: ratio(F.sum(dec(c)).cast("double"), F.count(c)),
        "std": std,
        "min": F.min,
        "max": F.max,
        "count": F.count,
    }
    rows = [
        F.struct(F.lit(name).alias("metric"), *[make[s](c).alias(s) for s in statistics])
        for name, c in columns.items()
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def describe(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Eight-number summary per column, with exact quartiles."""
    summary = statistic_matrix(df, columns, ["count", "mean", "std", "min", "max"])
    quartiles = quantiles(df, columns, [0.25, 0.5, 0.75]).select(
        "metric", *[F.get("q", F.lit(i)).alias(name)
                    for i, name in enumerate(("q25", "q50", "q75"))])
    return summary.join(quartiles, "metric", "left").select(
        "metric", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def median(df: DataFrame, value: Column) -> DataFrame:
    return quantile_row(df, value, [0.5]).select(F.get("q", F.lit(0)).alias("median"))


def bin_number(value: Column, low: Column, high: Column, bins: int) -> Column:
    """1-based index among ``bins`` equal bins of [low, high]; the top edge is closed."""
    inside = F.floor((value - low) * F.lit(float(bins)) / (high - low)).cast("int") + 1
    return F.when(high == low, F.lit(1)).otherwise(F.least(F.lit(bins), inside))


def histogram(df: DataFrame, series: Mapping[str, Column], bins: int = 50) -> DataFrame:
    """Counts in equal-width bins whose edges all series share, empty bins included."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("series"), c.cast("double").alias("value"))
        for name, c in series.items()
    ])).alias("s")).select("s.*").where("value IS NOT NULL")
    edges = long.agg(F.struct(F.min("value").alias("low"), F.max("value").alias("high")))
    counted = (
        long.withColumn("edges", edges.scalar())
        .groupBy("series", bin_number(F.col("value"), F.col("edges.low"), F.col("edges.high"),
                                      bins).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    return on_bins(counted, edges, list(series), bins)


def on_bins(counted: DataFrame, edges: DataFrame, series: Sequence[str], bins: int) -> DataFrame:
    """Lay ``(series, bin, n)`` counts out on every bin of every series."""
    width = (F.col("edges.high") - F.col("edges.low")) / F.lit(float(bins))
    axis = (
        edges.select(edges.columns[0]).toDF("edges").where("edges.low IS NOT NULL")
        .select("edges", F.explode(F.array(*[F.lit(s) for s in series])).alias("series"))
        .select("edges", "series", F.explode(F.sequence(
            F.lit(1), F.when(F.col("edges.low") == F.col("edges.high"), F.lit(1))
            .otherwise(F.lit(bins)))).alias("bin"))
        .select("series", "bin",
                (F.col("edges.low") + width * (F.col("bin") - 1)).alias("bin_low"),
                (F.col("edges.low") + width * F.col("bin")).alias("bin_high"))
    )
    return axis.join(counted, ["series", "bin"], "left").na.fill(0, subset=["n"])


def box_summary(df: DataFrame, value: Column) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 IQR, and the number of outliers."""
    cut = quantile_row(df, value, [0.25, 0.5, 0.75]).select(F.struct(*[
        F.get("q", F.lit(i)).alias(name) for i, name in enumerate(("q1", "med", "q3"))]))
    reach = F.lit(1.5) * (F.col("cut.q3") - F.col("cut.q1"))
    low, high = F.col("cut.q1") - reach, F.col("cut.q3") + reach
    v = F.col("v")
    return df.select(value.alias("v")).withColumn("cut", cut.scalar()).agg(
        F.count("v").alias("n"), F.min("v").alias("min"), F.max("cut.q1").alias("q1"),
        F.max("cut.med").alias("median"), F.max("cut.q3").alias("q3"), F.max("v").alias("max"),
        F.min(F.when(v >= low, v)).alias("whisker_low"),
        F.max(F.when(v <= high, v)).alias("whisker_high"),
        F.count(F.when((v < low) | (v > high), v)).alias("outliers"),
    )


def rough_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """The means of the columns, a number for each, 0 for what has none."""
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    means = {c: float(row[c] or 0.0) for c in columns}
    return {c: m if np.isfinite(m) else 0.0 for c, m in means.items()}


def correlation(df: DataFrame, columns: Sequence[str],
                centres: Mapping[str, float] | None = None) -> DataFrame:
    """Pearson matrix in long form ``(a, b, r)``, each pair over the rows where both are known.

    A constant column has no correlation: r is NULL, also with itself. Numbers are taken less
    ``centres``, values near the columns' means, so that sums of products do not cancel; any such
    values give the same result. Without them the means are computed first. ``df`` is then read
    once, and nothing of it is written. The sums are matrix products of Arrow batches; a
    partition passes on one row per pair of columns.
    """
    near = rough_means(df, columns) if centres is None else centres
    centred = df.select(*[
        (F.col(c).cast("double") - F.lit(near.get(c, 0.0))).alias(c) for c in columns])
    sums = centred.mapInPandas(
        _pair_sums, "a string, b string, n long, sa double, sb double, sab double, saa double, "
                    "sbb double"
    ).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "sab", "saa", "sbb")])

    def product(xy: str, x: str, y: str) -> Column:
        return F.col(xy) - ratio(F.col(x) * F.col(y), F.col("n"))

    va, vb = product("saa", "sa", "sa"), product("sbb", "sb", "sb")
    r = F.when((va > _noise("saa")) & (vb > _noise("sbb")),
               product("sab", "sa", "sb") / F.sqrt(va * vb))
    half = sums.select("a", "b", half_even(r, 6).alias("r"))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return half.select(F.inline(F.array_distinct(both)), "r")


def _pair_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums = None
    for batch in batches:
        values = batch.to_numpy(dtype=float)
        known = ~np.isnan(values)
        x, k = np.where(known, values, 0.0), known.astype(float)
        part = np.stack([k.T @ k, x.T @ k, x.T @ x, (x * x).T @ k])
        sums, names = (part if sums is None else sums + part), batch.columns
    if sums is None:
        return
    i, j = np.triu_indices(len(names))
    count, plain, cross, square = sums
    yield pd.DataFrame({
        "a": names[i], "b": names[j], "n": count[i, j].astype("int64"),
        "sa": plain[i, j], "sb": plain[j, i], "sab": cross[i, j],
        "saa": square[i, j], "sbb": square[j, i]})


def _noise(square_sum: str) -> Column:
    """What rounding can leave of a variance that is zero."""
    return F.lit(1e-12) * F.col(square_sum)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]
