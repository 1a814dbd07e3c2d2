"""Join keys that treat NULL as a value, and tables collapsed to one row per key.

Joining two tables that both repeat a key multiplies the repeats. The reports here only need
sums over the joined rows, so each side is first collapsed to one row per key with counts and
sums, and the repeats are multiplied arithmetically. A key that holds a third of all rows then
costs one row in the shuffle instead of billions of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def null_key(df: DataFrame, column: str) -> list[Column]:
    """Two non-null columns that are equal exactly when the key is equal, NULL included.

    A table aggregated by the pair alone is already partitioned for a join on it; a null-safe
    comparison in the join condition would shuffle the aggregated side again.
    """
    kind = df.schema[column].dataType
    blank = F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind)
    return [
        F.coalesce(F.col(column), blank).alias(f"{column}_key"),
        F.col(column).isNull().alias(f"{column}_absent"),
    ]


def key_names(column: str) -> list[str]:
    return [f"{column}_key", f"{column}_absent"]


def restore_key(column: str) -> Column:
    key, absent = key_names(column)
    return F.when(~F.col(absent), F.col(key)).alias(column)


def collapse(df: DataFrame, key: str, *measures: Column, also: tuple[Column, ...] = ()) -> DataFrame:
    """One row per null-safe key (and ``also`` columns) with the given aggregates."""
    return df.groupBy(*null_key(df, key), *also).agg(*measures)
