"""Joining a large table to one that is usually small."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fareloom.session import written


def left_join_small(df: DataFrame, small: DataFrame, on: str | list[str]) -> DataFrame:
    """Left join that spares ``df`` the shuffle when ``small`` turns out to be small.

    ``small`` is computed once and written. Spark estimates an aggregate at the size of its input;
    of a written table it knows the size, and broadcasts it only below its own threshold.
    """
    return df.join(written(small, "small-side"), on, "left")
