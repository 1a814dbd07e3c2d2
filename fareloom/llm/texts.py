"""Column expressions over texts that the corpus operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The characters between words, as a class of a regular expression: space and the ASCII controls
#: from tab to carriage return. A word is a run of anything else.
SPACES = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text; a missing one counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it was.

    ``lower`` does more than that beyond ASCII, so only texts of single bytes take it.
    """
    single = F.octet_length(text) == F.char_length(text)
    return F.when(single, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES + "+"), "")
