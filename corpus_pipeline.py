"""From raw documents to packed training sequences, in five stages.

Each stage takes all rows that the one before kept and is written before the next reads it.
Rejected by quality, then copies, then near copies: what is left has its personal data replaced and
is packed. All stages but the last return the columns of ``documents``.

Missing texts count as empty. Rows that repeat a doc_id are judged by their own texts in the first
two stages; in the third they stay or go together. An empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fareloom.llm import exact_dedup, lsh_forest, packing, quality_fm, surrogates
from fareloom.llm.queries import SURROGATE_KEY, tokenizer_path
from fareloom.llm.texts import documents
from fareloom.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a classifier, fitted on the labelled ones, doesn't reject."""
    model = quality_fm.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_fm.without_rejected(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents, five words to a shingle and 80 per cent alike, the first."""
    kept = lsh_forest.near_duplicates(docs).where("kept").select(
        F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data, and their new length."""
    replaced = surrogates.replace_entities(docs, key=SURROGATE_KEY)
    if "n_chars" in docs.columns:
        replaced = replaced.withColumn("n_chars", F.when(
            F.size("_entities") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)
        ).otherwise(F.col("n_chars")))
    return replaced.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, each with its sequence and its place there."""
    return packing.pack(packing.token_pieces(docs, tokenizer_path()).select(
        "doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32")))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("private", private),
          ("pack", pack)]

#: A trained classifier, MinHash and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
