"""The corpus operators applied to the benchmark's documents, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fareloom.llm import (
    alignment, bpe, brown, exact_dedup, hard_negatives, lsh_forest, outliers, packing,
    phrase_dedup, quality_fm, sharding, suffix_dedup, surrogates)
from fareloom.llm.texts import ascii_lower, documents, text_of

#: The tokenizer file of the queries; installed on every machine.
TOKENIZER = "word_bpe_49k.json"
#: The two that are aligned.
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: Bytes of text that a shard may hold.
SHARD_BYTES = 4 << 20
#: Stands in for the key that an owner of real data would keep.
SURROGATE_KEY = "benchmark"

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return suffix_dedup.repeated_spans(documents(spark, folder)).select(
        "doc_id", "n_bytes", removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(documents(spark, folder), limit_bytes=SHARD_BYTES).select(
        "doc_id", "n_bytes", "shard", "depth", "shard_bytes")


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = quality_fm.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return quality_fm.score(docs, model).select(
        "doc_id", F.coalesce(quality_fm.remainder() == 2, F.lit(False)).alias("held_out"),
        "score", "predicted")


def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lsh_forest.near_duplicates(documents(spark, folder), size=3, share=85)


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.token_pieces(documents(spark, folder), tokenizer_path()).select(
        "doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces)


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer_path()
    return bpe.decode(bpe.encode(documents(spark, folder), path), path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.quality_rules(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "d2")


def op8_class_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    return brown.class_ngram_scores(documents(spark, folder)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    replaced = surrogates.replace_entities(documents(spark, folder), key=SURROGATE_KEY)
    return replaced.select(
        "doc_id", F.size("_entities").cast("long").alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct("_entities")), ",").alias("kinds"), "text")


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text").withColumn(
        "text_sha256", F.sha2(ascii_lower(text_of()), 256))
    return exact_dedup.exact_dedup(docs, carry=("text_sha256",))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(documents(spark, folder), *map(tokenizer_path, ALIGNED))


def op12_phrase_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_dedup.recurring_passages(documents(spark, folder)).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", changed), F.col("vec_id") % 100 == 0)


def all_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_suffix_dedup, op2_sharding, op3_quality_classifier, op4_near_dedup, op5_packing,
        op6_bpe, op7_quality_rules, op8_class_ngrams, op9_surrogates, op10_exact_dedup,
        op11_alignment, op12_phrase_dedup, op13_hard_negatives)}
