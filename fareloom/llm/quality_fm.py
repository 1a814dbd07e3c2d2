"""A quality classifier: a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from fareloom.llm.texts import text_of, without, words_of
from fareloom.session import written

#: Hash buckets of the words and of the binned statistics.
WORD_BUCKETS, BIN_BUCKETS = 1 << 13, 1 << 9
#: Tasks of each iteration over the bounded sample; so few that their gradients need no further
#: stage to be summed in.
TASKS = 4


def remainder(doc_id: str = "doc_id", modulus: int = 4) -> Column:
    """crc32 of the id as text, modulo; NULL for a missing id."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def _shares() -> dict[str, Column]:
    """Statistics of the text and its metadata, each in about 0 to 1."""
    text = F.col("_text")
    chars = F.greatest(F.octet_length(text), F.lit(1))
    words = F.greatest(F.size("_words"), F.lit(1))

    def share(removed: Column) -> Column:
        return (F.octet_length(text) - F.octet_length(removed)) / chars

    return {
        "words": F.least(F.log1p(F.size("_words")) / 12, F.lit(1.0)),
        "declared": F.least(F.log1p(F.greatest(F.coalesce(
            F.col("_n_chars").cast("double"), F.lit(0.0)), F.lit(0.0))) / 15, F.lit(1.0)),
        "word_length": F.least(F.octet_length(without(text, " \t\n\r")) / words / 20, F.lit(1.0)),
        "distinct": F.size(F.array_distinct("_words")) / words,
        "capitals": share(F.regexp_replace(text, "[A-Z]+", "")),
        "digits": share(F.regexp_replace(text, "[0-9]+", "")),
        "marks": share(without(text, "!?")),
        "stops": share(without(text, ".,;:")),
        "bars": share(without(text, "|<>")),
        "symbols": share(without(text, "#*$%&")),
        "other": F.least(F.octet_length(text) / F.greatest(F.char_length(text), F.lit(1)) - 1,
                         F.lit(1.0)),
        "lines": F.least(share(without(text, "\n")) * 20, F.lit(1.0)),
    }


def features(docs: DataFrame, text: str = "text", carry: Column | None = None) -> DataFrame:
    """doc_id, the words, the statistics ``s_...`` and their bins as strings; ``carry`` as _row."""
    declared = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    row = (F.lit(None).cast("string") if carry is None else carry).alias("_row")
    base = docs.select("doc_id", text_of(text).alias("_text"), declared.alias("_n_chars"),
                       row).select("*", words_of(F.lower(F.col("_text"))).alias("_words"))
    shares = _shares()
    base = base.select("doc_id", "_row", "_words",
                       *[c.alias(f"s_{n}") for n, c in shares.items()])
    # Roots spread the small shares, where most of the difference lies, over the bins.
    bins = F.array(*[F.concat(F.lit(f"{n}="), F.floor(F.sqrt(F.col(f"s_{n}")) * 16).cast("string"))
                     for n in shares])
    return base.withColumn("_bins", bins)


def _stages() -> list:
    shares = [f"s_{n}" for n in _shares()]
    return [
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=WORD_BUCKETS),
        Normalizer(inputCol="_counts", outputCol="_word_vector"),
        HashingTF(inputCol="_bins", outputCol="_bin_vector", numFeatures=BIN_BUCKETS, binary=True),
        VectorAssembler(inputCols=["_word_vector", "_bin_vector", *shares], outputCol="features"),
    ]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000, rank: int = 4,
        iterations: int = 50, text: str = "text"):
    """A model from the labelled rows outside the held-out quarter, or its constant score.

    ``labels`` has doc_id and ``quality``, 0 or 1; other values and missing ones are left out, and
    so are rows whose crc32 of the id, modulo 4, is 2. Of more than ``sample_rows`` labelled rows
    a sample of about so many, chosen by a hash of the id, is used; this bounds the fit, which
    stands on hashed words with ``rank`` factors each. Rows that repeat count each time. Without
    rows of both labels the result is a number, the smoothed share of label 1.
    """
    wanted = labels.where(F.col("quality").isin(0, 1) & (remainder() != 2)).select(
        "doc_id", F.col("quality").cast("double").alias("label"))
    count, positive = wanted.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if positive in (0, count):
        return (positive + 1) / (count + 2)
    share = min(1.0, sample_rows / count)
    sample = wanted.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20))
                          < int(share * (1 << 20)))
    # About ``sample_rows`` rows of two numbers, whatever the input.
    chosen = features(docs.join(F.broadcast(sample), "doc_id", "left_semi"), text)
    rows = written(chosen.drop("_row").join(F.broadcast(sample), "doc_id").repartition(TASKS, "doc_id"),
                   "quality-training")
    machine = FMClassifier(
        featuresCol="features", labelCol="label", factorSize=rank, maxIter=iterations,
        stepSize=0.05, regParam=1e-5, solver="adamW", seed=42, initStd=0.05)
    return Pipeline(stages=[*_stages(), machine]).fit(rows)


def score(docs: DataFrame, model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, ``score`` (0 to 1, higher: better quality likelier) and ``predicted`` of each row.

    The pairwise term is summed in linear time, as half of the squared sums less the sums of
    squares of the factors. Whole texts are read; a missing text counts as empty and gets the score
    of its statistics. Ids, languages, sources and labels are not looked at; repeated rows get
    equal scores, and an empty table gives an empty result.
    """
    if isinstance(model, float):
        scored = docs.select("doc_id", F.lit(model).alias("score"))
    else:
        scored = model.transform(features(docs, text)).select(
            "doc_id", vector_to_array("probability")[1].alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def without_rejected(docs: DataFrame, model, text: str = "text",
                     threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with its columns."""
    if isinstance(model, float):
        return docs.where(F.lit(model >= threshold))
    names = docs.columns
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    kept = model.transform(features(docs, text, row)).where(
        vector_to_array("probability")[1] >= threshold)
    return kept.select(*[F.col(f"_row.c{i}").alias(n) for i, n in enumerate(names)])
