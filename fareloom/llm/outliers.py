"""Quality rules with a robust multivariate outlier test for each language and source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from fareloom.llm.texts import text_of, without, words_of
from fareloom.session import written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: The transformed statistics that the outlier test looks at.
DIMENSIONS = ("size", "word_length", "symbols", "repeats", "lines", "capitals")
P = len(DIMENSIONS)


def _window_hashes(words: Column) -> Column:
    """A hash of each run of eight words, by doubling."""
    n = F.size(words)
    h = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        # A slice that starts behind the end is empty; the sums over the end are cut off below.
        h = F.zip_with(h, F.slice(h, step + 1, F.greatest(n, F.lit(1))),
                       lambda a, b: F.xxhash64(a, b))
    return F.slice(h, 1, F.greatest(n - (WINDOW - 1), F.lit(0)))


def _repeated_words(hashes: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more."""
    marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    flags = F.zip_with(
        marked, F.slice(marked, 2, F.greatest(F.size(marked), F.lit(1))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
        .otherwise(F.array().cast("array<int>")))
    starts = F.sort_array(F.array_distinct(F.flatten(flags)))
    covered = F.aggregate(
        F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))),
                   lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
        F.lit(0), lambda total, n: total + n)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of each row's whole text, with doc_id, lang and source.

    ``n_words`` words (runs of characters other than space and the controls 9 to 13) and
    ``word_chars`` code points in them; ``n_symbols`` of ``SYMBOLS``; ``n_lines`` lines with a word
    and ``n_dup_lines`` of them equal to an earlier one; ``n_repeat_words`` words in eight-word
    windows found twice or more in the text, windows compared by 64-bit hashes; ``n_capitals``
    letters A-Z. A missing or empty text has zeros.
    """
    body = F.col("_text")
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select("doc_id", "lang", "source", text_of(text).alias("_text")).select(
        "*", words_of(body).alias("_words"), lines.alias("_lines")).select(
        "*", _window_hashes(F.col("_words")).alias("_windows"))
    return counted.select(
        "doc_id", "lang", "source",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(without(body, " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        (F.octet_length(body) - F.octet_length(without(body, SYMBOLS))).cast("long").alias(
            "n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("_windows")).cast("long").alias("n_repeat_words"),
        (F.octet_length(body) - F.octet_length(F.regexp_replace(body, "[A-Z]+", ""))).cast(
            "long").alias("n_capitals"))


def _vector() -> dict[str, Column]:
    """The statistics, transformed towards symmetry; each is within a few units."""
    n, chars = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    some = F.greatest(n, F.lit(1))
    return {
        "size": F.log1p(n.cast("double")),
        "word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / some),
        "symbols": F.sqrt(F.col("n_symbols") / chars),
        "repeats": F.sqrt(F.col("n_repeat_words") / some),
        "lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "capitals": F.sqrt(F.col("n_capitals") / chars),
    }


def chi2_cdf(x: float, dof: int) -> float:
    """By the series of the incomplete gamma function."""
    a, z = dof / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= z / k
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi2_quantile(share: float, dof: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, dof) < share:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, dof) < share else (low, middle)
    return high


def _bins(values: DataFrame, keys: list[str], value: str, share: float, out: str) -> DataFrame:
    """For each key the smallest integer ``value`` that ``share`` of its rows don't exceed.

    Counts per value are summed before anything is ordered, so a window holds the distinct values
    of one key, never its rows.
    """
    from pyspark.sql import Window

    counts = values.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return counts.select(*keys, value, F.sum("_n").over(upto).alias("_upto"),
                         F.sum("_n").over(whole).alias("_all")).where(
        F.col("_upto") >= F.ceil(F.col("_all") * share)).groupBy(*keys).agg(
        F.min(value).alias(out))


def _moments(rows: DataFrame) -> DataFrame:
    """Mean and covariance of each stratum, and the Cholesky factor of the covariance.

    A small ridge keeps the factor defined where a statistic is constant, as symbols are in clean
    prose; its size is the spread below which a difference isn't taken for one.
    """
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    x = [F.col(d) for d in DIMENSIONS]
    sums = rows.groupBy("stratum").agg(
        F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(P)],
        *[F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in pairs])
    out = sums.select("stratum", "n", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}")
                                        for i in range(P)],
                      *[F.col(f"q{i}_{j}") for i, j in pairs])
    out = out.select("stratum", "n", *[f"m{i}" for i in range(P)], *[
        (F.col(f"q{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
         + (RIDGE[i] ** 2 if i == j else 0.0)).alias(f"c{i}_{j}") for i, j in pairs])
    for j in range(P):
        for i in range(j, P):
            rest = F.col(f"c{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            value = F.sqrt(F.greatest(rest, F.lit(RIDGE[i] ** 2))) if i == j else \
                rest / F.col(f"l{j}_{j}")
            out = out.withColumn(f"l{i}_{j}", value)
    return out.select("stratum", *[f"m{i}" for i in range(P)], *[f"l{i}_{j}" for i, j in pairs])


#: The least spread of each dimension.
RIDGE = (0.25, 0.05, 0.05, 0.12, 0.12, 0.05)


def _distances(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance by forward substitution."""
    joined = rows.join(fits, "stratum", "left")
    for i in range(P):
        rest = F.col(DIMENSIONS[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}_{k}") * F.col(f"z{k}")
        joined = joined.withColumn(f"z{i}", rest / F.col(f"l{i}_{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0"))
    return joined.select(*rows.columns, d2.alias("d2"))


def quality_rules(docs: DataFrame, text: str = "text", subset: float = 0.75, steps: int = 3,
                  level: float = 0.99999, least: int = 200) -> DataFrame:
    """The statistics of each row with ``base_failed``, ``d2``, ``cutoff`` and ``kept``.

    A text fails the base rules with fewer than 20 words or more than 30 % of them in repeated
    windows. The rest is judged by its statistics, transformed towards symmetry, against the
    documents of its language and source: mean and covariance of the ``subset`` share of them with
    the smallest determinant are found by concentration steps, started from medians and median
    deviations, and a text is rejected when its squared Mahalanobis distance exceeds the chi-square
    quantile of ``level``, scaled for the subset. Sources of fewer than ``least`` documents are
    pooled by language, languages with fewer pooled rows with each other.

    Statistics and thresholds come from all rows. Medians and subset limits are read off counts of
    fine bins (1/200 of a unit; 1/32 of a power of e for distances), which do not depend on
    partitioning. Work after the first pass is on a table of counts, not texts.

    A missing text has no words and fails. Missing languages and sources are values of their own.
    Repeated rows count and are judged separately. An empty table gives an empty result. Fewer
    rows than it takes to estimate anything leave zero spread plus the ridge, so equal rows stay.
    """
    counted = written(statistics(docs, text), "quality-counts")
    base_failed = (F.col("n_words") < 20) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    judged = counted.withColumns({"base_failed": base_failed, **_vector()})
    fine = judged.where(~F.col("base_failed"))
    by_source = fine.groupBy("lang", "source").agg(F.count("*").alias("_of_source"))
    by_lang = by_source.where(F.col("_of_source") < least).groupBy("lang").agg(
        F.sum("_of_source").alias("_of_lang"))
    strata = written(by_source.alias("s").join(
        by_lang.alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang")), "left").select(
        F.col("s.lang").alias("_lang"), F.col("s.source").alias("_source"),
        F.when(F.col("_of_source") >= least, F.to_json(F.array("s.lang", "s.source")))
        .when(F.col("_of_lang") >= least, F.to_json(F.array("s.lang"))).otherwise("[]")
        .alias("stratum")), "quality-strata")
    rows = written(fine.join(
        strata, fine["lang"].eqNullSafe(strata["_lang"])
        & fine["source"].eqNullSafe(strata["_source"])).select("stratum", *DIMENSIONS),
        "quality-rows")

    # Start: distances from the medians in units of the median deviation.
    tall = rows.select("stratum", F.posexplode(F.array(*DIMENSIONS)).alias("d", "x")).select(
        "stratum", "d", F.round(F.col("x") * 200).cast("int").alias("b"))
    centre = written(_bins(tall, ["stratum", "d"], "b", 0.5, "mid"), "quality-medians")
    off = tall.join(centre, ["stratum", "d"]).select(
        "stratum", "d", "mid", F.abs(F.col("b") - F.col("mid")).alias("b"))
    spread = _bins(off, ["stratum", "d"], "b", 0.5, "mad").join(centre, ["stratum", "d"])
    ridge = F.element_at(F.array(*[F.lit(r) for r in RIDGE]), F.col("d") + 1)
    start = spread.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct(
        "d", F.struct((F.col("mid") / 200).alias("m"),
                      F.greatest(F.col("mad") / 200 * 1.4826, ridge).alias("s"))))).alias("at"))
    fits = start.select("stratum", *[F.col("at")[i]["m"].alias(f"m{i}") for i in range(P)], *[
        (F.col("at")[i]["s"] if i == j else F.lit(0.0)).alias(f"l{i}_{j}")
        for i in range(P) for j in range(i + 1)])
    for step in range(steps):
        fits = written(fits, f"quality-fit-{step}")
        near = _distances(rows, fits).withColumn(
            "b", F.floor(F.log(F.col("d2") + 1e-9) * 32).cast("int"))
        limits = _bins(near, ["stratum"], "b", subset, "limit")
        fits = _moments(near.join(limits, "stratum").where("b <= limit"))
    fits = written(fits, "quality-fit")

    q = chi2_quantile(subset, P)
    scale = subset / chi2_cdf(q, P + 2)
    cutoff = chi2_quantile(level, P) * scale
    placed = judged.join(strata, judged["lang"].eqNullSafe(strata["_lang"])
                         & judged["source"].eqNullSafe(strata["_source"]), "left")
    return _distances(placed, fits).select(
        *counted.columns, "base_failed",
        F.when(~F.col("base_failed"), F.col("d2")).alias("d2"), F.lit(cutoff).alias("cutoff"),
        (~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff)).alias("kept"))
