"""Sums over everything that sorts before a value, without sorting everything in one task.

``sums_before`` answers, for many probes at once, "what do the points below this code add up
to?". A single running window would put a whole group (or, without keys, the whole table) in one
task. Here the code is cut into 22-bit digits: a window only ever orders the at most 4,194,304
distinct digits that share all higher digits, and the digits' sums are added up by a join.
Rank comparisons and band joins are built on it.

``quantiles`` narrows down where its ranks lie, and orders no more than the sums that tell that.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

DIGIT_BITS = 22
#: Digits that 64-bit codes are cut into.
LEVELS = 3
MICRO = 1_000_000
_MANTISSA = float(1 << 52)


def micro(c: Column) -> Column:
    """Integer code of a number, with a resolution of 1e-6."""
    return F.rint(c * F.lit(float(MICRO))).cast("bigint")


def order_code(c: Column) -> Column:
    """An integer for each double, in the order of the doubles and different for different ones.

    Exponent and mantissa of the absolute value, put together; scaling by powers of two is exact.
    """
    def power_of(x: Column, near: Column) -> Column:
        return near + F.when(x < F.pow(F.lit(2.0), near), -1).when(
            x >= F.pow(F.lit(2.0), near + 1), 1).otherwise(0)

    def usual(x: Column, power: Column, half: Column) -> Column:
        # Two steps, as 2**-1022 has no double for its inverse's square.
        fraction = x / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), power - half)
        return (power + 1023) * F.lit(1 << 52) + ((fraction - 1) * F.lit(_MANTISSA)).cast("bigint")

    def code(x: Column) -> Column:
        tiny = (x * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("bigint")
        normal = _let(F.floor(F.log2(x)), lambda near: _let(
            power_of(x, near), lambda power: usual(x, power, F.floor(power / 2))))
        return F.when(x < F.lit(2.0 ** -1022), tiny).when(
            x == F.lit(float("inf")), F.lit(2047 << 52)).otherwise(normal)

    return _let(F.abs(c.cast("double")), code) * F.when(c < 0, -1).otherwise(1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(points: DataFrame, probes: DataFrame, code: str, measures: Sequence[str],
                keys: Sequence[str] = (), levels: int = LEVELS) -> DataFrame:
    """One row per distinct probe ``(*keys, code)``: ``before_<m>`` is the sum of measure m over
    the points of the same keys with a smaller code.

    Keys and codes must not be NULL. ``levels`` digits are cut off, the top one keeping all higher
    bits; by default they hold any 64-bit code.
    """
    keys = list(keys)
    place = [*keys, "tier", "block", "digits"]

    def with_places(df: DataFrame) -> DataFrame:
        """One row per tier: the digits from that level up, and the block that shares the rest."""
        shifts = F.array(*[
            F.struct(F.lit(level).alias("tier"),
                     F.shiftright(F.col(code), DIGIT_BITS * (level + 1)).alias("block")
                     if level < levels - 1 else F.lit(0).cast("bigint").alias("block"),
                     F.shiftright(F.col(code), DIGIT_BITS * level).alias("digits"))
            for level in range(levels)
        ])
        return df.select("*", F.inline(shifts))

    asked = probes.select(*keys, code).distinct()
    nothing = [F.lit(0).cast(points.schema[m].dataType).alias(m) for m in measures]
    digits = with_places(
        points.select(*keys, code, *measures).unionByName(asked.select(*keys, code, *nothing))
    ).groupBy(*place).agg(*[F.sum(m).alias(m) for m in measures])
    window = Window.partitionBy(*keys, "tier", "block").orderBy("digits").rowsBetween(
        Window.unboundedPreceding, -1)
    running = digits.select(*place, *[F.sum(m).over(window).alias(f"before_{m}") for m in measures])
    return with_places(asked).join(running, place).groupBy(*keys, code).agg(*[
        F.coalesce(F.sum(f"before_{m}"), F.lit(0)).alias(f"before_{m}") for m in measures
    ])


def from_code(code: Column) -> Column:
    """The double that has the ``order_code``."""
    size = F.abs(code)
    power, rest = F.shiftright(size, 52), size.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    half = F.floor((power - 1023) / 2)
    normal = (1 + rest / F.lit(_MANTISSA)) * F.pow(F.lit(2.0), half) * F.pow(
        F.lit(2.0), power - 1023 - half)
    value = F.when(power == 0, rest * F.lit(2.0 ** -537) * F.lit(2.0 ** -537)).when(
        power == 2047, F.lit(float("inf"))).otherwise(normal)
    return value * F.when(code < 0, -1.0).otherwise(1.0)


#: Low bits of a code that each step of a selection leaves open; the last leaves none.
STEPS = (42, 20, 0)


def selected(cells: DataFrame, ranks: Column) -> DataFrame:
    """Rows ``metric, n, values``: the values at some ranks of each metric, counted from 0.

    ``cells`` has a row per metric and ``code`` with its weight ``w``; ``ranks`` is an array over
    ``n``, the metric's total. The weights are summed by the codes' highest bits, which tells where
    each rank lies and how much of it is left; then by further bits of only those codes, and so
    on. No step orders more than 4,194,304 sums, and only the first sees all codes.
    """
    found = None
    for low in STEPS:
        digits = F.shiftright("code", low).alias("digits")
        if found is None:
            keys, rows = ["metric"], cells.groupBy("metric", digits).agg(F.sum("w").alias("w"))
        else:
            # A row per metric and rank: the metrics and ranks are named in the call.
            keys = ["metric", "slot", "rank", "n"]
            rows = cells.withColumn("above", F.shiftright("code", above)).join(
                F.broadcast(found), ["metric", "above"]).groupBy(*keys, digits).agg(
                F.sum("w").alias("w"))
        order = Window.partitionBy(*keys).orderBy("digits")
        rows = rows.withColumn("before", F.coalesce(F.sum("w").over(
            order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        if found is None:
            rows = rows.withColumn("n", F.sum("w").over(Window.partitionBy("metric"))).select(
                "*", F.posexplode(ranks).alias("slot", "rank"))
        found = rows.where("before <= rank AND rank < before + w").select(
            "metric", "slot", (F.col("rank") - F.col("before")).alias("rank"), "n",
            F.col("digits").alias("above"))
        above = low
    return found.groupBy("metric").agg(F.max("n").alias("n"), F.transform(
        F.sort_array(F.collect_list(F.struct("slot", "above"))),
        lambda s: from_code(s["above"])).alias("values"))


def quantiles(df: DataFrame, values: Mapping[str, Column], probabilities: Sequence[float],
              weight: Column | None = None) -> DataFrame:
    """Rows ``metric, n, q``: exact quantiles of each value, interpolated between ranks.

    A weight counts a row as that many rows. NULL values are left out; a metric without any value
    has no row. ``df`` is read once: its distinct values are shuffled, and all steps of the
    selection start from there.
    """
    cells = df.select(
        (weight if weight is not None else F.lit(1)).cast("bigint").alias("w"),
        F.inline(F.array(*[
            F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
            for name, value in values.items()
        ])),
    ).where("value IS NOT NULL AND w > 0").groupBy(
        "metric", order_code(F.col("value")).alias("code")).agg(F.sum("w").alias("w"))
    positions = [(F.col("n") - 1).cast("double") * F.lit(float(p)) for p in probabilities]
    ranks = F.array(*[end.cast("bigint") for p in positions for end in (F.floor(p), F.ceil(p))])
    return selected(cells, ranks).select("metric", "n", F.array(*[
        _between(F.struct(F.get("values", F.lit(2 * k)).alias("low"),
                          F.get("values", F.lit(2 * k + 1)).alias("high"),
                          (p - F.floor(p)).alias("part")))
        for k, p in enumerate(positions)]).alias("q"))


def _between(cut: Column) -> Column:
    """Linear interpolation, from whichever rank is nearer."""
    low, high, part = cut["low"], cut["high"], cut["part"]
    return F.when(part < 0.5, low + (high - low) * part).otherwise(
        high - (high - low) * (1 - part))


def quantile_row(df: DataFrame, value: Column, probabilities: Sequence[float],
                 weight: Column | None = None) -> DataFrame:
    """The quantiles of one value as a one-row table ``q`` (NULL without any value)."""
    return quantiles(df, {"value": value}, probabilities, weight).agg(F.max("q").alias("q"))
