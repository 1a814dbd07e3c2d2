"""Shift or auction: features, labels, model and decision for each booking."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from fareloom.functions.exact import mean
from fareloom.functions.keys import collapse, key_names, null_key
from fareloom.functions.scalars import duration_divisor
from fareloom.operators.auctions import PRICE
from fareloom.operators.band import (
    TOLERANCE, auction_points, with_similar_auctions, with_similar_auctions_1d)
from fareloom.session import written

FEATURES = [
    "booked_duration", "booked_distance", "expected_revenue", "hour_of_day", "day_of_week",
    "available_shifts", "avg_shift_cost", "avg_auction_price", "auction_success_rate",
]
AUCTION_SHARE_OF_REVENUE = 0.7


def daily_supply(shifts: DataFrame) -> DataFrame:
    return shifts.dropna(subset=["shift_date"]).groupBy(F.col("shift_date").alias("date")).agg(
        F.count("*").alias("available_shifts"), mean("hourly_rate_eur").alias("avg_shift_cost"))


def with_supply(bookings: DataFrame, shifts: DataFrame) -> DataFrame:
    """Bookings with the shifts of their date; NULL where the date has none."""
    return beside_supply(bookings, written(daily_supply(shifts), "daily-supply"))


def beside_supply(bookings: DataFrame, supply: DataFrame) -> DataFrame:
    """Bookings with the row of their date in ``supply``, a written ``daily_supply``."""
    return bookings.withColumn("date", F.to_date("booked_start_at")).join(supply, "date", "left")


def available_shifts(bookings: DataFrame, shifts: DataFrame) -> DataFrame:
    n = F.coalesce(F.col("available_shifts"), F.lit(0))
    return with_supply(bookings.select("booking_uuid", "booked_start_at"), shifts).select(
        "booking_uuid", n.alias("available_shifts"),
        F.when(n > 0, F.col("avg_shift_cost")).otherwise(F.lit(0.0)).alias("avg_shift_cost"))


def enriched(bookings: DataFrame, shifts: DataFrame, auctions: DataFrame,
             duration_only: bool = False, tolerance: float = TOLERANCE,
             exclude_self: bool = False, history: DataFrame | None = None) -> DataFrame:
    """Bookings with the supply of their date and with similar past auctions.

    ``history`` holds the bookings behind the auctions; by default the bookings themselves.
    """
    if duration_only:
        similar = with_similar_auctions_1d(bookings, auctions, tolerance)
    else:
        points = written(
            auction_points(bookings if history is None else history, auctions), "band-points")
        similar = with_similar_auctions(
            bookings, points, tolerance, auctions if exclude_self else None)
    return with_supply(similar, shifts)


def _features() -> list[Column]:
    n_shifts = F.coalesce(F.col("available_shifts"), F.lit(0))
    matched = F.col("matched_auctions") > 0
    return [
        F.col("booked_duration"),
        F.col("booked_distance"),
        F.col("gross_revenue_eur").alias("expected_revenue"),
        F.hour("booked_start_at").alias("hour_of_day"),
        F.weekday("booked_start_at").alias("day_of_week"),
        n_shifts.alias("available_shifts"),
        F.when(n_shifts > 0, F.col("avg_shift_cost")).otherwise(F.lit(0.0))
        .alias("avg_shift_cost"),
        F.when(matched, F.col("similar_price")).otherwise(F.lit(0.0)).alias("avg_auction_price"),
        F.when(matched, F.col("similar_success")).otherwise(F.lit(0.0))
        .alias("auction_success_rate"),
    ]


def decision_features(bookings: DataFrame, shifts: DataFrame, auctions: DataFrame,
                      duration_only: bool = False, tolerance: float = TOLERANCE,
                      exclude_self: bool = False) -> DataFrame:
    """The nine model features of every booking."""
    return enriched(
        bookings, shifts, auctions, duration_only, tolerance, exclude_self
    ).select("booking_uuid", *_features())


def first_auction(auctions: DataFrame) -> DataFrame:
    """One price per booking id: that of the auction which started first.

    Input files have an order, tables do not, so "first" is by start time and then by price.
    """
    order = [F.coalesce(F.col(c), F.lit("9999-12-31").cast("timestamp_ntz"))
             for c in ("auction_start_time",) if c in auctions.columns]
    first = F.min_by(F.struct(PRICE), F.struct(*order, F.col(PRICE).isNull(), F.col(PRICE)))
    return collapse(auctions, "booking_uuid", first.alias("first")).select(
        *key_names("booking_uuid"), F.col(f"first.{PRICE}").alias("first_price"))


def _shift_cost(duration_unit: str) -> Column:
    """Cost of the trip at the day's mean rate; NULL (no shift) stands for infinite."""
    divisor = F.lit(float(duration_divisor(duration_unit)))
    return F.when(F.coalesce(F.col("available_shifts"), F.lit(0)) > 0,
                  F.col("booked_duration") / divisor * F.col("avg_shift_cost"))


def _labelled(supplied: DataFrame, auctions: DataFrame, duration_unit: str) -> DataFrame:
    keyed = supplied.select("*", *null_key(supplied, "booking_uuid"))
    return keyed.join(first_auction(auctions), key_names("booking_uuid")).withColumn(
        "shift_cost", _shift_cost(duration_unit)
    ).withColumn(
        "profitable", F.coalesce(F.col("shift_cost") < F.col("first_price"), F.lit(False)))


def training_labels(bookings: DataFrame, shifts: DataFrame, auctions: DataFrame,
                    duration_unit: str = "min") -> DataFrame:
    """Auctioned bookings and whether a shift would have been cheaper than the auction."""
    return _labelled(with_supply(bookings, shifts), auctions, duration_unit).select(
        "booking_uuid", "shift_cost", F.col("first_price").alias("auction_price"), "profitable")


def training_set(bookings: DataFrame, shifts: DataFrame, auctions: DataFrame,
                 duration_unit: str = "min", **similarity) -> DataFrame:
    """Features and 0/1 ``label`` of the auctioned bookings."""
    labelled = _labelled(
        enriched(bookings, shifts, auctions, **similarity), auctions, duration_unit)
    return labelled.select(
        "booking_uuid", *_features(), F.col("profitable").cast("double").alias("label"))


def feature_scaling(features: DataFrame) -> DataFrame:
    """Mean and population deviation per feature: what standardising subtracts and divides by."""
    cells = [
        F.struct(F.lit(c).alias("feature"), mean(c).alias("mean"),
                 F.bround(F.stddev_pop(c), 6).alias("scale"))
        for c in FEATURES
    ]
    return features.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def fit_model(training: DataFrame, trees: int = 100, depth: int = 8,
              seed: int = 42) -> PipelineModel:
    """Standardised features into a random forest. Unknown feature values count as 0.

    Fitting passes over the training set several times, so it should be a written table.
    """
    complete = training.na.fill(0.0, subset=FEATURES)
    return Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        RandomForestClassifier(featuresCol="scaled", labelCol="label", numTrees=trees,
                               maxDepth=depth, seed=seed, probabilityCol="probability"),
    ]).fit(complete)


def with_probability(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``p_shift``, the probability that a shift is the cheaper choice."""
    scored = model.transform(df.na.fill(0.0, subset=FEATURES))
    probability = vector_to_array("probability")
    # A training set with one class only gives vectors of a single entry, that of class 0.
    p = F.coalesce(F.get(probability, F.lit(1)), F.lit(0.0))
    return scored.withColumn("p_shift", p).drop(
        "raw", "scaled", "rawPrediction", "probability", "prediction")


def model_predictions(training: DataFrame, model: PipelineModel) -> DataFrame:
    return with_probability(training, model).select(
        "booking_uuid", F.col("label").cast("int").alias("label"), "p_shift")


def with_costs(matched: DataFrame, duration_unit: str) -> DataFrame:
    revenue = F.col("gross_revenue_eur")
    estimate = F.when(F.col("matched_auctions") > 0, F.col("similar_price"))
    priced = matched.withColumns({
        "expected_shift_cost": _shift_cost(duration_unit),
        "expected_auction_price": F.coalesce(
            estimate, revenue * F.lit(AUCTION_SHARE_OF_REVENUE)),
    })
    cheaper = F.least("expected_shift_cost", "expected_auction_price")
    return priced.withColumn("expected_profit", revenue - cheaper)


def decision_costs(bookings: DataFrame, shifts: DataFrame, auctions: DataFrame,
                   duration_unit: str = "min", **similarity) -> DataFrame:
    """What each choice is expected to cost, and the profit of the cheaper one.

    Where no similar auction has a price, 70 % of the revenue is assumed. A date without shifts
    has no shift cost (NULL).
    """
    matched = enriched(bookings, shifts, auctions, **similarity)
    return with_costs(matched, duration_unit).select(
        "booking_uuid", F.coalesce(F.col("available_shifts"), F.lit(0)).alias("available_shifts"),
        "expected_shift_cost", "expected_auction_price", "expected_profit")


def dispatch_decision(bookings: DataFrame, shifts: DataFrame, auctions: DataFrame,
                      model: PipelineModel, duration_unit: str = "min",
                      **similarity) -> DataFrame:
    costed = with_costs(enriched(bookings, shifts, auctions, **similarity), duration_unit)
    return decide(costed, model)


def decide(costed: DataFrame, model: PipelineModel) -> DataFrame:
    """Decision for bookings that carry their costs and feature inputs."""
    scored = with_probability(
        costed.select("booking_uuid", "expected_shift_cost", "expected_auction_price",
                      "expected_profit", *_features()), model)
    p = F.col("p_shift")
    return scored.select(
        "booking_uuid", p,
        ((p > 0.5) & (F.col("available_shifts") > 0)).alias("assign_to_shift"),
        F.greatest(p, 1 - p).alias("confidence"),
        "expected_shift_cost", "expected_auction_price", "expected_profit")


def expected_profit_weighted(bookings: DataFrame, shifts: DataFrame, auctions: DataFrame,
                             p_shift: float = 0.5, duration_unit: str = "raw",
                             tolerance: float = TOLERANCE) -> DataFrame:
    """Profit of both choices weighted by the probability of the shift being the better one.

    Similarity is by duration alone. Without a shift the cost is infinite and the profit NULL.
    """
    costed = with_costs(
        enriched(bookings, shifts, auctions, duration_only=True, tolerance=tolerance),
        duration_unit)
    revenue = F.col("gross_revenue_eur")
    p = F.lit(float(p_shift))
    return costed.select(
        "booking_uuid", "expected_shift_cost", "expected_auction_price",
        (p * (revenue - F.col("expected_shift_cost"))
         + (1 - p) * (revenue - F.col("expected_auction_price"))).alias("expected_profit"))
