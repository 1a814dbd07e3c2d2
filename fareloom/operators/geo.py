"""Where auctioned bookings start and end, and what they cost there."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from fareloom.functions.exact import dec, half_even, mean, ratio
from fareloom.functions.keys import key_names, null_key
from fareloom.functions.scalars import grid_cell
from fareloom.operators.auctions import PRICE, weighted_mean, repeated, keyed_auctions
from fareloom.session import written
from fareloom.sources.schema import require

COORDINATES = ("pickup_longitude", "pickup_latitude", "dropoff_longitude", "dropoff_latitude")


def auctioned(bookings: DataFrame, auctions: DataFrame) -> DataFrame:
    """Coordinates and price of every auctioned booking; missing ids match each other."""
    require(bookings, *COORDINATES)
    return bookings.select("booking_uuid", *COORDINATES, *null_key(bookings, "booking_uuid")).join(
        auctions.select(PRICE, *null_key(auctions, "booking_uuid")), key_names("booking_uuid")
    ).drop(*key_names("booking_uuid"))


def with_grid(df: DataFrame, size: float = 0.01) -> DataFrame:
    return df.withColumns({
        "pickup_grid_x": grid_cell(F.col("pickup_longitude"), size),
        "pickup_grid_y": grid_cell(F.col("pickup_latitude"), size),
        "dropoff_grid_x": grid_cell(F.col("dropoff_longitude"), size),
        "dropoff_grid_y": grid_cell(F.col("dropoff_latitude"), size),
    })


def _grid(bookings: DataFrame, auctions: DataFrame, end: str, size: float) -> DataFrame:
    require(bookings, *COORDINATES)
    x, y = f"{end}_grid_x", f"{end}_grid_y"
    placed = with_grid(bookings, size).dropna(subset=[x, y])
    return keyed_auctions(auctions, placed, F.col(x), F.col(y)).groupBy(x, y).agg(
        weighted_mean("sum_price", "n_price").alias("avg_price"),
        F.sum(repeated("repeats", "n_price")).alias("n"))


def pickup_grid(bookings: DataFrame, auctions: DataFrame, size: float = 0.01) -> DataFrame:
    return _grid(bookings, auctions, "pickup", size)


def dropoff_grid(bookings: DataFrame, auctions: DataFrame, size: float = 0.01) -> DataFrame:
    return _grid(bookings, auctions, "dropoff", size)


def grid_top(bookings: DataFrame, auctions: DataFrame, k: int = 5,
             size: float = 0.01) -> DataFrame:
    return pickup_grid(bookings, auctions, size).dropna(subset=["avg_price"]).orderBy(
        F.desc("avg_price"), "pickup_grid_x", "pickup_grid_y").limit(k)


def price_map_points(bookings: DataFrame, auctions: DataFrame) -> DataFrame:
    """Points of the pickup and the dropoff price maps."""
    ends = F.array(*[
        F.struct(F.lit(end).alias("endpoint"), F.col(f"{end}_latitude").alias("latitude"),
                 F.col(f"{end}_longitude").alias("longitude"), F.col(PRICE).alias("price"))
        for end in ("pickup", "dropoff")
    ])
    return auctioned(bookings, auctions).select("booking_uuid", F.inline(ends))


def price_map_centre(bookings: DataFrame, auctions: DataFrame) -> DataFrame:
    return price_map_points(bookings, auctions).groupBy("endpoint").agg(
        mean("latitude").alias("latitude"), mean("longitude").alias("longitude"))


def fit_clusters(points: DataFrame, longitude: str, latitude: str, k: int = 5,
                 seed: int = 42, weight: str | None = None) -> tuple[KMeansModel, DataFrame]:
    """K-means over coordinates; returns the model and the points with their cluster.

    A ``weight`` counts a row as that many points. The fit reads its input once for each
    iteration, so ``points`` should be a written table.
    """
    assembler = VectorAssembler(inputCols=[longitude, latitude], outputCol="point")
    placed = assembler.transform(points.dropna(subset=[longitude, latitude]))
    means = KMeans(k=k, seed=seed, featuresCol="point", predictionCol="cluster")
    model = (means.setWeightCol(weight) if weight else means).fit(placed)
    return model, model.transform(placed).drop("point")


def pickup_clusters(bookings: DataFrame, auctions: DataFrame, k: int = 3,
                    seed: int = 42) -> DataFrame:
    """Prices of auctioned bookings by cluster of pickup places.

    The join runs once, summed to a row for each place and price with its number of points, and
    it is these that are clustered.
    """
    cells = written(
        auctioned(bookings, auctions).dropna(subset=["pickup_longitude", "pickup_latitude"])
        .groupBy("pickup_longitude", "pickup_latitude", PRICE).agg(F.count("*").alias("n")),
        "pickup-cells")
    places = written(cells.groupBy("pickup_longitude", "pickup_latitude").agg(
        F.sum("n").alias("n")), "pickup-places")
    _, placed = fit_clusters(places, "pickup_longitude", "pickup_latitude", k, seed, "n")
    price = F.col(PRICE)
    known = cells.join(placed.drop("n"), ["pickup_longitude", "pickup_latitude"]).withColumn(
        "priced", F.when(price.isNotNull(), F.col("n"))).withColumn(
        "total", dec(price) * F.col("priced"))
    sums = known.groupBy("cluster").agg(
        ratio(F.sum("total"), F.sum("priced")).alias("mean"),
        F.coalesce(F.sum("priced"), F.lit(0)).alias("price_count"), F.sum("n").alias("points"))
    spread = known.join(sums.select("cluster", "mean"), "cluster").groupBy("cluster").agg(
        F.bround(F.sqrt(ratio(F.sum(F.col("priced") * F.pow(price - F.col("mean"), F.lit(2))),
                              F.sum("priced") - 1)), 6).alias("std"))
    return sums.join(spread, "cluster").select(
        "cluster", half_even(F.col("mean")).alias("price_mean"), "price_count",
        half_even(F.col("std")).alias("price_std"), "points")
