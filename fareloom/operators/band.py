"""Past auctions of similar bookings: a band join without the join.

A booking is similar to another if duration and distance both lie within +-20 %. What is wanted
per booking is a count and a mean over all similar auctions, that is, a sum over a rectangle of
(duration, distance). Sums over rectangles do not need the pairs:

* the auctions in a band are those below its upper corner, less those below the two corners beside
  it, plus those below the lower one, and such sums need no pairs (``functions/dominance.py``);
* an auction whose booking id has several shapes counts once where any of them lies in the band.
  Seen from the other side, each shape is a box of the queries whose band holds it; the boxes of an
  id are cut into disjoint rectangles, which a query counts by the sums below itself.

The work grows with the number of distinct (duration, distance) cells times the logarithm of the
number of distinct durations, whatever share of the rows falls into one band or has one id.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fareloom.functions.dominance import DominanceIndex, dominance_sums
from fareloom.functions.exact import dec, ratio
from fareloom.functions.keys import collapse, key_names, null_key
from fareloom.functions.ordered import order_code, sums_before
from fareloom.operators.auctions import PRICE
from fareloom.session import written

TOLERANCE = 0.2
MEASURES = ["n", "n_price", "sum_price"]
BOOKING = key_names("booking_uuid")
SIDES = ("booked_duration", "booked_distance")


def _band(column: str, tolerance: float) -> dict[str, Column]:
    """Codes [from, to) of the values within the tolerance, both ends of the band included.

    Below zero the band is empty: its lower end lies above its upper end.
    """
    c = F.col(column)
    return {
        f"{column}_from": order_code(c * F.lit(1 - tolerance)),
        f"{column}_to": order_code(c * F.lit(1 + tolerance)) + 1,
    }


def _price_sums(auctions: DataFrame, *also: Column) -> DataFrame:
    return collapse(
        auctions, "booking_uuid", F.count("*").alias("n"), F.count(PRICE).alias("n_price"),
        F.sum(dec(PRICE)).alias("sum_price"), also=also)


def _summed(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("n_price").alias("n_price"),
        F.coalesce(F.sum("sum_price"), F.lit(0).cast("decimal(38,6)")).cast("decimal(38,6)")
        .alias("sum_price"))


def _matched(df: DataFrame) -> DataFrame:
    n = F.coalesce(F.col("n"), F.lit(0))
    return df.withColumns({
        "matched_auctions": n,
        "similar_price": ratio(F.col("sum_price"), F.col("n_price")),
        "similar_success": ratio(F.col("n_price"), n),
    }).drop(*MEASURES)


def _report(matched: DataFrame) -> DataFrame:
    return matched.select(
        "booking_uuid", "matched_auctions", F.col("similar_price").alias("avg_auction_price"),
        F.col("similar_success").alias("auction_success_rate"))


def similar_auctions(bookings: DataFrame, auctions: DataFrame, tolerance: float = TOLERANCE,
                     exclude_self: bool = False) -> DataFrame:
    """Per booking: auctions of bookings with similar duration and distance.

    The booking's own auctions count as similar unless ``exclude_self``. Without a match the
    count is 0 and mean and share are NULL.
    """
    points = written(auction_points(bookings, auctions), "band-points")
    return _report(with_similar_auctions(
        bookings, points, tolerance, auctions if exclude_self else None))


def auction_points(history: DataFrame, auctions: DataFrame) -> DataFrame:
    """Auction counts and price sums of past bookings, by exact duration and distance.

    An auction counts once however many bookings carry its id. Ids with one (duration, distance)
    are summed over it; those with several keep a row for each, with the id as ``repeated``.
    """
    shapes = history.dropna(subset=["booked_duration", "booked_distance"]).groupBy(
        *null_key(history, "booking_uuid"), "booked_duration", "booked_distance").agg(
        F.count("*").alias("bookings"))
    kinds = shapes.groupBy(*BOOKING).agg(F.count("*").alias("shapes"))
    priced = _price_sums(auctions).join(kinds, BOOKING)
    repeated = F.when(F.col("shapes") > 1, F.struct(*BOOKING)).alias("repeated")
    return _summed(priced.join(shapes, BOOKING), "booked_duration", "booked_distance", repeated)


def with_similar_auctions(bookings: DataFrame, points: DataFrame, tolerance: float = TOLERANCE,
                          without: DataFrame | None = None) -> DataFrame:
    """Bookings, past or incoming, with ``matched_auctions``, ``similar_price`` and
    ``similar_success``. Auctions given as ``without`` do not count for their own booking.

    ``points`` (``auction_points``) are read several times and should be a written table.
    """
    queries = bookings.select(*SIDES).dropna().distinct()
    sums = band_sums(points.where("repeated IS NULL"), queries, tolerance)
    repeated = points.where("repeated IS NOT NULL")
    if not repeated.isEmpty():
        sums = _summed(sums.unionByName(_repeated_sums(repeated, queries, tolerance)), *SIDES)
    out = bookings.join(sums, list(SIDES), "left")
    return _matched(out if without is None else _without_own(out, _price_sums(without)))


def with_indexed_auctions(bookings: DataFrame, index: BandIndex, folder: str) -> DataFrame:
    """As ``with_similar_auctions``, for a few bookings and the points of an index.

    ``folder`` takes what the lookups write.
    """
    queries = written(bookings.select(*SIDES).dropna().distinct(), "queries", folder)
    return _matched(bookings.join(index.sums(queries, folder), list(SIDES), "left"))


def _without_own(out: DataFrame, own: DataFrame) -> DataFrame:
    """Take a booking's own auctions out again; it is in its own band unless a side is negative."""
    renamed = own.select(*BOOKING, *[F.col(m).alias(f"own_{m}") for m in MEASURES])
    inside = (F.col("booked_duration") >= 0) & (F.col("booked_distance") >= 0)
    joined = out.select("*", *null_key(out, "booking_uuid")).join(renamed, BOOKING, "left")
    return joined.withColumns({
        m: F.col(m) - F.when(inside, F.coalesce(F.col(f"own_{m}"), F.lit(0))).otherwise(0)
        for m in MEASURES
    }).drop(*BOOKING, *[f"own_{m}" for m in MEASURES])


def _boxes(points: DataFrame, tolerance: float) -> DataFrame:
    """For each shape the codes [from, to) of the durations and distances whose bands hold it.

    The ends are the least double whose band reaches up to the value and the largest whose band
    reaches down to it, found among the neighbours of the quotients.
    """
    largest = F.lit(1.7976931348623157e308)

    def near(quotient: Column) -> Column:
        step = F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(quotient)) - 53), F.lit(5e-324))
        return F.when(quotient > 0, F.transform(
            F.sequence(F.lit(-12), F.lit(12)), lambda k: quotient + step * k)).otherwise(
            F.array(F.lit(0.0)))

    def ends(side: str) -> dict[str, Column]:
        x = F.col(f"booked_{side}").cast("double")
        finite = F.least(x, largest)
        low = F.array_min(F.filter(near(finite / F.lit(1 + tolerance)),
                                   lambda c: c * F.lit(1 + tolerance) >= x))
        high = F.when(x > largest, x).otherwise(F.array_max(F.filter(
            near(finite / F.lit(1 - tolerance)), lambda c: c * F.lit(1 - tolerance) <= x)))
        return {f"{side}_low": low, f"{side}_high": high}

    shown = points.where(" AND ".join(f"{c} >= 0" for c in SIDES))
    return shown.withColumns({**ends("duration"), **ends("distance")}).select(
        F.struct("repeated.*").alias("id"), *MEASURES,
        *[f"{s}_{e}" for s in ("duration", "distance") for e in ("low", "high")])


def box_corners(points: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """The repeated ids' measures as corners (u, v, measures): a query's sums over the ids of which
    any shape lies in its band are those of the corners at or below it.

    A box spans a factor of (1 + tolerance) / (1 - tolerance) in both directions. Space is cut into
    cells of a smaller factor, so that a box that meets a cell covers at least one of its ends in
    each direction. What an id's boxes cover above a duration of a cell is then a part from the
    cell's lower end up and one from the upper end down; both change at ends of boxes only. An id
    with so many shapes has at most as many such rectangles as boxes and cells, times four.
    """
    if not 0 < tolerance < 1:
        raise ValueError("a tolerance between 0 and 1 is needed")
    factor = ((1 + tolerance) / (1 - tolerance)) ** 0.9
    lowest = F.lit(-(1 << 20))

    def start_of(cell: Column) -> Column:
        return order_code(F.pow(F.lit(factor), cell.cast("double")))

    boxes = _boxes(points, tolerance)
    for side in ("duration", "distance"):
        low, high = F.col(f"{side}_low"), F.col(f"{side}_high")
        steps = [F.floor(F.log(F.least(c, F.lit(1.7e308))) / F.log(F.lit(factor))).cast("int")
                 for c in (low, high)]
        boxes = boxes.withColumn(f"{side}_cell", F.explode(
            F.when(low <= 0, F.array(lowest)).otherwise(
                F.sequence(steps[0] - 1, steps[1] + 1))))
        cell = F.col(f"{side}_cell")
        boxes = boxes.withColumns({
            f"{side}_begin": F.when(cell == lowest, 0).otherwise(start_of(cell)),
            f"{side}_end": F.when(cell == lowest, 1).otherwise(start_of(cell + 1)),
        }).withColumns({
            f"{side}_from": F.greatest(order_code(low), f"{side}_begin"),
            f"{side}_to": F.least(order_code(high) + 1, F.col(f"{side}_end")),
        }).where(f"{side}_from < {side}_to")
    place = ["id", "duration_cell", "distance_cell"]
    # Each box changes what is covered at one of its ends; before it, if it begins with the cell.
    bottom, top = (F.col(f"distance_{a}") == F.col(f"distance_{b}")
                   for a, b in (("from", "begin"), ("to", "end")))
    left = F.col("duration_from") == F.col("duration_begin")
    rises, falls = F.when(bottom, F.col("distance_to")), F.when(top, F.col("distance_from"))
    turns = boxes.select(
        *place, *MEASURES, "duration_begin", "duration_end", "distance_begin", "distance_end",
        F.inline(F.array(
            F.struct(F.when(left, F.col("duration_to")).otherwise(F.col("duration_from")).alias("at"),
                     F.when(left, rises).alias("up_before"), F.when(~left, rises).alias("up_from"),
                     F.when(left, falls).alias("down_before"),
                     F.when(~left, falls).alias("down_from")),
            F.struct(F.col("duration_begin").alias("at"), *[F.lit(None).cast("bigint").alias(c) for c in (
                "up_before", "up_from", "down_before", "down_from")]))))
    turns = turns.groupBy(*place, "at").agg(
        *[F.max(c).alias(c) for c in (*MEASURES, "duration_end", "distance_begin", "distance_end",
                                      "up_before", "up_from")],
        *[F.min(c).alias(c) for c in ("down_before", "down_from")])
    order = Window.partitionBy(*place).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    later = order.rowsBetween(1, Window.unboundedFollowing)
    slabs = turns.select(
        *MEASURES, F.col("at").alias("u_from"), "distance_begin", "distance_end",
        F.coalesce(F.lead("at").over(order), "duration_end").alias("u_to"),
        F.greatest(F.max("up_from").over(so_far), F.max("up_before").over(later)).alias("up"),
        F.least(F.min("down_from").over(so_far), F.min("down_before").over(later)).alias("down"),
    ).where("u_from < u_to")
    begin, end, up, down = (F.col(c) for c in ("distance_begin", "distance_end", "up", "down"))
    pieces = slabs.select(*MEASURES, "u_from", "u_to", F.inline(F.filter(F.array(
        F.struct(begin.alias("v_from"), F.when(up >= down, end).otherwise(up).alias("v_to")),
        F.struct(F.when(up >= down, None).otherwise(down).alias("v_from"), end.alias("v_to"))),
        lambda p: p["v_from"] < p["v_to"])))
    corners = pieces.select(*MEASURES, F.inline(F.array(*[
        F.struct(F.col(f"u_{a}").alias("u"), F.col(f"v_{b}").alias("v"),
                 F.lit(1 if a == b else -1).alias("sign"))
        for a in ("from", "to") for b in ("from", "to")])))
    signed = corners.select("u", "v", *[
        (F.col("sign") * F.col(m)).cast("decimal(38,6)" if m == "sum_price" else "bigint").alias(m)
        for m in MEASURES])
    return _summed(signed, "u", "v").where(" OR ".join(f"{m} <> 0" for m in MEASURES))


def _coded(points: DataFrame) -> DataFrame:
    return points.select(order_code(F.col("booked_duration")).alias("u"),
                         order_code(F.col("booked_distance")).alias("v"), *MEASURES)


def _ends_of_bands(queries: DataFrame, tolerance: float) -> DataFrame:
    """The corners (u, v) of each query's band, with signs."""
    bands = queries.withColumns(
        {**_band("booked_duration", tolerance), **_band("booked_distance", tolerance)}
    ).where("booked_duration_from < booked_duration_to "
            "AND booked_distance_from < booked_distance_to")
    return bands.select(*SIDES, F.inline(F.array(*[
        F.struct(F.col(f"booked_duration_{a}").alias("u"), F.col(f"booked_distance_{b}").alias("v"),
                 F.lit(1 if a == b else -1).alias("sign"))
        for a in ("from", "to") for b in ("from", "to")])))


def _places_in_boxes(queries: DataFrame) -> DataFrame:
    """Each query as the corner behind itself; below zero bands are empty."""
    return queries.where(" AND ".join(f"{c} >= 0" for c in SIDES)).select(
        *SIDES, (order_code(F.col("booked_duration")) + 1).alias("u"),
        (order_code(F.col("booked_distance")) + 1).alias("v"), F.lit(1).alias("sign"))


def _signed_sums(ends: DataFrame, found: DataFrame) -> DataFrame:
    return ends.join(found, ["u", "v"]).groupBy(*SIDES).agg(
        *[F.sum(F.col("sign") * F.col(m)).alias(m) for m in MEASURES])


def band_sums(points: DataFrame, queries: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Sums of the points in the band of each (booked_duration, booked_distance) query.

    Bands feed several branches, so they are written out once.
    """
    ends = written(_ends_of_bands(queries, tolerance), "bands")
    return _signed_sums(ends, dominance_sums(_coded(points), ends, MEASURES, purpose="band"))


def _repeated_sums(points: DataFrame, queries: DataFrame, tolerance: float) -> DataFrame:
    """Sums over the ids with several shapes of which any lies in the band, each id once."""
    corners = written(box_corners(points, tolerance), "band-boxes")
    ends = written(_places_in_boxes(queries), "band-places")
    return _signed_sums(ends, dominance_sums(corners, ends, MEASURES, purpose="boxes"))


class BandIndex:
    """The auction points of the past in a folder, for bookings that come in a few at a time.

    ``append`` takes ``auction_points``; the ids of bookings must be new ones, as an id that came
    before counts again. Points of one shape and the corners of repeated ids are kept apart.
    """

    def __init__(self, spark: SparkSession, folder: str, tolerance: float = TOLERANCE):
        self.tolerance = tolerance
        self.plain = DominanceIndex(spark, f"{folder}/plain", MEASURES)
        self.boxes = DominanceIndex(spark, f"{folder}/boxes", MEASURES)

    def append(self, points: DataFrame) -> None:
        self.plain.append(_coded(points.where("repeated IS NULL")))
        repeated = points.where("repeated IS NOT NULL")
        if not repeated.isEmpty():
            self.boxes.append(box_corners(repeated, self.tolerance))

    def sums(self, queries: DataFrame, folder: str) -> DataFrame:
        """The sums of each distinct query's band, from what it looks up in the index."""
        parts = []
        for name, index, ends in (
                ("plain", self.plain, _ends_of_bands(queries, self.tolerance)),
                ("boxes", self.boxes, _places_in_boxes(queries))):
            ends = written(ends, f"{name}-ends", folder)
            found = index.sums(ends, f"{folder}/{name}")
            if found is not None:
                parts.append(_signed_sums(ends, found))
        nothing = [F.lit(0).cast("decimal(38,6)" if m == "sum_price" else "bigint").alias(m)
                   for m in MEASURES]
        none = queries.select(*SIDES, *nothing).limit(0)
        return _summed(functools.reduce(DataFrame.unionByName, parts, none), *SIDES)


def similar_auctions_1d(bookings: DataFrame, auctions: DataFrame,
                        tolerance: float = TOLERANCE) -> DataFrame:
    """Per booking: auctions whose own ``booked_duration`` lies within the tolerance."""
    return _report(with_similar_auctions_1d(bookings, auctions, tolerance))


def with_similar_auctions_1d(bookings: DataFrame, auctions: DataFrame,
                             tolerance: float = TOLERANCE) -> DataFrame:
    points = auctions.dropna(subset=["booked_duration"]).groupBy(
        order_code(F.col("booked_duration")).alias("code")
    ).agg(F.count("*").alias("n"), F.count(PRICE).alias("n_price"),
          F.coalesce(F.sum(dec(PRICE)), F.lit(0)).alias("sum_price"))
    ends = bookings.select("booked_duration").dropna().distinct().withColumns(
        _band("booked_duration", tolerance)
    ).where("booked_duration_from < booked_duration_to").select(
        "booked_duration", F.inline(F.array(
            F.struct(F.col("booked_duration_from").alias("code"), F.lit(-1).alias("sign")),
            F.struct(F.col("booked_duration_to").alias("code"), F.lit(1).alias("sign")))))
    sums = ends.join(sums_before(points, ends, "code", MEASURES), "code").groupBy(
        "booked_duration"
    ).agg(*[F.sum(F.col("sign") * F.col(f"before_{m}")).alias(m) for m in MEASURES])
    return _matched(bookings.join(sums, "booked_duration", "left"))
