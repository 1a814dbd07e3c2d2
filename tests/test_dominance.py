"""Sums below a corner, the index of them, and boxes of repeated ids, against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fareloom.functions import dominance
from fareloom.operators import band
from fareloom.session import shared_folder

POINTS = "u long, v long, n long, m decimal(38,6)"


def random_points(rng, n):
    near = [-(1 << 62), -3, 0, 5, 1 << 40, (1 << 62) + 7]
    return [(rng.choice(near) + rng.randrange(-4, 5), rng.choice(near) + rng.randrange(-4, 5),
             rng.randrange(-3, 9), rng.randrange(100)) for _ in range(n)]


def below(points, probes):
    out = {}
    for u, v in set(probes):
        own = [p for p in points if p[0] < u and p[1] < v]
        out[u, v] = (sum(p[2] for p in own), sum(p[3] for p in own))
    return {k: s for k, s in out.items() if s != (0, 0)}


def made(rows):
    return {(r.u, r.v): (r.n, int(r.m)) for r in rows.collect() if (r.n, r.m) != (0, 0)}


def frame(spark, points):
    return spark.createDataFrame(points, "u long, v long, n long, m long").withColumn(
        "m", F.col("m").cast("decimal(38,6)"))


def test_sums_below(spark):
    rng = random.Random(5)
    points = random_points(rng, 200)
    probes = [p[:2] for p in random_points(rng, 80)] + [points[0][:2]]
    asked = spark.createDataFrame(probes, "u long, v long")
    assert made(dominance.dominance_sums(frame(spark, points), asked, ["n", "m"])) == below(
        points, probes)
    assert made(dominance.dominance_sums(
        frame(spark, points).where("false"), asked, ["n", "m"])) == {}


def test_index_in_levels(spark):
    rng = random.Random(6)
    index = dominance.DominanceIndex(spark, shared_folder(spark, "index"), ["n", "m"])
    probes = [p[:2] for p in random_points(rng, 30)]
    asked = spark.createDataFrame(probes, "u long, v long")
    assert index.sums(asked, shared_folder(spark, "asked")) is None
    points, sizes = [], []
    for n in (60, 20, 15):
        more = random_points(rng, n)
        points += more
        index.append(frame(spark, more))
        sizes.append(len(index.levels))
        if n < 60:
            assert made(index.sums(asked, shared_folder(spark, "asked"))) == below(points, probes)
    # The second stays beside the larger first; the third joins it, and both then the first.
    assert sizes == [1, 2, 1]
    index.append(frame(spark, points).where("false"))
    assert len(index.levels) == 1


def rows_read(monkeypatch):
    """Rows of the index that lookups read, added up."""
    read = []
    of_parts = dominance.DigitTable.of_parts

    def counted(self, parts):
        rows = of_parts(self, parts)
        read.append(rows.count())
        return rows

    monkeypatch.setattr(dominance.DigitTable, "of_parts", counted)
    return read


def test_a_few_probes_read_what_they_look_up(spark, monkeypatch):
    monkeypatch.setattr(dominance, "PART_ROWS", 64)
    rng = random.Random(7)
    probes = spark.createDataFrame([(rng.randrange(1 << 40), rng.randrange(1 << 40))
                                    for _ in range(2)], "u long, v long")
    read = rows_read(monkeypatch)
    totals = []
    for n in (100, 1000):
        points = frame(spark, [(rng.randrange(1 << 40), rng.randrange(1 << 40), 1, 1)
                               for _ in range(n)])
        index = dominance.DominanceIndex(spark, shared_folder(spark, "index"), ["n", "m"])
        index.append(points)
        read.clear()
        index.sums(probes, shared_folder(spark, "asked")).collect()
        level = index.levels[0]
        whole = level.tree.table.count() + sum(t.table.count() for t in level.ranks.values())
        totals.append((sum(read), whole))
    (few, all_few), (many, all_many) = totals
    # Ten times the points: three more levels of nodes are looked up, the table grows by far more.
    assert all_many > 8 * all_few and many < 3 * few and many < all_many / 2


def repeated_points(spark, shapes):
    """shapes: (id, duration, distance, n, n_price, sum_price)"""
    return spark.createDataFrame(shapes, "k string, booked_duration double, "
                                 "booked_distance double, n long, n_price long, p double").select(
        "booked_duration", "booked_distance", F.struct(
            F.col("k").alias("booking_uuid_key"), F.lit(False).alias("booking_uuid_absent"))
        .alias("repeated"), "n", "n_price", F.col("p").cast("decimal(38,6)").alias("sum_price"))


@pytest.mark.parametrize("tolerance", [0.2, 0.01])
def test_repeated_ids_count_once(spark, tolerance):
    rng = random.Random(8)
    shapes, weights = [], {}
    sizes = [0.0, 1.0, 1.2, 0.8, 600.0, 720.0, 480.0, 1e-3, 5e300, -4.0, 0.1]
    pick = lambda: rng.choice(sizes) if rng.random() < 0.4 else round(rng.uniform(1, 60), 1)
    for k in range(25):
        weights[f"k{k}"] = (rng.randrange(1, 5), rng.randrange(3), rng.randrange(90))
        for d, x in {(pick(), pick()) for _ in range(2 if k else 120)}:
            shapes.append((f"k{k}", d, x, *weights[f"k{k}"][:2], float(weights[f"k{k}"][2])))
    queries = {(pick(), pick()) for _ in range(150)}
    out = band._repeated_sums(
        repeated_points(spark, shapes),
        spark.createDataFrame(list(queries), "booked_duration double, booked_distance double"),
        tolerance).collect()
    found = {(r.booked_duration, r.booked_distance): (r.n, r.n_price, float(r.sum_price))
             for r in out if r.n}
    low, high = 1 - tolerance, 1 + tolerance
    expected = {}
    for d, x in queries:
        ids = {s[0] for s in shapes if d * low <= s[1] <= d * high and x * low <= s[2] <= x * high}
        if ids:
            expected[d, x] = tuple(float(sum(weights[i][c] for i in ids)) for c in range(3))
    assert {k: tuple(map(float, v)) for k, v in found.items()} == expected


def test_band_ends_are_those_of_doubles(spark):
    rng = random.Random(9)
    values = [rng.uniform(0.1, 9000) for _ in range(300)] + [1.0, 2.0, 4.0, 0.1, 3.0, 1e-300]
    boxes = band._boxes(repeated_points(spark, [("k", d, d, 1, 1, 1.0) for d in values]), 0.2)
    for r in boxes.select("duration_low", "duration_high").distinct().collect():
        for value in (v for v in values if r.duration_low * 0.79 < v < r.duration_high * 1.21):
            if r.duration_low * 1.2 >= value >= math.nextafter(r.duration_low, 0) * 1.2 and abs(
                    r.duration_low * 1.2 - value) <= 4 * math.ulp(value):
                assert math.nextafter(r.duration_low, 0) * 1.2 < value
                assert r.duration_high * 0.8 <= value
                assert math.nextafter(r.duration_high, math.inf) * 0.8 > value
                break
        else:
            raise AssertionError("no value has this box")


def test_corners_grow_with_shapes(spark):
    """A missing id with very many shapes, which all lie near each other."""
    counts = []
    for n in (250, 1000):
        rng = random.Random(n)
        shapes = [("k", rng.uniform(3000, 3600), rng.uniform(9, 11), 1, 1, 1.0) for _ in range(n)]
        counts.append(band.box_corners(repeated_points(spark, shapes)).count())
    assert counts[1] <= 5 * counts[0] and counts[1] < 20 * 1000


def test_index_of_bands_equals_the_batch(spark, tables):
    rng = random.Random(10)
    price = lambda: rng.choice([None, round(rng.uniform(5, 90), 2)])
    shape = lambda: (rng.choice([600.0, 720.0, round(rng.uniform(100, 4000), 1)]),
                     round(rng.uniform(0.5, 30), 2))
    past = [dict(zip(("booking_uuid", "booked_duration", "booked_distance"),
                     (rng.choice([f"b{i}", f"b{i // 2}", None]), *shape()))) for i in range(80)]
    auctions = tables.auctions(*[dict(booking_uuid=rng.choice([f"b{i}", None]),
                                      auction_winning_price=price()) for i in range(80)])
    history = tables.bookings(*past)
    points = band.auction_points(history, auctions)
    asked = tables.bookings(*[dict(booking_uuid=f"n{i}", booked_duration=d, booked_distance=x)
                              for i, (d, x) in enumerate(shape() for _ in range(12))])
    columns = ["booking_uuid", "matched_auctions", "similar_price", "similar_success"]
    expected = sorted(map(tuple, band.with_similar_auctions(asked, points).select(columns).collect()))
    index = band.BandIndex(spark, shared_folder(spark, "band-index"))
    # New ids in two lots: by the first letter of the id's hash, missing ids in one of them.
    lot = F.pmod(F.xxhash64(F.coalesce("booking_uuid", F.lit(""))), F.lit(2))
    for k in (0, 1):
        index.append(band.auction_points(history.where(lot == k), auctions))
    found = band.with_indexed_auctions(asked, index, shared_folder(spark, "looked-up"))
    assert sorted(map(tuple, found.select(columns).collect())) == expected
    assert sum(r[1] for r in expected) > 0
