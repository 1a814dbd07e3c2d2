"""The ordered sums and what is built on them, against brute force."""

import random

import numpy as np
import pytest

from fareloom.functions import ordered
from fareloom.operators import band, costs
from pyspark.sql import functions as F


def test_sums_before(spark):
    rng = random.Random(7)
    codes = [rng.choice([1, 70_000, 5_000_000_000, -3, -70_001, 2**40]) + rng.randrange(-3, 3)
             for _ in range(300)]
    points = [(rng.choice("ab"), c, rng.randrange(10)) for c in codes]
    probes = [(rng.choice("abc"), rng.choice(codes) + rng.randrange(-1, 2)) for _ in range(200)]
    got = ordered.sums_before(
        spark.createDataFrame(points, "k string, code long, m long"),
        spark.createDataFrame(probes, "k string, code long"), "code", ["m"], ["k"]).collect()
    assert {(r.k, r.code): r.before_m for r in got} == {
        (k, c): sum(m for pk, pc, m in points if pk == k and pc < c) for k, c in set(probes)}


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.5] * 7, [-1.25, 0.0, 4.0, 1e6, 2.5]])
def test_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    probabilities = [0.0, 0.2, 0.25, 0.5, 0.75, 1.0]
    row = ordered.quantile_row(df, F.col("v"), probabilities).collect()[0]
    assert row.q == pytest.approx(list(np.quantile(values, probabilities)), abs=1e-12)


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 4)], "v double, w long")
    row = ordered.quantile_row(df, F.col("v"), [0.1, 0.5, 0.6], F.col("w")).collect()[0]
    assert row.q == pytest.approx(list(np.quantile([1, 1, 1, 2, 9, 9, 9, 9], [0.1, 0.5, 0.6])))


def test_codes_give_their_doubles_back(spark):
    values = [0.0, 1.0, -1.0, 1.5, 3.141592653589793, -2.5e-7, 1e300, 5e-324, 2.2250738585072014e-308,
              1.7976931348623157e308, float("inf"), -1e-310, 0.1, 1 / 3, 123456.789]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn(
        "code", ordered.order_code(F.col("v")))
    rows = df.withColumn("back", ordered.from_code(F.col("code"))).collect()
    assert all(r.back == r.v for r in rows) and len({r.code for r in rows}) == len(values)
    assert [r.v for r in sorted(rows, key=lambda r: r.code)] == sorted(values)


def test_quantiles_of_close_values_and_several_metrics(spark):
    """Values that share all but their last bits, and one that has most of the weight."""
    rng = random.Random(13)
    close = [1.0 + k * 2.0 ** -52 for k in rng.sample(range(5000), 400)]
    rows = [(c, rng.uniform(-5, 5), rng.choice([0, 1, 2, 900 if k == 7 else 3]))
            for k, c in enumerate(close)]
    probabilities = [0.0, 0.013, 0.3, 0.5, 0.77, 1.0]
    out = ordered.quantiles(spark.createDataFrame(rows, "a double, b double, w long"), {
        "a": F.col("a"), "b": F.col("b")}, probabilities, F.col("w")).collect()
    for r in out:
        side = 0 if r.metric == "a" else 1
        values = [row[side] for row in rows for _ in range(row[2])]
        assert r.n == len(values)
        assert r.q == pytest.approx(list(np.quantile(values, probabilities)), abs=1e-15)
    assert len(out) == 2


def test_quantiles_of_nothing(spark):
    assert ordered.quantile_row(
        spark.createDataFrame([], "v double"), F.col("v"), [0.5]).collect()[0].q is None


def brute_band(bookings, auctions, own=None):
    shapes = {b: (d, x) for b, d, x in bookings}
    d, x = shapes[own] if own else (None, None)
    hits = []
    for a, price in auctions:
        if a in shapes and d is not None and x is not None and None not in shapes[a]:
            ad, ax = shapes[a]
            if d * 0.8 <= ad <= d * 1.2 and x * 0.8 <= ax <= x * 1.2:
                hits.append(price)
    return hits


def band_case(tables, bookings, auctions):
    return (
        tables.bookings(*[dict(booking_uuid=b, booked_duration=d, booked_distance=x)
                          for b, d, x in bookings]),
        tables.auctions(*[dict(booking_uuid=b, auction_winning_price=p) for b, p in auctions]))


def test_band_join_against_all_pairs(tables):
    rng = random.Random(3)
    # A third of the bookings share one shape; zero, negative and unknown sizes are among them.
    bookings = [
        (f"b{i}", 3600.0, 10.0) if i % 3 == 0 else
        (f"b{i}", rng.choice([0.0, -5.0, None, 600.5, rng.uniform(1, 9000)]),
         rng.choice([0.0, -1.0, None, 12.0, 9.999999, rng.uniform(0.1, 50)]))
        for i in range(150)
    ]
    bookings = [(b, None if d is None else round(d, 6), None if x is None else round(x, 6))
                for b, d, x in bookings]
    auctions = [(f"b{rng.randrange(170)}", rng.choice([None, round(rng.uniform(5, 90), 2)]))
                for _ in range(200)]
    result = band.similar_auctions(*band_case(tables, bookings, auctions)).collect()
    assert len(result) == len(bookings)
    for r in result:
        hits = brute_band(bookings, auctions, r.booking_uuid)
        prices = [p for p in hits if p is not None]
        assert r.matched_auctions == len(hits)
        if hits:
            assert r.auction_success_rate == pytest.approx(len(prices) / len(hits))
        if prices:
            assert r.avg_auction_price == pytest.approx(sum(prices) / len(prices))
        else:
            assert r.avg_auction_price is None


def test_band_join_without_auctions(tables):
    bookings, auctions = band_case(tables, [("b1", 60.0, 1.0)], [])
    row = band.similar_auctions(bookings, auctions).collect()[0]
    assert (row.matched_auctions, row.avg_auction_price) == (0, None)


def skewed_trips(tables):
    """One chauffeur has most bookings and shifts; another is unknown on both sides."""
    rng = random.Random(11)
    who = lambda i: "hot" if i % 2 else rng.choice(["c1", "c2", None])
    bookings = [(f"b{i}", who(i), float(rng.choice([0, 900, 1800, 3601, -600]))) for i in range(80)]
    auctions = [(f"b{rng.randrange(90)}", round(rng.uniform(0, 60), 2)) for _ in range(70)]
    shifts = [(f"s{i}", who(i), rng.choice([None, 20.0, 31.55, 40.0, 12.25])) for i in range(60)]
    pairs = []
    for b, c, seconds in bookings:
        prices = [p for a, p in auctions if a == b] or [None]
        rates = [r for _, sc, r in shifts if sc == c] or [None]
        pairs += [(seconds, p, r) for p in prices for r in rates]
    frames = (
        tables.bookings(*[dict(booking_uuid=b, chauffeur_uuid=c, booked_duration=d)
                          for b, c, d in bookings]),
        tables.auctions(*[dict(booking_uuid=b, auction_winning_price=p) for b, p in auctions]),
        tables.shifts(*[dict(shift_id=s, chauffeur_uuid=c, hourly_rate_eur=r,
                             shift_working_hours=8.0) for s, c, r in shifts]))
    return frames, pairs


def test_combination_counts_against_all_pairs(tables):
    frames, pairs = skewed_trips(tables)
    assert costs.booking_costs(*frames).agg(F.sum("copies")).collect()[0][0] == len(pairs)
    diffs = [round(p * 3600 - r * d, 4) / 3600 for d, p, r in pairs
             if p is not None and r is not None]
    row = costs.cost_comparison_summary(*frames).collect()[0]
    assert row.auction_cheaper_pct == pytest.approx(
        100 * sum(x < 0 for x in diffs) / len(diffs))
    assert row.shift_cheaper_pct == pytest.approx(100 * sum(x > 0 for x in diffs) / len(diffs))
    assert row.avg_cost_diff == pytest.approx(sum(diffs) / len(diffs))


def test_combination_histogram_against_all_pairs(tables):
    frames, pairs = skewed_trips(tables)
    diffs = [p - r * d / 3600 for d, p, r in pairs if p is not None and r is not None]
    rows = costs.cost_diff_histogram(*frames, bins=7).orderBy("bin").collect()
    counts, edges = np.histogram(diffs, bins=7)
    assert [r.n for r in rows] == list(counts)
    assert rows[0].bin_low == pytest.approx(edges[0])
    assert rows[-1].bin_high == pytest.approx(edges[-1])
