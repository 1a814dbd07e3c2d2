"""Band ends compared as doubles, repeated and missing ids, a missing chauffeur with most rows."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from fareloom.functions.ordered import order_code
from fareloom.operators import band, context, costs, decision, geo, utilization
from fareloom.plans import catalog
from conftest import TESTDATA


def test_codes_order_doubles(spark):
    rng = random.Random(1)
    values = {0.0, 1.0, -1.0, 2.0 ** -1074, 2.0 ** -1022, 5e-324 * 7, 1.7976931348623157e308,
              float("inf"), -float("inf"), 0.1, 0.2, 0.30000000000000004, 0.3}
    for _ in range(3000):
        x = struct.unpack("d", rng.randbytes(8))[0]
        y = rng.choice([x, rng.uniform(-1e6, 1e6), 2.0 ** rng.randrange(-1000, 1000)])
        values |= {v for v in (y, math.nextafter(y, 1e308), math.nextafter(y, 0)) if v == v}
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", order_code(F.col("v")).alias("code")).collect()
    rows.sort(key=lambda r: r.v)
    codes = [r.code for r in rows]
    assert all(a < b for a, b in zip(codes, codes[1:]))


def brute(bookings, auctions, without_own=False):
    out = []
    for b in bookings:
        ids = {c[0] for c in bookings if all(
            None not in (b[k], c[k]) and b[k] * 0.8 <= c[k] <= b[k] * 1.2 for k in (1, 2))}
        hits = [p for i, p in auctions if i in ids and not (without_own and i == b[0])]
        known = [p for p in hits if p is not None]
        out.append((b[0], len(hits), round(sum(known) / len(known), 4) if known else None))
    return sorted(out, key=str)


def frames(tables, bookings, auctions):
    return (tables.bookings(*[dict(booking_uuid=i, booked_duration=d, booked_distance=x)
                              for i, d, x in bookings]),
            tables.auctions(*[dict(booking_uuid=i, auction_winning_price=p) for i, p in auctions]))


def found(df):
    return sorted(((r.booking_uuid, r.matched_auctions, r.avg_auction_price and
                    round(r.avg_auction_price, 4)) for r in df.collect()), key=str)


def test_upper_end_of_the_band(tables):
    b, a = frames(tables, [("q", 600.0, 8.3333334), ("r", 600.0, 10.0000004)], [("r", 5.0)])
    assert found(band.similar_auctions(b, a)) == [("q", 0, None), ("r", 1, 5.0)]
    # 12.0 / 1.2 is 10.0; the bound itself is inside, its successor isn't.
    b, a = frames(tables, [("q", 600.0, 10.0), ("r", 600.0, 12.0),
                           ("s", 600.0, math.nextafter(12.0, 13))], [("r", 5.0), ("s", 7.0)])
    assert dict((i, n) for i, n, _ in found(band.similar_auctions(b, a)))["q"] == 1


def test_repeated_id_keeps_every_shape(tables):
    b, a = frames(tables, [("a", 600.0, 5.0), ("a", 6000.0, 50.0), ("z", 6000.0, 50.0)],
                  [("a", 9.0)])
    assert found(band.similar_auctions(b, a)) == [("a", 1, 9.0), ("a", 1, 9.0), ("z", 1, 9.0)]


@pytest.mark.parametrize("without_own", [False, True])
def test_random_doubles_and_repeated_ids(tables, without_own):
    rng = random.Random(8)
    bookings = [(rng.choice([None, *(f"b{i}" for i in range(40))]) if i % 3 else f"u{i}",
                 rng.choice([rng.uniform(0, 50), 10.0, 12.0, 8.0, 0.0, -3.0, None]),
                 rng.choice([rng.uniform(0, 9), 1.0, 1.2, 1.25, 0.8, 1 / 3]))
                for i in range(150)]
    auctions = [(rng.choice([b[0] for b in bookings]), rng.choice([rng.uniform(1, 99), None]))
                for _ in range(120)]
    b, a = frames(tables, bookings, auctions)
    got = found(band.similar_auctions(b, a, exclude_self=without_own))
    if not without_own:
        assert got == brute(bookings, auctions)
    else:
        # A booking whose own band is empty has nothing of its own to leave out.
        assert [(i, n) for i, n, _ in got] == [(i, n) for i, n, _ in brute(
            bookings, auctions, True)]


def test_missing_ids_count_everywhere(spark, tables):
    t = "2024-01-05 10:00:00"
    import datetime as dt

    when = dt.datetime.fromisoformat(t)
    place = dict(pickup_longitude=1.0, pickup_latitude=2.0, dropoff_longitude=3.0,
                 dropoff_latitude=4.0)
    b = tables.bookings(*[dict(booking_uuid=i, booked_start_at=when, booked_duration=60.0,
                               booked_distance=1.0, **place) for i in (None, "k")])
    a = tables.auctions(*[dict(booking_uuid=i, auction_winning_price=7.0) for i in (None, "k")])
    weather = spark.createDataFrame([(when.date(), "Fog", 3)],
                                    "date date, weather_condition string, temperature int")
    assert [r.n for r in context.price_by_weather(b, a, weather).collect()] == [2]
    assert [r.n for r in context.temperature_price_points(b, a, weather).collect()] == [2]
    assert [r.n for r in geo.pickup_grid(b, a).collect()] == [2]
    assert geo.price_map_points(b, a).groupBy("endpoint").count().select("count").distinct(
        ).collect() == [(2,)]
    assert context.merged_context(b, a, weather, None).count() == 2


def test_missing_chauffeur_is_not_shuffled(spark, tables):
    """Most bookings lack a chauffeur: the reports are right, and those rows join a broadcast."""
    import datetime as dt

    when = dt.datetime(2024, 1, 5, 10)
    bookings = [dict(booking_uuid=f"b{i}", chauffeur_uuid=None if i % 3 else "c",
                     booked_start_at=when, booked_duration=600.0 * (i % 7 + 1)) for i in range(90)]
    shifts = [dict(shift_id=f"s{i}", chauffeur_uuid=None if i % 2 else "c",
                   hourly_rate_eur=20.0 + i, shift_working_hours=8.0) for i in range(6)]
    b, s = tables.bookings(*bookings), tables.shifts(*shifts)
    a = tables.auctions(*[dict(booking_uuid=f"b{i}", auction_winning_price=5.0 + i % 11)
                          for i in range(90)])
    rates = {None: [21.0, 23.0, 25.0], "c": [20.0, 22.0, 24.0]}
    diffs = [5.0 + i % 11 - r * x["booked_duration"] / 3600
             for i, x in enumerate(bookings) for r in rates[x["chauffeur_uuid"]]]
    row = costs.cost_comparison_summary(b, a, s).first()
    assert row.avg_cost_diff == pytest.approx(sum(diffs) / len(diffs))
    assert row.auction_cheaper_pct == pytest.approx(
        100 * sum(d < 0 for d in diffs) / len(diffs))
    hour = costs.cost_diff_by_hour(b, a, s).collect()
    assert [(h.hour, pytest.approx(sum(diffs) / len(diffs))) for h in hour] == [
        (h.hour, h.avg_cost_diff) for h in hour]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = costs._with_chauffeur(costs._trip_cells(b, a), costs._rate_tables(s)[1])
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Present chauffeurs are joined by a shuffle; the missing one by a broadcast of one row.
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 1
    assert plan.count("Exchange hashpartitioning") == 2
    summary = costs.cost_diff_summary(b, a, s).first()
    assert summary["count"] == len(diffs) and summary["min"] == pytest.approx(min(diffs))


def test_top_and_bottom_performers(tables):
    """Utilization within (0, 100]: best first, worst last."""
    import datetime as dt

    day = dt.date(2024, 1, 5)
    shifts = [dict(shift_id=c, chauffeur_uuid=c, shift_date=day, shift_working_hours=10.0,
                   hourly_rate_eur=20.0) for c in ("low", "mid", "top", "idle", "over")]
    hours = {"low": 1.0, "mid": 5.0, "top": 9.0, "over": 30.0}
    # The report takes durations for minutes by default, as its ``duration_unit`` says.
    bookings = [dict(booking_uuid=c, chauffeur_uuid=c, booked_duration=h * 60,
                     booked_start_at=dt.datetime(2024, 1, 5, 9)) for c, h in hours.items()]
    s, b = tables.shifts(*shifts), tables.bookings(*bookings)
    top = [r.chauffeur_uuid for r in utilization.performers(s, b, best=True).collect()]
    bottom = [r.chauffeur_uuid for r in utilization.performers(s, b, best=False).collect()]
    assert top[0] == "top" and bottom[0] == "low"
    assert not {"idle", "over"} & {*top, *bottom}


@pytest.fixture(scope="module")
def queries():
    return catalog.all_queries()


def test_what_holds_for_clusters(spark, queries):
    rows = queries["pickup_clusters"](spark, TESTDATA).collect()
    points = queries["price_map_points"](spark, TESTDATA).where("endpoint = 'pickup'").count()
    assert 1 <= len(rows) <= 3 and sum(r.points for r in rows) == points
    assert all(r.price_count <= r.points for r in rows)


def test_what_holds_for_decisions(spark, queries):
    made = {r.booking_uuid: r for r in queries["dispatch_decision"](spark, TESTDATA).collect()}
    expected = {r.booking_uuid: r for r in queries["decision_costs"](spark, TESTDATA).collect()}
    assert made.keys() == expected.keys()
    for i, r in made.items():
        assert 0 <= r.p_shift <= 1 and r.confidence == max(r.p_shift, 1 - r.p_shift)
        assert r.expected_profit == expected[i].expected_profit
        assert not r.assign_to_shift or expected[i].available_shifts > 0
    model = queries["dispatch_model"](spark, TESTDATA).collect()
    labels = {r.booking_uuid: int(r.profitable)
              for r in queries["training_labels"](spark, TESTDATA).collect()}
    assert {r.booking_uuid: r.label for r in model} == labels
    assert all(0 <= r.p_shift <= 1 for r in model)


def test_written_tables_can_be_removed(spark, tmp_path, monkeypatch):
    import os

    from fareloom import session

    monkeypatch.setattr(session, "checkpoint_root", lambda _: str(tmp_path))
    assert session.written(spark.range(3), "numbers").count() == 3
    folder = os.path.dirname(session.shared_folder(spark, "other"))
    assert os.listdir(folder)
    session.remove_written(spark)
    assert not os.path.exists(folder)
    monkeypatch.setattr(session, "checkpoint_root", lambda _: None)
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(spark, "none")
