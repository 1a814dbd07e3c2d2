"""Labels, model, decisions and their streaming form."""

from datetime import date, datetime

import pytest

from conftest import TESTDATA
from fareloom.operators import band, decision, geo
from fareloom.session import written
from fareloom.sources.tables import EVENTS, DerivedMarketplace, bookings_of
from fareloom.streaming import jobs

AT = datetime(2024, 1, 2, 10)


@pytest.fixture(scope="module")
def market(spark):
    return DerivedMarketplace(spark, TESTDATA)


@pytest.fixture(scope="module")
def model(market):
    return decision.fit_model(
        decision.training_set(market.bookings, market.shifts, market.auctions), trees=5, depth=4)


def small(tables):
    bookings = tables.bookings(
        dict(booking_uuid="b1", booked_start_at=AT, booked_duration=3600.0, booked_distance=10.0,
             gross_revenue_eur=100.0),
        dict(booking_uuid="b2", booked_start_at=datetime(2024, 1, 3), booked_duration=60.0,
             booked_distance=1.0, gross_revenue_eur=50.0))
    shifts = tables.shifts(
        dict(shift_id="s1", shift_date=date(2024, 1, 2), hourly_rate_eur=30.0),
        dict(shift_id="s2", shift_date=date(2024, 1, 2), hourly_rate_eur=None))
    auctions = tables.auctions(
        dict(booking_uuid="b1", auction_winning_price=None, auction_start_time=datetime(2024, 1, 2, 9)),
        dict(booking_uuid="b1", auction_winning_price=45.0, auction_start_time=datetime(2024, 1, 2, 8)))
    return bookings, shifts, auctions


def test_first_auction_decides_the_label(tables):
    rows = decision.training_labels(*small(tables), duration_unit="h").collect()
    assert [(r.booking_uuid, r.shift_cost, r.auction_price, r.profitable) for r in rows] == [
        ("b1", 30.0, 45.0, True)]


def test_costs_fall_back_to_a_share_of_the_revenue(tables):
    rows = {r.booking_uuid: r for r in decision.decision_costs(
        *small(tables), duration_unit="h").collect()}
    assert rows["b1"].expected_auction_price == 45.0
    assert rows["b1"].expected_profit == 70.0
    assert rows["b2"].expected_shift_cost is None
    assert rows["b2"].expected_auction_price == pytest.approx(35.0)
    assert rows["b2"].expected_profit == pytest.approx(15.0)


def test_model_gives_probabilities(market, model):
    rows = decision.dispatch_decision(
        market.bookings, market.shifts, market.auctions, model).collect()
    assert len(rows) == market.bookings.count()
    assert all(0.0 <= r.p_shift <= 1.0 and 0.5 <= r.confidence <= 1.0 for r in rows)


def test_one_class_training_set(tables):
    bookings, shifts, auctions = small(tables)
    training = decision.training_set(bookings, shifts, auctions)
    fitted = decision.fit_model(training, trees=2)
    assert [r.p_shift for r in decision.model_predictions(training, fitted).collect()] == [0.0]


def test_clusters_hold_every_point(market):
    rows = geo.pickup_clusters(market.bookings, market.auctions, k=4).collect()
    assert len(rows) == 4
    assert sum(r.points for r in rows) == geo.auctioned(market.bookings, market.auctions).count()


def test_missing_coordinates_are_named(market):
    with pytest.raises(ValueError, match="pickup_longitude"):
        geo.pickup_grid(market.bookings.drop("pickup_longitude"), market.auctions)


def test_streamed_decisions_equal_batch(spark, market, model, tmp_path):
    market.events.repartition(3).write.parquet(f"{tmp_path}/arriving")
    points = written(band.auction_points(market.bookings, market.auctions), "points")
    arriving = bookings_of(jobs.read_stream(spark, f"{tmp_path}/arriving", EVENTS, 1))
    jobs.stream_decisions(arriving, points, market.shifts, model, f"{tmp_path}/out",
                          f"{tmp_path}/state").awaitTermination()
    streamed = spark.read.parquet(f"{tmp_path}/out")
    assert streamed.select("batch").distinct().count() == 3
    batch = decision.dispatch_decision(market.bookings, market.shifts, market.auctions, model)
    assert sorted(streamed.drop("batch").collect()) == sorted(batch.collect())
