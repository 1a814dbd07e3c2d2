"""Hand-checked values on four trips read from CSV files."""

import pytest

from fareloom.operators import auctions, context, costs, geo, seasonality, supply
from fareloom.functions.stats import correlation
from fareloom.sources.marketplace import Marketplace
from fareloom.sources.sinks import read_result, write_results

FILES = {
    "bookings": """booking_uuid,chauffeur_uuid,booking_start_time,booking_end_time,booked_duration,pickup_latitude,pickup_longitude,dropoff_latitude,dropoff_longitude
trip-a,dana,2023-06-14 18:15:00,2023-06-14 20:15:00,2.0,48.137,11.575,48.354,11.786
trip-b,eli,2023-06-14 21:40:00,2023-06-14 22:10:00,0.5,48.204,11.618,48.151,11.549
trip-c,dana,2023-06-15 06:05:00,2023-06-15 09:05:00,3.0,48.099,-11.504,48.262,11.431
trip-d,finn,2023-06-15 21:20:00,2023-06-15 22:20:00,1.0,-48.176,11.597,48.133,11.566
""",
    "auctions": """booking_uuid,auction_winning_price,auction_start_time,auction_end_time
trip-a,58,2023-06-14 12:00:00,2023-06-14 12:20:00
trip-b,22,2023-06-14 15:30:00,2023-06-14 15:50:00
trip-c,66,2023-06-14 17:00:00,2023-06-14 17:45:00
trip-d,14,2023-06-15 10:10:00,2023-06-15 10:30:00
""",
    "shifts": """shift_id,chauffeur_uuid,shift_working_hours,hourly_rate_eur,shift_start_time,shift_end_time
71,dana,5,20,2023-06-14 16:00:00,2023-06-14 21:00:00
72,eli,4,36,2023-06-14 20:00:00,2023-06-15 00:00:00
73,finn,10,17.5,2023-06-15 13:00:00,2023-06-15 23:00:00
""",
    "weather": "date,weather_condition,temperature\n2023-06-14,Fog,11\n2023-06-15,Fog,11\n",
}


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    for name, text in FILES.items():
        (folder / f"{name}.csv").write_text(text)
    return Marketplace.from_csv(
        spark, *[f"{folder}/{n}.csv" for n in ("shifts", "bookings", "auctions", "weather",
                                               "no_such_calendar")], duration_unit="h")


def one(df):
    return df.collect()[0].asDict()


def test_optional_files(market):
    assert market.calendar is None
    assert market.weather.count() == 2
    assert market.bookings.where("booked_duration = 1800").count() == 1


def test_costs_per_booking(market):
    rows = {r.booking_uuid: r for r in costs.booking_costs(
        market.bookings, market.auctions, market.shifts).collect()}
    trips = ("trip-a", "trip-b", "trip-c", "trip-d")
    assert [rows[b].pre_purchased_cost for b in trips] == [40.0, 18.0, 60.0, 17.5]
    assert [rows[b].cost_diff for b in trips] == [18.0, 4.0, 6.0, -3.5]


def test_cost_summary(market):
    row = one(costs.cost_comparison_summary(market.bookings, market.auctions, market.shifts))
    assert row["total_shift_cost"] == 5 * 20 + 4 * 36 + 10 * 17.5
    assert row["avg_auction_price"] == 40.0
    assert row["avg_cost_diff"] == pytest.approx(24.5 / 4)
    assert row["auction_cheaper_pct"] == 25.0
    assert row["shift_cheaper_pct"] == 75.0


def test_difference_by_hour(market):
    rows = costs.cost_diff_by_hour(market.bookings, market.auctions, market.shifts).collect()
    assert {r.hour: r.avg_cost_diff for r in rows} == {6: 6.0, 18: 18.0, 21: 0.25}


def test_quantile_bins_show_the_empty_one(market):
    # Durations of 0.5, 1, 2 and 3 hours: the cuts at 0.6 of an hour and so on leave one bin empty.
    rows = costs.cost_diff_by_duration_quantile(
        market.bookings, market.auctions, market.shifts, bins=6).orderBy("bin").collect()
    assert [r.avg_cost_diff for r in rows] == [4.0, -3.5, None, 18.0, None, 6.0]
    rows = costs.cost_diff_by_duration_quantile(
        market.bookings, market.auctions, market.shifts, bins=3).orderBy("bin").collect()
    assert [r.avg_cost_diff for r in rows] == [0.25, 18.0, 6.0]


def test_constant_duration_gives_the_summary(market):
    equal = market.bookings.where("booking_uuid = 'trip-c'")
    args = (equal, market.auctions, market.shifts)
    assert costs.cost_diff_by_duration_quantile(*args).collect() == []
    row = one(costs.cost_diff_by_duration(*args))
    assert (row["count"], row["mean"], row["q50"]) == (1, 6.0, 6.0)
    assert "bin" in costs.cost_diff_by_duration(
        market.bookings, market.auctions, market.shifts).columns


def test_grid_cells_truncate_toward_zero(market):
    rows = geo.with_grid(market.bookings).orderBy("booking_uuid").collect()
    assert [r.pickup_grid_x for r in rows] == [1157, 1161, -1150, 1159]
    assert [r.pickup_grid_y for r in rows] == [4813, 4820, 4809, -4817]


def test_prices_in_context(market):
    by_day = {r.day_of_week: r.avg_price for r in context.price_by_weekday(
        market.bookings, market.auctions).collect()}
    assert by_day == {"Wednesday": 40.0, "Thursday": 40.0}
    fog = one(context.price_by_weather(market.bookings, market.auctions, market.weather))
    assert (fog["weather_condition"], fog["avg_price"], fog["n"]) == ("Fog", 40.0, 4)
    day = one(context.price_event_vs_regular(
        market.bookings, market.auctions, market.weather, market.calendar))
    assert day == {"has_event": "Regular Day", "avg_price": 40.0, "n": 4}


def test_constant_column_has_no_correlation(market):
    rows = context.correlation_matrix(
        market.bookings, market.auctions, market.weather, None,
        ["booked_duration", "auction_winning_price", "temperature"]).collect()
    r = {(x.a, x.b): x.r for x in rows}
    assert len(r) == 9
    assert r["temperature", "temperature"] is None
    assert r["booked_duration", "temperature"] is None
    assert r["booked_duration", "booked_duration"] == 1.0
    assert 0.9 < r["booked_duration", "auction_winning_price"] < 1.0


def test_correlation_is_pairwise_complete(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 1.0), (2.0, 4.0, None), (3.0, 6.0, 3.0), (4.0, None, 2.0)], "x double, y double, z double")
    r = {(c.a, c.b): c.r for c in correlation(df, ["x", "y", "z"]).collect()}
    assert r["x", "y"] == r["y", "x"] == 1.0
    assert r["y", "z"] == 1.0
    assert r["x", "z"] == pytest.approx(0.6546536707, abs=1e-6)


def test_price_statistics(market):
    row = one(costs.cost_summary(market.shifts, market.auctions))
    assert (row["avg_auction_price"], row["std_auction_price"]) == (40.0, 25.819889)
    assert (row["min_auction_price"], row["max_auction_price"]) == (14.0, 66.0)


def test_results_are_written_and_read_back(spark, market, tmp_path):
    daily = supply.supply_daily_stats(market.shifts)
    write_results({"supply_analysis": daily}, str(tmp_path))
    back = read_result(spark, f"{tmp_path}/supply_analysis", daily.schema).collect()
    assert back == daily.collect()


def test_persist_keeps_the_tables(market):
    kept = market.persist()
    assert seasonality.bookings_by_hour(kept.bookings).count() == 3  # 6, 18 and 21 o'clock
    assert auctions.auction_metrics(kept.auctions).count() == 4
    for table in (kept.bookings, kept.shifts, kept.auctions, kept.weather):
        table.unpersist()
