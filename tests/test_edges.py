"""Empty tables, NULL keys, ties, absent rows and bad text."""

from datetime import date, datetime

import pytest

from fareloom.functions import scalars
from fareloom.functions.stats import box_summary, histogram
from fareloom.operators import (
    auctions as A, balance, cleaning, costs, demand, profile, seasonality, supply, utilization)
from fareloom.sources.schema import SHIFTS, conform
from pyspark.sql import functions as F

NINE = datetime(2024, 1, 1, 9, 30)


def one(df):
    return df.collect()[0].asDict()


def test_empty_tables(tables):
    b, a, s = tables.bookings(), tables.auctions(), tables.shifts()
    assert demand.hourly_demand(b).count() == 24
    assert demand.demand_date_spine(b).count() == 0
    assert demand.lost_revenue(b).count() == 0
    assert supply.supply_daily(s).count() == 0
    assert one(balance.kpis(s, b, a))["hours_per_booking"] is None
    assert one(balance.cost_revenue(s, b, a))["profit"] == 0.0
    assert costs.cost_diff_by_duration_quantile(b, a, s).count() == 0
    assert costs.cost_diff_histogram(b, a, s).count() == 0
    assert one(costs.cost_comparison_summary(b, a, s))["auction_cheaper_pct"] is None
    assert profile.impute_shifts(s).count() == 0
    assert one(seasonality.seasonality_summary(b))["total_bookings"] == 0


def test_one_row_has_no_deviation(tables):
    row = one(supply.supply_daily_stats(tables.shifts(
        dict(shift_id="s", shift_date=date(2024, 1, 1), hourly_rate_eur=40.0))))
    assert row["std_rate"] is None and row["avg_rate"] == 40.0


def test_null_keys_meet_in_joins_but_not_in_groups(tables):
    b = tables.bookings(
        dict(booking_uuid=None, chauffeur_uuid=None, booked_start_at=NINE, booked_duration=60.0))
    a = tables.auctions(dict(booking_uuid=None, auction_winning_price=50.0))
    s = tables.shifts(dict(shift_id="s1", chauffeur_uuid=None, hourly_rate_eur=30.0,
                           shift_working_hours=8.0),
                      dict(shift_id="s2", chauffeur_uuid=None, hourly_rate_eur=40.0,
                           shift_working_hours=8.0))
    row = one(A.peak_hours_top(a, b, s))
    assert (row["num_bookings"], row["avg_shift_cost"]) == (2, 35.0)
    assert utilization.shift_utilization_by_chauffeur(s, b).count() == 0


def test_duplicates_multiply_like_a_join(tables):
    b = tables.bookings(*[dict(booking_uuid="b", chauffeur_uuid="c", booked_start_at=NINE,
                               gross_revenue_eur=10.0)] * 2)
    a = tables.auctions(dict(booking_uuid="b", auction_winning_price=10.0),
                        dict(booking_uuid="b", auction_winning_price=20.0),
                        dict(booking_uuid="b", auction_winning_price=None))
    row = one(A.hourly_auctions(a, b))
    assert (row["price_mean"], row["price_min"], row["price_max"]) == (15.0, 10.0, 20.0)
    assert row["price_std"] == pytest.approx(5.77)
    assert one(A.auction_price_by_day_hour(a, b))["n"] == 4


def test_bookings_without_shifts_have_unbounded_rates(tables):
    b = tables.bookings(dict(booking_uuid="b", booked_start_at=NINE, booked_duration=7200.0,
                             gross_revenue_eur=0.0))
    aligned = one(balance.hours_distribution_aligned(tables.shifts(), b))
    assert aligned["utilization_rate"] is None
    daily = one(balance.daily_supply_demand(tables.shifts(), b))
    assert daily["utilization_rate"] == 1.0 and daily["revenue_per_hour"] == 0.0


def test_absent_weekday_is_null(tables):
    b = tables.bookings(dict(booking_uuid="b", booked_start_at=NINE))
    assert [r.bookings for r in seasonality.bookings_by_weekday(b).collect()] == [1] + [None] * 6
    heat = seasonality.weekday_hour_heatmap(b).collect()
    assert heat[0].h09 == 1 and heat[0].h10 == 0 and heat[1].h09 is None
    assert seasonality.weekday_hour_heatmap(b, absent_day_as_zero=True).collect()[1].h09 == 0
    row = one(seasonality.weekday_insights(b))
    assert row["busiest_day"] == row["quietest_day"] == "Monday"


def test_earlier_hour_wins_a_tie(tables):
    b = tables.bookings(*[dict(booking_uuid=str(h), booked_start_at=datetime(2024, 1, 1, h))
                          for h in (7, 3, 23)])
    assert one(seasonality.seasonality_summary(b))["peak_hour"] == "03:00"
    rows = seasonality.hour_insights(b, k=2).where("kind = 'peak'").orderBy("rank").collect()
    assert [r.hour for r in rows] == [3, 7]


def test_date_range_includes_both_ends(tables):
    b = tables.bookings(*[dict(booking_uuid=str(d), booked_start_at=datetime(2024, 1, d, 23, 59))
                          for d in (1, 2, 3, 4)])
    assert one(seasonality.seasonality_summary(b, "2024-01-02", "2024-01-03"))["total_bookings"] == 2
    plan = seasonality.in_dates(b, "2024-01-02")._jdf.queryExecution().optimizedPlan().toString()
    assert "booked_start_at" in plan


def test_labels(spark):
    row = spark.range(1).select(
        scalars.hour_span_label(F.lit(8)).alias("a"), scalars.hour_to_next_label(F.lit(23)).alias("b"),
        scalars.euro_text(F.lit(3.14159)).alias("c"), scalars.euro_text(F.lit(None).cast("double"))
        .alias("d"), scalars.grid_cell(F.lit(-0.017), 0.01).alias("e"),
        scalars.clip(F.lit(None).cast("double"), 0, 1).alias("f")).collect()[0]
    assert tuple(row) == ("08:00 - 08:59", "23:00 - 24:00", "€3.14", "N/A", -1, None)


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("1,000",), (" 4 ",), ("x",), ("",), ("inf",), (None,)], "t string")
    lenient = [r[0] for r in df.select(scalars.number_from_text(F.col("t"), False)).collect()]
    assert lenient == [1000.0, 4.0, None, None, None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(scalars.number_from_text(F.col("t"))).collect()


def test_hours_without_a_time_column(spark):
    df = spark.createDataFrame([(5, "40"), (30, "1,000.5")], "booking_uuid long, auction_winning_price string")
    rows = cleaning.clean_auctions(df).orderBy("booking_uuid").collect()
    assert [r.hour_of_day for r in rows] == [5, 6]
    assert rows[1].auction_winning_price == 1000.5


def test_incomplete_rows_are_dropped(spark):
    df = spark.createDataFrame(
        [("s1", "2024-01-01 08:00:00", "40", 8.0, 5.0), ("s2", "not a time", "41", 8.0, 5.0),
         ("s3", "2024-01-01 09:00:00", None, 8.0, 5.0)],
        "shift_id string, shift_start_time string, hourly_rate_eur string, "
        "shift_working_hours double, hours_used double")
    rows = cleaning.clean_shifts(df).collect()
    assert [(r.shift_id, r.hour_of_day, r.unused_hours) for r in rows] == [("s1", 8, 3.0)]


def test_lenient_and_strict_columns(spark):
    df = spark.createDataFrame([("s1", "bad", "2024-01-01")],
                               "shift_uuid string, hourly_rate_eur string, date string")
    row = conform(df, SHIFTS, lenient=True).collect()[0]
    assert (row.shift_id, row.hourly_rate_eur, row.shift_date) == ("s1", None, date(2024, 1, 1))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        conform(df, SHIFTS).collect()


def test_constant_values_make_one_bin(spark):
    df = spark.createDataFrame([(2.0,)] * 3, "v double")
    assert [(r.bin, r.n) for r in histogram(df, {"v": F.col("v")}).collect()] == [(1, 3)]
    assert one(box_summary(df, F.col("v")))["outliers"] == 0


def test_constant_duration_has_no_bins(tables):
    b = tables.bookings(*[dict(booking_uuid=str(i), chauffeur_uuid="c", booked_duration=60.0)
                          for i in range(3)])
    a = tables.auctions(dict(booking_uuid="1", auction_winning_price=10.0))
    s = tables.shifts(dict(shift_id="s", chauffeur_uuid="c", hourly_rate_eur=60.0))
    assert costs.cost_diff_by_duration_quantile(b, a, s).count() == 0
    assert one(costs.cost_diff_summary(b, a, s))["q50"] == 9.0


def test_half_even_rounding(tables):
    row = one(supply.hourly_supply(tables.shifts(
        dict(shift_id="s", shift_date=date(2024, 1, 1), shift_working_hours=0.125))).where("hour = 0"))
    assert row["working_hours"] == 0.12
