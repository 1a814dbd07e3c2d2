"""Streams with bookings that come late."""

import datetime as dt

from fareloom.sources.schema import BOOKINGS
from fareloom.streaming import jobs


def at(day, hour=9):
    return dt.datetime(2024, 3, day, hour)


def test_late_bookings_end_in_their_day(spark, tables, tmp_path):
    shifts = tables.shifts(
        dict(shift_id="s1", shift_date=dt.date(2024, 3, 1), shift_working_hours=8.0),
        dict(shift_id="s2", shift_date=dt.date(2024, 3, 1), shift_working_hours=4.5))
    trip = lambda i, day, **more: dict(
        booking_uuid=f"b{i}", booked_start_at=day and at(day), booked_duration=600.0 + i,
        gross_revenue_eur=0.1 * i, **more)
    lots = [
        [trip(1, 1), trip(2, 1), trip(3, 2)],
        [trip(4, 9), trip(5, None)],
        # Days after day 1 was closed; a booking without id is not counted, but lasts.
        [trip(6, 1), trip(7, 9), {**trip(8, 1), "booking_uuid": None}],
    ]
    folder, out = f"{tmp_path}/arriving", f"{tmp_path}/days"
    for lot in lots:
        tables.bookings(*lot).coalesce(1).write.mode("append").parquet(folder)
        jobs.stream_corrected_days(
            jobs.read_stream(spark, folder, BOOKINGS, 1), shifts, out,
            f"{tmp_path}/state").awaitTermination()
    rows = {r.date.day: (r.total_bookings, r.total_booking_duration, round(r.total_revenue, 9),
                         r.total_shifts, r.total_shift_hours)
            for r in spark.read.parquet(out).collect()}
    assert rows == {1: (3, 601.0 + 602 + 606 + 608, 1.7, 2, 12.5), 2: (1, 603.0, 0.3, 0, 0.0),
                    9: (2, 604.0 + 607, 1.1, 0, 0.0)}


def test_a_batch_run_again_is_not_doubled(spark, tables, tmp_path):
    """A job that lost its state reads all again: its sums are written over."""
    shifts = tables.shifts(dict(shift_id="s1", shift_date=dt.date(2024, 3, 1)))
    folder, out = f"{tmp_path}/arriving", f"{tmp_path}/days"
    tables.bookings(dict(booking_uuid="b1", booked_start_at=at(1), booked_duration=60.0)).write.parquet(
        folder)
    for k in range(2):
        jobs.stream_corrected_days(jobs.read_stream(spark, folder, BOOKINGS), shifts, out,
                                   f"{tmp_path}/state-{k}").awaitTermination()
    assert [(r.total_bookings, r.total_booking_duration) for r in spark.read.parquet(out).collect()] \
        == [(1, 60.0)]
