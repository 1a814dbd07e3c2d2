"""Supply set against demand: hours, utilization, cost and revenue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fareloom.functions.calendar import on_hours
from fareloom.functions.exact import mean, product_total, ratio, ratio_or_zero, std, total
from fareloom.functions.scalars import (
    clip, duration_divisor, quotient_inf_as_null, quotient_inf_as_zero)
from fareloom.operators.demand import hourly_demand
from fareloom.operators.supply import supply_daily


def beside(df: DataFrame, **tables: DataFrame) -> DataFrame:
    """Add one-row tables as struct columns, as scalar subqueries."""
    for name, table in tables.items():
        df = df.withColumn(name, table.select(F.struct(*table.columns)).scalar())
    return df


def _shift_sums(shifts: DataFrame) -> DataFrame:
    return shifts.agg(
        total("shift_working_hours").alias("hours"),
        product_total("shift_working_hours", "hourly_rate_eur").alias("cost"),
    )


def _booking_sums(bookings: DataFrame) -> DataFrame:
    return bookings.agg(
        F.count("*").alias("rows"),
        total("booked_duration").alias("duration"),
        total("gross_revenue_eur").alias("revenue"),
    )


def kpis(shifts: DataFrame, bookings: DataFrame, auctions: DataFrame) -> DataFrame:
    success = auctions.agg(
        ratio(F.count("auction_winning_price"), F.count("*")).alias("rate"))
    hours, revenue, cost = F.col("s.hours"), F.col("revenue"), F.col("s.cost")
    return beside(_booking_sums(bookings), s=_shift_sums(shifts), a=success).select(
        ratio(hours, F.col("rows")).alias("hours_per_booking"),
        ratio(revenue, hours).alias("revenue_per_hour"),
        ratio(cost, hours).alias("cost_per_hour"),
        ratio(revenue - cost, revenue).alias("gross_margin"),
        F.col("a.rate").alias("auction_success_rate"),
    )


def _hour_sums(df: DataFrame, start: str, measure: Column, name: str) -> DataFrame:
    return df.dropna(subset=[start]).groupBy(F.hour(start).alias("hour")).agg(
        measure.alias(name))


def hours_distribution(shifts: DataFrame, bookings: DataFrame, start: str = "shift_date",
                       duration_unit: str = "h") -> DataFrame:
    """Hours bought and hours driven, for each hour of the day."""
    divisor = F.lit(float(duration_divisor(duration_unit)))
    used = _hour_sums(bookings, "booked_start_at", total("booked_duration") / divisor,
                      "utilized_hours")
    bought = _hour_sums(shifts, start, total("shift_working_hours"), "prepurchased_hours")
    return on_hours(used.join(bought, "hour", "full"))


def hours_distribution_totals(shifts: DataFrame, bookings: DataFrame,
                              duration_unit: str = "h") -> DataFrame:
    """Totals over all hours of the day; rows without a start time have no hour."""
    divisor = F.lit(float(duration_divisor(duration_unit)))
    used = bookings.dropna(subset=["booked_start_at"]).agg(
        (total("booked_duration") / divisor).alias("hours"))
    bought = shifts.dropna(subset=["shift_date"]).agg(total("shift_working_hours").alias("hours"))
    u, b = F.col("u.hours"), F.col("hours")
    return beside(bought, u=used).select(
        u.alias("total_utilized"),
        b.alias("total_prepurchased"),
        (b - u).alias("unused_hours"),
        ratio_or_zero(u * 100, b).alias("utilization_rate"),
    )


def hours_distribution_aligned(shifts: DataFrame, bookings: DataFrame) -> DataFrame:
    """Unconverted booking durations against shift hours, for the hours either side has.

    Bookings in an hour without shifts have an infinite rate, given as NULL.
    """
    supply = _hour_sums(shifts, "shift_start_time", total("shift_working_hours"), "shift_hours")
    demand = _hour_sums(bookings, "booked_start_at", total("booked_duration"), "booking_hours")
    return supply.join(demand, "hour", "full").na.fill(
        0, subset=["shift_hours", "booking_hours"]
    ).withColumn(
        "utilization_rate",
        quotient_inf_as_null(F.col("booking_hours"), F.col("shift_hours")) * 100)


def hours_distribution_aligned_totals(shifts: DataFrame, bookings: DataFrame) -> DataFrame:
    supply = shifts.dropna(subset=["shift_start_time"]).agg(
        total("shift_working_hours").alias("total_shift_hours"))
    demand = bookings.dropna(subset=["booked_start_at"]).agg(
        total("booked_duration").alias("hours"))
    return beside(supply, d=demand).select(
        "total_shift_hours",
        F.col("d.hours").alias("total_booking_hours"),
        ratio_or_zero(F.col("d.hours") * 100, F.col("total_shift_hours"))
        .alias("overall_utilization"),
    )


def hours_totals(shifts: DataFrame, bookings: DataFrame) -> DataFrame:
    """Totals with the booked duration left unconverted."""
    hours, active = F.col("s.hours"), F.col("duration")
    return beside(_booking_sums(bookings), s=_shift_sums(shifts)).select(
        hours.alias("total_scheduled_hours"),
        active.alias("total_active_hours"),
        (hours - active).alias("unused_hours"),
        ratio_or_zero(active * 100, hours).alias("utilization_rate"),
        F.col("s.cost").alias("total_cost"),
        F.col("revenue").alias("total_revenue"),
    )


def supply_demand_summary(shifts: DataFrame, bookings: DataFrame,
                          auctions: DataFrame) -> DataFrame:
    """Headline totals. Booked hours, revenue and bookings are summed over the hourly table."""
    by_hour = hourly_demand(bookings).agg(
        total("booked_duration").alias("total_booked_hours"),
        total("revenue_sum").alias("total_revenue"),
        F.sum("booking_count").alias("total_bookings"),
    )
    prices = auctions.agg(
        mean("auction_winning_price").alias("mean"), std("auction_winning_price").alias("std"))
    booked, revenue, n = F.col("total_booked_hours"), F.col("total_revenue"), F.col("total_bookings")
    hours = F.col("s.hours")
    return beside(by_hour, s=_shift_sums(shifts), p=prices).select(
        hours.alias("total_hours"),
        "total_booked_hours", "total_revenue", "total_bookings",
        F.col("p.mean").alias("avg_winning_price"),
        F.col("p.std").alias("std_winning_price"),
        ratio_or_zero(booked, n).alias("hours_per_booking"),
        ratio_or_zero(revenue, hours).alias("revenue_per_hour"),
        ratio_or_zero(booked * 100, hours).alias("utilization_rate"),
    )


def daily_supply_demand(shifts: DataFrame, bookings: DataFrame,
                        duration_unit: str = "h") -> DataFrame:
    divisor = F.lit(float(duration_divisor(duration_unit)))
    supply = supply_daily(shifts).select(
        F.col("shift_date").alias("date"), "total_shifts",
        F.col("total_hours").alias("total_shift_hours"))
    demand = bookings.dropna(subset=["booked_start_at"]).groupBy(
        F.to_date("booked_start_at").alias("date")
    ).agg(
        F.count("booking_uuid").alias("total_bookings"),
        total("booked_duration").alias("total_booking_duration"),
        total("gross_revenue_eur").alias("total_revenue"),
    )
    joined = supply.join(demand, "date", "full").na.fill(0)
    with_hours = joined.withColumn(
        "total_booking_hours", F.col("total_booking_duration") / divisor)
    used, bought = F.col("total_booking_hours"), F.col("total_shift_hours")
    # used/0 is infinite and clips to 1, 0/0 is unknown.
    share = F.when(bought == 0, F.when(used > 0, F.lit(1.0)).when(used < 0, F.lit(0.0))).otherwise(
        clip(ratio(used, bought), 0.0, 1.0))
    return with_hours.select(
        "*",
        share.alias("utilization_rate"),
        quotient_inf_as_zero(F.col("total_revenue"), used).alias("revenue_per_hour"),
    )


def daily_supply_demand_overview(shifts: DataFrame, bookings: DataFrame) -> DataFrame:
    return daily_supply_demand(shifts, bookings).agg(
        mean("total_shifts").alias("avg_daily_shifts"),
        mean("total_bookings").alias("avg_daily_bookings"),
        (mean("utilization_rate") * 100).alias("avg_utilization_pct"),
        mean("revenue_per_hour").alias("avg_revenue_per_hour"),
        ratio(total("total_booking_hours") * 100, total("total_shift_hours"))
        .alias("overall_utilization_pct"),
    )


def shift_utilization_summary(shifts: DataFrame, bookings: DataFrame,
                              duration_unit: str = "h") -> DataFrame:
    divisor = F.lit(float(duration_divisor(duration_unit)))
    used, bought = F.col("duration") / divisor, F.col("s.hours")
    return beside(_booking_sums(bookings), s=_shift_sums(shifts)).select(
        used.alias("total_utilized_hours"),
        bought.alias("total_shift_hours"),
        (bought - used).alias("unused_hours"),
        ratio_or_zero(used * 100, bought).alias("utilization_rate"),
        F.col("revenue").alias("total_revenue"),
        F.col("s.cost").alias("total_shift_cost"),
        ratio_or_zero(F.col("revenue"), used).alias("revenue_per_hour"),
        ratio_or_zero(F.col("s.cost"), bought).alias("cost_per_hour"),
    )


def supply_vs_demand_series(shifts: DataFrame, bookings: DataFrame) -> DataFrame:
    """Supply hours and booking counts on one axis of dates; NULL where a side has no rows."""
    supply = shifts.dropna(subset=["shift_date"]).groupBy(F.col("shift_date").alias("date")).agg(
        total("shift_working_hours").alias("supply_hours"))
    demand = bookings.dropna(subset=["booked_start_at"]).groupBy(
        F.to_date("booked_start_at").alias("date")).agg(F.count("*").alias("bookings"))
    return supply.join(demand, "date", "full")


def cost_revenue(shifts: DataFrame, bookings: DataFrame, auctions: DataFrame) -> DataFrame:
    prices = auctions.agg(total("auction_winning_price").alias("cost"))
    cost = F.col("s.cost") + F.col("a.cost")
    return beside(_booking_sums(bookings), s=_shift_sums(shifts), a=prices).select(
        cost.alias("total_cost"),
        F.col("revenue").alias("total_revenue"),
        F.col("s.cost").alias("total_shift_cost"),
        F.col("a.cost").alias("total_auction_cost"),
        (F.col("revenue") - cost).alias("profit"),
    )


def cost_revenue_margin(shifts: DataFrame, bookings: DataFrame, auctions: DataFrame) -> DataFrame:
    return cost_revenue(shifts, bookings, auctions).select(
        "total_revenue", "profit",
        ratio_or_zero(F.col("profit") * 100, F.col("total_revenue")).alias("profit_margin_pct"))


def cost_revenue_unit(shifts: DataFrame, bookings: DataFrame) -> DataFrame:
    """Per-booking and per-shift averages; auction cost is left out."""
    per_shift = shifts.agg(
        product_total("shift_working_hours", "hourly_rate_eur").alias("cost"),
        ratio(product_total("shift_working_hours", "hourly_rate_eur"),
              F.count(F.col("shift_working_hours") * F.col("hourly_rate_eur"))).alias("avg"))
    per_booking = bookings.agg(
        F.count("*").alias("rows"),
        total("gross_revenue_eur").alias("revenue"), mean("gross_revenue_eur").alias("avg"))
    shift_rows = shifts.agg(F.count("*").alias("rows"))
    return beside(per_booking, s=per_shift, r=shift_rows).select(
        F.col("s.cost").alias("total_shift_cost"),
        F.col("revenue").alias("total_revenue"),
        (F.col("revenue") - F.col("s.cost")).alias("profit_loss"),
        F.when(F.col("rows") > 0, F.col("avg")).otherwise(F.lit(0.0))
        .alias("avg_revenue_per_booking"),
        F.when(F.col("r.rows") > 0, F.col("s.avg")).otherwise(F.lit(0.0))
        .alias("avg_cost_per_shift"),
    )
