"""Auction prices: their spread, and how they move over the day and the week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fareloom.functions.calendar import on_hours
from fareloom.functions.exact import dec, half_even, mean, ratio
from fareloom.functions.keys import collapse, key_names
from fareloom.functions.scalars import euro_text, hour_span_label, hour_to_next_label
from fareloom.functions.stats import statistic_matrix

PRICE = "auction_winning_price"
LOW = "auction_corridor_min_price"
HIGH = "auction_corridor_max_price"
# Counts of joined pairs: a product of two row counts may pass 2**63.
PAIRS = "decimal(20,0)"


def auction_metrics(auctions: DataFrame) -> DataFrame:
    return statistic_matrix(auctions, {
        "min_price": F.col(LOW),
        "max_price": F.col(HIGH),
        "winning_price": F.col(PRICE),
        "profit_margin": F.col(PRICE) - F.col(LOW),
    }, ["mean", "std"])


def auction_price_matrix(auctions: DataFrame) -> DataFrame:
    return statistic_matrix(auctions, {
        LOW: F.col(LOW),
        HIGH: F.col(HIGH),
        PRICE: F.col(PRICE),
        "margin": F.col(PRICE) - F.col(LOW),
    }, ["mean", "std", "min", "max"])


def auctions_per_booking(auctions: DataFrame) -> DataFrame:
    """One row per booking key: counts, sums and extremes that merge over any grouping."""
    p = F.col(PRICE)
    return collapse(
        auctions, "booking_uuid",
        F.count("*").alias("n"), F.count(p).alias("n_price"),
        F.sum(dec(p)).alias("sum_price"), F.sum(dec(p) * dec(p)).alias("sum_price2"),
        F.min(p).alias("min_price"), F.max(p).alias("max_price"),
        F.count(LOW).alias("n_low"), F.sum(dec(LOW)).alias("sum_low"),
        F.count(HIGH).alias("n_high"), F.sum(dec(HIGH)).alias("sum_high"),
    )


def keyed_auctions(auctions: DataFrame, bookings: DataFrame, *keys: Column) -> DataFrame:
    """Auctions joined to keys taken from their bookings, both sides collapsed per booking.

    ``repeats`` says how many bookings share the id and the keys. Auctions without a booking have
    no key to be grouped by, so the join is an inner one.
    """
    starts = collapse(bookings, "booking_uuid", F.count("*").alias("repeats"), also=keys)
    return auctions_per_booking(auctions).join(starts, key_names("booking_uuid"))


def timed_auctions(auctions: DataFrame, bookings: DataFrame, *keys: Column) -> DataFrame:
    """The same for keys made from the start time: bookings without one are left out."""
    return keyed_auctions(auctions, bookings.dropna(subset=["booked_start_at"]), *keys)


def repeated(count: str, c: str) -> Column:
    return F.col(count) * F.col(c)


def weighted_mean(total: str, n: str) -> Column:
    return ratio(F.sum(repeated("repeats", total)).cast("double"), F.sum(repeated("repeats", n)))


def auction_price_by_day_hour(auctions: DataFrame, bookings: DataFrame) -> DataFrame:
    start = F.col("booked_start_at")
    return timed_auctions(
        auctions, bookings, F.weekday(start).alias("weekday"), F.hour(start).alias("hour")
    ).groupBy("weekday", "hour").agg(
        weighted_mean("sum_price", "n_price").alias("avg_price"),
        F.sum(repeated("repeats", "n_price")).alias("n"),
    )


def peak_price_slots(auctions: DataFrame, bookings: DataFrame, k: int = 5) -> DataFrame:
    return auction_price_by_day_hour(auctions, bookings).orderBy(
        F.desc_nulls_last("avg_price"), "weekday", "hour").limit(k)


def hourly_auctions(auctions: DataFrame, bookings: DataFrame) -> DataFrame:
    """Price statistics by booking hour, with the mean +- std band that charts show.

    The deviation comes from exact decimal moments, since the rows behind it are weighted.
    """
    by_hour = timed_auctions(
        auctions, bookings, F.hour("booked_start_at").alias("hour")
    ).groupBy("hour").agg(
        F.sum(repeated("repeats", "n_price")).alias("n"),
        F.sum(repeated("repeats", "sum_price")).cast("double").alias("s1"),
        F.sum(repeated("repeats", "sum_price2")).cast("double").alias("s2"),
        F.min("min_price").alias("price_min"),
        F.max("max_price").alias("price_max"),
        weighted_mean("sum_low", "n_low").alias("corridor_min_mean"),
        weighted_mean("sum_high", "n_high").alias("corridor_max_mean"),
    )
    variance = F.greatest(
        ratio(F.col("s2") - F.col("s1") * ratio(F.col("s1"), F.col("n")), F.col("n") - 1),
        F.lit(0.0))
    deviation = F.when(F.col("n") > 1, F.sqrt(variance))
    rounded = by_hour.select(
        "hour",
        half_even(ratio(F.col("s1"), F.col("n"))).alias("price_mean"),
        half_even(deviation).alias("price_std"),
        *[half_even(F.col(c)).alias(c)
          for c in ("price_min", "price_max", "corridor_min_mean", "corridor_max_mean")],
    )
    return rounded.select(
        "*",
        (F.col("price_mean") - F.col("price_std")).alias("band_low"),
        (F.col("price_mean") + F.col("price_std")).alias("band_high"),
    )


def auction_price_vs_revenue_by_hour(bookings: DataFrame, auctions: DataFrame) -> DataFrame:
    """Mean price and mean revenue over the auctioned bookings of each hour."""
    per_booking = collapse(
        bookings.dropna(subset=["booked_start_at"]), "booking_uuid",
        F.count("*").alias("repeats"),
        F.count("gross_revenue_eur").alias("n_revenue"),
        F.sum(dec("gross_revenue_eur")).alias("sum_revenue"),
        also=(F.hour("booked_start_at").alias("hour"),))
    return auctions_per_booking(auctions).join(per_booking, key_names("booking_uuid")).groupBy(
        "hour"
    ).agg(
        weighted_mean("sum_price", "n_price").alias("avg_auction_price"),
        ratio(F.sum(repeated("n", "sum_revenue")).cast("double"),
              F.sum(repeated("n", "n_revenue"))).alias("avg_revenue"),
    )


def auction_price_vs_revenue_table(bookings: DataFrame, auctions: DataFrame) -> DataFrame:
    """The same, with amounts as the text a report prints."""
    return auction_price_vs_revenue_by_hour(bookings, auctions).select(
        "hour",
        euro_text(F.col("avg_auction_price")).alias("avg_auction_price"),
        euro_text(F.col("avg_revenue")).alias("avg_revenue"),
    )


def rates_per_chauffeur(shifts: DataFrame) -> DataFrame:
    return collapse(
        shifts, "chauffeur_uuid",
        F.count("*").alias("n_shifts"), F.count("hourly_rate_eur").alias("n_rate"),
        F.sum(dec("hourly_rate_eur")).alias("sum_rate"))


def _peak_sums(auctions: DataFrame, bookings: DataFrame, shifts: DataFrame) -> DataFrame:
    """Sums by hour over auctions x bookings x all shifts of the chauffeur.

    The shift join ignores dates, so every shift of a chauffeur repeats the booking. The repeats
    are multiplied, not produced.
    """
    timed = bookings.dropna(subset=["booked_start_at"]).select(
        "booking_uuid", "chauffeur_uuid", F.hour("booked_start_at").alias("hour"))
    starts = collapse(
        timed, "booking_uuid", F.count("*").alias("repeats"),
        also=(F.col("chauffeur_uuid"), F.col("hour")))
    driven = collapse(
        auctions_per_booking(auctions).join(starts, key_names("booking_uuid")),
        "chauffeur_uuid",
        F.sum(repeated("repeats", "n")).alias("n"),
        F.sum(repeated("repeats", "n_price")).alias("n_price"),
        F.sum(repeated("repeats", "sum_price")).alias("sum_price"),
        also=(F.col("hour"),))
    joined = driven.join(rates_per_chauffeur(shifts), key_names("chauffeur_uuid"), "left")
    copies = F.coalesce(F.col("n_shifts"), F.lit(1)).cast(PAIRS)
    return joined.groupBy("hour").agg(
        F.sum(F.col("n") * copies).alias("n"),
        ratio(F.sum(F.col("sum_price") * copies),
              F.sum(F.col("n_price") * copies)).alias("avg_auction_price"),
        ratio(F.sum(F.col("sum_rate") * F.col("n")),
              F.sum(F.col("n_rate").cast(PAIRS) * F.col("n"))).alias("avg_shift_cost"),
    )


def peak_hours_price_vs_cost(auctions: DataFrame, bookings: DataFrame,
                             shifts: DataFrame) -> DataFrame:
    return _peak_sums(auctions, bookings, shifts).select(
        "hour",
        half_even(F.col("avg_auction_price")).alias("avg_auction_price"),
        half_even(F.col("avg_shift_cost")).alias("avg_shift_cost"),
    ).withColumn(
        "price_difference", half_even(F.col("avg_auction_price") - F.col("avg_shift_cost")))


def peak_hours_top(auctions: DataFrame, bookings: DataFrame, shifts: DataFrame,
                   k: int = 6) -> DataFrame:
    """The k hours with the most joined rows; the earlier hour wins a tie."""
    top = _peak_sums(auctions, bookings, shifts).orderBy(F.desc("n"), "hour").limit(k)
    return top.select(
        hour_span_label(F.col("hour")).alias("time_range"),
        F.col("n").cast("bigint").alias("num_bookings"),
        "avg_auction_price",
        "avg_shift_cost",
        F.coalesce(F.col("avg_auction_price") - F.col("avg_shift_cost"), F.lit(0.0))
        .alias("price_difference"),
    ).orderBy("time_range")


def peak_hours_revenue(bookings: DataFrame, shifts: DataFrame) -> DataFrame:
    """Revenue by hour against one overall shift rate, the mean of every shift's own mean."""
    per_shift = shifts.dropna(subset=["shift_id"]).groupBy("shift_id").agg(
        mean("hourly_rate_eur").alias("rate"))
    rate = per_shift.agg(mean("rate").alias("rate"))
    by_hour = bookings.dropna(subset=["booked_start_at"]).groupBy(
        F.hour("booked_start_at").alias("hour")
    ).agg(
        F.count("gross_revenue_eur").alias("num_bookings"),
        mean("gross_revenue_eur").alias("avg_revenue"),
    )
    return by_hour.withColumn("avg_shift_cost", rate.scalar()).select(
        "hour",
        hour_to_next_label(F.col("hour")).alias("time_range"),
        "num_bookings", "avg_revenue", "avg_shift_cost",
        (F.col("avg_revenue") - F.col("avg_shift_cost")).alias("revenue_difference"),
    )


def peak_hours_full(bookings: DataFrame, auctions: DataFrame) -> DataFrame:
    by_hour = bookings.dropna(subset=["booked_start_at"]).groupBy(
        F.hour("booked_start_at").alias("hour")
    ).agg(
        F.count("booking_uuid").alias("total_bookings"),
        mean("gross_revenue_eur").alias("avg_revenue"),
        (mean("booked_duration") / 60).alias("avg_duration"),
    )
    prices = timed_auctions(
        auctions, bookings, F.hour("booked_start_at").alias("hour")
    ).groupBy("hour").agg(weighted_mean("sum_price", "n_price").alias("avg_auction_price"))
    return by_hour.join(prices, "hour", "left")


def peak_hours_overview(bookings: DataFrame, auctions: DataFrame) -> DataFrame:
    """Means over the hours that have bookings."""
    return peak_hours_full(bookings, auctions).agg(
        mean("total_bookings").alias("avg_bookings_per_hour"),
        mean("avg_revenue").alias("avg_revenue_per_hour"),
        mean("avg_duration").alias("avg_duration_minutes"),
    )


def hourly_cost_curve(shifts: DataFrame, auctions: DataFrame,
                      trip_duration: float = 1.0) -> DataFrame:
    """Shift cost of one trip against the mean auction price of each hour of the day.

    An hour without auctions takes the overall mean price. ``auctions`` and ``shifts`` are the
    cleaned tables; ``hour_of_day`` is the auction hour.
    """
    by_hour = auctions.dropna(subset=["hour_of_day"]).groupBy(
        F.col("hour_of_day").cast("int").alias("hour")
    ).agg(mean(PRICE).alias("price"))
    rate = shifts.agg(mean("hourly_rate_eur").alias("rate"))
    overall = auctions.agg(mean(PRICE).alias("price"))
    laid = on_hours(by_hour, fill_zero=False)
    return laid.select(
        F.col("hour").alias("hour_of_day"),
        (rate.scalar() * F.lit(float(trip_duration))).alias("shift_cost"),
        F.coalesce(F.col("price"), overall.scalar()).alias("auction_cost"),
    ).withColumn("cost_diff", F.col("shift_cost") - F.col("auction_cost"))


def cost_recommendations(curve: DataFrame) -> DataFrame:
    """Hours in which shifts or auctions are the cheaper choice (at most 24 of them)."""
    hour = F.col("hour_of_day")
    return curve.agg(
        F.sort_array(F.collect_list(F.when(F.col("cost_diff") < 0, hour))).alias("prefer_shifts"),
        F.sort_array(F.collect_list(F.when(F.col("cost_diff") > 0, hour))).alias("prefer_auctions"),
        mean(F.abs("cost_diff")).alias("avg_potential_savings"),
    )
