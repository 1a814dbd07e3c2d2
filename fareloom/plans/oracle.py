"""ANSI SQL for the same analyses, written naively: joins produce every combination, statistics
are the engine's own. It is what the DataFrame operators are checked against."""

from __future__ import annotations

import re
from itertools import combinations_with_replacement

TABLES = {
    "keyed_events": """
        SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events""",
    "bookings": """
        SELECT event_id AS booking_uuid,
               CASE WHEN event_id % 13 <> 0 THEN user_id END AS chauffeur_uuid,
               ts AS booked_start_at,
               CAST(600 + ((event_id * 37) % 110) * 60 AS DOUBLE) AS booked_duration,
               CAST(1 + k AS DOUBLE) AS booked_distance,
               CASE WHEN event_type = 'error' THEN CAST(0 AS DOUBLE) ELSE value END
                   AS gross_revenue_eur,
               (k - 50) * CAST(0.013 AS DOUBLE) AS pickup_longitude,
               CAST(52.4 AS DOUBLE) + (user_id % 25) * CAST(0.0101 AS DOUBLE) AS pickup_latitude,
               (k - 30) * CAST(0.011 AS DOUBLE) AS dropoff_longitude,
               CAST(52.3 AS DOUBLE) + (event_id % 40) * CAST(0.0103 AS DOUBLE) AS dropoff_latitude
        FROM keyed_events""",
    "auctions": """
        SELECT CASE WHEN event_id % 97 = 0 THEN -event_id - 1 ELSE event_id END AS booking_uuid,
               CASE WHEN event_id % 11 <> 0 THEN 5 + value * CAST(0.8 AS DOUBLE) END
                   AS auction_winning_price,
               value * CAST(0.5 AS DOUBLE) AS auction_corridor_min_price,
               5 + value * CAST(1.2 AS DOUBLE) AS auction_corridor_max_price,
               ts - INTERVAL 15 MINUTE AS auction_start_time,
               ts - INTERVAL 5 MINUTE AS auction_end_time
        FROM keyed_events WHERE event_type IN ('click', 'view', 'purchase')""",
    "shifts": """
        SELECT o_orderkey AS shift_id, o_custkey AS chauffeur_uuid,
               DATE '2024-01-01' + CAST(o_orderkey % 28 AS INTEGER) AS shift_date,
               4 + (o_orderkey % 13) * CAST(0.5 AS DOUBLE) AS shift_working_hours,
               CASE WHEN o_orderkey % 41 <> 0 THEN CAST(35 + o_custkey % 20 AS DOUBLE) END
                   AS hourly_rate_eur,
               CAST(DATE '2024-01-01' + CAST(o_orderkey % 28 AS INTEGER) AS TIMESTAMP)
                   + to_hours(CAST(6 + o_orderkey % 12 AS INTEGER)) AS shift_start_time,
               CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' WHEN o_orderkey = 1 THEN '1,035.50'
                    WHEN o_orderkey = 2 THEN ' 42 '
                    ELSE CAST(35 + o_custkey % 20 AS VARCHAR) || '.00' END AS hourly_rate_raw
        FROM orders""",
    "weather": """
        SELECT d AS date, 'W' || CAST(day(d) % 3 AS VARCHAR) AS weather_condition,
               CAST(day(d) * 7 % 15 AS INTEGER) AS temperature
        FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) WHERE day(d) NOT IN (7, 14)""",
    "calendar": """
        SELECT DATE '2024-01-01' + CAST(n_nationkey % 20 AS INTEGER) AS event_date,
               'TYPE_' || CAST(n_regionkey AS VARCHAR) AS event_type, n_name AS event_name
        FROM nation""",
    "hours": "SELECT CAST(range AS INTEGER) AS h FROM range(24)",
    "weekdays": """
        SELECT * FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'),
                              (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')) t(w, name)""",
    # auctions with their booking, as a left join
    "auction_bookings": """
        SELECT a.*, b.booked_start_at, b.chauffeur_uuid, b.gross_revenue_eur,
               hour(b.booked_start_at) AS h, isodow(b.booked_start_at) - 1 AS w
        FROM auctions a LEFT JOIN bookings b ON a.booking_uuid IS NOT DISTINCT FROM b.booking_uuid""",
    "auctioned": """
        SELECT b.*, a.auction_winning_price, a.auction_corridor_min_price,
               a.auction_corridor_max_price, hour(b.booked_start_at) AS h,
               CAST(b.booked_start_at AS DATE) AS d
        FROM bookings b JOIN auctions a ON a.booking_uuid IS NOT DISTINCT FROM b.booking_uuid""",
    "in_context": """
        SELECT m.*, w.weather_condition, w.temperature, c.event_type
        FROM auctioned m LEFT JOIN weather w ON m.d = w.date
        LEFT JOIN calendar c ON m.d = c.event_date""",
    "trip_costs": """
        SELECT b.booking_uuid, b.chauffeur_uuid, b.booked_start_at, b.booked_duration,
               a.auction_winning_price, s.hourly_rate_eur,
               CAST(a.auction_winning_price AS DECIMAL(18,6)) AS price_dec,
               CAST(s.hourly_rate_eur AS DECIMAL(18,6)) AS rate_dec,
               CAST(b.booked_duration AS DECIMAL(18,6)) AS seconds_dec
        FROM bookings b
        LEFT JOIN auctions a ON a.booking_uuid IS NOT DISTINCT FROM b.booking_uuid
        LEFT JOIN shifts s ON s.chauffeur_uuid IS NOT DISTINCT FROM b.chauffeur_uuid""",
    "daily_supply": """
        SELECT shift_date, count(*) AS n, {mean:hourly_rate_eur} AS rate
        FROM shifts WHERE shift_date IS NOT NULL GROUP BY shift_date""",
    "own_duration": """
        SELECT a.*, b.booked_duration AS own FROM auctions a
        LEFT JOIN bookings b ON a.booking_uuid = b.booking_uuid""",
    "cells": """
        SELECT DISTINCT booked_duration AS d, booked_distance AS x FROM bookings""",
    "past": """
        SELECT b.booked_duration AS d, b.booked_distance AS x, count(*) AS n,
               count(a.auction_winning_price) AS n_price,
               sum(CAST(a.auction_winning_price AS DECIMAL(18,6))) AS sum_price
        FROM auctions a JOIN bookings b ON a.booking_uuid = b.booking_uuid GROUP BY 1, 2""",
    "cell_matches": """
        SELECT c.d, c.x, sum(p.n) AS n, sum(p.n_price) AS n_price, sum(p.sum_price) AS sum_price
        FROM cells c JOIN past p ON p.d BETWEEN c.d * CAST(0.8 AS DOUBLE) AND c.d * CAST(1.2 AS DOUBLE)
            AND p.x BETWEEN c.x * CAST(0.8 AS DOUBLE) AND c.x * CAST(1.2 AS DOUBLE)
        GROUP BY c.d, c.x""",
    "matches": """
        SELECT b.*, CAST(COALESCE(m.n, 0) AS BIGINT) AS n,
               CASE WHEN m.n_price > 0 THEN CAST(m.sum_price AS DOUBLE) / m.n_price END AS price,
               CASE WHEN m.n > 0 THEN CAST(m.n_price AS DOUBLE) / m.n END AS success
        FROM bookings b
        LEFT JOIN cell_matches m ON b.booked_duration = m.d AND b.booked_distance = m.x""",
    "duration_matches": """
        SELECT c.d, count(*) AS n, count(o.auction_winning_price) AS n_price,
               sum(CAST(o.auction_winning_price AS DECIMAL(18,6))) AS sum_price
        FROM (SELECT DISTINCT booked_duration AS d FROM bookings) c
        JOIN own_duration o ON o.own BETWEEN c.d * CAST(0.8 AS DOUBLE) AND c.d * CAST(1.2 AS DOUBLE)
        GROUP BY c.d""",
    "matches_1d": """
        SELECT b.*, CAST(COALESCE(m.n, 0) AS BIGINT) AS n,
               CASE WHEN m.n_price > 0 THEN CAST(m.sum_price AS DOUBLE) / m.n_price END AS price,
               CASE WHEN m.n > 0 THEN CAST(m.n_price AS DOUBLE) / m.n END AS success
        FROM bookings b LEFT JOIN duration_matches m ON b.booked_duration = m.d""",
}


def dec(c: str) -> str:
    return f"CAST({c} AS DECIMAL(18,6))"


def total(c: str) -> str:
    return f"COALESCE(CAST(sum({dec(c)}) AS DOUBLE), CAST(0 AS DOUBLE))"


def product(a: str, b: str) -> str:
    return f"COALESCE(CAST(sum({dec(a)} * {dec(b)}) AS DOUBLE), CAST(0 AS DOUBLE))"


def mean(c: str) -> str:
    return f"CAST(sum({dec(c)}) AS DOUBLE) / NULLIF(count({c}), 0)"


def std(c: str) -> str:
    return f"round_even(stddev_samp({c}), 6)"


def half_even(x: str) -> str:
    return f"CAST(round_even({x}, 2) AS DOUBLE)"


def zero(x: str) -> str:
    return f"COALESCE({x}, 0)"


P = "auction_winning_price"
COST_CURVE = f"""
    SELECT h.h AS hour_of_day, r.rate * CAST(1.5 AS DOUBLE) AS shift_cost,
           COALESCE(a.price, o.price) AS auction_cost,
           r.rate * CAST(1.5 AS DOUBLE) - COALESCE(a.price, o.price) AS cost_diff
    FROM hours h
    LEFT JOIN (SELECT hour(auction_start_time) AS h, {mean(P)} AS price FROM auctions
               WHERE {P} IS NOT NULL GROUP BY 1) a ON a.h = h.h,
    (SELECT {mean('hourly_rate_eur')} AS rate FROM shifts WHERE hourly_rate_eur IS NOT NULL) r,
    (SELECT {mean(P)} AS price FROM auctions) o"""
HOURLY_DEMAND = f"""
    SELECT h.h AS "hour", {zero('b.n')} AS booking_count, {zero('b.rs')} AS revenue_sum,
           {zero('b.rm')} AS revenue_mean, {zero('b.rd')} AS revenue_std,
           {zero('b.d')} / CAST(3600 AS DOUBLE) AS booked_duration
    FROM hours h LEFT JOIN (
        SELECT hour(booked_start_at) AS h, count(booking_uuid) AS n,
               {half_even(total('gross_revenue_eur'))} AS rs,
               {half_even(mean('gross_revenue_eur'))} AS rm,
               {half_even(std('gross_revenue_eur'))} AS rd,
               {half_even(total('booked_duration'))} AS d
        FROM bookings GROUP BY 1) b ON b.h = h.h"""
DAILY_BALANCE = f"""
    SELECT *, CASE WHEN total_shift_hours = 0 THEN CASE WHEN total_booking_hours > 0
                        THEN CAST(1 AS DOUBLE) END
                   ELSE least(greatest(total_booking_hours / total_shift_hours, 0), 1) END
               AS utilization_rate,
           CASE WHEN total_booking_hours = 0 AND total_revenue <> 0 THEN CAST(0 AS DOUBLE)
                ELSE total_revenue / NULLIF(total_booking_hours, 0) END AS revenue_per_hour
    FROM (SELECT COALESCE(s.d, b.d) AS date, {zero('s.n')} AS total_shifts,
                 {zero('s.hours')} AS total_shift_hours, {zero('b.n')} AS total_bookings,
                 {zero('b.seconds')} AS total_booking_duration, {zero('b.revenue')} AS total_revenue,
                 {zero('b.seconds')} / CAST(3600 AS DOUBLE) AS total_booking_hours
          FROM (SELECT shift_date AS d, count(shift_id) AS n, {total('shift_working_hours')} AS hours
                FROM shifts GROUP BY 1) s
          FULL JOIN (SELECT CAST(booked_start_at AS DATE) AS d, count(booking_uuid) AS n,
                            {total('booked_duration')} AS seconds,
                            {total('gross_revenue_eur')} AS revenue
                     FROM bookings GROUP BY 1) b ON s.d = b.d)"""
BY_CHAUFFEUR = f"""
    SELECT *, shift_working_hours - booked_hours AS unused_hours,
           {half_even('booked_hours / NULLIF(shift_working_hours, 0) * 100')} AS utilization_rate,
           hourly_rate_eur AS cost_per_hour,
           {half_even('gross_revenue_eur / NULLIF(shift_working_hours, 0)')} AS revenue_per_hour
    FROM (SELECT s.c AS chauffeur_uuid, s.hours AS shift_working_hours,
                 {zero('s.rate')} AS hourly_rate_eur, {zero('b.hours')} AS booked_hours,
                 {zero('b.revenue')} AS gross_revenue_eur
          FROM (SELECT chauffeur_uuid AS c, {half_even(total('shift_working_hours'))} AS hours,
                       {half_even(mean('hourly_rate_eur'))} AS rate
                FROM shifts WHERE chauffeur_uuid IS NOT NULL GROUP BY 1) s
          LEFT JOIN (SELECT chauffeur_uuid AS c,
                            {half_even(total('booked_duration') + ' / CAST(60 AS DOUBLE)')} AS hours,
                            {half_even(total('gross_revenue_eur'))} AS revenue
                     FROM bookings WHERE chauffeur_uuid IS NOT NULL GROUP BY 1) b ON s.c = b.c)"""
PEAK = f"""
    SELECT x.h, count(*) AS n, {mean('x.' + P)} AS price, {mean('s.hourly_rate_eur')} AS rate
    FROM auction_bookings x
    LEFT JOIN shifts s ON s.chauffeur_uuid IS NOT DISTINCT FROM x.chauffeur_uuid
    WHERE x.h IS NOT NULL GROUP BY x.h"""
COST_REVENUE = f"""
    SELECT s.cost + a.cost AS total_cost, b.revenue AS total_revenue, s.cost AS total_shift_cost,
           a.cost AS total_auction_cost, b.revenue - (s.cost + a.cost) AS profit
    FROM (SELECT {product('shift_working_hours', 'hourly_rate_eur')} AS cost FROM shifts) s,
         (SELECT {total(P)} AS cost FROM auctions) a,
         (SELECT {total('gross_revenue_eur')} AS revenue FROM bookings) b"""
SHIFT_SUMS = f"""(SELECT {total('shift_working_hours')} AS hours,
    {product('shift_working_hours', 'hourly_rate_eur')} AS cost, count(*) AS rows FROM shifts)"""
BOOKING_SUMS = f"""(SELECT count(*) AS rows, {total('booked_duration')} AS duration,
    {total('gross_revenue_eur')} AS revenue FROM bookings)"""
DEMAND_DAILY = f"""
    SELECT CAST(booked_start_at AS DATE) AS booking_date, count(booking_uuid) AS total_bookings,
           {total('gross_revenue_eur')} AS total_revenue,
           {zero(mean('booked_duration'))} AS avg_duration,
           {zero(mean('booked_distance'))} AS avg_distance
    FROM bookings GROUP BY 1"""
SUPPLY_DAILY = f"""
    SELECT shift_date, count(shift_id) AS total_shifts, {total('shift_working_hours')} AS total_hours,
           {mean('hourly_rate_eur')} AS avg_rate
    FROM shifts WHERE shift_date IS NOT NULL GROUP BY 1"""
FULL_HOURS = f"""
    SELECT b.h AS "hour", b.n AS total_bookings, b.revenue AS avg_revenue,
           b.duration / 60 AS avg_duration, a.price AS avg_auction_price
    FROM (SELECT hour(booked_start_at) AS h, count(booking_uuid) AS n,
                 {mean('gross_revenue_eur')} AS revenue, {mean('booked_duration')} AS duration
          FROM bookings GROUP BY 1) b
    LEFT JOIN (SELECT h, {mean(P)} AS price FROM auction_bookings WHERE h IS NOT NULL
               GROUP BY h) a ON a.h = b.h"""
BY_WEEKDAY = """
    SELECT d.w, d.name, b.n FROM weekdays d
    LEFT JOIN (SELECT isodow(booked_start_at) - 1 AS w, count(*) AS n FROM bookings GROUP BY 1) b
    ON b.w = d.w"""
BY_HOUR = "SELECT hour(booked_start_at) AS h, count(*) AS n FROM bookings GROUP BY 1"
COSTS = """
    SELECT *, hourly_rate_eur * (booked_duration / CAST({divisor} AS DOUBLE)) AS cost,
           price_dec * {divisor} - rate_dec * seconds_dec AS scaled_diff,
           price_micro * {divisor} * 1000000 - rate_micro * seconds_micro AS diff_units,
           rate_micro * seconds_micro AS cost_units,
           price_micro * {divisor} * 1000000 AS price_units
    FROM (SELECT *, CAST(CAST(price_dec AS DECIMAL(38,6)) * 1000000 AS HUGEINT) AS price_micro,
                 CAST(CAST(rate_dec AS DECIMAL(38,6)) * 1000000 AS HUGEINT) AS rate_micro,
                 CAST(CAST(seconds_dec AS DECIMAL(38,6)) * 1000000 AS HUGEINT) AS seconds_micro
          FROM trip_costs)"""


def matrix(columns: dict[str, str], statistics: list[str]) -> str:
    make = {"mean": mean, "std": std, "min": lambda c: f"min({c})", "max": lambda c: f"max({c})"}
    return " UNION ALL ".join(
        f"SELECT '{name}' AS metric, "
        + ", ".join(f"{make[s](c)} AS {s}" for s in statistics) + " FROM auctions"
        for name, c in columns.items())


def quantile(values: str, p: float) -> str:
    """Interpolated from the nearer of the two ranks around position (n - 1) * p of a sorted list.
    (The built-in quantile weights both ends, which differs in the last digit.)"""
    position = f"((len({values}) - 1) * CAST({p} AS DOUBLE))"
    low = f"{values}[CAST(floor({position}) AS BIGINT) + 1]"
    high = f"{values}[CAST(ceil({position}) AS BIGINT) + 1]"
    part = f"({position} - floor({position}))"
    return (f"CASE WHEN {part} < 0.5 THEN {low} + ({high} - {low}) * {part} "
            f"ELSE {high} - ({high} - {low}) * (1 - {part}) END")


def describe(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT metric, count, mean, std, min, {quantile('v', 0.25)} AS q25,
            {quantile('v', 0.5)} AS q50, {quantile('v', 0.75)} AS q75, max
            FROM (SELECT '{c}' AS metric, count({c}) AS count, {mean(c)} AS mean, {std(c)} AS std,
                  CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
                  list(CAST({c} AS DOUBLE) ORDER BY {c}) FILTER ({c} IS NOT NULL) AS v
                  FROM ({source}))"""
        for c in columns)


def histogram(source: str, series: dict[str, str], bins: int) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{name}' AS series, {c} AS v FROM ({source}) WHERE {c} IS NOT NULL"
        for name, c in series.items())
    return f"""
        SELECT s.series, CAST(i.range AS INTEGER) AS bin,
               e.lo + (e.hi - e.lo) / CAST({bins} AS DOUBLE) * (i.range - 1) AS bin_low,
               e.lo + (e.hi - e.lo) / CAST({bins} AS DOUBLE) * i.range AS bin_high,
               count(v.v) AS n
        FROM (SELECT min(v) AS lo, max(v) AS hi FROM ({long})) e,
             (SELECT DISTINCT series FROM ({long})) s, range(1, {bins} + 1) i
        LEFT JOIN ({long}) v ON v.series = s.series AND i.range = CASE WHEN e.hi = e.lo THEN 1 ELSE
            least({bins}, floor((v.v - e.lo) * CAST({bins} AS DOUBLE) / (e.hi - e.lo)) + 1) END
        WHERE e.hi > e.lo OR i.range = 1
        GROUP BY s.series, i.range, e.lo, e.hi"""


def exact_histogram(source: str, series: dict[str, str], bins: int, divisor: int) -> str:
    """Bins of integers scaled by ``divisor`` * 10**12, so that no edge depends on rounding."""
    long = " UNION ALL ".join(
        f"SELECT '{name}' AS series, {c} AS v FROM ({source}) WHERE {c} IS NOT NULL"
        for name, c in series.items())
    low = f"(CAST(e.lo AS DOUBLE) / CAST({divisor}000000000000 AS DOUBLE))"
    high = f"(CAST(e.hi AS DOUBLE) / CAST({divisor}000000000000 AS DOUBLE))"
    return f"""
        WITH long AS MATERIALIZED ({long}),
             e AS (SELECT min(v) AS lo, max(v) AS hi FROM long),
             counted AS (SELECT series, least({bins}, (v - lo) * {bins} // (hi - lo) + 1) AS bin,
                                count(*) AS n FROM long, e GROUP BY 1, 2),
             axis AS (SELECT s.series, i.range AS bin
                      FROM (SELECT DISTINCT series FROM long) s, range(1, {bins} + 1) i)
        SELECT a.series, CAST(a.bin AS INTEGER) AS bin,
               {low} + ({high} - {low}) / CAST({bins} AS DOUBLE) * (a.bin - 1) AS bin_low,
               {low} + ({high} - {low}) / CAST({bins} AS DOUBLE) * a.bin AS bin_high,
               COALESCE(c.n, 0) AS n
        FROM axis a CROSS JOIN e LEFT JOIN counted c ON c.series = a.series AND c.bin = a.bin"""


def correlation(columns: list[str]) -> str:
    rows = []
    for a, b in combinations_with_replacement(columns, 2):
        r = (f"CASE WHEN isnan(corr({a}, {b})) THEN NULL "
             f"ELSE round_even(corr({a}, {b}), 6) END")
        for x, y in sorted({(a, b), (b, a)}):
            rows.append(f"SELECT '{x}' AS a, '{y}' AS b, {r} AS r FROM j")
    picked = ", ".join("h AS hour_of_day" if c == "hour_of_day" else c for c in columns)
    return f"WITH j AS MATERIALIZED (SELECT {picked} FROM in_context) " + " UNION ALL ".join(rows)


def booking_costs(divisor: int) -> str:
    return f"""
        SELECT booking_uuid, chauffeur_uuid, booked_duration, {P}, hourly_rate_eur,
               cost AS pre_purchased_cost, {P} - cost AS cost_diff, count(*) AS copies
        FROM ({COSTS.format(divisor=divisor)}) GROUP BY 1, 2, 3, 4, 5, 6, 7"""


def grid(end: str) -> str:
    return f"""
        SELECT CAST(trunc({end}_longitude / CAST(0.01 AS DOUBLE)) AS BIGINT) AS {end}_grid_x,
               CAST(trunc({end}_latitude / CAST(0.01 AS DOUBLE)) AS BIGINT) AS {end}_grid_y,
               {mean(P)} AS avg_price, count({P}) AS n FROM auctioned GROUP BY 1, 2"""


def seasonality(where: str) -> str:
    return f"""
        SELECT count(*) AS total_bookings,
               CAST(count(*) AS DOUBLE) / count(DISTINCT CAST(booked_start_at AS DATE))
                   AS avg_daily_bookings,
               (SELECT printf('%02d:00', h) FROM (
                   SELECT hour(booked_start_at) AS h, count(*) AS n FROM bookings WHERE {where}
                   GROUP BY 1 ORDER BY n DESC, h LIMIT 1)) AS peak_hour
        FROM bookings WHERE {where}"""


def performers(order: str, factor: int = 1) -> str:
    by_chauffeur = BY_CHAUFFEUR.replace("FROM shifts", f"""FROM (
        SELECT * REPLACE (shift_working_hours * {factor} AS shift_working_hours) FROM shifts)""")
    return f"""SELECT * FROM ({by_chauffeur}) WHERE utilization_rate > 0
        AND utilization_rate <= 100 ORDER BY utilization_rate {order}, chauffeur_uuid LIMIT 5"""


def difference_summary(differences: str) -> str:
    return f"""
        WITH d AS MATERIALIZED ({differences})
        SELECT count(v) AS count, CAST(sum(CAST(v AS DECIMAL(18,6))) AS DOUBLE) / count(v) AS mean,
               {std('v')} AS std, min(v) AS min, quantile_cont(v, 0.25) AS q25,
               quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75, max(v) AS max FROM d"""


def hourly_supply(start: str) -> str:
    return f"""
        SELECT h.h AS "hour", {zero('s.hours')} AS working_hours, {zero('s.cost')} AS shift_cost,
               {zero('s.rate')} AS avg_rate, {zero('s.spread')} AS std_rate
        FROM hours h LEFT JOIN (
            SELECT hour({start}) AS h, {half_even(total('shift_working_hours'))} AS hours,
                   {half_even(product('shift_working_hours', 'hourly_rate_eur'))} AS cost,
                   {half_even(mean('hourly_rate_eur'))} AS rate,
                   {half_even(std('hourly_rate_eur'))} AS spread
            FROM shifts GROUP BY 1) s ON s.h = h.h"""


def rate_by_day_hour(start: str) -> str:
    return f"""
        SELECT isodow({start}) - 1 AS weekday, hour({start}) AS "hour",
               {mean('hourly_rate_eur')} AS avg_rate, count(hourly_rate_eur) AS n
        FROM shifts GROUP BY 1, 2"""


def profile(tables: dict[str, list[str]]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{t}' AS entity, '{c}' AS "column", count(*) AS n_rows, count({c}) AS non_null,
            count(*) - count({c}) AS nulls FROM {t}"""
        for t, columns in tables.items() for c in columns)


def similar(source: str) -> str:
    return f"""SELECT booking_uuid, n AS matched_auctions, price AS avg_auction_price,
        success AS auction_success_rate FROM {source}"""


def features(source: str) -> str:
    return f"""
        SELECT m.booking_uuid, m.booked_duration, m.booked_distance,
               m.gross_revenue_eur AS expected_revenue, hour(m.booked_start_at) AS hour_of_day,
               isodow(m.booked_start_at) - 1 AS day_of_week,
               COALESCE(s.n, 0) AS available_shifts,
               CASE WHEN s.n > 0 THEN s.rate ELSE CAST(0 AS DOUBLE) END AS avg_shift_cost,
               CASE WHEN m.n > 0 THEN m.price ELSE CAST(0 AS DOUBLE) END AS avg_auction_price,
               CASE WHEN m.n > 0 THEN m.success ELSE CAST(0 AS DOUBLE) END AS auction_success_rate
        FROM {source} m LEFT JOIN daily_supply s ON s.shift_date = CAST(m.booked_start_at AS DATE)"""


FEATURES = ["booked_duration", "booked_distance", "expected_revenue", "hour_of_day", "day_of_week",
            "available_shifts", "avg_shift_cost", "avg_auction_price", "auction_success_rate"]
CORRELATED = ["booked_duration", "booked_distance", "gross_revenue_eur", "pickup_longitude",
              "pickup_latitude", "dropoff_longitude", "dropoff_latitude", P,
              "auction_corridor_min_price", "auction_corridor_max_price", "hour_of_day",
              "temperature"]
AUCTIONED_FEATURES = f"""
    SELECT f.* FROM ({features('matches')}) f
    WHERE f.booking_uuid IN (SELECT booking_uuid FROM auctions)"""
EXPECTED = """
    SELECT m.booking_uuid, COALESCE(s.n, 0) AS n_shifts, m.gross_revenue_eur AS revenue,
           CASE WHEN s.n > 0 THEN m.booked_duration / CAST({divisor} AS DOUBLE) * s.rate END AS shift_cost,
           COALESCE(CASE WHEN m.n > 0 THEN m.price END,
                    m.gross_revenue_eur * CAST(0.7 AS DOUBLE)) AS price
    FROM {source} m LEFT JOIN daily_supply s ON s.shift_date = CAST(m.booked_start_at AS DATE)"""

COST_DIFF_QUINTILES = f"""
        WITH c AS MATERIALIZED ({COSTS.format(divisor=3600)}),
             q AS (SELECT quantile_cont(booked_duration, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM c),
             edge AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i
                      FROM (SELECT DISTINCT unnest(e) AS v FROM q)),
             bin AS (SELECT a.i, a.v AS lo, b.v AS hi FROM edge a JOIN edge b ON b.i = a.i + 1)
        SELECT CAST(bin.i AS INTEGER) AS bin, bin.lo / CAST(3600 AS DOUBLE) AS duration_from,
               bin.hi / CAST(3600 AS DOUBLE) AS duration_to,
               {half_even('CAST(sum(scaled_diff) AS DOUBLE) / NULLIF(count(scaled_diff), 0) / CAST(3600 AS DOUBLE)')}
                   AS avg_cost_diff
        FROM bin LEFT JOIN c ON (booked_duration > lo OR (bin.i = 0 AND booked_duration = lo))
            AND booked_duration <= hi
        GROUP BY bin.i, bin.lo, bin.hi"""
QUERIES = {
    "supply_daily": SUPPLY_DAILY,
    "supply_daily_stats": f"""
        SELECT shift_date, count(shift_id) AS total_shifts,
               {total('shift_working_hours')} AS total_hours, {mean('hourly_rate_eur')} AS avg_rate,
               {std('hourly_rate_eur')} AS std_rate
        FROM shifts GROUP BY 1""",
    "supply_totals": f"""
        SELECT {total('shift_working_hours')} AS total_hours,
               {mean('hourly_rate_eur')} AS avg_hourly_rate,
               count(DISTINCT chauffeur_uuid) AS unique_chauffeurs FROM shifts""",
    "shift_rate_by_day_hour": rate_by_day_hour("CAST(shift_date AS TIMESTAMP)"),
    "shift_rate_by_start_hour": rate_by_day_hour("shift_start_time"),
    "hourly_supply": hourly_supply("CAST(shift_date AS TIMESTAMP)"),
    "hourly_supply_by_start": hourly_supply("shift_start_time"),
    "shift_summary": f"""
        SELECT count(*) AS total_shifts, {total('shift_working_hours')} AS total_hours,
               {mean('shift_working_hours')} AS avg_hours_per_shift,
               {mean('hourly_rate_eur')} AS avg_hourly_rate,
               {product('shift_working_hours', 'hourly_rate_eur')} AS total_cost,
               {product('shift_working_hours', 'hourly_rate_eur')}
                   / NULLIF({total('shift_working_hours')}, 0) AS cost_per_hour FROM shifts""",
    "hours_by_start_hour": f"""
        SELECT hour(shift_start_time) AS "hour", {total('shift_working_hours')} AS shift_hours
        FROM shifts GROUP BY 1""",
    "demand_daily": DEMAND_DAILY,
    "demand_date_spine": f"""
        SELECT CAST(g.d AS DATE) AS booking_date, {zero('b.total_bookings')} AS total_bookings,
               {zero('b.total_revenue')} AS total_revenue, {zero('b.avg_duration')} AS avg_duration,
               {zero('b.avg_distance')} AS avg_distance
        FROM (SELECT unnest(generate_series(min(CAST(booked_start_at AS DATE)),
                     max(CAST(booked_start_at AS DATE)), INTERVAL 1 DAY)) AS d FROM bookings) g
        LEFT JOIN ({DEMAND_DAILY}) b ON b.booking_date = CAST(g.d AS DATE)""",
    "demand_daily_stats": f"""
        SELECT CAST(booked_start_at AS DATE) AS booking_date,
               count(booking_uuid) AS total_bookings,
               {total('gross_revenue_eur')} AS total_revenue,
               {mean('gross_revenue_eur')} AS avg_revenue,
               {mean('booked_duration')} AS avg_duration, {std('booked_duration')} AS std_duration,
               {mean('booked_distance')} AS avg_distance, {std('booked_distance')} AS std_distance
        FROM bookings GROUP BY 1""",
    "demand_totals": f"""
        SELECT {total('gross_revenue_eur')} AS total_revenue,
               {mean('booked_duration')} AS avg_trip_duration,
               {mean('booked_distance')} AS avg_trip_distance FROM bookings""",
    "hourly_demand": HOURLY_DEMAND,
    "hourly_utilization": f"""
        SELECT hour(booked_start_at) AS "hour",
               {half_even(total('booked_duration') + ' / CAST(60 AS DOUBLE)')} AS hours_used_sum,
               count(booked_duration) AS hours_used_count,
               {half_even(total('gross_revenue_eur'))} AS gross_revenue_eur
        FROM bookings GROUP BY 1""",
    "lost_revenue": f"""
        SELECT l.n AS total_cases, l.seconds / 3600 AS total_hours, l.distance AS avg_distance_km,
               l.duration / 60 AS avg_duration_minutes,
               CASE WHEN e.duration / 60 > 0 THEN e.revenue / (e.duration / 60) ELSE 0 END
                   * (l.seconds / 60) AS estimated_lost_revenue
        FROM (SELECT count(*) AS n, {total('booked_duration')} AS seconds,
                     {mean('booked_distance')} AS distance, {mean('booked_duration')} AS duration
              FROM bookings WHERE gross_revenue_eur = 0) l,
             (SELECT {mean('gross_revenue_eur')} AS revenue, {mean('booked_duration')} AS duration
              FROM bookings WHERE gross_revenue_eur > 0) e
        WHERE l.n > 0""",
    "lost_revenue_details": """
        SELECT booking_uuid, strftime(booked_start_at, '%Y-%m-%d %H:%M') AS start_time,
               booked_distance AS distance_km, booked_duration / 60 AS duration_min
        FROM bookings WHERE gross_revenue_eur = 0""",
    "auction_metrics": matrix({
        "min_price": "auction_corridor_min_price", "max_price": "auction_corridor_max_price",
        "winning_price": P, "profit_margin": f"({P} - auction_corridor_min_price)",
    }, ["mean", "std"]),
    "auction_price_matrix": matrix({
        "auction_corridor_min_price": "auction_corridor_min_price",
        "auction_corridor_max_price": "auction_corridor_max_price", P: P,
        "margin": f"({P} - auction_corridor_min_price)",
    }, ["mean", "std", "min", "max"]),
    "auction_price_by_day_hour": f"""
        SELECT w AS weekday, h AS "hour", {mean(P)} AS avg_price, count({P}) AS n
        FROM auction_bookings WHERE h IS NOT NULL GROUP BY w, h""",
    "peak_price_slots": f"""
        SELECT w AS weekday, h AS "hour", {mean(P)} AS avg_price, count({P}) AS n
        FROM auction_bookings WHERE h IS NOT NULL GROUP BY w, h
        ORDER BY avg_price DESC NULLS LAST, w, h LIMIT 5""",
    "hourly_auctions": f"""
        SELECT *, price_mean - price_std AS band_low, price_mean + price_std AS band_high
        FROM (SELECT h AS "hour", {half_even(mean(P))} AS price_mean,
                     {half_even(f'stddev_samp({P})')} AS price_std,
                     {half_even(f'min({P})')} AS price_min, {half_even(f'max({P})')} AS price_max,
                     {half_even(mean('auction_corridor_min_price'))} AS corridor_min_mean,
                     {half_even(mean('auction_corridor_max_price'))} AS corridor_max_mean
              FROM auction_bookings WHERE h IS NOT NULL GROUP BY h)""",
    "auction_price_vs_revenue_by_hour": f"""
        SELECT h AS "hour", {mean(P)} AS avg_auction_price, {mean('gross_revenue_eur')} AS avg_revenue
        FROM auctioned GROUP BY h""",
    "auction_price_vs_revenue_table": f"""
        SELECT h AS "hour",
               COALESCE('€' || printf('%.2f', {mean(P)}), 'N/A') AS avg_auction_price,
               COALESCE('€' || printf('%.2f', {mean('gross_revenue_eur')}), 'N/A') AS avg_revenue
        FROM auctioned GROUP BY h""",
    "peak_hours_price_vs_cost": f"""
        SELECT h AS "hour", {half_even('price')} AS avg_auction_price,
               {half_even('rate')} AS avg_shift_cost,
               {half_even(half_even('price') + ' - ' + half_even('rate'))} AS price_difference
        FROM ({PEAK})""",
    "peak_hours_top6": f"""
        SELECT printf('%02d:00 - %02d:59', h, h) AS time_range, n AS num_bookings,
               price AS avg_auction_price, rate AS avg_shift_cost,
               COALESCE(price - rate, 0) AS price_difference
        FROM ({PEAK} ORDER BY n DESC, x.h LIMIT 6)""",
    "peak_hours_revenue": f"""
        SELECT b.h AS "hour", printf('%02d:00 - %02d:00', b.h, b.h + 1) AS time_range,
               b.n AS num_bookings, b.revenue AS avg_revenue, r.rate AS avg_shift_cost,
               b.revenue - r.rate AS revenue_difference
        FROM (SELECT hour(booked_start_at) AS h, count(gross_revenue_eur) AS n,
                     {mean('gross_revenue_eur')} AS revenue FROM bookings GROUP BY 1) b,
             (SELECT {mean('rate')} AS rate FROM (
                 SELECT {mean('hourly_rate_eur')} AS rate FROM shifts GROUP BY shift_id)) r""",
    "peak_hours_full": FULL_HOURS,
    "peak_hours_overview": f"""
        SELECT {mean('total_bookings')} AS avg_bookings_per_hour,
               {mean('avg_revenue')} AS avg_revenue_per_hour,
               {mean('avg_duration')} AS avg_duration_minutes FROM ({FULL_HOURS})""",
    "hourly_cost_curve": COST_CURVE,
    "cost_recommendations": f"""
        SELECT COALESCE(string_agg(CAST(hour_of_day AS VARCHAR), ',' ORDER BY hour_of_day)
                        FILTER (cost_diff < 0), '') AS prefer_shifts,
               COALESCE(string_agg(CAST(hour_of_day AS VARCHAR), ',' ORDER BY hour_of_day)
                        FILTER (cost_diff > 0), '') AS prefer_auctions,
               {mean('abs(cost_diff)')} AS avg_potential_savings FROM ({COST_CURVE})""",
    "kpis": f"""
        SELECT s.hours / b.rows AS hours_per_booking, b.revenue / s.hours AS revenue_per_hour,
               s.cost / s.hours AS cost_per_hour,
               (b.revenue - s.cost) / b.revenue AS gross_margin,
               (SELECT CAST(count({P}) AS DOUBLE) / count(*) FROM auctions) AS auction_success_rate
        FROM {SHIFT_SUMS} s, {BOOKING_SUMS} b""",
    "hours_distribution": f"""
        SELECT h.h AS "hour", {zero('b.hours')} AS utilized_hours, {zero('s.hours')} AS prepurchased_hours
        FROM hours h
        LEFT JOIN (SELECT hour(booked_start_at) AS h,
                          {total('booked_duration')} / CAST(3600 AS DOUBLE) AS hours
                   FROM bookings GROUP BY 1) b ON b.h = h.h
        LEFT JOIN (SELECT hour(CAST(shift_date AS TIMESTAMP)) AS h,
                          {total('shift_working_hours')} AS hours FROM shifts GROUP BY 1) s
        ON s.h = h.h""",
    "hours_distribution_totals": f"""
        SELECT b.duration / 3600 AS total_utilized, s.hours AS total_prepurchased,
               s.hours - b.duration / 3600 AS unused_hours,
               CASE WHEN s.hours > 0 THEN b.duration / 3600 * 100 / s.hours ELSE 0 END
                   AS utilization_rate
        FROM {SHIFT_SUMS} s, {BOOKING_SUMS} b""",
    "hours_distribution_aligned": f"""
        SELECT COALESCE(s.h, b.h) AS "hour", {zero('s.hours')} AS shift_hours,
               {zero('b.hours')} AS booking_hours,
               CASE WHEN {zero('s.hours')} = 0 AND {zero('b.hours')} = 0 THEN 0
                    ELSE {zero('b.hours')} / NULLIF({zero('s.hours')}, 0) * 100 END
                   AS utilization_rate
        FROM (SELECT hour(shift_start_time) AS h, {total('shift_working_hours')} AS hours
              FROM shifts GROUP BY 1) s
        FULL JOIN (SELECT hour(booked_start_at) AS h, {total('booked_duration')} AS hours
                   FROM bookings GROUP BY 1) b ON s.h = b.h""",
    "hours_distribution_aligned_totals": f"""
        SELECT s.hours AS total_shift_hours, b.duration AS total_booking_hours,
               CASE WHEN s.hours > 0 THEN b.duration * 100 / s.hours ELSE 0 END AS overall_utilization
        FROM {SHIFT_SUMS} s, {BOOKING_SUMS} b""",
    "hours_totals": f"""
        SELECT s.hours AS total_scheduled_hours, b.duration AS total_active_hours,
               s.hours - b.duration AS unused_hours,
               CASE WHEN s.hours > 0 THEN b.duration * 100 / s.hours ELSE 0 END AS utilization_rate,
               s.cost AS total_cost, b.revenue AS total_revenue
        FROM {SHIFT_SUMS} s, {BOOKING_SUMS} b""",
    "supply_demand_summary": f"""
        SELECT s.hours AS total_hours, d.hours AS total_booked_hours, d.revenue AS total_revenue,
               d.n AS total_bookings, a.price AS avg_winning_price, a.spread AS std_winning_price,
               CASE WHEN d.n > 0 THEN d.hours / d.n ELSE 0 END AS hours_per_booking,
               CASE WHEN s.hours > 0 THEN d.revenue / s.hours ELSE 0 END AS revenue_per_hour,
               CASE WHEN s.hours > 0 THEN d.hours * 100 / s.hours ELSE 0 END AS utilization_rate
        FROM {SHIFT_SUMS} s,
             (SELECT {total('booked_duration')} AS hours, {total('revenue_sum')} AS revenue,
                     CAST(sum(booking_count) AS BIGINT) AS n FROM ({HOURLY_DEMAND})) d,
             (SELECT {mean(P)} AS price, {std(P)} AS spread FROM auctions) a""",
    "daily_supply_demand": DAILY_BALANCE,
    "daily_supply_demand_overview": f"""
        SELECT {mean('total_shifts')} AS avg_daily_shifts, {mean('total_bookings')} AS avg_daily_bookings,
               {mean('utilization_rate')} * 100 AS avg_utilization_pct,
               {mean('revenue_per_hour')} AS avg_revenue_per_hour,
               {total('total_booking_hours')} * 100 / NULLIF({total('total_shift_hours')}, 0)
                   AS overall_utilization_pct FROM ({DAILY_BALANCE})""",
    "shift_utilization_summary": f"""
        SELECT b.duration / 3600 AS total_utilized_hours, s.hours AS total_shift_hours,
               s.hours - b.duration / 3600 AS unused_hours,
               CASE WHEN s.hours > 0 THEN b.duration / 3600 * 100 / s.hours ELSE 0 END
                   AS utilization_rate,
               b.revenue AS total_revenue, s.cost AS total_shift_cost,
               CASE WHEN b.duration > 0 THEN b.revenue / (b.duration / 3600) ELSE 0 END
                   AS revenue_per_hour,
               CASE WHEN s.hours > 0 THEN s.cost / s.hours ELSE 0 END AS cost_per_hour
        FROM {SHIFT_SUMS} s, {BOOKING_SUMS} b""",
    "supply_vs_demand_series": f"""
        SELECT COALESCE(s.d, b.d) AS date, s.hours AS supply_hours, b.n AS bookings
        FROM (SELECT shift_date AS d, {total('shift_working_hours')} AS hours FROM shifts
              GROUP BY 1) s
        FULL JOIN (SELECT CAST(booked_start_at AS DATE) AS d, count(*) AS n FROM bookings
                   GROUP BY 1) b ON s.d = b.d""",
    "cost_revenue": COST_REVENUE,
    "cost_revenue_unit": f"""
        SELECT s.cost AS total_shift_cost, b.revenue AS total_revenue,
               b.revenue - s.cost AS profit_loss,
               (SELECT {mean('gross_revenue_eur')} FROM bookings) AS avg_revenue_per_booking,
               (SELECT {product('shift_working_hours', 'hourly_rate_eur')}
                       / count(shift_working_hours * hourly_rate_eur) FROM shifts)
                   AS avg_cost_per_shift
        FROM {SHIFT_SUMS} s, {BOOKING_SUMS} b""",
    "cost_revenue_margin": f"""
        SELECT total_revenue, profit,
               CASE WHEN total_revenue > 0 THEN profit * 100 / total_revenue ELSE 0 END
                   AS profit_margin_pct FROM ({COST_REVENUE})""",
    "shift_utilization_by_chauffeur": BY_CHAUFFEUR,
    "utilization_totals": f"""
        SELECT {total('shift_working_hours')} AS total_scheduled_hours,
               {total('booked_hours')} AS total_actual_hours,
               {total('unused_hours')} AS total_unused_hours,
               {half_even(total('booked_hours') + ' / ' + total('shift_working_hours') + ' * 100')}
                   AS average_utilization_rate,
               {product('hourly_rate_eur', 'shift_working_hours')} AS total_cost,
               {total('gross_revenue_eur')} AS total_revenue, count(*) AS total_chauffeurs
        FROM ({BY_CHAUFFEUR})""",
    "top_performers": performers("DESC"),
    "bottom_performers": performers("ASC"),
    "top_performers_of_long_shifts": performers("DESC", 10),
    "bottom_performers_of_long_shifts": performers("ASC", 10),
    "supply_daily_from_csv": SUPPLY_DAILY,
    "booking_costs": booking_costs(3600),
    "booking_costs_minutes": booking_costs(60),
    "cost_comparison_summary": f"""
        SELECT (SELECT {product('shift_working_hours', 'hourly_rate_eur')} FROM shifts)
                   AS total_shift_cost,
               (SELECT {mean(P)} FROM auctions) AS avg_auction_price,
               CAST(sum(scaled_diff) AS DOUBLE) / count(scaled_diff) / CAST(3600 AS DOUBLE)
                   AS avg_cost_diff,
               CAST(count(*) FILTER (scaled_diff < 0) AS DOUBLE) / count(scaled_diff) * 100
                   AS auction_cheaper_pct,
               CAST(count(*) FILTER (scaled_diff > 0) AS DOUBLE) / count(scaled_diff) * 100
                   AS shift_cheaper_pct
        FROM ({COSTS.format(divisor=3600)})""",
    "cost_diff_by_hour": f"""
        SELECT hour(booked_start_at) AS "hour",
               CAST(sum(scaled_diff) AS DOUBLE) / NULLIF(count(scaled_diff), 0)
                   / CAST(3600 AS DOUBLE) AS avg_cost_diff
        FROM ({COSTS.format(divisor=3600)}) GROUP BY 1""",
    "cost_diff_by_duration_quintile": COST_DIFF_QUINTILES,
    "cost_diff_by_duration": COST_DIFF_QUINTILES,
    "cost_diff_of_one_duration": difference_summary(
        f"SELECT {P} - hourly_rate_eur * (CAST(1800 AS DOUBLE) / CAST(3600 AS DOUBLE)) AS v "
        "FROM trip_costs"),
    "cost_diff_summary": difference_summary(
        f"SELECT {P} - cost AS v FROM ({COSTS.format(divisor=3600)})"),
    "cost_summary": f"""
        SELECT (SELECT {product('shift_working_hours', 'hourly_rate_eur')} FROM shifts)
                   AS total_shift_cost,
               (SELECT {mean('hourly_rate_eur')} FROM shifts) AS avg_hourly_rate,
               {mean(P)} AS avg_auction_price, {std(P)} AS std_auction_price,
               min({P}) AS min_auction_price, max({P}) AS max_auction_price FROM auctions""",
    "price_histogram": histogram("SELECT * FROM auctions", {P: P}, 50),
    "cost_diff_histogram": exact_histogram(
        COSTS.format(divisor=3600), {"cost_diff": "diff_units"}, 50, 3600),
    "cost_vs_price_histogram": exact_histogram(
        COSTS.format(divisor=60), {"shift_cost": "cost_units", "auction_price": "price_units"},
        50, 60),
    "cost_curve_histogram": histogram(COST_CURVE, {"cost_diff": "cost_diff"}, 10),
    "rate_box_summary": """
        SELECT count(v) AS n, min(v) AS min, max(q1) AS q1, max(q2) AS median, max(q3) AS q3,
               max(v) AS max,
               min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
               max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
               count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM (SELECT hourly_rate_eur AS v FROM shifts),
             (SELECT quantile_cont(hourly_rate_eur, 0.25) AS q1,
                     quantile_cont(hourly_rate_eur, 0.5) AS q2,
                     quantile_cont(hourly_rate_eur, 0.75) AS q3 FROM shifts)""",
    "describe_daily": describe(SUPPLY_DAILY, ["total_shifts", "total_hours", "avg_rate"])
    + " UNION ALL "
    + describe(DEMAND_DAILY, ["total_bookings", "total_revenue", "avg_duration", "avg_distance"]),
    "pickup_grid": grid("pickup"),
    "dropoff_grid": grid("dropoff"),
    "grid_top5": f"""SELECT * FROM ({grid('pickup')}) WHERE avg_price IS NOT NULL
        ORDER BY avg_price DESC, pickup_grid_x, pickup_grid_y LIMIT 5""",
    "price_map_points": f"""
        SELECT booking_uuid, 'pickup' AS endpoint, pickup_latitude AS latitude,
               pickup_longitude AS longitude, {P} AS price FROM auctioned
        UNION ALL SELECT booking_uuid, 'dropoff', dropoff_latitude, dropoff_longitude, {P}
        FROM auctioned""",
    "price_map_centre": f"""
        SELECT 'pickup' AS endpoint, {mean('pickup_latitude')} AS latitude,
               {mean('pickup_longitude')} AS longitude FROM auctioned
        UNION ALL SELECT 'dropoff', {mean('dropoff_latitude')}, {mean('dropoff_longitude')}
        FROM auctioned""",
    "price_by_hour": f"""
        SELECT h AS "hour", {mean(P)} AS avg_price, count({P}) AS n FROM auctioned
        WHERE h IS NOT NULL GROUP BY h""",
    "price_by_weekday": f"""
        SELECT dayname(booked_start_at) AS day_of_week, {mean(P)} AS avg_price FROM auctioned
        GROUP BY 1""",
    "price_by_weather": f"""
        SELECT weather_condition, {mean(P)} AS avg_price, count({P}) AS n FROM in_context
        WHERE weather_condition IS NOT NULL GROUP BY 1""",
    "temperature_price_points": f"""
        SELECT temperature, {P}, count(*) AS n FROM in_context
        WHERE temperature IS NOT NULL AND {P} IS NOT NULL GROUP BY 1, 2""",
    "price_by_event_type": f"""
        SELECT event_type, {mean(P)} AS avg_price, count({P}) AS n FROM in_context
        WHERE event_type IS NOT NULL GROUP BY 1""",
    "price_event_vs_regular": f"""
        SELECT CASE WHEN event_type IS NOT NULL THEN 'Event Day' ELSE 'Regular Day' END AS has_event,
               {mean(P)} AS avg_price, count({P}) AS n FROM in_context GROUP BY 1""",
    "correlation_matrix": correlation(CORRELATED),
    "bookings_by_weekday": f"""
        SELECT w AS weekday, name AS day_of_week, n AS bookings FROM ({BY_WEEKDAY}) ORDER BY w""",
    "bookings_by_hour": f"""SELECT h AS "hour", n AS bookings FROM ({BY_HOUR}) ORDER BY h""",
    "weekday_hour_heatmap": "SELECT d.w AS weekday, d.name AS day_of_week, "
    + ", ".join(f"b.h{h:02d}" for h in range(24))
    + " FROM weekdays d LEFT JOIN (SELECT isodow(booked_start_at) - 1 AS w, "
    + ", ".join(f"count(booking_uuid) FILTER (hour(booked_start_at) = {h}) AS h{h:02d}"
                for h in range(24))
    + " FROM bookings GROUP BY 1) b ON b.w = d.w ORDER BY d.w",
    "seasonality_summary": seasonality("booked_start_at IS NOT NULL"),
    "seasonality_summary_range": seasonality(
        "CAST(booked_start_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"),
    "weekday_insights": f"""
        SELECT (SELECT name FROM ({BY_WEEKDAY}) WHERE n IS NOT NULL ORDER BY n DESC, w LIMIT 1)
                   AS busiest_day,
               max(n) AS busiest_bookings,
               (SELECT name FROM ({BY_WEEKDAY}) WHERE n IS NOT NULL ORDER BY n, w LIMIT 1)
                   AS quietest_day,
               min(n) AS quietest_bookings,
               avg(n) FILTER (w >= 5) / avg(n) FILTER (w < 5) AS weekend_weekday_ratio
        FROM ({BY_WEEKDAY})""",
    "hour_insights": f"""
        SELECT * FROM (
            SELECT 'peak' AS kind, row_number() OVER (ORDER BY n DESC, h) AS rank, h AS "hour",
                   n AS bookings FROM ({BY_HOUR})
            UNION ALL SELECT 'off_peak', row_number() OVER (ORDER BY n, h), h, n FROM ({BY_HOUR}))
        WHERE rank <= 3""",
    "similar_auctions": similar("matches"),
    "similar_auctions_excluding_self": """
        SELECT b.booking_uuid, CAST(COALESCE(m.n, 0) - COALESCE(o.n, 0) AS BIGINT) AS matched_auctions,
               CAST(m.sum_price - COALESCE(o.sum_price, 0) AS DOUBLE)
                   / NULLIF(m.n_price - COALESCE(o.n_price, 0), 0) AS avg_auction_price,
               CAST(m.n_price - COALESCE(o.n_price, 0) AS DOUBLE)
                   / NULLIF(m.n - COALESCE(o.n, 0), 0) AS auction_success_rate
        FROM bookings b
        LEFT JOIN cell_matches m ON b.booked_duration = m.d AND b.booked_distance = m.x
        LEFT JOIN (SELECT booking_uuid, count(*) AS n, count(auction_winning_price) AS n_price,
                          sum(CAST(auction_winning_price AS DECIMAL(18,6))) AS sum_price
                   FROM auctions GROUP BY 1) o ON o.booking_uuid = b.booking_uuid""",
    "similar_auctions_1d": similar("matches_1d"),
    "available_shifts": """
        SELECT b.booking_uuid, COALESCE(s.n, 0) AS available_shifts,
               CASE WHEN s.n > 0 THEN s.rate ELSE CAST(0 AS DOUBLE) END AS avg_shift_cost
        FROM bookings b LEFT JOIN daily_supply s ON s.shift_date = CAST(b.booked_start_at AS DATE)""",
    "decision_features": features("matches"),
    "decision_features_1d": features("matches_1d"),
    "feature_scaling": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {mean(c)} AS mean, round_even(stddev_pop({c}), 6) AS scale "
        f"FROM ({AUCTIONED_FEATURES})" for c in FEATURES),
    "training_labels": f"""
        SELECT b.booking_uuid,
               CASE WHEN s.n > 0 THEN b.booked_duration / CAST(60 AS DOUBLE) * s.rate END AS shift_cost,
               a.{P} AS auction_price,
               COALESCE(CASE WHEN s.n > 0 THEN b.booked_duration / CAST(60 AS DOUBLE) * s.rate END
                        < a.{P}, FALSE) AS profitable
        FROM bookings b JOIN auctions a ON a.booking_uuid = b.booking_uuid
        LEFT JOIN daily_supply s ON s.shift_date = CAST(b.booked_start_at AS DATE)""",
    "decision_costs": f"""
        SELECT booking_uuid, n_shifts AS available_shifts, shift_cost AS expected_shift_cost,
               price AS expected_auction_price,
               revenue - LEAST(shift_cost, price) AS expected_profit
        FROM ({EXPECTED.format(divisor=60, source='matches')})""",
    "expected_profit_weighted": f"""
        SELECT booking_uuid, shift_cost AS expected_shift_cost, price AS expected_auction_price,
               CAST(0.5 AS DOUBLE) * (revenue - shift_cost)
                   + (1 - CAST(0.5 AS DOUBLE)) * (revenue - price) AS expected_profit
        FROM ({EXPECTED.format(divisor=1, source='matches_1d')})""",
    "data_profile": profile({
        "bookings": ["booking_uuid", "chauffeur_uuid", "booked_start_at", "booked_duration",
                     "booked_distance", "gross_revenue_eur", "pickup_longitude", "pickup_latitude",
                     "dropoff_longitude", "dropoff_latitude"],
        "shifts": ["shift_id", "chauffeur_uuid", "shift_date", "shift_working_hours",
                   "hourly_rate_eur", "shift_start_time", "hourly_rate_raw"],
        "auctions": ["booking_uuid", P, "auction_corridor_min_price", "auction_corridor_max_price",
                     "auction_start_time", "auction_end_time"],
        "weather": ["date", "weather_condition", "temperature"],
        "calendar": ["event_date", "event_type", "event_name"],
    }),
    "impute_shifts": """
        SELECT shift_id, chauffeur_uuid, shift_date, COALESCE(shift_working_hours, 8)
                   AS shift_working_hours,
               COALESCE(hourly_rate_eur, (SELECT quantile_cont(hourly_rate_eur, 0.5) FROM shifts))
                   AS hourly_rate_eur FROM shifts""",
    "clean_shifts": """
        SELECT shift_id, rate AS hourly_rate_eur, hour(shift_start_time) AS hour_of_day,
               shift_working_hours, shift_working_hours - shift_working_hours / 2 AS unused_hours
        FROM (SELECT *, TRY_CAST(trim(replace(hourly_rate_raw, ',', '')) AS DOUBLE) AS rate
              FROM shifts) WHERE rate IS NOT NULL""",
    "clean_auctions": f"""
        SELECT booking_uuid, {P}, auction_corridor_min_price, auction_corridor_max_price,
               auction_start_time, auction_end_time, hour(auction_start_time) AS hour_of_day
        FROM auctions WHERE {P} IS NOT NULL""",
    "stream_supply_demand": f"""
        SELECT b.date, b.n AS total_bookings, b.seconds AS total_booking_duration,
               b.revenue AS total_revenue, {zero('s.total_shifts')} AS total_shifts,
               {zero('s.total_hours')} AS total_shift_hours
        FROM (SELECT CAST(booked_start_at AS DATE) AS date, count(booking_uuid) AS n,
                     {total('booked_duration')} AS seconds, {total('gross_revenue_eur')} AS revenue
              FROM bookings GROUP BY 1) b
        LEFT JOIN ({SUPPLY_DAILY}) s ON s.shift_date = b.date
        WHERE b.date + 1 <= (SELECT max(booked_start_at) - INTERVAL 1 HOUR FROM bookings)""",
    "stream_corrected_days": f"""
        SELECT b.date, b.n AS total_bookings, b.seconds AS total_booking_duration,
               b.revenue AS total_revenue, {zero('s.total_shifts')} AS total_shifts,
               {zero('s.total_hours')} AS total_shift_hours
        FROM (SELECT CAST(booked_start_at AS DATE) AS date, count(booking_uuid) AS n,
                     {total('booked_duration')} AS seconds, {total('gross_revenue_eur')} AS revenue
              FROM bookings GROUP BY 1) b
        LEFT JOIN ({SUPPLY_DAILY}) s ON s.shift_date = b.date
        WHERE b.date IS NOT NULL""",
}


# Queries whose hours, weekdays and ranks are 32-bit; the functions of the SQL engine give 64.
HOURLY = ("hours_by_start_hour hourly_utilization hourly_auctions auction_price_vs_revenue_by_hour "
          "auction_price_vs_revenue_table peak_hours_price_vs_cost peak_hours_revenue "
          "peak_hours_full hours_distribution_aligned cost_diff_by_hour price_by_hour "
          "bookings_by_hour").split()
AS_INTEGER = {
    **{name: ["hour"] for name in HOURLY},
    **{name: ["weekday", "hour"] for name in (
        "shift_rate_by_day_hour", "shift_rate_by_start_hour", "auction_price_by_day_hour",
        "peak_price_slots")},
    **{name: ["hour_of_day", "day_of_week"] for name in (
        "decision_features", "decision_features_1d")},
    "hour_insights": ["rank", "hour"],
    "clean_shifts": ["hour_of_day"],
    "clean_auctions": ["hour_of_day"],
}


def all_sql() -> dict[str, str]:
    return {name: with_tables(_typed(name, query)) for name, query in QUERIES.items()}


def _typed(name: str, query: str) -> str:
    casts = ", ".join(f'CAST("{c}" AS INTEGER) AS "{c}"' for c in AS_INTEGER.get(name, []))
    return f"SELECT * REPLACE ({casts}) FROM ({query})" if casts else query


def with_tables(query: str) -> str:
    """Prefix the derived tables a query uses, directly or through others."""
    used: list[str] = []

    def visit(text: str) -> None:
        for table, body in TABLES.items():
            if re.search(rf"\b(?:FROM|JOIN)\s+{table}\b|,\s*{table}\b", text) and table not in used:
                visit(body)
                used.append(table)

    visit(query)
    heads = ",\n".join(f"{t} AS ({_means(TABLES[t])})" for t in used)
    nested = re.match(r"\s*WITH\s", query)
    body = re.sub(r"^\s*WITH\s", "", query) if nested else query
    return f"WITH {heads}{', ' if nested else ' '}{body}"


def _means(text: str) -> str:
    return re.sub(r"\{mean:(\w+)\}", lambda found: mean(found[1]), text)
