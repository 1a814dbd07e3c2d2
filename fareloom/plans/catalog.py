"""Every named analysis, run on the marketplace derived from the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fareloom.functions.keys import key_names, null_key
from fareloom.functions.stats import box_summary, describe, histogram
from fareloom.operators import (
    auctions as A, balance as B, band, cleaning, context, costs, decision, demand as D, geo,
    profile, seasonality as S, supply as U, utilization as Z)
from fareloom.session import shared_folder, shared_stages, written
from fareloom.sources.marketplace import Marketplace
from fareloom.sources.sinks import write_results
from fareloom.sources.tables import EVENTS, DerivedMarketplace, bookings_of
from fareloom.streaming import jobs

Analysis = Callable[[DerivedMarketplace], DataFrame]


def _clean_shifts(m: DerivedMarketplace) -> DataFrame:
    raw = m.shifts.withColumn("hours_used", F.col("shift_working_hours") / 2)
    return cleaning.clean_shifts(raw, rate="hourly_rate_raw", strict=False).select(
        "shift_id", "hourly_rate_eur", "hour_of_day", "shift_working_hours", "unused_hours")


def _clean_auctions(m: DerivedMarketplace) -> DataFrame:
    return cleaning.clean_auctions(m.auctions)


def _cost_curve(m: DerivedMarketplace) -> DataFrame:
    return A.hourly_cost_curve(
        cleaning.clean_shifts(m.shifts), cleaning.clean_auctions(m.auctions), trip_duration=1.5)


def _cost_recommendations(m: DerivedMarketplace) -> DataFrame:
    return A.cost_recommendations(_cost_curve(m)).withColumns({
        c: F.array_join(F.col(c).cast("array<string>"), ",")
        for c in ("prefer_shifts", "prefer_auctions")})


def _describe_daily(m: DerivedMarketplace) -> DataFrame:
    supply = describe(U.supply_daily(m.shifts), {
        c: F.col(c) for c in ("total_shifts", "total_hours", "avg_rate")})
    demand = describe(D.demand_daily(m.bookings), {
        c: F.col(c) for c in ("total_bookings", "total_revenue", "avg_duration", "avg_distance")})
    return supply.unionByName(demand)


def _supply_from_csv(m: DerivedMarketplace) -> DataFrame:
    """Daily supply of shifts that were written as CSV and read back."""
    path = shared_folder(m.spark, "csv")
    tables = {"shifts": m.shifts.drop("hourly_rate_raw"), "bookings": m.bookings,
              "auctions": m.auctions}
    write_results(tables, path)
    read = Marketplace.from_csv(m.spark, **{name: f"{path}/{name}" for name in tables})
    return U.supply_daily(read.shifts)


def _long_shifts(m: DerivedMarketplace) -> DataFrame:
    """Shifts so long that driven time stays below them."""
    return m.shifts.withColumn("shift_working_hours", F.col("shift_working_hours") * 10)


def _one_duration(m: DerivedMarketplace) -> DataFrame:
    """The report by duration where all bookings last half an hour, which leaves no bins."""
    return costs.cost_diff_by_duration(
        m.bookings.withColumn("booked_duration", F.lit(1800.0)), m.auctions, m.shifts)


def _own_duration(m: DerivedMarketplace) -> DataFrame:
    """Auctions that carry the duration of their booking."""
    key = key_names("booking_uuid")
    return m.auctions.select("*", *null_key(m.auctions, "booking_uuid")).join(
        m.bookings.select("booked_duration", *null_key(m.bookings, "booking_uuid")), key, "left"
    ).drop(*key)


def _training(m: DerivedMarketplace) -> DataFrame:
    return decision.training_set(m.bookings, m.shifts, m.auctions)


def _model(m: DerivedMarketplace):
    return decision.fit_model(written(_training(m), "training"))


def _dispatch_model(m: DerivedMarketplace) -> DataFrame:
    training = written(_training(m), "training")
    return decision.model_predictions(training, decision.fit_model(training))


ANALYSES: dict[str, Analysis] = {
    # supply
    "supply_daily": lambda m: U.supply_daily(m.shifts),
    "supply_daily_stats": lambda m: U.supply_daily_stats(m.shifts),
    "supply_totals": lambda m: U.supply_totals(m.shifts),
    "shift_rate_by_day_hour": lambda m: U.shift_rate_by_day_hour(m.shifts),
    "shift_rate_by_start_hour": lambda m: U.shift_rate_by_day_hour(m.shifts, "shift_start_time"),
    "hourly_supply": lambda m: U.hourly_supply(m.shifts),
    "hourly_supply_by_start": lambda m: U.hourly_supply(m.shifts, "shift_start_time"),
    "shift_summary": lambda m: U.shift_summary(m.shifts),
    "hours_by_start_hour": lambda m: U.hours_by_start_hour(m.shifts),
    # demand
    "demand_daily": lambda m: D.demand_daily(m.bookings),
    "demand_date_spine": lambda m: D.demand_date_spine(m.bookings),
    "demand_daily_stats": lambda m: D.demand_daily_stats(m.bookings),
    "demand_totals": lambda m: D.demand_totals(m.bookings),
    "hourly_demand": lambda m: D.hourly_demand(m.bookings),
    "hourly_utilization": lambda m: D.hourly_utilization(m.bookings),
    "lost_revenue": lambda m: D.lost_revenue(m.bookings),
    "lost_revenue_details": lambda m: D.lost_revenue_details(m.bookings),
    # auctions
    "auction_metrics": lambda m: A.auction_metrics(m.auctions),
    "auction_price_matrix": lambda m: A.auction_price_matrix(m.auctions),
    "auction_price_by_day_hour": lambda m: A.auction_price_by_day_hour(m.auctions, m.bookings),
    "peak_price_slots": lambda m: A.peak_price_slots(m.auctions, m.bookings),
    "hourly_auctions": lambda m: A.hourly_auctions(m.auctions, m.bookings),
    "auction_price_vs_revenue_by_hour":
        lambda m: A.auction_price_vs_revenue_by_hour(m.bookings, m.auctions),
    "auction_price_vs_revenue_table":
        lambda m: A.auction_price_vs_revenue_table(m.bookings, m.auctions),
    "peak_hours_price_vs_cost":
        lambda m: A.peak_hours_price_vs_cost(m.auctions, m.bookings, m.shifts),
    "peak_hours_top6": lambda m: A.peak_hours_top(m.auctions, m.bookings, m.shifts),
    "peak_hours_revenue": lambda m: A.peak_hours_revenue(m.bookings, m.shifts),
    "peak_hours_full": lambda m: A.peak_hours_full(m.bookings, m.auctions),
    "peak_hours_overview": lambda m: A.peak_hours_overview(m.bookings, m.auctions),
    "hourly_cost_curve": _cost_curve,
    "cost_recommendations": _cost_recommendations,
    # supply against demand
    "kpis": lambda m: B.kpis(m.shifts, m.bookings, m.auctions),
    "hours_distribution": lambda m: B.hours_distribution(m.shifts, m.bookings),
    "hours_distribution_totals": lambda m: B.hours_distribution_totals(m.shifts, m.bookings),
    "hours_distribution_aligned": lambda m: B.hours_distribution_aligned(m.shifts, m.bookings),
    "hours_distribution_aligned_totals":
        lambda m: B.hours_distribution_aligned_totals(m.shifts, m.bookings),
    "hours_totals": lambda m: B.hours_totals(m.shifts, m.bookings),
    "supply_demand_summary":
        lambda m: B.supply_demand_summary(m.shifts, m.bookings, m.auctions),
    "daily_supply_demand": lambda m: B.daily_supply_demand(m.shifts, m.bookings),
    "daily_supply_demand_overview":
        lambda m: B.daily_supply_demand_overview(m.shifts, m.bookings),
    "shift_utilization_summary": lambda m: B.shift_utilization_summary(m.shifts, m.bookings),
    "supply_vs_demand_series": lambda m: B.supply_vs_demand_series(m.shifts, m.bookings),
    "cost_revenue": lambda m: B.cost_revenue(m.shifts, m.bookings, m.auctions),
    "cost_revenue_unit": lambda m: B.cost_revenue_unit(m.shifts, m.bookings),
    "cost_revenue_margin": lambda m: B.cost_revenue_margin(m.shifts, m.bookings, m.auctions),
    # chauffeurs
    "shift_utilization_by_chauffeur":
        lambda m: Z.shift_utilization_by_chauffeur(m.shifts, m.bookings),
    "utilization_totals": lambda m: Z.utilization_totals(m.shifts, m.bookings),
    "top_performers": lambda m: Z.performers(m.shifts, m.bookings),
    "bottom_performers": lambda m: Z.performers(m.shifts, m.bookings, best=False),
    "top_performers_of_long_shifts": lambda m: Z.performers(_long_shifts(m), m.bookings),
    "bottom_performers_of_long_shifts":
        lambda m: Z.performers(_long_shifts(m), m.bookings, best=False),
    "supply_daily_from_csv": _supply_from_csv,
    # trip costs
    "booking_costs": lambda m: costs.booking_costs(m.bookings, m.auctions, m.shifts),
    "booking_costs_minutes":
        lambda m: costs.booking_costs(m.bookings, m.auctions, m.shifts, duration_unit="min"),
    "cost_comparison_summary":
        lambda m: costs.cost_comparison_summary(m.bookings, m.auctions, m.shifts),
    "cost_diff_by_hour": lambda m: costs.cost_diff_by_hour(m.bookings, m.auctions, m.shifts),
    "cost_diff_by_duration_quintile":
        lambda m: costs.cost_diff_by_duration_quantile(m.bookings, m.auctions, m.shifts),
    "cost_diff_by_duration":
        lambda m: costs.cost_diff_by_duration(m.bookings, m.auctions, m.shifts),
    "cost_diff_of_one_duration": _one_duration,
    "cost_diff_summary": lambda m: costs.cost_diff_summary(m.bookings, m.auctions, m.shifts),
    "cost_summary": lambda m: costs.cost_summary(m.shifts, m.auctions),
    # distributions
    "price_histogram": lambda m: histogram(
        m.auctions, {"auction_winning_price": F.col("auction_winning_price")}),
    "cost_diff_histogram": lambda m: costs.cost_diff_histogram(m.bookings, m.auctions, m.shifts),
    "cost_vs_price_histogram":
        lambda m: costs.cost_vs_price_histogram(m.bookings, m.auctions, m.shifts),
    "cost_curve_histogram": lambda m: histogram(
        _cost_curve(m), {"cost_diff": F.col("cost_diff")}, bins=10),
    "rate_box_summary": lambda m: box_summary(m.shifts, F.col("hourly_rate_eur")),
    "describe_daily": _describe_daily,
    # geography
    "pickup_grid": lambda m: geo.pickup_grid(m.bookings, m.auctions),
    "dropoff_grid": lambda m: geo.dropoff_grid(m.bookings, m.auctions),
    "grid_top5": lambda m: geo.grid_top(m.bookings, m.auctions),
    "price_map_points": lambda m: geo.price_map_points(m.bookings, m.auctions),
    "price_map_centre": lambda m: geo.price_map_centre(m.bookings, m.auctions),
    "pickup_clusters": lambda m: geo.pickup_clusters(m.bookings, m.auctions),
    # time, weather, calendar
    "price_by_hour": lambda m: context.price_by_hour(m.bookings, m.auctions),
    "price_by_weekday": lambda m: context.price_by_weekday(m.bookings, m.auctions),
    "price_by_weather":
        lambda m: context.price_by_weather(m.bookings, m.auctions, m.weather, m.calendar),
    "temperature_price_points":
        lambda m: context.temperature_price_points(m.bookings, m.auctions, m.weather, m.calendar),
    "price_by_event_type":
        lambda m: context.price_by_event_type(m.bookings, m.auctions, m.weather, m.calendar),
    "price_event_vs_regular":
        lambda m: context.price_event_vs_regular(m.bookings, m.auctions, m.weather, m.calendar),
    "correlation_matrix":
        lambda m: context.correlation_matrix(m.bookings, m.auctions, m.weather, m.calendar),
    # seasonality
    "bookings_by_weekday": lambda m: S.bookings_by_weekday(m.bookings),
    "bookings_by_hour": lambda m: S.bookings_by_hour(m.bookings),
    "weekday_hour_heatmap": lambda m: S.weekday_hour_heatmap(m.bookings),
    "seasonality_summary": lambda m: S.seasonality_summary(m.bookings),
    "seasonality_summary_range":
        lambda m: S.seasonality_summary(m.bookings, "2024-01-05", "2024-01-20"),
    "weekday_insights": lambda m: S.weekday_insights(m.bookings),
    "hour_insights": lambda m: S.hour_insights(m.bookings),
    # decision
    "similar_auctions": lambda m: band.similar_auctions(m.bookings, m.auctions),
    "similar_auctions_excluding_self":
        lambda m: band.similar_auctions(m.bookings, m.auctions, exclude_self=True),
    "similar_auctions_1d": lambda m: band.similar_auctions_1d(m.bookings, _own_duration(m)),
    "available_shifts": lambda m: decision.available_shifts(m.bookings, m.shifts),
    "decision_features": lambda m: decision.decision_features(m.bookings, m.shifts, m.auctions),
    "decision_features_1d": lambda m: decision.decision_features(
        m.bookings, m.shifts, _own_duration(m), duration_only=True),
    "feature_scaling": lambda m: decision.feature_scaling(_training(m)),
    "training_labels": lambda m: decision.training_labels(m.bookings, m.shifts, m.auctions),
    "decision_costs": lambda m: decision.decision_costs(m.bookings, m.shifts, m.auctions),
    "expected_profit_weighted": lambda m: decision.expected_profit_weighted(
        m.bookings, m.shifts, _own_duration(m)),
    "dispatch_model": _dispatch_model,
    "dispatch_decision": lambda m: decision.dispatch_decision(
        m.bookings, m.shifts, m.auctions, _model(m)),
    # tables
    "data_profile": lambda m: profile.data_profile({
        "bookings": m.bookings, "shifts": m.shifts, "auctions": m.auctions,
        "weather": m.weather, "calendar": m.calendar}).drop("type"),
    "impute_shifts": lambda m: profile.impute_shifts(m.shifts).select(
        "shift_id", "chauffeur_uuid", "shift_date", "shift_working_hours", "hourly_rate_eur"),
    "clean_shifts": _clean_shifts,
    "clean_auctions": _clean_auctions,
}


def stream_decision(spark: SparkSession, folder: str) -> DataFrame:
    """Fit on the past, then decide the bookings as they stream in."""
    m = DerivedMarketplace(spark, folder)
    out = shared_folder(spark, "decisions")
    band.auction_points(m.bookings, m.auctions).write.parquet(f"{out}/points")
    arriving = bookings_of(jobs.read_stream(spark, f"{folder}/events.parquet", EVENTS))
    jobs.stream_decisions(
        arriving, spark.read.parquet(f"{out}/points"), m.shifts, _model(m), f"{out}/decided",
        f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/decided").drop("batch")


def stream_supply_demand(spark: SparkSession, folder: str) -> DataFrame:
    """Closed days of the stream, as appended by the job."""
    out = shared_folder(spark, "supply-demand")
    arriving = bookings_of(jobs.read_stream(spark, f"{folder}/events.parquet", EVENTS))
    jobs.stream_supply_demand(
        arriving, DerivedMarketplace(spark, folder).shifts, f"{out}/days",
        f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/days")


def stream_corrected_days(spark: SparkSession, folder: str) -> DataFrame:
    """All days of the stream, late bookings included."""
    out = shared_folder(spark, "corrected-days")
    arriving = bookings_of(jobs.read_stream(spark, f"{folder}/events.parquet", EVENTS))
    jobs.stream_corrected_days(
        arriving, DerivedMarketplace(spark, folder).shifts, f"{out}/days",
        f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/days")


def _on_tables(analysis: Analysis) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        with shared_stages():
            return analysis(DerivedMarketplace(spark, folder))

    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        **{name: _on_tables(analysis) for name, analysis in ANALYSES.items()},
        "stream_decision": stream_decision,
        "stream_supply_demand": stream_supply_demand,
        "stream_corrected_days": stream_corrected_days,
    }
