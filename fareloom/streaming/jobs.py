"""Streaming forms of two analyses: decisions for incoming bookings, and daily supply/demand."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from fareloom.functions.exact import dec
from fareloom.functions.joins import left_join_small
from fareloom.operators.band import TOLERANCE, BandIndex, with_indexed_auctions
from fareloom.operators.decision import beside_supply, daily_supply, decide, with_costs
from fareloom.operators.supply import supply_daily
from fareloom.session import written


def stream_decisions(bookings: DataFrame, points: DataFrame | BandIndex, shifts: DataFrame,
                     model: PipelineModel, out: str, checkpoint: str,
                     duration_unit: str = "min", tolerance: float = TOLERANCE,
                     trigger: dict | None = None) -> StreamingQuery:
    """Decide every micro-batch of an unbounded ``bookings`` stream.

    ``trigger`` goes to the stream's writer: by default what is there is decided and the job
    ends; ``{"processingTime": "10 seconds"}`` keeps deciding what comes in. The supply of each
    day is summed once, when the job starts.

    ``points`` are the similar-auction points of the past (``auction_points``), of which an index
    is made when the job starts, or such an index, which may be added to while the job runs. A
    batch reads from it what its bookings look up, not the points. Each batch goes to its own folder, written over on a retry, so that a batch
    replayed after a failure is not doubled.
    """
    supply = written(daily_supply(shifts), "daily-supply")
    if isinstance(points, BandIndex):
        index = points
    else:
        index = BandIndex(points.sparkSession, f"{out}-index", tolerance)
        index.append(points)

    def decide_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            matched = with_indexed_auctions(batch, index, f"{out}-work")
            decisions = decide(with_costs(beside_supply(matched, supply), duration_unit), model)
            decisions.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        finally:
            batch.unpersist()

    return (
        bookings.writeStream.foreachBatch(decide_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def windowed_demand(bookings: DataFrame, window: str = "1 day",
                    watermark: str = "1 hour") -> DataFrame:
    """Bookings, booked seconds and revenue per event-time window of a stream.

    A window is emitted once it is closed, that is, once a booking later than its end plus the
    watermark was seen; bookings later than that are dropped.
    """
    # Days are those of the naive times, whatever the session's zone: taken as UTC and back.
    utc, zone = F.lit("UTC"), F.lit(bookings.sparkSession.conf.get("spark.sql.session.timeZone"))
    timed = bookings.withColumn(
        "at", F.convert_timezone(utc, zone, F.col("booked_start_at")).cast("timestamp"))

    def naive(c: str) -> Column:
        return F.convert_timezone(zone, utc, F.col(c).cast("timestamp_ntz"))

    return timed.withWatermark("at", watermark).groupBy(F.window("at", window).alias("w")).agg(
        F.count("booking_uuid").alias("total_bookings"),
        F.sum(dec("booked_duration")).cast("double").alias("total_booking_duration"),
        F.sum(dec("gross_revenue_eur")).cast("double").alias("total_revenue"),
    ).select(
        naive("w.start").alias("window_start"),
        naive("w.end").alias("window_end"),
        "total_bookings", "total_booking_duration", "total_revenue")


def stream_supply_demand(bookings: DataFrame, shifts: DataFrame, out: str,
                         checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Closed days of demand with the supply of the day, appended to parquet."""
    daily = windowed_demand(bookings).withColumn("date", F.to_date("window_start"))
    supply = supply_daily(shifts).select(
        F.col("shift_date").alias("date"), "total_shifts",
        F.col("total_hours").alias("total_shift_hours"))
    joined = left_join_small(daily, supply, "date").na.fill(
        0, subset=["total_shifts", "total_shift_hours"])
    return (
        joined.drop("window_start", "window_end")
        .writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_corrected_days(bookings: DataFrame, shifts: DataFrame, out: str, checkpoint: str,
                          trigger: dict | None = None) -> StreamingQuery:
    """Days of demand with the supply of the day, kept right however late bookings come.

    Where ``stream_supply_demand`` drops what comes after a day was closed, this job adds each
    micro-batch's sums by day to ``{out}-sums`` and writes the days that the batch touches
    anew, as folders ``date=...`` of ``out``, from all sums of those days. Sums are decimals,
    so that the result is that of one batch over all bookings. A batch that is run again after a
    failure writes over its own sums and the same days. Bookings without a time have no day.

    A day is read from as many small files as batches have touched it, and no other day's.
    """
    supply = written(supply_daily(shifts).select(
        F.col("shift_date").alias("date"), "total_shifts",
        F.col("total_hours").alias("total_shift_hours")), "supply-by-day")
    days = T.StructType([
        T.StructField("total_bookings", T.LongType()),
        T.StructField("seconds", T.DecimalType(28, 6)),
        T.StructField("revenue", T.DecimalType(28, 6)),
        T.StructField("batch", T.LongType()), T.StructField("date", T.DateType())])

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, sums = batch.sparkSession, f"{out}-sums"
        batch.where("booked_start_at IS NOT NULL").groupBy(
            F.to_date("booked_start_at").alias("date")).agg(
            F.count("booking_uuid").alias("total_bookings"),
            F.sum(dec("booked_duration")).alias("seconds"),
            F.sum(dec("gross_revenue_eur")).alias("revenue"),
        ).write.mode("overwrite").partitionBy("date").parquet(f"{sums}/batch={batch_id}")
        known = spark.read.schema(days).parquet(sums)
        touched = known.where(F.col("batch") == batch_id).select("date").distinct()
        merged = known.join(touched, "date", "left_semi").groupBy("date").agg(
            F.sum("total_bookings").alias("total_bookings"),
            F.coalesce(F.sum("seconds").cast("double"), F.lit(0.0)).alias("total_booking_duration"),
            F.coalesce(F.sum("revenue").cast("double"), F.lit(0.0)).alias("total_revenue"))
        merged.join(supply, "date", "left").na.fill(
            0, subset=["total_shifts", "total_shift_hours"]
        ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "date").parquet(out)

    return (
        bookings.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_stream(spark: SparkSession, path: str, schema: T.StructType,
                files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream.

    A stream takes a single file only through a glob, so the last letter is made one.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")
