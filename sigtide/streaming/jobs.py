"""Streaming jobs. Every query keeps its checkpoint in a caller-given shared folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sigtide import constants as K
from sigtide.operators.features import geo_scores, market_daily
from sigtide.operators.model import RegimeModel, predict_latest
from sigtide.sources.normalize import normalize_wikipedia
from sigtide.sources.raw import feed_name
from sigtide.sources.tables import publish_signal, read_optional, upsert_daily
from sigtide.streaming.changes import read_changes

ONCE = {"availableNow": True}


def stream_raw(spark: SparkSession, landing: str, keywords: Sequence[str] = K.MACRO_EDIT_KEYWORDS,
               files_per_trigger: int = 1000) -> DataFrame:
    """Change-stream files landed as text, normalised as they arrive.

    The first-N cap of a batch read becomes a bound on files per trigger: nothing is lost, a
    large backlog just takes several batches.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(landing)
    return normalize_wikipedia(lines, keywords=keywords)


def stream_changes(spark: SparkSession, landing: str, keywords: Sequence[str] = K.MACRO_EDIT_KEYWORDS,
                   **options: object) -> DataFrame:
    """Captured server-sent blocks, normalised as they arrive; blocks may be split over files."""
    blocks = read_changes(spark, landing, **options)
    return normalize_wikipedia(blocks.select(F.concat(F.lit("data: "), "data").alias("value")),
                               keywords=keywords)


def dedup_stream(records: DataFrame, key: str = "id", watermark: str | None = "2 days",
                 timestamp: str = "timestamp") -> DataFrame:
    """Keep the first record per id.

    With a watermark the state forgets ids once it has passed them; ``None`` remembers every id
    forever, as the batch rule does, and its state grows with the stream.
    """
    if watermark is None:
        return records.dropDuplicates([key])
    return records.withWatermark(timestamp, watermark).dropDuplicatesWithinWatermark([key])


def write_raw_stream(records: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append raw records by feed and event day."""
    out = records.withColumn("ingest_date", F.to_date("timestamp")).withColumn(
        "feed", feed_name(F.col("source")))
    return (out.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).partitionBy("feed", "ingest_date")
            .outputMode("append").trigger(**(trigger or ONCE)).start())


def _daily(rows: DataFrame, timestamp: str, watermark: str, window: str,
           aggregates: Sequence[Column]) -> DataFrame:
    """Calendar-day buckets with bounded lateness; partial sums combine before the shuffle.

    Rows later than the watermark are dropped from this running result; ``run_recomputed`` has no
    watermark and takes them in by computing the touched days anew.
    """
    bucket = F.window(F.col(timestamp), window).alias("_w")
    return rows.withWatermark(timestamp, watermark).groupBy(bucket).agg(*aggregates).select(
        F.to_date("_w.start").alias("date"), "*").drop("_w")


def sentiment_stream(scores: DataFrame, timestamp: str = "timestamp", watermark: str = "2 days",
                     window: str = "1 day") -> DataFrame:
    """Streaming form of the daily cross-source sentiment."""
    return _daily(scores, timestamp, watermark, window, [
        F.avg("composite").alias("cross_composite"), F.avg("positive").alias("cross_positive"),
        F.avg("negative").alias("cross_negative"), F.count("composite").alias("cross_count")])


def geo_stream(events: DataFrame, timestamp: str = "timestamp", watermark: str = "2 days",
               window: str = "1 day") -> DataFrame:
    """Streaming form of the daily geopolitical table (input as from ``geo_fields``)."""
    g = F.col("goldstein_scalar")
    daily = _daily(events, timestamp, watermark, window, [
        F.avg(g).alias("mean_goldstein"), F.stddev_samp(g).alias("std_goldstein"),
        F.avg("tone_scalar").alias("mean_tone"),
        F.count_if(g < K.CONFLICT_BELOW).alias("conflict_events"),
        F.count_if(g > K.COOPERATION_ABOVE).alias("cooperation_events"),
        F.count(g).alias("total_events")])
    return geo_scores(daily)


def market_stream(records: DataFrame, timestamp: str = "fetched_at", watermark: str = "2 days",
                  window: str = "1 day") -> DataFrame:
    """Streaming form of the daily market scalar and counts."""
    rows = records.withWatermark(timestamp, watermark).withColumn(
        "_day", F.window(F.col(timestamp), window))
    daily = market_daily(rows, "_day")
    return daily.select(F.to_date("_day.start").alias("date"), *daily.columns[1:])


def run_recomputed(records: DataFrame, store: str, build: Callable[[DataFrame], DataFrame],
                   path: str, checkpoint: str, timestamp: str = "timestamp",
                   source: str = "live", **trigger) -> StreamingQuery:
    """Append records to a table by event day, then compute the days they touch anew from it.

    No state and no watermark: a record may be late by any time. ``build`` turns stored records with
    a ``date`` into daily rows, which replace the stored days. Each batch of a ``source`` writes its
    records to its own ``batch`` partition, so one that is replayed after a failure overwrites
    itself. Reading is pruned to the touched days.
    """
    def upsert(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("date", F.to_date(timestamp)).where(F.col("date").isNotNull())
        name = f"{source}-{batch_id}"
        (rows.withColumn("batch", F.lit(name)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(store))
        if rows.isEmpty():
            return
        stored = batch.sparkSession.read.parquet(store)
        touched = stored.where(F.col("batch") == name).select("date").distinct()
        upsert_daily(build(stored.join(touched, "date", "left_semi")), path)

    return (records.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or ONCE)).start())


def run_merged(records: DataFrame, store: str, state: Callable[[DataFrame], DataFrame],
               build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
               untimed: str | None = None, timestamp: str = "timestamp", source: str = "live",
               **trigger) -> StreamingQuery:
    """Daily rows from merged states: a late batch adds its state to a day, whose rows are not read again.

    ``state`` turns records with a ``date`` into one row per day, stored by day and ``batch``; ``build``
    turns stored states into daily rows, which replace the stored days. No watermark: a record may be
    late by any time. A batch that is replayed after a failure overwrites its own states. Records
    without a time belong to no day; they go to the table ``untimed``, if one is given, by batch.
    """
    def upsert(batch: DataFrame, batch_id: int) -> None:
        name = f"{source}-{batch_id}"
        rows = batch.withColumn("date", F.to_date(timestamp))
        if untimed:
            (batch.where(F.to_date(timestamp).isNull()).withColumn("batch", F.lit(name)).write
                .mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch")
                .parquet(untimed))
        (state(rows.where(F.col("date").isNotNull())).withColumn("batch", F.lit(name)).write
            .mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch")
            .parquet(store))
        stored = read_optional(batch.sparkSession, store)
        if stored is None or "date" not in stored.columns:
            return
        touched = stored.where(F.col("batch") == name).select("date").distinct()
        if not touched.isEmpty():
            upsert_daily(build(stored.join(touched, "date", "left_semi")), path)

    return (records.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or ONCE)).start())


def run_to_table(daily: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Upsert updated days into a daily table after every batch.

    Update mode hands over only the days a batch touched. Writing them is idempotent, so a batch
    that is replayed after a failure leaves the same table.
    """
    def upsert(batch: DataFrame, _batch_id: int) -> None:
        upsert_daily(batch, path)

    return (daily.writeStream.outputMode("update").foreachBatch(upsert)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start())


def run_live(changes: DataFrame, model: RegimeModel | None, matrix_path: str, signal_path: str,
             checkpoint: str, message_path: str | None = None, **trigger) -> StreamingQuery:
    """Publish the newest regime whenever features change (every 30 seconds by default).

    ``changes`` is any stream that ticks when the feature matrix was updated. Each batch reads the
    matrix table, predicts its newest day, upserts the signal table and, if asked, appends the
    message a client would get. An unknown regime is not published.
    """
    def publish(batch: DataFrame, _batch_id: int) -> None:
        matrix = read_optional(batch.sparkSession, matrix_path)
        if matrix is None or model is None:
            return
        latest = predict_latest(model, matrix.drop("year"))
        p = {c: F.coalesce(F.try_element_at("probabilities", F.lit(c)), F.lit(0.0)).alias(
            f"{c}_prob") for c in ("risk_on", "risk_off", "transition")}
        publish_signal(latest.select("date", "regime", "confidence", *p.values()), signal_path)
        if message_path:
            latest.select(F.lit("signal_update").alias("type"), "date", "regime", "confidence",
                          "probabilities", F.current_timestamp().alias("timestamp")
                          ).write.mode("append").parquet(message_path)

    return (changes.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "30 seconds"})).start())
