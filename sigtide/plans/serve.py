"""The small read queries of the service, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtide.operators import backtest, features, model, topics
from sigtide.plans import stages
from sigtide.sources import raw, tables

GEO_COLUMNS = ("date", "mean_goldstein", "geopolitical_risk_score", "conflict_ratio",
               "total_events")
MARKET_COLUMNS = ("date", "kalshi_regime_scalar", "kalshi_n_markets", "kalshi_n_weighted_markets",
                  "kalshi_total_open_interest")
SENTIMENT_COLUMNS = ("date", "cross_composite", "cross_positive", "cross_negative", "cross_count")
SIGNAL_COLUMNS = ("date", "regime", "confidence", "risk_on_prob", "risk_off_prob",
                  "transition_prob")


def _days(n: int) -> int:
    if not 1 <= n <= 365:
        raise ValueError("days must lie between 1 and 365")
    return n


def signal_history(spark: SparkSession, root: str, days: int = 90) -> DataFrame:
    return tables.feature_tail(
        tables.signal_table(spark, stages.Paths(root).signals), _days(days), SIGNAL_COLUMNS)


def latest_signal(spark: SparkSession, root: str) -> DataFrame:
    """Newest prediction with its probabilities and the record counts per source.

    Days and records are both returned; a count of dated files alone says little.
    """
    fitted = model.load_optional(stages.Paths(root).model)
    latest = model.predict_latest(fitted, stages.matrix(spark, root))
    return with_source_counts(latest, raw.read_raw_table(spark, root))


def with_source_counts(latest: DataFrame, records: DataFrame, source: str = "feed",
                       date: str = "ingest_date") -> DataFrame:
    """One row per feed: the columns of the one-row frame ``latest``, feed, n_days, n_records.

    Feeds stay a table however many there are; the caller folds them into a map if it wants one.
    Without any record the result is empty.
    """
    newest = latest.select(F.struct(*latest.columns)).scalar()
    return raw.source_counts(records, source, date).withColumn("_l", newest).select(
        "_l.*", source, "n_days", "n_records")


def sentiment_tail(spark: SparkSession, root: str, days: int = 60) -> DataFrame:
    df = spark.read.parquet(stages.Paths(root).sentiment)
    return tables.feature_tail(df, _days(days), SENTIMENT_COLUMNS)


def topics_tail(spark: SparkSession, root: str, days: int = 30) -> DataFrame:
    return tables.feature_tail(
        tables.daily_table(spark, stages.Paths(root).topics), _days(days))


def topic_summary(spark: SparkSession, root: str, k: int = 8) -> DataFrame:
    return topics.dominant_topics(tables.daily_table(spark, stages.Paths(root).topics), k)


def geo_tail(spark: SparkSession, root: str, days: int = 60) -> DataFrame:
    df = spark.read.parquet(stages.Paths(root).geopolitical)
    return tables.feature_tail(df, _days(days), GEO_COLUMNS)


def market_tail(spark: SparkSession, root: str, days: int = 60) -> DataFrame:
    df = spark.read.parquet(stages.Paths(root).markets)
    return tables.feature_tail(df, _days(days), MARKET_COLUMNS)


def latest_markets(spark: SparkSession, root: str) -> DataFrame:
    """All market records of the newest day, each with the day's record count."""
    df = raw.latest_partition(spark.read.parquet(stages.Paths(root).market_records), "date")
    total = df.agg(F.count(F.lit(1)).alias("count"), F.max("date").alias("date"))
    return df.join(F.broadcast(total), "date")


def run_backtest(spark: SparkSession, root: str, prices: DataFrame,
                 strategies: list[backtest.Strategy], lag: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rounded metrics and marked bars of each strategy over the stored feature tables.

    Prices are an input; nothing is made up when data is missing. Strategies with fewer than 30
    usable bars have no metrics row (``backtest.rejected`` names them).
    """
    paths = stages.Paths(root)
    sources = {s.signal_source for s in strategies}
    sent = spark.read.parquet(paths.sentiment) if sources & {"sentiment", "composite"} else None
    geo = spark.read.parquet(paths.geopolitical) if sources & {
        "geopolitical", "composite"} else None
    signals = None
    for source in sorted(sources):
        part = features.signal_series(source, sent, geo).withColumn("signal_source", F.lit(source))
        signals = part if signals is None else signals.unionByName(part)
    frame = backtest.grid(signals, prices, backtest.strategy_frame(spark, strategies), lag)
    return backtest.rounded(backtest.summary_text(backtest.metrics(frame))), frame.withColumns(
        {"equity": F.round("equity", 4), "drawdown": F.round("drawdown", 4)})


def tearsheet(spark: SparkSession, root: str, prices: DataFrame, start: str = "2020-01-01",
              mapping=None) -> tuple[DataFrame, DataFrame]:
    return stages.stage_validation(spark, root, prices, start, mapping)
