"""The batch stages, one function each, over one data folder.

Layout below ``root``: ``raw_table`` (feed, ingest_date), ``raw/<source>/<date>/*.jsonl`` for landed
lines, ``features/<layer>``, ``models/regime``, ``signals``, ``runs``.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide import schemas
from sigtide.functions.text import strip_text
from sigtide.operators import features, labels, model, sentiment, topics, validation
from sigtide.operators.timeseries import align_signals, forward_returns, tail_n
from sigtide.sources import backfill as history
from sigtide.sources import ingest, raw, tables
from sigtide.sources.normalize import normalize_markets, parse_payload


@dataclass(frozen=True)
class Paths:
    root: str

    @property
    def sentiment_scores(self) -> str:
        return f"{self.root}/features/sentiment_scores"

    @property
    def sentiment(self) -> str:
        return f"{self.root}/features/sentiment"

    @property
    def sentiment_sources(self) -> str:
        return f"{self.root}/features/sentiment_sources"

    @property
    def geopolitical(self) -> str:
        return f"{self.root}/features/geopolitical"

    @property
    def markets(self) -> str:
        return f"{self.root}/features/kalshi"

    @property
    def market_records(self) -> str:
        return f"{self.root}/market_records"

    @property
    def topic_assignments(self) -> str:
        return f"{self.root}/features/topic_assignments"

    @property
    def topics(self) -> str:
        return f"{self.root}/features/topics"

    @property
    def returns(self) -> str:
        return f"{self.root}/features/forward_returns"

    @property
    def tearsheet(self) -> str:
        return f"{self.root}/features/ic_tearsheet"

    @property
    def attribution(self) -> str:
        return f"{self.root}/features/shap_importance"

    @property
    def model(self) -> str:
        return f"{self.root}/models/regime"

    @property
    def signals(self) -> str:
        return f"{self.root}/signals"

    @property
    def runs(self) -> str:
        return f"{self.root}/runs"

    @property
    def parts(self) -> list[str]:
        return [self.sentiment, self.geopolitical, self.markets, self.topics]


def _logged(spark: SparkSession, paths: Paths, stage: str, work: Callable[[], tuple]):
    """Run a stage and append its outcome; a failure is logged and raised again."""
    start = time.monotonic()
    try:
        result, rows, notes = work()
    except Exception as error:
        tables.log_run(spark, paths.runs, stage, "failed", None, time.monotonic() - start,
                       str(error))
        raise
    tables.log_run(spark, paths.runs, stage, "ok", rows, time.monotonic() - start, notes)
    return result


def records(spark: SparkSession, root: str, sources: Sequence[str] | None = None,
            date_col: str = "ingest_date", since: str | None = None) -> DataFrame:
    """Raw records with the ``date`` features are grouped by (partition day by default).

    ``since`` on the partition day prunes folders, so a daily run reads the new days only.
    """
    df = raw.read_raw_table(spark, root, sources)
    day = F.to_date("timestamp") if date_col == "event_date" else F.col(date_col)
    if since is not None:
        df = df.where(day >= F.lit(since).cast("date"))
    return df.withColumn("date", day)


def _since(df: DataFrame, since: str | None) -> DataFrame:
    return df if since is None else df.where(F.col("date") >= F.lit(since).cast("date"))


def stage_sentiment(spark: SparkSession, root: str, scorer="lexicon",
                    sources: Sequence[str] | None = None, date_col: str = "ingest_date",
                    since: str | None = None) -> None:
    """Score all sources, then write scores, the daily table and the per-source table.

    With ``since`` only days from then on are scored and replaced.
    """
    paths = Paths(root)

    def work():
        seen, part = Observation("scored"), since is not None
        scores = sentiment.score_text(
            records(spark, root, sources, date_col, since), scorer).observe(
            seen, F.count(F.lit(1)).alias("n"))
        tables.write_by_date(scores, paths.sentiment_scores, part)
        stored = _since(spark.read.parquet(paths.sentiment_scores), since)
        tables.write_daily(features.sentiment_daily(stored), paths.sentiment, part)
        tables.write_daily(features.sentiment_by_source(stored), paths.sentiment_sources, part)
        return None, raw.observed_rows(seen, "n"), None

    _logged(spark, paths, "sentiment", work)


def stage_topics(spark: SparkSession, root: str, sources: Sequence[str] | None = None,
                 k: int = 20, min_topic_size: int = 10,
                 date_col: str = "ingest_date") -> None:
    """Fit topics on the text, label them by their words, write assignments and daily counts.

    Text and metadata are filtered together, so assignments always line up with their records.
    Whole texts are used. Topics are fitted anew, so every day is rewritten.
    """
    paths = Paths(root)

    def work():
        body = strip_text(F.coalesce("body", F.lit("")))
        docs = records(spark, root, sources, date_col).where(
            F.length(body) > K.MIN_SCORABLE_CHARS).select(
            "id", "source", "source_type", "date", "body")
        _, assigned = topics.fit_assigned(docs, "lda", "body", k, min_topic_size)
        names = topics.topic_labels(topics.class_tfidf(assigned))
        seen = Observation("assigned")
        out = topics.label_documents(assigned, names).select(
            "id", "source", "source_type", "date", "topic_id", "topic_prob", "macro_label"
        ).observe(seen, F.count(F.lit(1)).alias("n"))
        tables.write_by_date(out, paths.topic_assignments)
        tables.write_daily(
            topics.topic_pivot(spark.read.parquet(paths.topic_assignments)), paths.topics)
        return None, raw.observed_rows(seen, "n"), None

    _logged(spark, paths, "topics", work)


def stage_geopolitical(spark: SparkSession, root: str, date_col: str = "ingest_date",
                       since: str | None = None) -> None:
    paths = Paths(root)

    def work():
        events = records(spark, root, ["gdelt"], date_col, since)
        tables.write_daily(features.geo_daily(features.geo_fields(events)), paths.geopolitical,
                           since is not None)
        return None, None, None

    _logged(spark, paths, "geopolitical", work)


def stage_markets(spark: SparkSession, root: str, payloads: DataFrame, fetched_at=None,
                  events: Sequence[str] | None = K.MACRO_EVENTS) -> None:
    """Normalise landed event payloads (event_ticker, value), keep them, upsert today's scalar."""
    paths = Paths(root)

    def work():
        # One instant for the whole run, which reads the payloads more than once.
        at = F.lit(fetched_at or datetime.now(timezone.utc)).cast("timestamp")
        opened = parse_payload(payloads, schemas.MARKET_EVENT)
        rows = normalize_markets(opened, F.col("event_ticker"), events).withColumn(
            "fetched_at", at).withColumn("date", F.to_date("fetched_at"))
        (rows.hint("rebalance", "date").write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("date")
            .parquet(paths.market_records))
        stored = spark.read.parquet(paths.market_records)
        fresh = stored.join(rows.select("date").distinct(), "date", "left_semi")
        tables.upsert_daily(features.market_daily(fresh), paths.markets)
        return None, None, None

    _logged(spark, paths, "kalshi", work)


def stage_ingest(spark: SparkSession, root: str, landed: dict[str, DataFrame],
                 ingest_date: str | None = None) -> None:
    """Normalise landed payloads (see ``sources.ingest``) into the raw table under one arrival day.

    The (feed, day) partitions present are replaced, so a rerun leaves the same table.
    """
    paths = Paths(root)

    def work():
        seen = Observation("ingested")
        rows = ingest.landed_records(landed).observe(seen, F.count(F.lit(1)).alias("n"))
        raw.write_raw(rows, root, ingest_date)
        return None, raw.observed_rows(seen, "n"), ",".join(landed)

    _logged(spark, paths, "ingest", work)


def stage_backfill(spark: SparkSession, root: str, posts: DataFrame, periods=None,
                   subreddits=None, order: str = "seq") -> dict:
    """Append archive records of the chosen windows that are not stored yet."""
    paths = Paths(root)

    def work():
        existing = tables.read_optional(spark, f"{root}/raw_table")
        if existing is not None:
            existing = existing.where(F.col("feed") == "reddit")
        summary = history.backfill(posts, existing, root, periods, subreddits, order)
        return summary, summary["written"], None

    return _logged(spark, paths, "backfill", work)


def matrix(spark: SparkSession, root: str) -> DataFrame:
    return features.feature_matrix(tables.load_feature_parts(spark, Paths(root).parts))


def stage_train(spark: SparkSession, root: str, params: model.TrainParams | None = None) -> dict:
    """Label the panel, train, save; returns mean fold accuracy and feature count."""
    paths = Paths(root)

    def work():
        points = labels.volatility_points(records(spark, root, ["fred"]))
        labelled = labels.label_regimes(matrix(spark, root), points)
        fitted, folds = model.train(labelled, params)
        model.save_model(fitted, paths.model)
        hits = (F.col("label") == F.col("prediction")).cast("double")
        scores = [] if folds is None else folds.groupBy("fold").agg(
            F.avg(hits).alias("accuracy"), F.count(F.lit(1)).alias("n")).orderBy("fold").collect()
        for fold in scores:  # one log row per fold: its test rows, accuracy and the parameters
            note = {"accuracy": fold["accuracy"], **fitted.params}
            tables.log_run(spark, paths.runs, f"train_fold_{fold['fold']}", "ok", fold["n"],
                           notes=json.dumps(note))
        mean = sum(f["accuracy"] for f in scores) / len(scores) if scores else None
        result = {"mean_cv_accuracy": mean, "n_features": len(fitted.features)}
        return result, None, str(result)

    return _logged(spark, paths, "train", work)


def stage_predict(spark: SparkSession, root: str, all_days: bool = False) -> DataFrame:
    """Predict the newest day (or every day) and publish it in the signal table."""
    paths = Paths(root)

    def work():
        fitted = model.load_model(paths.model)
        panel = matrix(spark, root)
        panel = panel if all_days else tail_n(panel, 1)
        tables.publish_signal(model.predict_all(fitted, panel).drop("probabilities"),
                              paths.signals)
        return tables.signal_table(spark, paths.signals), None, None

    return _logged(spark, paths, "predict", work)


def stage_attribution(spark: SparkSession, root: str, n: int = 50) -> DataFrame:
    """Write all feature attributions; returns the ten largest."""
    paths = Paths(root)

    def work():
        scores = model.attribution(model.load_model(paths.model), matrix(spark, root), n)
        tables.write_feature(scores, paths.attribution)
        return model.top_attribution(spark.read.parquet(paths.attribution)), None, None

    return _logged(spark, paths, "shap", work)


def stage_validation(spark: SparkSession, root: str, prices: DataFrame, start: str = "2020-01-01",
                     mapping=None) -> tuple[DataFrame, DataFrame]:
    """Forward returns, alignment, tearsheet (written) and rolling IC."""
    paths = Paths(root)

    def work():
        tables.write_feature(forward_returns(
            prices.where(F.col("date") >= F.lit(start).cast("date"))), paths.returns)
        signals = tables.signal_table(spark, paths.signals).drop("created_at", "confidence")
        aligned = align_signals(spark.read.parquet(paths.returns), signals)
        tables.write_feature(validation.ic_summary(aligned, mapping), paths.tearsheet)
        return (spark.read.parquet(paths.tearsheet),
                validation.rolling_ic(aligned, mapping)), None, None

    return _logged(spark, paths, "validation", work)


def stage_all(spark: SparkSession, root: str, params: model.TrainParams | None = None) -> DataFrame:
    """Sentiment, topics, geopolitics, training, prediction, attribution, in that order.

    Market snapshots and backfill are separate runs, as they depend on outside schedules.
    """
    stage_sentiment(spark, root)
    stage_topics(spark, root)
    stage_geopolitical(spark, root)
    stage_train(spark, root, params)
    stage_predict(spark, root)
    return stage_attribution(spark, root)
