"""Every operator as a query over the tables of one data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtide import schemas, streaming
from sigtide.functions import signals as rules
from sigtide.functions import text as words
from sigtide.operators import backtest, dedup, density, features, labels, model, sentiment, timeseries
from sigtide.operators import states, topics, validation
from sigtide.plans import bindings as B
from sigtide.plans import serve, stages
from sigtide.session import scratch_path
from sigtide.sources import normalize, raw, tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
DIGITS = 6


def _plain(df: DataFrame) -> DataFrame:
    """Comparable output: six decimals, dates as text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, DIGITS)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _query(fn: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return _plain(fn(spark, sf))

    run.__doc__ = fn.__doc__
    _QUERIES[fn.__name__] = run
    return run


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---- geopolitics ---------------------------------------------------------------------------------

def _geo(spark, sf):
    return features.geo_daily(features.geo_fields(B.news_events(spark, sf)))


@_query
def geo_daily(spark, sf):
    return _geo(spark, sf)


@_query
def geo_daily_tail(spark, sf):
    return tables.feature_tail(_geo(spark, sf), 10, serve.GEO_COLUMNS)


@_query
def cameo_score(spark, sf):
    counts = B.event_codes(spark, sf).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("score", rules.cameo_score(F.col("code")))


# ---- text and sentiment --------------------------------------------------------------------------

@_query
def text_clean(spark, sf):
    docs = sentiment.scorable(B.documents(spark, sf))
    body = words.post_body(F.col("source_type"), F.col("body"))
    return docs.select(
        "doc_id", F.length("body").alias("n_chars"), words.long_enough(F.col("body")).cast(
            "int").alias("long_chars"), F.octet_length("body").alias("n_bytes"),
        F.md5(body).alias("body_md5"))


@_query
def record_id(spark, sf):
    return B.documents(spark, sf).select("doc_id", words.record_id(
        "doc", F.concat(F.lit("doc_"), F.col("body"))).alias("id"))


def _scores(spark, sf):
    return sentiment.score_text(B.documents(spark, sf), positive=B.POSITIVE, negative=B.NEGATIVE)


@_query
def sentiment_scores(spark, sf):
    return _scores(spark, sf)


@_query
def sentiment_daily(spark, sf):
    return features.sentiment_daily(_scores(spark, sf))


@_query
def sentiment_by_source(spark, sf):
    return features.sentiment_by_source(_scores(spark, sf))


@_query
def sentiment_rollup(spark, sf):
    return features.sentiment_rollup(_scores(spark, sf))


@_query
def sentiment_tail(spark, sf):
    return tables.feature_tail(
        features.sentiment_daily(_scores(spark, sf)), 7, serve.SENTIMENT_COLUMNS, ascending=True)


# ---- topics --------------------------------------------------------------------------------------

def _assigned(spark, sf):
    """Documents with the cluster of their embedding; those without one are noise."""
    vectors = B.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label").alias("topic_id"))
    return B.documents(spark, sf).join(vectors, "doc_id", "left").withColumn(
        "topic_id", F.coalesce("topic_id", F.lit(-1)))


def _topic_labels(spark, sf):
    return topics.topic_labels(topics.class_tfidf(_assigned(spark, sf)), B.TOPIC_WORDS)


def _labelled(spark, sf):
    return topics.label_documents(
        _assigned(spark, sf).drop("body"), _topic_labels(spark, sf))


def _topic_counts(spark, sf):
    return topics.topic_pivot(_labelled(spark, sf))


@_query
def class_tfidf(spark, sf):
    return topics.class_tfidf(_assigned(spark, sf))


@_query
def macro_label(spark, sf):
    return _topic_labels(spark, sf)


@_query
def topic_assign(spark, sf):
    return _labelled(spark, sf).select("id", "source", "source_type", "date", "topic_id",
                                       "macro_label")


@_query
def topic_pivot(spark, sf):
    return _topic_counts(spark, sf)


@_query
def topics_tail(spark, sf):
    return tables.feature_tail(_topic_counts(spark, sf), 5)


@_query
def topic_top8(spark, sf):
    top = topics.dominant_topics(_topic_counts(spark, sf))
    return top.withColumn("shown", rules.display_label(F.col("label")))


# ---- prediction markets --------------------------------------------------------------------------

def _markets(spark, sf, events=None):
    return normalize.normalize_markets(
        B.market_payloads(spark, sf), F.col("event_ticker"), events)


@_query
def market_records(spark, sf):
    return _markets(spark, sf)


@_query
def market_events(spark, sf):
    """Markets of the six followed events, counted per event."""
    return _markets(spark, sf, normalize.K.MACRO_EVENTS).groupBy("event_ticker").agg(
        F.count(F.lit(1)).alias("n"), F.sum("directional_weight").alias("weight"))


@_query
def market_scalar(spark, sf):
    return features.market_daily(_markets(spark, sf))


@_query
def market_tail(spark, sf):
    return tables.feature_tail(
        features.market_daily(_markets(spark, sf)), 12, serve.MARKET_COLUMNS)


@_query
def latest_markets(spark, sf):
    return raw.latest_partition(_markets(spark, sf), "date").select(
        "date", "ticker", "title", "series", "mid_price", "directional_weight")


# ---- raw records ---------------------------------------------------------------------------------

@_query
def latest_partition(spark, sf):
    return raw.latest_partition(B.table(spark, sf, "events").withColumn(
        "date", F.to_date("ts")), "date").select("date", "event_id", "event_type", "value")


@_query
def source_counts(spark, sf):
    return raw.source_counts(B.documents(spark, sf), "source", "date")


@_query
def union_records(spark, sf):
    """Three differently shaped sources concatenated by name, counted per source."""
    docs = B.documents(spark, sf).select("id", F.lit("documents").alias("feed"), "body")
    pages = B.table(spark, sf, "pages").select(
        words.record_id("page", F.col("url")).alias("id"), F.lit("pages").alias("feed"), "url",
        F.col("html").alias("body"))
    talk = B.table(spark, sf, "conversations").select(
        words.record_id("talk", F.concat_ws("_", "conv_id", "turn")).alias("id"),
        F.lit("conversations").alias("feed"), F.col("text").alias("body"))
    return normalize.union_all(docs, pages, talk).groupBy("feed").agg(
        F.count(F.lit(1)).alias("n"), F.count("url").alias("n_url"),
        F.sum(F.length("body")).alias("n_chars"), F.min("id").alias("first_id"))


@_query
def dedup_existing(spark, sf):
    """Texts not stored by feed src0, first copy of each; copies share their hash."""
    docs = B.documents(spark, sf).withColumn("id", words.record_id("doc", F.col("body")))
    stored = docs.where(F.col("source") == "src0")
    return dedup.dedup_existing(
        docs.select("id", "doc_id", "source", "date"), stored, "id", "doc_id")


@_query
def dedup_consecutive(spark, sf):
    events = B.table(spark, sf, "events").select("event_id", "ts", "event_type")
    return dedup.dedup_consecutive(events, "event_type", ["ts", "event_id"], descending=True
                                   ).select("event_id", "event_type")


@_query
def period_select(spark, sf):
    orders = B.table(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", "o_orderpriority")
    periods = {"early": ("1995-03-01", "1996-01-01"), "overlap": ("1995-10-01", "1996-06-01"),
               "late": ("1999-12-31", "2001-02-03")}
    chosen = normalize.select_periods(
        orders, periods, ["1-URGENT", "5-LOW", "3-MEDIUM"], "o_orderdate", "o_orderpriority")
    return chosen.select("period", "o_orderkey", "o_orderpriority")


# ---- landed payloads -----------------------------------------------------------------------------

def _shown(records: DataFrame, **meta: str) -> DataFrame:
    """Raw records with long text hashed and metadata fields typed (parsed once)."""
    kinds = ", ".join(f"{k} {kind}" for k, kind in meta.items())
    return records.withColumn("_m", F.from_json("metadata", kinds)).select(
        "id", "source", "source_type", F.unix_timestamp("timestamp").alias("epoch"),
        F.md5("title").alias("title_md5"), F.md5("body").alias("body_md5"), "url",
        *[F.col(f"_m.{k}").alias(f"m_{k}") for k in meta])


def _talk(spark, sf):
    text = F.when(F.col("turn") == 4, F.lit("[removed]")).when(
        F.col("turn") == 5, F.lit("")).otherwise(F.col("text"))
    return B.table(spark, sf, "conversations").withColumn("text", text)


def _listings(spark, sf):
    post = F.struct(
        F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("role").alias("title"),
        F.col("text").alias("selftext"), F.col("turn").alias("score"),
        F.col("conv_id").alias("num_comments"),
        (F.col("conv_id") * 60 + 1704067200.5).alias("created_utc"),
        F.col("role").alias("subreddit"), F.concat(F.lit("/r/"), F.col("role")).alias("url"),
        (F.col("turn") / 8.0).alias("upvote_ratio"))
    return _talk(spark, sf).select(
        F.struct(F.array(F.struct(post.alias("data"))).alias("children")).alias("data"))


@_query
def normalize_reddit(spark, sf):
    return _shown(normalize.normalize_reddit(_listings(spark, sf), "top"), score="bigint",
                  num_comments="bigint", upvote_ratio="double", subreddit="string", sort="string")


@_query
def normalize_reddit_archive(spark, sf):
    posts = _talk(spark, sf).select(
        F.concat_ws("_", "conv_id", "turn").alias("id"),
        F.concat(F.lit("  "), F.col("role"), F.lit("\n")).alias("title"),
        F.concat(F.lit(" "), F.col("text"), F.lit(" \n")).alias("selftext"),
        (F.col("conv_id") * 60 + 1704067200).alias("created_utc"),
        F.when(F.col("turn") != 1, F.col("role")).alias("subreddit"),
        F.when(F.col("turn") != 2, F.concat(F.lit("/r/"), F.col("role"))).alias("permalink"),
        F.when(F.col("turn") != 3, F.col("turn")).alias("score"),
        F.col("conv_id").alias("num_comments"), (F.col("turn") / 8.0).alias("upvote_ratio"))
    return _shown(normalize.normalize_reddit(posts, kind="archive"), score="bigint",
                  num_comments="bigint", upvote_ratio="double", subreddit="string", sort="string")


def _articles(spark, sf):
    docs = B.table(spark, sf, "documents")
    article = F.struct(
        F.when(F.col("lang") != "es", F.date_format(
            B.day_of(F.col("doc_id")), "yyyyMMdd'T'101500'Z'")).otherwise(
            F.lit("20240131T235959Z")).alias("seendate"),
        F.concat(F.lit("https://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
        .alias("url"),
        F.when(F.col("lang") != "fr", F.col("text")).alias("title"),
        F.col("source").alias("sourcecountry"), F.col("lang").alias("sourcelang"),
        (F.col("n_chars") / 100.0).alias("tone"),
        F.lit(None).cast("double").alias("goldsteinscale"))
    return docs.select(F.array(article).alias("articles"), "source")


@_query
def normalize_gdelt(spark, sf):
    return _shown(normalize.normalize_gdelt(_articles(spark, sf), F.col("source")), query="string",
                  source_country="string", source_lang="string", tone="double",
                  goldstein_scale="double")


def _observations(spark, sf):
    """Observations with both missing marks and one unparsable value."""
    kind = F.col("event_type")
    value = F.when(kind == "view", ".").when(kind == "signup", "").when(
        kind == "error", "abc").otherwise(F.format_string("%.2f", "value"))
    obs = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), value.alias("value"))
    return B.table(spark, sf, "events").select(
        F.array(obs).alias("observations"), F.upper("event_type").alias("series"))


@_query
def normalize_fred(spark, sf):
    return _shown(normalize.normalize_fred(_observations(spark, sf), F.col("series")), series_id="string",
                  value="double", date="string")


def _filings(spark, sf):
    key = F.col("o_orderkey")
    filing = F.struct(F.struct(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("file_date"),
        F.array(F.col("o_orderpriority")).alias("display_names"),
        F.col("o_orderstatus").alias("form_type"),
        F.when(key % 3 != 0, F.date_format("o_orderdate", "yyyy-MM")).alias("period_of_report"),
        F.when(key % 4 != 0, F.col("o_orderpriority")).alias("entity_name"),
        F.when(key % 5 != 0, key.cast("string")).alias("file_num")).alias("_source"))
    return B.table(spark, sf, "orders").select(
        F.struct(F.array(filing).alias("hits")).alias("hits"), "o_orderstatus")


@_query
def normalize_edgar(spark, sf):
    return _shown(normalize.normalize_edgar(_filings(spark, sf), F.col("o_orderstatus")), form_type="string",
                  entity_name="string", period_of_report="string",
                  display_names="array<string>").withColumn(
        "m_display_names", F.array_join("m_display_names", "|"))


def _edit_lines(spark, sf):
    key = F.col("page_id")
    event = F.to_json(F.struct(
        F.col("url").alias("title"), F.col("html").alias("comment"),
        F.when(key % 4 == 0, "commons.wikimedia.org").otherwise("en.wikipedia.org").alias(
            "server_name"),
        F.when(key % 7 == 0, "log").otherwise("edit").alias("type"),
        (key + 1704067200).alias("timestamp"), F.lit("ed").alias("user"),
        F.when(key % 3 != 0, F.struct(F.length("html").cast("long").alias("new"), F.when(
            key % 2 == 0, key).alias("old"))).alias("length")))
    mark = F.when(key % 11 == 0, "event: ").otherwise("data: ")
    return B.table(spark, sf, "pages").select(F.concat(mark, event).alias("value"))


@_query
def normalize_wikipedia(spark, sf):
    return _shown(normalize.normalize_wikipedia(
        _edit_lines(spark, sf), keywords=B.EDIT_WORDS), server="string", edit_delta="bigint",
        user="string")


@_query
def stream_changes(spark, sf):
    """Edit events as server-sent blocks, cut into files inside blocks, landed in two parts with a restart
    between them."""
    land, state, out = (scratch_path(spark, x) for x in ("changes", "changes-state", "changes-raw"))
    lines = _edit_lines(spark, sf).withColumn("n", F.xxhash64("value")).select(
        "n", F.posexplode(F.array(
            F.lit("event: message"), F.concat(F.lit("id: "), F.col("n").cast("string")),
            F.col("value"), F.lit(""))).alias("k", "value"))
    # the first part ends behind the data line of a block, its blank line is in the second
    first = (F.col("n") < 0) | ((F.col("n") == F.lit(lines.where("n >= 0").agg(F.min("n")).scalar()))
                                & (F.col("k") < 3))
    for name, part in (("0", lines.where(first)), ("1", lines.where(~first))):
        (part.repartitionByRange(5, "n", "k").sortWithinPartitions("n", "k").select("value")
            .write.text(f"{land}/{name}"))
        records = streaming.stream_changes(spark, land, B.EDIT_WORDS, range=200_000)
        streaming.write_raw_stream(records, out, state).awaitTermination()
    return _shown(spark.read.parquet(out).drop("feed", "ingest_date"), server="string",
                  edit_delta="bigint", user="string")


@_query
def ingest_all(spark, sf):
    """Payload texts of four sources through the ingest stage, run twice, to the raw table."""
    root = scratch_path(spark, "ingest")

    def texts(frame, tag, payload):
        return frame.select(tag.alias("tag"), F.to_json(F.struct(payload)).alias("value"))

    landed = {
        "reddit": texts(_listings(spark, sf), F.lit("top"), "data"),
        "gdelt": texts(_articles(spark, sf), F.col("source"), "articles"),
        "fred": texts(_observations(spark, sf), F.col("series"), "observations"),
        "edgar": texts(_filings(spark, sf), F.col("o_orderstatus"), "hits")}
    for _ in range(2):
        stages.stage_ingest(spark, root, landed, "2024-02-01")
    stored = raw.read_raw_table(spark, root)
    return stored.groupBy("feed", F.col("ingest_date").cast("string").alias("ingest_date")).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


# ---- macro series and regimes --------------------------------------------------------------------

def _points(spark, sf, gaps=True):
    return features.last_write_wins(
        B.volatility_writes(spark, sf, gaps), "date", "value", ("ts", "event_id"))


def _event_days(spark, sf):
    return B.table(spark, sf, "events").select(F.to_date("ts").alias("date")).distinct()


@_query
def macro_last_write(spark, sf):
    return _points(spark, sf, gaps=False)


@_query
def vix_interpolated(spark, sf):
    return timeseries.resample_daily_linear(_points(spark, sf))


@_query
def nearest_join(spark, sf):
    points = _points(spark, sf).withColumn("seen", F.col("date").cast("string"))
    return timeseries.nearest_join(_event_days(spark, sf), points)


@_query
def regime_labels(spark, sf):
    return labels.label_regimes(_event_days(spark, sf), _points(spark, sf))


@_query
def macro_pivot(spark, sf):
    return features.macro_pivot(
        B.volatility_writes(spark, sf), list(B.SERIES), ("ts", "event_id"),
        series="event_type")


# ---- panel ---------------------------------------------------------------------------------------

def _parts(spark, sf):
    return [features.sentiment_daily(_scores(spark, sf)), _geo(spark, sf),
            features.market_daily(_markets(spark, sf)), _topic_counts(spark, sf)]


@_query
def feature_matrix(spark, sf):
    return features.feature_matrix(_parts(spark, sf))


@_query
def feature_flags(spark, sf):
    """Parts with different date ranges: zeros and missing flags."""
    return features.feature_matrix(B.training_parts(spark, sf), missing_flags=True)


@_query
def select_features(spark, sf):
    return features.select_features(
        _geo(spark, sf), ["mean_tone", "absent", "std_goldstein", "total_events"])


def _composite(spark, sf):
    return features.composite_signal(
        features.sentiment_daily(_scores(spark, sf)), _geo(spark, sf))


@_query
def composite_signal(spark, sf):
    return _composite(spark, sf)


# ---- prices and alignment ------------------------------------------------------------------------

@_query
def prices_long(spark, sf):
    """Wide prices (a missing close where a ticker did not trade) back to long."""
    close = F.col("o_totalprice")
    wide = B.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(*[
        F.max(F.when(F.col("o_orderpriority") == t, close)).alias(t) for t in B.TICKERS])
    return normalize.prices_long(wide, B.TICKERS)


def _returns(spark, sf):
    return timeseries.forward_returns(B.prices(spark, sf))


@_query
def forward_returns(spark, sf):
    return _returns(spark, sf)


@_query
def period_returns(spark, sf):
    out = timeseries.pct_change(B.prices(spark, sf), "close", by=["ticker"])
    return timeseries.first_difference(out, "close", by=["ticker"])


@_query
def series_tail(spark, sf):
    return timeseries.tail_n(B.prices(spark, sf), 15, "date", ["ticker"])


def _aligned(spark, sf, mode="exact_ffill"):
    return timeseries.align_signals(
        _returns(spark, sf), B.regime_signals(spark, sf, gaps=True).drop("confidence"), mode)


@_query
def ffill_align(spark, sf):
    return _aligned(spark, sf)


def _weekend_signals(spark, sf):
    """Signals whose day is moved so that some fall on days without prices."""
    return B.regime_signals(spark, sf, gaps=True).select(
        F.date_sub("date", 1).alias("date"), "regime", "risk_on_prob")


@_query
def asof_align(spark, sf):
    return timeseries.align_signals(B.prices(spark, sf), _weekend_signals(spark, sf), "asof")


# ---- validation ----------------------------------------------------------------------------------

@_query
def ic_summary(spark, sf):
    out = validation.ic_summary(_aligned(spark, sf), B.MAPPING, digits=DIGITS)
    return out.withColumn("ic_class", rules.ic_class(F.col("ic")))


def _rolling(spark, sf):
    return validation.rolling_ic(_aligned(spark, sf), B.MAPPING, digits=DIGITS)


@_query
def rolling_ic(spark, sf):
    return _rolling(spark, sf)


@_query
def rolling_ic_wide(spark, sf):
    return validation.rolling_ic_wide(_rolling(spark, sf), list(B.MAPPING))


@_query
def rolling_tickers(spark, sf):
    return validation.tickers_present(_rolling(spark, sf))


# ---- back-test -----------------------------------------------------------------------------------

STRATEGIES = [
    backtest.Strategy(source, lookback, entry, leave, fees=fee)
    for source in ("sentiment", "geopolitical", "composite")
    for lookback in (252, 1260)
    for entry, leave in ((0.2, -0.1), (0.0, 0.3))
    for fee in (0.001, 0.01)
]


def _grid(spark, sf, lag=0):
    params = backtest.strategy_frame(spark, STRATEGIES)
    return backtest.grid(B.strategy_signals(spark, sf), B.market_prices(spark, sf), params, lag)


@_query
def backtest_positions(spark, sf):
    return _grid(spark, sf).select("strategy_id", "date", "bar", "signal", "position")


@_query
def backtest_equity(spark, sf):
    return _grid(spark, sf).select("strategy_id", "date", "period_return", "equity", "peak",
                                   "drawdown")


@_query
def backtest_lagged(spark, sf):
    return _grid(spark, sf, lag=1).select("strategy_id", "date", "period_return", "equity")


@_query
def backtest_trades(spark, sf):
    return backtest.trades(_grid(spark, sf))


@_query
def backtest_metrics(spark, sf):
    return backtest.metrics(_grid(spark, sf))


@_query
def backtest_reported(spark, sf):
    """Metrics with the decimals they are reported with."""
    return backtest.rounded(backtest.metrics(_grid(spark, sf)))


@_query
def backtest_summary(spark, sf):
    shown = backtest.summary_text(backtest.metrics(_grid(spark, sf)))
    return shown.select("strategy_id", "n_trades", "summary")


@_query
def backtest_rejected(spark, sf):
    """A source whose days have no prices gets a reason instead of metrics."""
    few = _composite(spark, sf).select(
        F.lit("sentiment").alias("signal_source"), "date", "signal")
    enough = B.strategy_signals(spark, sf).where(F.col("signal_source") != "sentiment")
    params = backtest.strategy_frame(spark, STRATEGIES)
    frame = backtest.bars(enough.unionByName(few), B.market_prices(spark, sf), params)
    return backtest.rejected(frame, params)


# ---- tables, streaming ---------------------------------------------------------------------------

@_query
def upsert_daily(spark, sf):
    """Write daily event counts, then upsert the days of error events with their own counts."""
    path = scratch_path(spark, "upsert")
    events = B.table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    daily = events.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    errors = events.where((F.col("event_type") == "error") & (F.dayofmonth("date") > 20)).groupBy(
        "date").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    for frame in (daily, errors, errors):
        tables.upsert_daily(frame, path)
    return spark.read.parquet(path).drop("year")


@_query
def publish_signals(spark, sf):
    """Signal table after publishing the history and then a second version of it; newest 90."""
    path = scratch_path(spark, "signals")
    first = B.regime_signals(spark, sf)
    tables.publish_signal(first, path)
    tables.publish_signal(first.where(F.year("date") >= 2000).withColumn(
        "confidence", F.lit(1.0)), path)
    return tables.feature_tail(tables.signal_table(spark, path), 90, serve.SIGNAL_COLUMNS)


@_query
def renormalised_signals(spark, sf):
    s = B.regime_signals(spark, sf)
    on, off, mid = rules.renormalise(
        F.col("risk_on_prob"), F.col("risk_off_prob") * 2, F.col("transition_prob") * 0.5)
    return s.select("date", rules.display_day(F.col("date")).alias("shown"),
                    rules.display_label(F.col("regime")).alias("regime"), on.alias("risk_on"),
                    off.alias("risk_off"), mid.alias("transition"))


def _filed(docs, root, value):
    """Write one text line per document below ``<root>/raw``, filed by source and day."""
    docs.select(F.col("source").alias("feed"), F.to_date("timestamp").alias("ingest_date"),
                value.alias("value")).hint("rebalance", "feed", "ingest_date").write.partitionBy(
        "feed", "ingest_date").text(f"{root}/raw")


@_query
def raw_by_day(spark, sf):
    """Scan of two chosen days of the landed lines of every feed."""
    root = scratch_path(spark, "days")
    _filed(_raw_documents(spark, sf), root, F.to_json(F.struct(*schemas.RAW_COLUMNS)))
    chosen = raw.read_raw(spark, root, days=["2024-01-05", "2024-01-20"])
    return chosen.groupBy("feed", "ingest_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("n_chars"))


def _raw_documents(spark, sf):
    docs = B.documents(spark, sf)
    return docs.select(
        "id", "source", "source_type", F.col("date").cast("timestamp").alias("timestamp"),
        F.lit(None).cast("string").alias("title"), "body", F.lit(None).cast("string").alias("url"),
        F.lit("{}").alias("metadata"))


@_query
def raw_roundtrip(spark, sf):
    """Append all documents by event day, replace one day, then scan every feed."""
    root = scratch_path(spark, "raw")
    docs = _raw_documents(spark, sf)
    raw.append_raw(docs, root)
    redo = docs.where(F.to_date("timestamp") == "2024-01-05").withColumn(
        "body", F.lit("replaced"))
    raw.write_raw(redo, root, "2024-01-05")
    return raw.read_raw_table(spark, root).groupBy("feed", "ingest_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("n_chars"))


@_query
def raw_jsonl(spark, sf):
    """JSON lines filed by source and day, with records lacking an id put aside."""
    root = scratch_path(spark, "jsonl")
    docs = _raw_documents(spark, sf)
    broken = F.col("source_type") == "es"
    _filed(docs, root, F.when(broken, F.concat(F.lit("{broken "), F.col("id"))).otherwise(
        F.to_json(F.struct(F.when(F.col("source_type") != "de", F.col("id")).alias("id"), *[
            c for c in schemas.RAW_COLUMNS if c != "id"]))))
    good, bad = raw.read_raw(spark, root, quarantine=True)
    ok = good.select("feed", "ingest_date", F.lit(0).alias("bad"), F.length("body").alias("n"))
    out = ok.unionByName(bad.select("feed", "ingest_date", F.lit(1).alias("bad"),
                                    F.lit(0).alias("n")))
    return out.groupBy("feed", "ingest_date", "bad").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n_chars"))


def _stream_events(spark, sf):
    """The event table as a stream; the pattern fits a single file as well as a folder."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")


@_query
def stream_daily(spark, sf):
    """The stored result of the streaming daily table equals the batch table."""
    path, checkpoint = scratch_path(spark, "daily"), scratch_path(spark, "daily-state")
    rows = _stream_events(spark, sf).select(
        F.col("ts").cast("timestamp").alias("timestamp"), B.news_metadata().alias("metadata"))
    daily = streaming.geo_stream(features.geo_fields(rows))
    streaming.run_to_table(daily, path, checkpoint).awaitTermination()
    return spark.read.parquet(path).drop("year")


@_query
def stream_recomputed(spark, sf):
    """Events that arrive in two streams, the second one all late: the counts have every event."""
    store, path = scratch_path(spark, "events"), scratch_path(spark, "recomputed")
    build = lambda rows: features.geo_daily(features.geo_fields(rows))
    for late in (False, True):
        rows = _stream_events(spark, sf).where((F.col("event_id") % 3 == 0) == F.lit(late)).select(
            F.col("ts").cast("timestamp").alias("timestamp"), B.news_metadata().alias("metadata"))
        streaming.run_recomputed(
            rows, store, build, path, scratch_path(spark, "recomputed-state"),
            source="late" if late else "live").awaitTermination()
    return spark.read.parquet(path).drop("year")


@_query
def stream_merged(spark, sf):
    """Daily rows from states of three streams, two of them late; no event is read again."""
    store, path = scratch_path(spark, "states"), scratch_path(spark, "merged")
    for part in range(3):
        rows = _stream_events(spark, sf).where(F.col("event_id") % 3 == part).select(
            F.col("ts").cast("timestamp").alias("timestamp"), B.news_metadata().alias("metadata"))
        streaming.run_merged(
            rows, store, lambda r: states.geo_state(features.geo_fields(r)), states.geo_from_states, path,
            scratch_path(spark, "merged-state"), source=f"part{part}").awaitTermination()
    return spark.read.parquet(path).drop("year")


@_query
def stream_markets(spark, sf):
    """The streaming market table equals the batch table; landed records arrive as files."""
    landed, path = scratch_path(spark, "markets"), scratch_path(spark, "market-days")
    _markets(spark, sf).withColumn("fetched_at", F.col("date").cast("timestamp")).drop("date").write.parquet(
        landed)
    rows = spark.readStream.schema(spark.read.parquet(landed).schema).parquet(landed)
    streaming.run_to_table(streaming.market_stream(rows), path, scratch_path(
        spark, "market-state")).awaitTermination()
    return spark.read.parquet(path).drop("year")


@_query
def stream_sentiment(spark, sf):
    """The streaming sentiment table equals the batch table; scores arrive as files."""
    landed, path = scratch_path(spark, "scores"), scratch_path(spark, "score-days")
    _scores(spark, sf).select(
        F.col("date").cast("timestamp").alias("timestamp"), "positive", "negative",
        "composite").write.parquet(landed)
    rows = spark.readStream.schema(spark.read.parquet(landed).schema).parquet(landed)
    streaming.run_to_table(streaming.sentiment_stream(rows), path, scratch_path(
        spark, "score-state")).awaitTermination()
    return spark.read.parquet(path).drop("year")


@_query
def stream_dedup(spark, sf):
    """First event per user through the stateful operator: the set of users."""
    path, checkpoint = scratch_path(spark, "users"), scratch_path(spark, "users-state")
    rows = _stream_events(spark, sf).select(F.col("user_id").alias("id"))
    unique = streaming.dedup_stream(rows, watermark=None)
    (unique.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        .awaitTermination())
    return spark.read.schema(unique.schema).parquet(path)


@_query
def stream_first(spark, sf):
    """First event per user, whole, with how many repeated and late ones lie beside it. Events land in
    three parts; the stream is started anew for each and goes on from its state."""
    landed, path, checkpoint = (scratch_path(spark, n) for n in ("landed", "first", "first-state"))
    events = B.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (2, 0, 1):
        events.where(F.col("event_id") % 3 == part).write.mode("append").parquet(landed)
        streaming.run_first_records(
            spark.readStream.schema(events.schema).parquet(landed), path, checkpoint, "user_id",
            "ts").awaitTermination()
    stored = spark.read.parquet(path)
    beside = stored.where("status <> 'first'").groupBy("user_id").agg(
        F.count_if(F.col("status") == "repeat").alias("n_repeat"),
        F.count_if(F.col("status") == "late").alias("n_late"))
    return stored.where("status = 'first'").join(beside, "user_id", "left").select(
        "user_id", "event_id", F.unix_micros("ts").alias("micros"), "event_type", "value", "props",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_repeat", "n_late")])


# ---- model ---------------------------------------------------------------------------------------

def _training(spark, sf):
    matrix = features.feature_matrix(B.training_parts(spark, sf))
    return labels.label_regimes(matrix, B.training_points(spark, sf))


@_query
def training_labels(spark, sf):
    return _training(spark, sf).select("date", "n_orders", "quantity", "vix", "regime")


@_query
def ts_split(spark, sf):
    split = model.ts_split(B.status_shares(spark, sf).select("date"), 3)
    return split


def _judged(spark, sf):
    """A fixed rule as classifier: long texts are predicted to be of good quality."""
    truth = B.table(spark, sf, "labels")
    docs = B.table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    long = F.when(F.col("n_chars") > 2000, "2").when(F.col("n_chars") > 400, "1").otherwise("0")
    return truth.join(docs, "doc_id").select(
        F.col("lang").alias("fold"), F.col("quality").cast("string").alias("label"),
        long.alias("prediction"))


@_query
def confusion(spark, sf):
    return model.confusion(_judged(spark, sf), ["0", "1", "2"], by=["fold"])


@_query
def class_report(spark, sf):
    return model.class_report(_judged(spark, sf))


@_query
def train_predict(spark, sf):
    """Cross-validated accuracy per fold and the newest prediction."""
    labelled = _training(spark, sf)
    fitted, folds = model.train(labelled)
    report = model.class_report(folds).groupBy("fold").agg(F.first("accuracy").alias("accuracy"))
    latest = model.predict_latest(fitted, labelled).select("date", "regime", "confidence")
    newest = latest.select(F.struct(*latest.columns)).scalar()  # one row
    return report.withColumn("_l", newest).select("fold", "accuracy", "_l.*")


def _by_quarter(spark, sf):
    """A panel whose regime is decided by one feature with wide gaps, and the model of it."""
    level = (F.quarter("date") % 3) * 10.0
    panel = B.status_shares(spark, sf).select("date", "n_orders", level.alias("level"))
    labelled = panel.withColumn("regime", F.when(F.col("level") == 0, "risk_on").when(
        F.col("level") == 10, "transition").otherwise("risk_off"))
    return panel, *model.train(labelled)


@_query
def predict_known(spark, sf):
    """Regime of every day by a model of a known rule."""
    panel, fitted, _ = _by_quarter(spark, sf)
    return model.predict_all(fitted, panel).select("date", "regime")


@_query
def train_known(spark, sf):
    """Class report of the folds of a known rule."""
    return model.class_report(_by_quarter(spark, sf)[2])


@_query
def latest_known(spark, sf):
    """Newest day through the model of a known rule, and without any model, per source."""
    panel, fitted, _ = _by_quarter(spark, sf)
    docs = B.documents(spark, sf)
    both = [serve.with_source_counts(
        model.predict_latest(m, panel).select("date", "regime"), docs, "source", "date")
        for m in (fitted, None)]
    return both[0].unionByName(both[1])


@_query
def predict_history(spark, sf):
    """Every day predicted by a model on all days."""
    labelled = _training(spark, sf)
    fitted, _ = model.train(labelled, model.TrainParams(folds=0))
    return model.predict_all(fitted, labelled).drop("probabilities")


@_query
def attribution(spark, sf):
    labelled = _training(spark, sf)
    fitted, _ = model.train(labelled, model.TrainParams(folds=0))
    return model.attribution(fitted, labelled)


def _two_splits(spark, sf):
    """A panel whose regime two features decide: the third quarter, else the day of the month. One tree
    over all days finds the quarter first, as that leaves less to decide."""
    day = B.status_shares(spark, sf).select("date", "n_orders")
    panel = day.withColumns({
        "level": F.when(F.quarter("date") == 3, 0.0).otherwise(10.0),
        "band": F.when(F.dayofmonth("date") % 4 == 0, 0.0).otherwise(8.0)})
    labelled = panel.withColumn("regime", F.when(F.col("level") == 0, "risk_on").when(
        F.col("band") == 0, "transition").otherwise("risk_off"))
    return panel, model.train(labelled, model.TrainParams(
        trees=1, row_sample=1.0, bootstrap=False, column_sample=1.0, folds=0))[0]


@_query
def shapley_known(spark, sf):
    """Contributions of every day to every class by a tree of a known rule."""
    panel, fitted = _two_splits(spark, sf)
    return model.contributions(fitted, panel)


@_query
def attribution_known(spark, sf):
    """Largest mean contributions over the last 50 days by a tree of a known rule."""
    panel, fitted = _two_splits(spark, sf)
    return model.top_attribution(model.attribution(fitted, panel))


@_query
def latest_signal(spark, sf):
    """Newest published signal with the record counts of each source."""
    latest = tables.feature_tail(B.regime_signals(spark, sf), 1, serve.SIGNAL_COLUMNS)
    return serve.with_source_counts(latest, B.documents(spark, sf), "source", "date").select(
        "date", "regime", "confidence", "source", "n_days", "n_records")


@_query
def topic_fit(spark, sf):
    """Clusters of the embeddings with their sizes."""
    vectors = B.table(spark, sf, "embeddings")
    _, assigned = topics.fit_assigned(vectors, "kmeans", "embedding", 10)
    return assigned.groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("topic_prob").alias("mean_prob"))


@_query
def topic_fit_text(spark, sf):
    """Topics of the document texts by latent Dirichlet allocation."""
    docs = sentiment.scorable(B.documents(spark, sf))
    _, assigned = topics.fit_assigned(docs, "lda", "body", 8)
    return assigned.groupBy("date", "topic_id").agg(
        F.count(F.lit(1)).alias("n"))


@_query
def topic_density(spark, sf):
    """Topics of the document texts by density: their number is found, thin places are noise."""
    points = density.text_points(B.documents(spark, sf), keep=["doc_id"])
    return density.density_topics(points).select("doc_id", "topic_id", "topic_prob")
