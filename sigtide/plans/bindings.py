"""Domain tables derived from the star-schema and text tables of a data folder.

Each function reads whole tables. Selections appear only where they carry meaning (a stored feed,
missing observation days), never to make a query smaller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtide.functions.parse import json_double
from sigtide.functions.text import record_id

# fixed values: frequent invented words of the text tables, grouped for the word-list scorer and
# the topic labels (the prose has no real finance vocabulary)
POSITIVE = ("that", "with", "this")
NEGATIVE = ("from", "ther", "than")
TOPIC_WORDS = {
    "inflation": ("the", "ing "),
    "monetary_policy": ("die", "sch", "und"),
    "recession": ("les", "eaux", "que"),
    "credit": ("los", "ción", "el "),
    "geopolitics": ("zz", "qq"),
}
EDIT_WORDS = ("eauxque", "hain", "für die", "tion the", "queaux")
SERIES = ("click", "error", "purchase", "signup", "view")  # the kinds of events
START = "2024-01-01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def day_of(key: Column) -> Column:
    """One of thirty days from a numeric key."""
    return F.date_add(F.lit(START).cast("date"), (key % 30).cast("int"))


def pick(index: Column, *values: str) -> Column:
    """Constant chosen by a number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Raw text records, one per document."""
    return table(spark, sf, "documents").select(
        "doc_id", record_id("doc", F.col("doc_id").cast("string")).alias("id"), "source",
        F.col("lang").alias("source_type"), F.col("text").alias("body"),
        day_of(F.col("doc_id")).alias("date"))


def news_metadata() -> Column:
    """Typed metadata of an event: errors are hostile, views carry no Goldstein value."""
    size = F.least(F.col("value") / 10.0, F.lit(10.0))
    goldstein = F.when(F.col("event_type") == "error", -size).when(
        F.col("event_type") != "view", size)
    tone = json_double(F.col("props"), "k") - 50.0 + F.col("value") / 1000.0
    return F.struct(goldstein.alias("goldstein_scale"), tone.alias("tone"))


def news_events(spark: SparkSession, sf: str) -> DataFrame:
    """News events with their metadata; the tone is read out of the props JSON."""
    return table(spark, sf, "events").select(
        "event_id", F.to_date("ts").alias("date"), F.col("ts").alias("timestamp"),
        news_metadata().alias("metadata"))


def event_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Event codes: known and unknown roots, one-character codes and NULLs."""
    key = F.col("event_id")
    code = F.concat(F.lpad(((key * 7) % 45).cast("string"), 2, "0"), (key % 10).cast("string"))
    return table(spark, sf, "events").select(F.when(
        key % 50 != 0, F.when(key % 50 == 1, F.lit("9")).otherwise(code)).alias("code"))


def market_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Landed market events, one market each; open interest is the ordered quantity."""
    part = table(spark, sf, "part")
    interest = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum("l_quantity").alias("oi"))
    key, size = F.col("p_partkey"), F.col("p_size")
    series = pick(key, "KXFED", "KXCPI", "KXFEDDECISION", "KXRATECUTCOUNT", "KXGDP", "KXUNEMP",
                  "KXINFL", "KXRECESSION")
    event = F.concat(series, F.lit("-"), pick(key, "26APR", "26JUN", "26MAY"))
    ticker = F.concat(event, F.lit("-"), pick(size, "T", "B", "U", "A", "H", "X"),
                      F.floor(size / 10).cast("string"), F.lit("."), (size % 10).cast("string"))
    title = pick(F.floor(key / 8), "Rate above target", "Rate cut", "Government spending", "Hold",
                 "Will it be lower", "", "Recession odds")
    bid = F.when(key % 5 != 0, F.round((F.col("p_retailprice") - 900.0) / 100.0, 3)).otherwise(0.0)
    ask = F.when(key % 7 != 0, F.round((F.col("p_retailprice") - 898.0) / 100.0, 3)).otherwise(0.0)
    last = F.when(key % 11 != 0, size / 50.0).otherwise(0.0)
    market = F.struct(
        ticker.alias("ticker"), title.alias("title"), F.col("p_name").alias("yes_sub_title"),
        bid.cast("string").alias("yes_bid_dollars"), ask.cast("string").alias("yes_ask_dollars"),
        last.cast("string").alias("last_price_dollars"),
        F.col("oi").cast("string").alias("open_interest_fp"), F.lit("n/a").alias("volume"))
    return part.join(interest, "p_partkey", "left").select(
        day_of(key).alias("date"), event.alias("event_ticker"), F.array(market).alias("markets"))


def volatility_writes(spark: SparkSession, sf: str, gaps: bool = False) -> DataFrame:
    """Index values as written during each day; with ``gaps`` every third day has none."""
    rows = table(spark, sf, "events").select(
        F.to_date("ts").alias("date"), "ts", "event_id", "event_type",
        (F.col("value") / 2.0).alias("value"))
    return rows.where(F.dayofmonth("date") % 3 != 0) if gaps else rows


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """(date, ticker, close): 100 plus the scaled largest order value per day and priority."""
    return table(spark, sf, "orders").groupBy(
        F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("ticker")).agg(
        (100.0 + F.max("o_totalprice") / 10000.0).alias("close"))


def market_prices(spark: SparkSession, sf: str) -> DataFrame:
    """(date, close) over all orders."""
    return table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        (100.0 + F.max("o_totalprice") / 10000.0).alias("close"))


TICKERS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
# Same roles as the usual tickers: two risk-on assets, two havens, one without a mapping.
MAPPING = {
    "1-URGENT": ("risk_on_prob", 1.0), "2-HIGH": ("risk_on_prob", 1.0),
    "3-MEDIUM": ("risk_off_prob", -1.0), "4-NOT SPECIFIED": ("risk_off_prob", -1.0),
}


def status_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Daily shares of the three order states, named as regime probabilities."""
    status = F.col("o_orderstatus")
    n = F.count(F.lit(1))
    return table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        (F.count_if(status == "F") / n).alias("risk_on_prob"),
        (F.count_if(status == "O") / n).alias("risk_off_prob"),
        (F.count_if(status == "P") / n).alias("transition_prob"), n.alias("n_orders"))


def regime_signals(spark: SparkSession, sf: str, gaps: bool = False) -> DataFrame:
    """Daily signals; with ``gaps`` none on days 7, 14, 21 and 28, for alignment to carry over."""
    on, off, mid = (F.col(f"{c}_prob") for c in ("risk_on", "risk_off", "transition"))
    best = F.greatest(on, off, mid)
    shares = status_shares(spark, sf)
    shares = shares.where(F.dayofmonth("date") % 7 != 0) if gaps else shares
    return shares.select(
        "date", F.when(on == best, "risk_on").when(off == best, "risk_off").otherwise(
            "transition").alias("regime"), best.alias("confidence"), "risk_on_prob",
        "risk_off_prob", "transition_prob")


def strategy_signals(spark: SparkSession, sf: str) -> DataFrame:
    """(signal_source, date, signal) for the three back-test sources."""
    shares = status_shares(spark, sf)
    first = F.col("risk_on_prob") - F.col("risk_off_prob")
    second = F.col("transition_prob") - F.col("risk_off_prob")
    return shares.select("date", F.explode(F.array(
        F.struct(F.lit("sentiment").alias("signal_source"), first.alias("signal")),
        F.struct(F.lit("geopolitical").alias("signal_source"), second.alias("signal")),
        F.struct(F.lit("composite").alias("signal_source"),
                 (first * 0.6 + second * 0.4).alias("signal")))).alias("_s")).select(
        "_s.signal_source", "date", "_s.signal")


def training_points(spark: SparkSession, sf: str) -> DataFrame:
    """Long volatility series for training."""
    return table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        (F.avg("o_totalprice") / 12500.0).alias("value"))


def training_parts(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Two daily feature parts with different date ranges."""
    price = F.col("o_totalprice")
    order_part = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.max(price).alias("max_price"),
        F.min(price).alias("min_price"), F.stddev_samp(price).alias("std_price"))
    line_part = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.avg("l_discount").alias("mean_discount"),
        F.sum("l_quantity").alias("quantity"))
    return [order_part, line_part]
