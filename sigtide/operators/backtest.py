"""Threshold strategies over parameter grids.

A strategy is one row of parameters. Bars are joined to it on the signal source, then every window
and aggregate is keyed by ``strategy_id``: one shuffle for the whole back-test, and the number of
strategies, not the length of one, is what grows. A strategy has at most ``lookback_days`` bars.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.functions.stats import calendar_window

MAX_LOOKBACK = 1260


@dataclass(frozen=True)
class Strategy:
    """Parameters of one strategy, with the usual defaults."""

    signal_source: str = "composite"
    lookback_days: int = 252
    entry_threshold: float = 0.2
    exit_threshold: float = -0.1
    direction: str = "long"
    fees: float = 0.001

    def check(self) -> "Strategy":
        ranges = (30 <= self.lookback_days <= MAX_LOOKBACK, 0 <= self.entry_threshold <= 1,
                  -1 <= self.exit_threshold <= 1, 0 <= self.fees <= 0.05)
        if not all(ranges):
            raise ValueError(f"parameter out of range: {self}")
        if self.direction != "long":
            # Accepted but never acted on originally; refusing is better than a wrong result.
            raise ValueError("only direction='long' is defined")
        return self


PARAMS = ("strategy_id", "signal_source", "lookback_days", "entry_threshold", "exit_threshold",
          "fees")


def strategy_frame(spark: SparkSession, strategies: Sequence[Strategy]) -> DataFrame:
    rows = [(i, s.signal_source, s.lookback_days, float(s.entry_threshold),
             float(s.exit_threshold), float(s.fees))
            for i, s in enumerate(x.check() for x in strategies)]
    return spark.createDataFrame(
        rows, "strategy_id long, signal_source string, lookback_days int, "
              "entry_threshold double, exit_threshold double, fees double")


def bars(signals: DataFrame, prices: DataFrame, strategies: DataFrame,
         min_bars: int = K.MIN_BACKTEST_BARS) -> DataFrame:
    """Bars per strategy: the last ``lookback_days`` dates that have both signal and price.

    ``signals`` is (signal_source, date, signal), ``prices`` is (date, close). The equi-join on
    the source has one bar per source and day on one side; AQE splits a source that most
    strategies share. Strategies left with too few bars are reported by ``rejected``.
    """
    latest = Window.partitionBy("signal_source").orderBy(F.col("date").desc())
    recent = (signals.join(prices.select("date", "close"), "date")
              .where(F.col("signal").isNotNull() & F.col("close").isNotNull())
              .withColumn("_age", F.row_number().over(latest)))
    # bars the source can offer: the age of its oldest bar
    offered = F.max("_age").over(Window.partitionBy("signal_source"))
    recent = recent.withColumn("_offered", offered)
    joined = strategies.join(recent, "signal_source").where(
        F.col("_age") <= F.col("lookback_days"))
    return joined.where(F.least("_offered", "lookback_days") >= min_bars).drop("_age", "_offered")


def rejected(bar_frame: DataFrame, strategies: DataFrame,
             min_bars: int = K.MIN_BACKTEST_BARS) -> DataFrame:
    """Strategies without a result, and why."""
    done = bar_frame.select("strategy_id").distinct()
    return strategies.join(done, "strategy_id", "left_anti").select(
        "strategy_id", F.lit(f"fewer than {min_bars} bars with signal and price").alias("reason"))


def positions(df: DataFrame, order: str = "date", by: Sequence[str] = ("strategy_id",)
              ) -> DataFrame:
    """0/1 position of each bar under entry and exit thresholds.

    Flat goes long on an entry, long goes flat on an exit, and the first bar is ignored. Seen from
    outside: a bar with only an entry sets the position to 1, only an exit sets it to 0, and both
    at once (possible when the exit threshold is above the entry one) toggle it. The position is
    the last set value plus the toggles since, modulo 2, which windows can compute.
    """
    spec = calendar_window(order, *by)
    so_far = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    entry = F.col("signal") > F.col("entry_threshold")
    leave = F.col("signal") < F.col("exit_threshold")
    bar = F.row_number().over(spec) - 1
    df = df.withColumn("bar", bar).withColumns({
        "_set": F.when(F.col("bar") == 0, 0).when(entry & ~leave, 1).when(leave & ~entry, 0),
        "_flip": ((F.col("bar") > 0) & entry & leave).cast("int")})
    df = df.withColumn("_flips", F.sum("_flip").over(so_far))
    df = df.withColumn("_base", F.last(F.when(F.col("_set").isNotNull(), F.struct(
        F.col("_set").alias("v"), F.col("_flips").alias("f"))), ignorenulls=True).over(so_far))
    state = (F.col("_base.v") + F.col("_flips") - F.col("_base.f")) % 2
    return df.withColumn("position", state.cast("int")).drop("_set", "_flip", "_flips", "_base")


def equity_curve(df: DataFrame, order: str = "date", by: Sequence[str] = ("strategy_id",),
                 lag: int = 0) -> DataFrame:
    """Period return, compounded equity, running maximum and drawdown per bar.

    ``lag=0`` lets a bar earn its own return on the position it opens (a look-ahead kept for equal
    results); ``lag=1`` earns on the position held before the bar.
    """
    if lag not in (0, 1):
        raise ValueError("lag is 0 or 1")
    spec = calendar_window(order, *by)
    so_far = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.col("position") if lag == 0 else F.coalesce(F.lag("position", 1).over(spec), F.lit(0))
    change = F.try_divide(F.col("close"), F.lag("close").over(spec)) - 1.0
    df = df.withColumn("period_return", F.coalesce(change * held, F.lit(0.0)))
    df = df.withColumn("equity", F.product(1.0 + F.col("period_return")).over(so_far))
    df = df.withColumn("peak", F.max("equity").over(so_far))
    return df.withColumn("drawdown", (F.col("equity") - F.col("peak")) / F.col("peak"))


def mark_trades(df: DataFrame, order: str = "date", by: Sequence[str] = ("strategy_id",)
                ) -> DataFrame:
    """Flag entries and exits; ``trade_id`` counts entries, ``trade_return`` is set on exits.

    Fees raise the entry price and lower the exit price; they do not touch the equity curve.
    """
    spec = calendar_window(order, *by)
    so_far = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.coalesce(F.lag("position").over(spec), F.lit(0))
    opened = (F.col("position") == 1) & (before == 0)
    closed = (F.col("position") == 0) & (before == 1)
    df = df.withColumns({"opened": opened, "closed": closed})
    df = df.withColumns({
        "trade_id": F.count_if("opened").over(so_far),
        "_entry": F.last(F.when(F.col("opened"), F.struct(
            F.col("date").alias("date"), (F.col("close") * (1.0 + F.col("fees"))).alias("price"))),
            ignorenulls=True).over(so_far)})
    paid = F.col("close") * (1.0 - F.col("fees")) / F.col("_entry.price") - 1.0
    return df.withColumns({
        "entry_date": F.col("_entry.date"), "entry_price": F.col("_entry.price"),
        "trade_return": F.when(F.col("closed"), paid)}).drop("_entry")


def trades(marked: DataFrame) -> DataFrame:
    """Completed trades; one that is still open on the last bar is not a trade."""
    return marked.where("closed").select(
        "strategy_id", "trade_id", "entry_date", F.col("date").alias("exit_date"), "entry_price",
        (F.col("close") * (1.0 - F.col("fees"))).alias("exit_price"), "trade_return")


def metrics(marked: DataFrame) -> DataFrame:
    """Performance per strategy, from bars that carry equity and trade marks.

    Undefined ratios are 0. The annualisation uses the number of bars; the volatilities use the
    bar returns after the first, the downside one only the negative ones.
    """
    later = F.when(F.col("bar") > 0, F.col("period_return"))
    total = marked.groupBy("strategy_id").agg(
        F.first("signal_source").alias("signal_source"),
        F.first("lookback_days").alias("lookback_days"),
        F.count(F.lit(1)).alias("n_bars"),
        (F.max_by("equity", "bar") - 1.0).alias("total_return"),
        F.stddev_samp(later).alias("_vol"),
        F.stddev_samp(F.when(later < 0, later)).alias("_down"),
        F.min("drawdown").alias("max_drawdown"),
        F.count("trade_return").alias("n_trades"),
        F.count_if(F.col("trade_return") > 0).alias("_wins"))
    year = float(K.TRADING_DAYS)
    total = total.withColumn("annualized_return", F.pow(
        1.0 + F.col("total_return"), year / F.greatest(F.col("n_bars"), F.lit(1))) - 1.0)

    def ratio(scale):
        return F.when(scale > 0, F.col("annualized_return") / scale).otherwise(F.lit(0.0))

    root = math.sqrt(year)
    return total.select(
        "strategy_id", "signal_source", "lookback_days", "n_bars", "total_return",
        "annualized_return", ratio(F.col("_vol") * root).alias("sharpe_ratio"),
        ratio(F.col("_down") * root).alias("sortino_ratio"), "max_drawdown",
        ratio(F.abs("max_drawdown")).alias("calmar_ratio"),
        (F.col("_wins") / F.greatest(F.col("n_trades"), F.lit(1))).alias("win_rate"), "n_trades")


# fixed values: decimals of the reported ratios
SHOWN = {"total_return": 4, "annualized_return": 4, "sharpe_ratio": 3, "sortino_ratio": 3,
         "max_drawdown": 4, "calmar_ratio": 3, "win_rate": 3}


def rounded(result: DataFrame) -> DataFrame:
    """Metrics as they are reported."""
    return result.withColumns({c: F.round(c, digits) for c, digits in SHOWN.items()})


def summary_text(result: DataFrame) -> DataFrame:
    """Adds the one-sentence summary. Shown numbers are rounded half to even."""
    def shown(value, digits):
        return F.bround(value, digits)

    # fixed value: the wording of the summary
    text = F.format_string(
        "%s signal backtest over %d days. Strategy produced %s annualized returns of %.1f%% with "
        "Sharpe %.2f, max drawdown %.1f%%, and %d trades at %.0f%% win rate.",
        F.initcap("signal_source"), "lookback_days",
        F.when(F.col("annualized_return") > 0, "positive").otherwise("negative"),
        shown(F.col("annualized_return") * 100, 1), shown(F.col("sharpe_ratio"), 2),
        shown(F.col("max_drawdown") * 100, 1), "n_trades", shown(F.col("win_rate") * 100, 0))
    return result.withColumn("summary", text)


def grid(signals: DataFrame, prices: DataFrame, strategies: DataFrame, lag: int = 0) -> DataFrame:
    """Marked bars of every strategy: positions, equity, drawdown and trades."""
    return mark_trades(equity_curve(positions(bars(signals, prices, strategies)), lag=lag))
