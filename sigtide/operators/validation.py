"""Does the signal predict returns? Rank correlations, information ratio, hit rate."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.functions.parse import real
from sigtide.functions.stats import (
    avg_rank, calendar_window, rank_correlation_sums, t_two_sided_p, window_spearman)


def signed_signal(aligned: DataFrame, mapping: dict[str, tuple[str, float]] | None = None
                  ) -> DataFrame:
    """Signal with the sign each ticker calls for; tickers outside the mapping are dropped."""
    mapping = mapping or K.SIGNAL_MAP
    ticker = F.col("ticker")
    choice = F.coalesce(*[
        F.when(ticker == t, F.col(col).cast("double") * sign)
        for t, (col, sign) in mapping.items() if col in aligned.columns])
    return aligned.where(ticker.isin(*mapping)).withColumn("signal", real(choice))


def ic_pairs(aligned: DataFrame, mapping=None, horizons: Sequence[int] = K.HORIZONS) -> DataFrame:
    """Long (ticker, horizon, date, signal, ret) rows where both values exist."""
    returns = F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), real(F.col(f"fwd_{h}d")).alias("ret"))
        for h in horizons]))
    return (signed_signal(aligned, mapping)
            .select("ticker", "date", "signal", returns.alias("_r"))
            .select("ticker", "date", "signal", "_r.*")
            .where(F.col("signal").isNotNull() & F.col("ret").isNotNull()))


def ic_summary(aligned: DataFrame, mapping=None, horizons: Sequence[int] = K.HORIZONS,
               window: int = K.ROLLING_WINDOW, min_obs: int = K.MIN_OBSERVATIONS,
               digits: int = 4) -> DataFrame:
    """Tearsheet: IC, p-value, information ratio, hit rate and count per ticker and horizon.

    The rolling windows hold the ``window`` pairs before each pair (missing pairs are removed
    first; the last pair never enters a window). Ranks, rolling windows and totals all use the
    partitioning by (ticker, horizon), so the table is shuffled once.
    """
    key = ("ticker", "horizon")
    history = calendar_window("date", *key)
    frame = history.rowsBetween(-window, -1)
    ranked = ic_pairs(aligned, mapping, horizons).withColumns({
        "_rs": avg_rank("signal", *key), "_rr": avg_rank("ret", *key),
        "_n": F.row_number().over(history),
        "_ws": F.collect_list("signal").over(frame), "_wr": F.collect_list("ret").over(frame)})
    full = F.col("_n") > window
    rolling = window_spearman(F.when(full, F.col("_ws")), F.when(full, F.col("_wr")))
    total = ranked.withColumn("_rho", rolling).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.sum(F.col("_rs") * F.col("_rr")).alias("_xy"),
        F.sum(F.col("_rs") * F.col("_rs")).alias("_xx"),
        F.sum(F.col("_rr") * F.col("_rr")).alias("_yy"),
        F.avg("_rho").alias("_mean"), F.stddev_samp("_rho").alias("_std"),
        F.avg((F.signum("signal") == F.signum("ret")).cast("double")).alias("hit_rate"),
    ).where(F.col("n_obs") >= min_obs)
    n = F.col("n_obs").cast("double")
    total = total.withColumn("_ic", rank_correlation_sums(
        n, F.col("_xy"), F.col("_xx"), F.col("_yy")))
    ir = F.when(F.col("_std") > 0, F.col("_mean") / F.col("_std") * math.sqrt(K.TRADING_DAYS))
    return total.select(
        *key, F.round("_ic", digits).alias("ic"),
        F.round(t_two_sided_p(F.col("_ic"), F.col("n_obs")), digits).alias("ic_pvalue"),
        F.round(ir, digits).alias("ir"), F.round("hit_rate", digits).alias("hit_rate"), "n_obs")


def rolling_ic(aligned: DataFrame, mapping=None, window: int = K.ROLLING_WINDOW,
               min_obs: int = K.MIN_WINDOW_OBSERVATIONS, horizon: int = 1,
               digits: int = 4) -> DataFrame:
    """IC over the ``window`` rows before each date; missing values are skipped inside a window.

    Windows with fewer than ``min_obs`` usable rows or a constant side give no row. A frame is
    collected as a pair of ``window``-long arrays (missing as NaN), so rows are not copied once
    per window they belong to.
    """
    history = calendar_window("date", "ticker")
    frame = history.rowsBetween(-window, -1)
    rows = signed_signal(aligned, mapping).select(
        "ticker", "date", "signal", real(F.col(f"fwd_{horizon}d")).alias("ret"))
    nan = F.lit(float("nan"))
    rows = rows.withColumns({
        "_n": F.row_number().over(history),
        "_usable": F.count_if(F.col("signal").isNotNull() & F.col("ret").isNotNull()).over(frame),
        "_ws": F.collect_list(F.coalesce("signal", nan)).over(frame),
        "_wr": F.collect_list(F.coalesce("ret", nan)).over(frame)})
    rho = rows.where((F.col("_n") > window) & (F.col("_usable") >= min_obs)).withColumn(
        "rolling_ic", window_spearman("_ws", "_wr"))
    return rho.where(F.col("rolling_ic").isNotNull()).select(
        "date", "ticker", F.round("rolling_ic", digits).alias("rolling_ic"))


def rolling_ic_wide(rolling: DataFrame, tickers: Sequence[str] = K.PRICE_TICKERS) -> DataFrame:
    """One row per date, one column per ticker."""
    return rolling.groupBy("date").agg(*[
        F.max(F.when(F.col("ticker") == t, F.col("rolling_ic"))).alias(t) for t in tickers])


def tickers_present(rolling: DataFrame) -> DataFrame:
    return rolling.select("ticker").distinct()

