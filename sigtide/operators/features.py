"""Daily features: sentiment, geopolitics, markets, and the panel that joins them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtide import constants as K
from sigtide.functions.parse import clip

# ---- sentiment -----------------------------------------------------------------------------------


def sentiment_daily(scores: DataFrame, date: str = "date") -> DataFrame:
    """Means over all records of a day (each record counts once, whatever its source)."""
    return scores.groupBy(date).agg(
        F.avg("composite").alias("cross_composite"), F.avg("positive").alias("cross_positive"),
        F.avg("negative").alias("cross_negative"), F.count("composite").alias("cross_count"))


def _by_source() -> list[Column]:
    return [
        F.avg("composite").alias("mean_composite"), F.avg("positive").alias("mean_positive"),
        F.avg("negative").alias("mean_negative"),
        F.stddev_samp("composite").alias("std_composite"), F.count("composite").alias("count"),
        F.avg("text_length").alias("mean_text_length")]


def sentiment_by_source(scores: DataFrame, date: str = "date") -> DataFrame:
    """Per day and source type. (Computed but thrown away in the original flow; kept here.)"""
    return scores.groupBy(date, "source_type").agg(*_by_source())


def sentiment_rollup(scores: DataFrame, date: str = "date") -> DataFrame:
    """Both levels in one pass: ``source_type`` is NULL on the cross-source rows.

    Scoring is the expensive part, so grouping sets read it once instead of twice.
    """
    level = F.grouping("source_type").cast("int").alias("is_cross")
    return scores.groupingSets(
        [[date, "source_type"], [date]], date, "source_type").agg(*_by_source(), level)


# ---- geopolitics ---------------------------------------------------------------------------------


def geo_fields(events: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Goldstein value and tone out of the metadata, scaled to about [-1, 1].

    Metadata is JSON text, parsed once for both fields, or an already typed struct. Missing values
    and non-objects count as 0.
    """
    zero = F.lit(0.0)
    typed = isinstance(events.schema[metadata].dataType, T.StructType)
    fields = F.col(metadata) if typed else F.from_json(
        metadata, "goldstein_scale double, tone double")
    return events.withColumn("_m", fields).withColumns({
        "goldstein_scalar": F.coalesce("_m.goldstein_scale", zero) / K.GOLDSTEIN_SCALE,
        "tone_scalar": F.coalesce("_m.tone", zero) / K.TONE_SCALE}).drop("_m")


def geo_daily(events: DataFrame, date: str = "date") -> DataFrame:
    """Daily conflict / cooperation aggregates and the clipped risk score.

    The conflict ratio counts events below the Goldstein threshold; the event-code table is a
    separate scalar (``signals.cameo_score``).
    """
    g = F.col("goldstein_scalar")
    daily = events.groupBy(date).agg(
        F.avg(g).alias("mean_goldstein"), F.stddev_samp(g).alias("std_goldstein"),
        F.avg("tone_scalar").alias("mean_tone"),
        F.count_if(g < K.CONFLICT_BELOW).alias("conflict_events"),
        F.count_if(g > K.COOPERATION_ABOVE).alias("cooperation_events"),
        F.count(g).alias("total_events"))
    return geo_scores(daily)


def geo_scores(daily: DataFrame) -> DataFrame:
    """Adds the conflict ratio and the clipped risk score to daily geopolitical aggregates."""
    ratio = F.col("conflict_events") / F.greatest(F.col("total_events"), F.lit(1))
    daily = daily.withColumn("conflict_ratio", ratio)
    risk = (F.col("mean_goldstein") * K.RISK_MEAN_WEIGHT
            + F.col("conflict_ratio") * K.RISK_CONFLICT_WEIGHT)
    return daily.withColumn("geopolitical_risk_score", clip(risk, -1.0, 1.0))


# ---- prediction markets --------------------------------------------------------------------------


def market_daily(records: DataFrame, date: str = "date") -> DataFrame:
    """Open-interest-weighted signal in [-1, 1] and market counts per day.

    The scalar uses weighted markets with a price, each weighing at least 1; the counts and the
    open interest cover every weighted market, priced or not. A day without any gives 0.
    """
    w = F.coalesce(F.col("directional_weight"), F.lit(0.0))
    weighted = w != 0
    priced = weighted & F.col("mid_price").isNotNull()
    weight = F.greatest(F.coalesce(F.col("open_interest"), F.lit(0.0)), F.lit(1.0))
    signal = (clip(F.col("mid_price"), 0.0, 1.0) - 0.5) * 2.0 * w
    daily = records.groupBy(date).agg(
        F.sum(F.when(priced, signal * weight)).alias("_num"),
        F.sum(F.when(priced, weight)).alias("_den"),
        F.count(F.lit(1)).alias("kalshi_n_markets"),
        F.count_if(weighted).alias("kalshi_n_weighted_markets"),
        F.coalesce(F.sum(F.when(weighted, F.col("open_interest"))), F.lit(0.0)).alias(
            "kalshi_total_open_interest"))
    scalar = clip(F.coalesce(F.try_divide("_num", "_den"), F.lit(0.0)), -1.0, 1.0)
    return daily.select(
        date, scalar.alias("kalshi_regime_scalar"), "kalshi_n_markets",
        "kalshi_n_weighted_markets", "kalshi_total_open_interest")


# ---- macro series --------------------------------------------------------------------------------


def last_write_wins(df: DataFrame, key: Sequence[str] | str, value: str,
                    order: Sequence[str]) -> DataFrame:
    """Value of the latest write (later ingest day, then later line) per key.

    Writes that tie in ``order`` are decided by the larger value, so a rerun agrees.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order, value)).alias(value))


def macro_pivot(df: DataFrame, series_ids: Sequence[str], order: Sequence[str],
                date: str = "date", series: str = "series_id",
                value: str = "value") -> DataFrame:
    """One column per macro series, latest write per cell, in a single aggregation.

    The id list is explicit: the schema does not depend on the data and no job lists the ids.
    """
    at = F.struct(*order)
    return df.where(F.col(series).isin(*series_ids)).groupBy(date).agg(*[
        F.max_by(F.col(value), F.when(F.col(series) == s, at)).alias(s) for s in series_ids])


# ---- panel ---------------------------------------------------------------------------------------


def feature_matrix(parts: Sequence[DataFrame], date: str = "date",
                   missing_flags: bool = False) -> DataFrame:
    """Full outer join of daily parts on the date; absent values become 0.

    Written as one union and one aggregation, so n parts cost one shuffle rather than n - 1 full
    outer joins. Dates must be unique in every part; a duplicate raises. ``missing_flags`` adds a
    ``part<i>_missing`` column per part.
    """
    marks, names, frames = [], [], []
    for i, part in enumerate(parts):
        marks.append(f"_part{i}")
        cols = [c for c in part.columns if c != date]
        names += cols
        frames.append(part.select(date, *cols, F.lit(1).alias(marks[-1])))
    if len(set(names)) != len(names):
        raise ValueError("feature names must differ between parts")
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    merged = stacked.groupBy(date).agg(
        *[F.max(c).alias(c) for c in names], *[F.count(m).alias(m) for m in marks])
    twice = F.greatest(*[F.col(m) for m in marks], F.lit(0)) > 1
    checked = F.when(twice, F.raise_error(F.concat(
        F.lit("duplicate date in a feature part: "), F.col(date).cast("string"))).cast("int"))
    merged = merged.where(checked.isNull())
    flags = [(F.col(m) == 0).cast("int").alias(f"part{i}_missing")
             for i, m in enumerate(marks)] if missing_flags else []
    return merged.select(date, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names], *flags)


def select_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ("date",)
                    ) -> DataFrame:
    """The model's columns in its order; columns the frame lacks are 0."""
    return df.select(*keep, *[
        (F.coalesce(F.col(c), F.lit(0)) if c in df.columns else F.lit(0)).cast("double").alias(c)
        for c in names])


def composite_signal(sentiment: DataFrame, geo: DataFrame,
                     weights: tuple[float, float] = K.COMPOSITE_WEIGHTS) -> DataFrame:
    """Weighted sum of sentiment and negated risk on the dates both have."""
    joined = sentiment.select("date", "cross_composite").join(
        geo.select("date", "geopolitical_risk_score"), "date")
    value = (F.col("cross_composite") * weights[0]
             + (-F.col("geopolitical_risk_score")) * weights[1])
    return joined.select("date", value.alias("signal")).where(F.col("signal").isNotNull())


def signal_series(source: str, sentiment: DataFrame | None = None,
                  geo: DataFrame | None = None) -> DataFrame:
    """Back-test input by name: ``sentiment``, ``geopolitical`` (negated risk) or ``composite``."""
    if source == "sentiment":
        return sentiment.select("date", F.col("cross_composite").alias("signal"))
    if source == "geopolitical":
        return geo.select("date", (-F.col("geopolitical_risk_score")).alias("signal"))
    if source == "composite":
        return composite_signal(sentiment, geo)
    raise ValueError(f"unknown signal source {source!r}")
