"""Regime labels from a volatility series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.functions.parse import series_value
from sigtide.functions.signals import regime_label
from sigtide.operators.features import last_write_wins
from sigtide.operators.timeseries import nearest_join, resample_daily_linear


def volatility_points(raw: DataFrame, order: tuple[str, ...] = ("ingest_date", "id")) -> DataFrame:
    """Observed index values from macro raw records, the latest write per observation day.

    Reads the typed metadata; the rendered body is only a fallback.
    """
    rows = raw.where(F.contains("body", F.lit(K.VOLATILITY_SERIES + ":"))).withColumns({
        "value": series_value(F.col("body"), F.col("metadata")),
        "date": F.coalesce(F.get_json_object("metadata", "$.date").try_cast("date"),
                           F.col("ingest_date"))}).where(F.col("value").isNotNull())
    return last_write_wins(rows, "date", "value", order)


def label_regimes(dates: DataFrame, points: DataFrame, date: str = "date",
                  value: str = "value") -> DataFrame:
    """Regime of each date: daily linear series, nearest day, right-closed bins.

    Days outside the observed range take the edge value. A missing series gives NULL labels (not
    the text ``nan``), which training drops. ``dates`` holds each date once.
    """
    daily = resample_daily_linear(points, date, value).withColumnRenamed(value, "vix")
    return nearest_join(dates, daily, date, unique_left=True).withColumn(
        "regime", regime_label(F.col("vix")))
