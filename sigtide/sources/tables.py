"""Feature tables, the signal table and the run log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtide import schemas


def feature_tail(df: DataFrame, n: int, cols: Sequence[str] | None = None,
                 date: str = "date", ascending: bool = False) -> DataFrame:
    """Latest ``n`` days, newest first (or re-sorted oldest first for display)."""
    out = df.select(*cols) if cols else df
    out = out.orderBy(F.col(date).desc()).limit(n)
    return out.orderBy(date) if ascending else out


def write_feature(df: DataFrame, path: str) -> None:
    """Replace a feature table. Daily tables are small; AQE sizes the files."""
    df.hint("rebalance").write.mode("overwrite").parquet(path)


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None when nothing has been written there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def load_feature_parts(spark: SparkSession, paths: Sequence[str]) -> list[DataFrame]:
    """Feature tables that exist, with ``date`` as a date; fails when there is none."""
    found = [read_optional(spark, p) for p in paths]
    parts = [df.withColumn("date", F.to_date("date")).drop("year") for df in found
             if df is not None]
    if not parts:
        raise FileNotFoundError("no feature table found; run the feature stages first")
    return parts


def merged_rows(existing: DataFrame, new: DataFrame, key: str = "date") -> DataFrame:
    """Existing rows whose key is not in ``new``, plus ``new``."""
    kept = existing.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def upsert_daily(df: DataFrame, path: str, key: str = "date") -> None:
    """Replace the days present in ``df`` and keep the others; repeating it changes nothing.

    The table is partitioned by year: a day touches one small file set, not the whole table, and
    twenty years are twenty folders instead of thousands. Rows of the touched years are merged
    with the new ones and written by dynamic partition overwrite, which stages all files before it
    swaps folders: a lost executor or a failed job leaves the old rows in place, and only the swap
    itself is not atomic.
    """
    spark = df.sparkSession
    new = df.withColumn("year", F.year(key))
    existing = read_optional(spark, path)
    if existing is not None:
        touched = existing.join(new.select("year").distinct(), "year", "left_semi")
        new = merged_rows(touched, new, key)
    (new.hint("rebalance", "year").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path))


def write_daily(df: DataFrame, path: str, incremental: bool = False, key: str = "date") -> None:
    """Write a daily table by year: all of it, or only the days present in ``df``."""
    if incremental:
        upsert_daily(df, path, key)
        return
    (df.withColumn("year", F.year(key)).hint("rebalance", "year").write.mode("overwrite")
        .option("partitionOverwriteMode", "static").partitionBy("year").parquet(path))


def write_by_date(df: DataFrame, path: str, incremental: bool = False, key: str = "date") -> None:
    """Write record-level rows in one folder per day; a busy day is split into several files."""
    mode = "dynamic" if incremental else "static"
    (df.hint("rebalance", key).write.mode("overwrite").option("partitionOverwriteMode", mode)
        .partitionBy(key).parquet(path))


def daily_table(spark: SparkSession, path: str) -> DataFrame:
    """A daily table without its storage column."""
    return spark.read.parquet(path).drop("year")


def signal_table(spark: SparkSession, path: str) -> DataFrame:
    """Published regime signals, one row a day."""
    found = read_optional(spark, path)
    if found is None:
        return spark.createDataFrame([], schemas.REGIME_SIGNAL)
    return found.select(*schemas.REGIME_SIGNAL.fieldNames())


def publish_signal(signals: DataFrame, path: str) -> None:
    """Upsert regime signals; the date is unique."""
    out = signals if "created_at" in signals.columns else signals.withColumn(
        "created_at", F.current_timestamp())
    upsert_daily(out.select(*schemas.REGIME_SIGNAL.fieldNames()), path)


def log_run(spark: SparkSession, path: str, stage: str, status: str, records: int | None = None,
            seconds: float | None = None, notes: str | None = None) -> None:
    """Append one line to the run log."""
    row = spark.range(1).select(
        F.current_timestamp().alias("run_at"), F.lit(stage).alias("stage"),
        F.lit(status).alias("status"), F.lit(records).cast("long").alias("records_processed"),
        F.lit(seconds).cast("double").alias("duration_seconds"),
        F.lit(notes).cast("string").alias("notes"))
    row.coalesce(1).write.mode("append").parquet(path)
