"""Raw record scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtide import schemas

_CORRUPT = "_corrupt_record"
# Plain folders (raw/gdelt/2024-01-05) or key=value folders, whichever the lander wrote.
_JSONL_PATH = r".*/raw/(?:\w+=)?([^/]+)/(?:\w+=)?(\d{4}-\d{2}-\d{2})/[^/]*$"


def read_raw(spark: SparkSession, root: str, sources: Sequence[str] | None = None,
             quarantine: bool = False, schema: T.StructType = schemas.RAW_RECORD,
             days: Sequence[str] | None = None):
    """Scan the JSON lines below ``<root>/raw/<source>/<date>/``, listing only chosen sources and
    days (``yyyy-MM-dd``); a choice without any folder raises.

    ``feed`` and ``ingest_date`` come from the path, ``event_date`` from the timestamp: both dates
    are kept because live records are filed by arrival day and backfilled ones by event day. A
    broken line costs that line only, not its file; with ``quarantine=True`` the result is
    ``(good, bad)`` where ``bad`` holds undecodable lines and records without an id.
    """
    feeds = "{feed=,}{" + ",".join(sources) + "}" if sources else "*"
    folders = "{ingest_date=,}{" + ",".join(days) + "}" if days else "*"
    fields = T.StructType(list(schema.fields) + [T.StructField(_CORRUPT, T.StringType(), True)])
    path = F.col("_metadata.file_path")
    rows = (
        spark.read.schema(fields)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
        .json(f"{root}/raw/{feeds}/{folders}")
        .select("*", F.regexp_extract(path, _JSONL_PATH, 1).alias("feed"),
                F.regexp_extract(path, _JSONL_PATH, 2).try_cast("date").alias("ingest_date"))
    )
    key = "id" if "id" in schema.fieldNames() else schema.fieldNames()[0]
    sound = F.col(_CORRUPT).isNull() & F.col(key).isNotNull()
    good = rows.where(sound).drop(_CORRUPT)
    if "timestamp" in schema.fieldNames():
        good = good.withColumn("event_date", F.to_date("timestamp"))
    if not quarantine:
        return good
    bad = rows.where(~sound).select("feed", "ingest_date", _CORRUPT, F.col(key).alias("key"))
    return good, bad


def read_raw_table(spark: SparkSession, root: str,
                   sources: Sequence[str] | None = None) -> DataFrame:
    """Scan the partitioned table that ``write_raw`` keeps; ``sources`` prunes partitions."""
    df = spark.read.parquet(f"{root}/raw_table")
    return df.where(F.col("feed").isin(*sources)) if sources else df


def latest_partition(df: DataFrame, date_col: str = "ingest_date") -> DataFrame:
    """Rows of the newest day. The maximum is a scalar subquery, so it prunes partitions."""
    return df.where(F.col(date_col) == df.agg(F.max(date_col)).scalar())


def feed_name(source):
    """Folder of a source: text before the first slash, filings under ``edgar``."""
    head = F.split_part(source, F.lit("/"), F.lit(1))
    return F.when(head == "sec_edgar", "edgar").otherwise(head)


def _dated(df: DataFrame, date_col: str, date) -> DataFrame:
    out = df if "feed" in df.columns else df.withColumn("feed", feed_name(F.col("source")))
    return out if date_col in out.columns else out.withColumn(date_col, date)


def write_raw(df: DataFrame, root: str, ingest_date=None, fmt: str = "parquet") -> None:
    """Replace the (feed, day) partitions present in ``df``; all other days stay.

    REBALANCE lets AQE cut a hot feed or day into several evenly sized files and pack small ones
    together, so neither a third of the rows in one partition nor thousands of tiny ones hurt.
    """
    day = F.current_date() if ingest_date is None else F.lit(ingest_date).cast("date")
    out = _dated(df, "ingest_date", day).hint("rebalance", "feed", "ingest_date")
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("feed", "ingest_date").format(fmt).save(f"{root}/raw_table"))


def observed_rows(seen: Observation, name: str = "rows") -> int:
    """Rows counted by an observation placed on top of a written plan.

    When adaptive execution finds the plan empty it drops the observed node, and the observation
    ends without a row: that is a count of 0.
    """
    try:
        return seen.get[name]
    except (Py4JJavaError, KeyError):
        return 0


def append_raw(df: DataFrame, root: str, fmt: str = "parquet") -> int:
    """Append records filed by event day; returns how many were written.

    Rows without a timestamp are skipped. The count comes from the write job itself.
    """
    seen = Observation("append_raw")
    out = (_dated(df.where(F.col("timestamp").isNotNull()), "ingest_date", F.to_date("timestamp"))
           .observe(seen, F.count(F.lit(1)).alias("rows"))
           .hint("rebalance", "feed", "ingest_date"))
    out.write.mode("append").partitionBy("feed", "ingest_date").format(fmt).save(
        f"{root}/raw_table")
    return observed_rows(seen)


def source_counts(df: DataFrame, source: str = "feed", date: str = "ingest_date") -> DataFrame:
    """Days and records per source.

    Counting per (source, day) first keeps a dominant source from funnelling its rows through one
    distinct-count task.
    """
    daily = df.groupBy(source, date).agg(F.count(F.lit(1)).alias("n"))
    return daily.groupBy(source).agg(
        F.count(date).alias("n_days"), F.sum("n").alias("n_records"))
