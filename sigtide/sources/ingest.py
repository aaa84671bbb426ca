"""Landed payloads of each source to raw records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtide import schemas
from sigtide.operators.dedup import first_per_key
from sigtide.sources import normalize
from sigtide.sources.normalize import parse_payload


def _tagged(schema, build: Callable) -> Callable[[DataFrame], DataFrame]:
    return lambda landed: build(parse_payload(landed, schema), F.col("tag"))


def _news(landed: DataFrame) -> DataFrame:
    """One article answers several queries: the first record of an id stays.

    The body is the title, so it is left out of the comparison and its shuffle.
    """
    rows = normalize.normalize_gdelt(parse_payload(landed, schemas.GDELT_PAYLOAD), F.col("tag"))
    first = first_per_key(rows.drop("body"), "id", "timestamp")
    return first.withColumn("body", F.col("title")).select(*rows.columns)


# ``tag`` is the sort order, query, series or form a payload was asked with
SOURCES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "reddit": _tagged(schemas.REDDIT_LISTING, normalize.normalize_reddit),
    "gdelt": _news,
    "fred": _tagged(schemas.FRED_PAYLOAD, normalize.normalize_fred),
    "edgar": _tagged(schemas.EDGAR_PAYLOAD, normalize.normalize_edgar),
    "wikipedia": normalize.normalize_wikipedia,
}


def landed_records(landed: dict[str, DataFrame]) -> DataFrame:
    """Raw records of all landed payloads, each source a frame of (tag, value) texts.

    Payloads that do not parse give no records; unknown source names raise.
    """
    if unknown := set(landed) - set(SOURCES):
        raise ValueError(f"unknown sources {sorted(unknown)}")
    return normalize.union_all(*[SOURCES[name](rows) for name, rows in landed.items()])
