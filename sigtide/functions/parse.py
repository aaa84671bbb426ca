"""Tolerant parsing. The session runs in ANSI mode, so every cast here is a ``try_`` form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_double(value: Column) -> Column:
    """Number, or 0.0 for NULL and anything that does not parse."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def is_reported(value: Column) -> Column:
    """False for the two missing-value marks of macro series: ``.`` and empty."""
    return value.isNotNull() & ~value.isin(".", "")


def json_double(meta: Column, key: str) -> Column:
    """Numeric field of a JSON text; missing, null, or a non-object text gives 0.0."""
    return safe_double(F.get_json_object(meta, f"$.{key}"))


def parse_timestamp(value: Column, fmt: str, fallback: Column | None = None) -> Column:
    """Text to timestamp; unparsable values become ``fallback`` (default: now)."""
    parsed = F.try_to_timestamp(value, F.lit(fmt))
    return F.coalesce(parsed, F.current_timestamp() if fallback is None else fallback)


def epoch_timestamp(seconds: Column, fallback: Column | None = None) -> Column:
    """Whole epoch seconds to timestamp; NULL becomes ``fallback`` (default: now)."""
    parsed = F.timestamp_seconds(seconds.cast("bigint"))
    return F.coalesce(parsed, F.current_timestamp() if fallback is None else fallback)


def series_value(body: Column, meta: Column | None = None) -> Column:
    """Value of a macro record: the typed metadata field, else the text after the first colon."""
    text = F.trim(F.split_part(body, F.lit(":"), F.lit(2))).try_cast("double")
    if meta is None:
        return text
    return F.coalesce(F.get_json_object(meta, "$.value").try_cast("double"), text)


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp to [low, high], NULL stays NULL (``least`` would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def real(value: Column) -> Column:
    """NaN to NULL."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)
