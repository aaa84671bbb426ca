"""Historical backfill: select, deduplicate, append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.operators.dedup import dedup_existing
from sigtide.session import materialised
from sigtide.sources.normalize import select_periods
from sigtide.sources.raw import append_raw, observed_rows


def backfill(records: DataFrame, existing: DataFrame | None, root: str,
             periods: dict[str, tuple[str, str]] | None = None,
             subreddits: Sequence[str] | None = None, order: str = "seq") -> dict:
    """Append the records of the chosen windows that are not stored yet; returns the counts.

    ``records`` are raw records plus an ``order`` column (arrival order). The deduplicated batch
    is written to the shared folder first, so it is computed once; the selection is counted by that
    job and the append by its own.
    """
    periods = periods or K.BACKFILL_PERIODS
    subreddits = list(subreddits or K.BACKFILL_SUBREDDITS)
    named = records.withColumn("_member", F.get_json_object("metadata", "$.subreddit"))
    chosen = select_periods(named, periods, subreddits, member="_member").drop(
        "_member", "period")
    fetched = Observation("fetched")
    chosen = chosen.observe(fetched, F.count(F.lit(1)).alias("rows"))
    fresh = materialised(dedup_existing(chosen, existing, "id", order), "backfill")
    written = append_raw(fresh.drop(order), root)
    return {"fetched": observed_rows(fetched), "after_dedup": fresh.count(), "written": written,
            "periods": list(periods), "subreddits": subreddits}
