"""Structured Streaming: ingestion, incremental deduplication, daily features, live signal."""

from sigtide.streaming.first import first_records, run_first_records
from sigtide.streaming.jobs import (
    dedup_stream, geo_stream, market_stream, run_live, run_merged, run_recomputed,
    run_to_table, sentiment_stream, stream_changes, stream_raw, write_raw_stream)

__all__ = ["dedup_stream", "first_records", "geo_stream", "market_stream", "run_first_records", "run_live",
           "run_merged", "run_recomputed", "run_to_table", "sentiment_stream", "stream_changes", "stream_raw", "write_raw_stream"]
