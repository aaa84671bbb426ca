"""Declared schemas of the landed payloads, raw records and result tables."""

from __future__ import annotations

from pyspark.sql import types as T


S, D, L = T.StringType(), T.DoubleType(), T.LongType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# Universal raw record. ``metadata`` stays JSON text: its shape differs per source.
RAW_RECORD = struct(
    id=S, source=S, source_type=S, timestamp=T.TimestampType(), title=S, body=S, url=S, metadata=S,
)
RAW_COLUMNS = RAW_RECORD.fieldNames()

REDDIT_META = struct(score=L, num_comments=L, upvote_ratio=D, subreddit=S, sort=S)
GDELT_META = struct(query=S, source_country=S, source_lang=S, tone=D, goldstein_scale=D)
EDGAR_META = struct(form_type=S, entity_name=S, period_of_report=S, display_names=T.ArrayType(S))
WIKIPEDIA_META = struct(server=S, edit_delta=L, user=S)

# Landed payloads, one JSON document per row.
REDDIT_LISTING = struct(data=struct(children=T.ArrayType(struct(data=struct(
    id=S, title=S, selftext=S, score=L, num_comments=L, created_utc=D, subreddit=S, url=S,
    upvote_ratio=D,
)))))
REDDIT_ARCHIVE = struct(
    id=S, title=S, selftext=S, created_utc=L, subreddit=S, permalink=S, score=L, num_comments=L,
    upvote_ratio=D,
)
GDELT_PAYLOAD = struct(articles=T.ArrayType(struct(
    seendate=S, url=S, title=S, sourcecountry=S, sourcelang=S, tone=D, goldsteinscale=D,
)))
FRED_PAYLOAD = struct(observations=T.ArrayType(struct(date=S, value=S)))
EDGAR_PAYLOAD = struct(hits=struct(hits=T.ArrayType(struct(_source=struct(
    file_date=S, display_names=T.ArrayType(S), form_type=S, period_of_report=S, entity_name=S,
    file_num=S,
)))))
WIKIPEDIA_EVENT = struct(
    title=S, comment=S, server_name=S, type=S, timestamp=L, user=S, length=struct(new=L, old=L),
)
# Market numbers may arrive as JSON numbers or strings; text keeps both.
MARKET_EVENT = struct(markets=T.ArrayType(struct(
    ticker=S, title=S, yes_sub_title=S, yes_bid_dollars=S, yes_ask_dollars=S,
    last_price_dollars=S, open_interest_fp=S, volume=S,
)))

MARKET_RECORD = struct(
    ticker=S, title=S, series=S, event_ticker=S, yes_bid=D, yes_ask=D, last_price=D, mid_price=D,
    open_interest=D, volume=D, directional_weight=D, fetched_at=T.TimestampType(),
)
REGIME_SIGNAL = struct(
    date=T.DateType(), regime=S, confidence=D, risk_on_prob=D, risk_off_prob=D,
    transition_prob=D, created_at=T.TimestampType(),
)
RUN_LOG = struct(
    run_at=T.TimestampType(), stage=S, status=S, records_processed=L, duration_seconds=D, notes=S,
)
