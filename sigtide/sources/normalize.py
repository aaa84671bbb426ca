"""Landed payloads to raw records.

Each function takes a frame with the parsed payload (see ``schemas``) and returns raw-record
columns. Everything is a projection over ``explode``: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide import schemas
from sigtide.functions.parse import epoch_timestamp, is_reported, parse_timestamp, safe_double
from sigtide.functions.signals import directional_weight, mid_price
from sigtide.functions.text import (
    contains_any, long_enough, post_body, record_id, strip_text)


def parse_payload(df: DataFrame, schema, column: str = "value") -> DataFrame:
    """Text payloads to columns; rows that do not parse are dropped.

    The parsed payload is the one element of an exploded array: conditions on it stay above, where
    they read it, instead of moving below and parsing the text (and making it) again.
    """
    doc = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.array(doc)).alias("_doc")).where(
        F.col("_doc").isNotNull()).select(*rest, "_doc.*")


def _meta(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]),
                     {"ignoreNullFields": "false"})


def _record(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns[name].alias(name) for name in schemas.RAW_COLUMNS])


def normalize_reddit(df: DataFrame, sort: Column | str = "hot", kind: str = "listing",
                     length_unit: str = "chars") -> DataFrame:
    """Posts of a listing (``kind='listing'``) or of the historical archive (``'archive'``).

    Archive titles and texts are stripped, the link comes from the permalink and ``sort`` is
    ``historical``. ``length_unit='bytes'`` applies the minimum length to UTF-8 bytes.
    """
    if kind == "archive":
        posts = df.select(
            "*", strip_text(F.coalesce("title", F.lit(""))).alias("_title"),
            strip_text(F.coalesce("selftext", F.lit(""))).alias("_text"))
        link = F.when(F.coalesce(F.col("permalink"), F.lit("")) != "",
                      F.concat(F.lit("https://reddit.com"), F.col("permalink")))
        title, order = F.nullif(F.col("_title"), F.lit("")), F.lit("historical")
        created = F.coalesce(F.col("created_utc"), F.lit(0))
        subreddit = F.coalesce(F.col("subreddit"), F.lit("unknown"))
        score, comments = (F.coalesce(F.col(c), F.lit(0)) for c in ("score", "num_comments"))
    elif kind == "listing":
        posts = df.select(F.lit(sort).alias("_sort"), F.explode("data.children").alias("_c")).select(
            "_sort", "_c.data.*").select(
            "*", F.col("title").alias("_title"), F.col("selftext").alias("_text"))
        link = F.concat(F.lit("https://reddit.com"), F.col("url"))
        title, order = F.col("_title"), F.col("_sort")
        created, subreddit = F.col("created_utc"), F.col("subreddit")
        score, comments = F.col("score"), F.col("num_comments")
    else:
        raise ValueError(f"unknown kind {kind!r}")
    body = post_body(F.col("_title"), F.col("_text"))
    return _record(
        posts.where(long_enough(body, length_unit)),
        id=record_id("reddit", F.concat(F.lit("reddit_"), F.col("id"))),
        source=F.concat(F.lit("reddit/r/"), subreddit), source_type=F.lit("social"),
        timestamp=epoch_timestamp(created), title=title, body=body, url=link,
        metadata=_meta(score=score, num_comments=comments, upvote_ratio=F.col("upvote_ratio"),
                       subreddit=subreddit, sort=order))


def normalize_gdelt(df: DataFrame, query: Column | str) -> DataFrame:
    """News articles; those without a title are dropped, the title is the body."""
    tag = F.lit(query) if isinstance(query, str) else query
    rows = df.select(tag.alias("_query"), F.explode("articles").alias("_a")).select(
        "_query", "_a.*").where(F.coalesce(F.col("title"), F.lit("")) != "")
    return _record(
        rows,
        id=record_id("gdelt", F.coalesce(F.col("url"), F.lit(""))),
        source=F.lit("gdelt"), source_type=F.lit("news"),
        timestamp=parse_timestamp(F.col("seendate"), "yyyyMMdd'T'HHmmss'Z'"),
        title=F.col("title"), body=F.col("title"), url=F.col("url"),
        metadata=_meta(query=F.col("_query"), source_country=F.col("sourcecountry"),
                       source_lang=F.col("sourcelang"), tone=F.col("tone"),
                       goldstein_scale=F.col("goldsteinscale")))


def number_text(value: Column) -> Column:
    """All digits of a double without an exponent: ``5`` for 5.0.

    The cast gives the digits and perhaps an exponent; the exponent moves the decimal point. Numbers
    shown without one only lose the zeros at their end.
    """
    shown = F.abs(value).cast("string")
    whole = F.regexp_extract(shown, r"^([0-9]+)", 1)
    part = F.regexp_extract(shown, r"\.([0-9]+)", 1)
    power = F.coalesce(F.regexp_extract(shown, r"E(-?[0-9]+)", 1).try_cast("int"), F.lit(0))
    digits = F.concat(whole, part)
    point = F.length(whole) + power  # digits before the decimal point
    zero = F.lit("0")
    padded = F.concat(F.repeat(zero, F.greatest(1 - point, F.lit(0))), digits,
                      F.repeat(zero, F.greatest(point - F.length(digits), F.lit(0))))
    at = F.greatest(point, F.lit(1))
    text = F.concat(F.substring(padded, F.lit(1), at), F.lit("."),
                    F.substring(padded, at + 1, F.length(padded)))
    plain = F.regexp_replace(F.regexp_replace(text, r"\.?0*$", ""), r"^0+(?=[0-9])", "")
    ready = F.contains(shown, F.lit(".")) & ~F.contains(shown, F.lit("E"))
    short = F.rtrim(F.rtrim(shown, F.lit("0")), F.lit("."))
    return F.concat(F.when(value < 0, "-").otherwise(""), F.when(ready, short).otherwise(plain))


def normalize_fred(df: DataFrame, series: Column | str) -> DataFrame:
    """Macro observations. ``.`` and empty are missing and dropped; other garbage becomes 0.0.

    The typed number travels in the metadata; never parse it back out of the rendered body.
    """
    name = F.lit(series) if isinstance(series, str) else series
    rows = (
        df.select(name.alias("_s"), F.explode("observations").alias("_o"))
        .select("_s", "_o.*").where(is_reported(F.col("value")))
        .withColumn("_v", safe_double(F.col("value"))))
    shown = number_text(F.col("_v"))
    return _record(
        rows,
        id=F.concat(F.lit("fred_"), F.col("_s"), F.lit("_"),
                    F.replace(F.col("date"), F.lit("-"), F.lit(""))),
        source=F.lit("fred"), source_type=F.lit("macro"),
        timestamp=parse_timestamp(F.col("date"), "yyyy-MM-dd"),
        title=F.concat(F.col("_s"), F.lit(" = "), shown),
        body=F.concat(F.col("_s"), F.lit(": "), shown),
        url=F.concat(F.lit("https://fred.stlouisfed.org/series/"), F.col("_s")),
        metadata=_meta(series_id=F.col("_s"), value=F.col("_v"), date=F.col("date")))


def normalize_edgar(df: DataFrame, form: Column | str) -> DataFrame:
    """Filings; entity and file number default to ``Unknown`` and ``0``, the title is composed."""
    kind = F.lit(form) if isinstance(form, str) else form
    rows = df.select(kind.alias("_form"), F.explode("hits.hits").alias("_h")).select(
        "_form", "_h._source.*")
    entity = F.coalesce(F.col("entity_name"), F.lit("Unknown"))
    number = F.coalesce(F.col("file_num"), F.lit("0"))
    title = F.concat(F.col("_form"), F.lit(" "), F.coalesce(F.col("period_of_report"), F.lit("")),
                     F.lit(" filing by "), entity)
    return _record(
        rows,
        id=record_id("edgar", F.concat(F.lit("edgar_"), F.col("_form"), F.lit("_"), number)),
        source=F.lit("sec_edgar"), source_type=F.lit("filing"),
        timestamp=parse_timestamp(F.col("file_date"), "yyyy-MM-dd"),
        title=title, body=title,
        url=F.concat(F.lit("https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&filenum="),
                     number),
        metadata=_meta(form_type=F.col("_form"), entity_name=entity,
                       period_of_report=F.col("period_of_report"),
                       display_names=F.col("display_names")))


def normalize_wikipedia(df: DataFrame, column: str = "value",
                        keywords: Sequence[str] = K.MACRO_EDIT_KEYWORDS) -> DataFrame:
    """Edit events from server-sent ``data: {json}`` lines (batch or streaming).

    Keeps encyclopedia edits whose title or comment contains a macro keyword. There is no first-N
    cap; a stream bounds its batches by files per trigger.
    """
    prefix = "data: "
    lines = df.where(F.startswith(F.col(column), F.lit(prefix))).select(
        F.expr(f"substring(`{column}`, {len(prefix) + 1})").alias("_json"))
    rows = parse_payload(lines, schemas.WIKIPEDIA_EVENT, "_json")
    title, comment = (F.coalesce(F.col(c), F.lit("")) for c in ("title", "comment"))
    text = F.lower(F.concat(title, F.lit(" "), comment))
    rows = rows.where(
        F.contains(F.coalesce(F.col("server_name"), F.lit("")), F.lit("wikipedia.org"))
        & (F.col("type") == "edit") & contains_any(text, keywords))
    delta = F.when(F.col("length").isNotNull(),
                   F.coalesce(F.col("length.new"), F.lit(0)) - F.coalesce(
                       F.col("length.old"), F.lit(0)))
    return _record(
        rows,
        id=record_id("wiki", F.concat(F.lit("wiki_"), title, F.lit("_"), comment)),
        source=F.lit("wikipedia"), source_type=F.lit("event"),
        timestamp=epoch_timestamp(F.col("timestamp")), title=title,
        body=F.concat(title, F.lit(": "), comment),
        url=F.concat(F.lit("https://en.wikipedia.org/wiki/"),
                     F.replace(title, F.lit(" "), F.lit("_"))),
        metadata=_meta(server=F.col("server_name"), edit_delta=delta, user=F.col("user")))


def normalize_markets(df: DataFrame, event: Column | str,
                      events: Sequence[str] | None = None) -> DataFrame:
    """Markets of landed event payloads; the series is the event ticker up to its first dash.

    ``events`` keeps only those event tickers (``constants.MACRO_EVENTS`` is the usual list) and
    is applied before the payload is opened.
    """
    tag = F.lit(event) if isinstance(event, str) else event
    rows = df.withColumn("_event", tag)
    if events is not None:
        rows = rows.where(F.col("_event").isin(*events))
    keep = [c for c in df.columns if c not in ("markets", *schemas.MARKET_RECORD.fieldNames())]
    rows = rows.select(*keep, "_event", F.explode("markets").alias("_m")).select(
        *keep, "_event", "_m.*")
    ticker = F.coalesce(F.col("ticker"), F.lit(""))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")),
                       F.nullif(F.col("yes_sub_title"), F.lit("")), F.lit(""))
    bid, ask, last, interest, volume = (
        safe_double(F.col(c)) for c in ("yes_bid_dollars", "yes_ask_dollars",
                                        "last_price_dollars", "open_interest_fp", "volume"))
    series = F.split_part(F.col("_event"), F.lit("-"), F.lit(1))
    return rows.select(
        *keep, ticker.alias("ticker"), title.alias("title"), series.alias("series"),
        F.col("_event").alias("event_ticker"), bid.alias("yes_bid"), ask.alias("yes_ask"),
        last.alias("last_price"), mid_price(bid, ask, last).alias("mid_price"),
        interest.alias("open_interest"), volume.alias("volume"),
        directional_weight(series, ticker, title).alias("directional_weight"))


def prices_long(df: DataFrame, tickers: Sequence[str] = K.PRICE_TICKERS,
                date: str = "date") -> DataFrame:
    """One column per ticker to (date, ticker, close); missing closes are dropped."""
    return (df.unpivot([date], list(tickers), "ticker", "close")
            .where(F.col("close").isNotNull()))


def select_periods(df: DataFrame, periods: dict[str, tuple[str, str]] | None = None,
                   members: Sequence[str] | None = None, timestamp: str = "timestamp",
                   member: str = "subreddit") -> DataFrame:
    """Rows inside named half-open [after, before) windows, one copy per matching window.

    The windows are a short configured list, so they are matched inside the row; no range join.
    """
    periods = periods or K.BACKFILL_PERIODS
    rows = df.where(F.col(member).isin(*members)) if members else df
    ts = F.col(timestamp)
    first, last = min(p[0] for p in periods.values()), max(p[1] for p in periods.values())
    rows = rows.where((ts >= F.lit(first).cast("timestamp_ntz"))
                      & (ts < F.lit(last).cast("timestamp_ntz")))
    windows = F.array(*[
        F.struct(F.lit(name).alias("period"), F.lit(a).cast("timestamp_ntz").alias("after"),
                 F.lit(b).cast("timestamp_ntz").alias("before"))
        for name, (a, b) in periods.items()])
    hits = F.transform(F.filter(windows, lambda p: (ts >= p["after"]) & (ts < p["before"])),
                       lambda p: p["period"])
    return rows.select("*", F.explode(hits).alias("period"))


def open_metadata(df: DataFrame, schema, column: str = "metadata") -> DataFrame:
    """Metadata text as a typed struct (``schemas.REDDIT_META`` and the like)."""
    return df.withColumn(column, F.from_json(column, schema))


def union_all(*frames: DataFrame) -> DataFrame:
    """Concatenate by column name; absent columns become NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
