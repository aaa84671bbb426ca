"""Landed payloads, raw scans and sinks."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide import schemas
from sigtide.plans import stages
from sigtide.sources import ingest, normalize, raw, tables
from sigtide.sources.backfill import backfill


def payload(spark, schema, *docs, **extra):
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "value string")
    return normalize.parse_payload(df, schema)


def short(prefix, key):
    return f"{prefix}_" + hashlib.sha256(key.encode()).hexdigest()[:16]


def test_reddit_listing(spark):
    post = dict(id="a1", title="A title of some length", selftext="body", score=3, num_comments=2,
                created_utc=1700000000.9, subreddit="investing", url="/r/x", upvote_ratio=None)
    brief = dict(post, id="a2", title="short", selftext="[removed]")
    got = normalize.normalize_reddit(payload(spark, schemas.REDDIT_LISTING, {
        "data": {"children": [{"data": post}, {"data": brief}]}}), "top").collect()
    assert len(got) == 1
    r = got[0]
    assert r.id == short("reddit", "reddit_a1") and r.source == "reddit/r/investing"
    assert r.body == "A title of some length\n\nbody" and r.url == "https://reddit.com/r/x"
    assert json.loads(r.metadata) == {"score": 3, "num_comments": 2, "upvote_ratio": None,
                                      "subreddit": "investing", "sort": "top"}


def test_reddit_archive(spark):
    full = dict(id="b", title="  Title long enough here ", selftext=" text\n",
                created_utc=1700000000, subreddit="Economics", permalink="/p", score=1)
    bare = dict(id="c", title="", selftext="only text that is long enough")
    got = {r.id: r for r in normalize.normalize_reddit(
        payload(spark, schemas.REDDIT_ARCHIVE, full, bare), kind="archive").collect()}
    first = got[short("reddit", "reddit_b")]
    assert first.body == "Title long enough here\n\ntext" and first.url == "https://reddit.com/p"
    second = got[short("reddit", "reddit_c")]
    assert second.title is None and second.url is None and second.source == "reddit/r/unknown"
    assert second.timestamp == dt.datetime(1970, 1, 1)
    assert json.loads(second.metadata)["sort"] == "historical"


def test_gdelt(spark):
    got = normalize.normalize_gdelt(payload(spark, schemas.GDELT_PAYLOAD, {"articles": [
        {"title": "News", "url": "u", "seendate": "20240105T101500Z", "tone": -2.5},
        {"title": "", "url": "v"}, {"url": "w"}]}, {"articles": None}), "q").collect()
    assert [r.id for r in got] == [short("gdelt", "u")]
    assert got[0].timestamp == dt.datetime(2024, 1, 5, 10, 15)
    assert json.loads(got[0].metadata)["tone"] == -2.5
    assert json.loads(got[0].metadata)["goldstein_scale"] is None


def test_fred(spark):
    obs = [{"date": "2024-01-0%d" % i, "value": v} for i, v in enumerate(
        [".", "", "4.5", "abc", "5", "0.00001", "100"], 1)]
    got = normalize.normalize_fred(
        payload(spark, schemas.FRED_PAYLOAD, {"observations": obs}), "VIXCLS").collect()
    assert [r.body for r in got] == ["VIXCLS: 4.5", "VIXCLS: 0", "VIXCLS: 5", "VIXCLS: 0.00001",
                                     "VIXCLS: 100"]
    assert got[0].id == "fred_VIXCLS_20240103" and got[0].title == "VIXCLS = 4.5"
    assert json.loads(got[0].metadata) == {"series_id": "VIXCLS", "value": 4.5,
                                           "date": "2024-01-03"}


def test_edgar(spark):
    got = normalize.normalize_edgar(payload(spark, schemas.EDGAR_PAYLOAD, {"hits": {"hits": [
        {"_source": {"file_date": "2024-01-05", "display_names": ["A", "B"]}}]}}), "8-K").collect()
    assert got[0].title == "8-K  filing by Unknown" and got[0].id == short("edgar", "edgar_8-K_0")
    assert json.loads(got[0].metadata)["display_names"] == ["A", "B"]


def test_wikipedia(spark):
    event = dict(title="Trade War", comment="x", server_name="en.wikipedia.org", type="edit",
                 timestamp=1700000000, user="u", length={"new": 5})
    lines = ["data: " + json.dumps(e) for e in (
        event, dict(event, type="log"), dict(event, server_name="wikidata.org"),
        dict(event, title="Cats", comment="dogs"), dict(event, length=None, title="GDP"))]
    df = spark.createDataFrame([(x,) for x in [*lines, "data: {bad", ": ok", ""]], "value string")
    got = {r.title: r for r in normalize.normalize_wikipedia(df).collect()}
    assert set(got) == {"Trade War", "GDP"}
    assert got["Trade War"].url.endswith("/Trade_War")
    assert json.loads(got["Trade War"].metadata)["edit_delta"] == 5
    assert json.loads(got["GDP"].metadata)["edit_delta"] is None


def test_markets(spark):
    df = payload(spark, schemas.MARKET_EVENT, {"markets": [
        {"ticker": "KXCPI-26APR-T3.0", "title": "", "yes_sub_title": "Above 3",
         "yes_bid_dollars": "0.40", "yes_ask_dollars": 0, "open_interest_fp": "bad"}]})
    r = normalize.normalize_markets(df, "KXCPI-26APR", K.MACRO_EVENTS).first()
    assert (r.series, r.title, r.mid_price, r.open_interest) == ("KXCPI", "Above 3", 0.2, 0.0)
    assert normalize.normalize_markets(df, "KXCPI-27APR", K.MACRO_EVENTS).count() == 0


def test_typed_metadata(spark):
    df = spark.createDataFrame([('{"tone": 1.5, "query": "q", "extra": 1}',), ("bad",)], "metadata string")
    got = normalize.open_metadata(df, schemas.GDELT_META).select("metadata.tone", "metadata.query").collect()
    assert [tuple(r) for r in got] == [(1.5, "q"), (None, None)]


def test_prices_long_drops_missing(spark, rows):
    df = spark.createDataFrame([("d1", 1.0, None), ("d2", 2.0, 3.0)], "date string, A double, B double")
    assert rows(normalize.prices_long(df, ["A", "B"])) == [
        ("d1", "A", 1.0), ("d2", "A", 2.0), ("d2", "B", 3.0)]


def raw_frame(spark, data):
    return spark.createDataFrame(
        [(i, s, t, f"{t} 10:00:00", b, m) for i, s, t, b, m in data],
        "id string, source string, t string, ts string, body string, metadata string").select(
        "id", "source", F.lit("social").alias("source_type"),
        F.to_timestamp("ts").alias("timestamp"), F.lit(None).cast("string").alias("title"),
        "body", F.lit(None).cast("string").alias("url"), "metadata")


def test_jsonl_scan_skips_only_bad_lines(spark, tmp_path):
    folder = tmp_path / "raw" / "gdelt" / "2024-01-05"
    folder.mkdir(parents=True)
    (folder / "data.jsonl").write_text(
        '{"id": "1", "timestamp": "2024-01-04T01:00:00Z", "body": "b", "metadata": {"tone": 1.5}}\n'
        '\n{broken\n{"body": "no id"}\n')
    other = tmp_path / "raw" / "fred" / "2024-01-06"
    other.mkdir(parents=True)
    (other / "data.jsonl").write_text('{"id": "2", "body": "x"}\n')
    good, bad = raw.read_raw(spark, str(tmp_path), quarantine=True)
    assert {r.id for r in good.collect()} == {"1", "2"}
    assert bad.count() == 2
    one = raw.read_raw(spark, str(tmp_path), ["gdelt"]).first()
    assert (str(one.ingest_date), str(one.event_date), one.feed) == (
        "2024-01-05", "2024-01-04", "gdelt")
    assert json.loads(one.metadata) == {"tone": 1.5}
    assert [r.id for r in raw.latest_partition(good).collect()] == ["2"]
    day = raw.read_raw(spark, str(tmp_path), days=["2024-01-06", "2024-01-07"])
    assert [r.id for r in day.collect()] == ["2"]


def test_ingest_stage_repeats_and_rejects_unknown(spark, tmp_path):
    root = str(tmp_path)
    payload = json.dumps({"articles": [
        {"seendate": "20240105T101500Z", "url": "u", "title": "a"},
        {"seendate": "20240104T101500Z", "url": "u", "title": "b"}, {"url": "v", "title": ""}]})
    landed = {"gdelt": spark.createDataFrame([("q", payload), ("q", "{broken"), ("q", None)],
                                             "tag string, value string"),
              "wikipedia": spark.createDataFrame([], "value string")}
    for _ in range(2):
        stages.stage_ingest(spark, root, landed, "2024-01-06")
    stored = raw.read_raw_table(spark, root).collect()
    assert [(r.feed, str(r.ingest_date), r.title) for r in stored] == [
        ("gdelt", "2024-01-06", "b")]
    log = spark.read.parquet(f"{root}/runs").collect()
    assert [(r.stage, r.status, r.records_processed) for r in log] == [("ingest", "ok", 1)] * 2
    with pytest.raises(ValueError):
        stages.stage_ingest(spark, root, {"else": landed["gdelt"]})


def test_write_raw_replaces_only_its_days(spark, tmp_path, rows):
    root = str(tmp_path)
    a = raw_frame(spark, [("1", "reddit/r/x", "2024-01-05", "a", "{}"), ("2", "sec_edgar", "2024-01-05", "b", "{}")])
    raw.write_raw(a, root, "2024-01-05")
    raw.write_raw(a.where("id = '1'").withColumn("id", F.lit("3")), root, "2024-01-06")
    raw.write_raw(a.where("id = '1'").withColumn("id", F.lit("4")), root, "2024-01-05")
    got = rows(raw.read_raw_table(spark, root), "feed", F.col("ingest_date").cast("string"), "id")
    assert got == [("edgar", "2024-01-05", "2"), ("reddit", "2024-01-05", "4"),
                   ("reddit", "2024-01-06", "3")]
    counts = {r.feed: (r.n_days, r.n_records) for r in raw.source_counts(
        raw.read_raw_table(spark, root)).collect()}
    assert counts == {"edgar": (1, 1), "reddit": (2, 2)}


def test_backfill_counts_and_repeats(spark, tmp_path):
    meta = json.dumps({"subreddit": "investing"})
    data = [("1", "reddit/r/investing", "2020-02-01", "old", meta),
            ("1", "reddit/r/investing", "2020-02-01", "copy", meta),
            ("2", "reddit/r/investing", "2023-05-01", "edge", meta),
            ("3", "reddit/r/investing", "2021-05-01", "outside", meta),
            ("4", "reddit/r/cats", "2020-02-01", "other", json.dumps({"subreddit": "cats"}))]
    posts = raw_frame(spark, data).withColumn("seq", F.monotonically_increasing_id())
    root = str(tmp_path)
    first = backfill(posts, None, root)
    assert (first["fetched"], first["after_dedup"], first["written"]) == (3, 2, 2)
    stored = raw.read_raw_table(spark, root)
    assert {r.body for r in stored.collect()} == {"old", "edge"}
    again = backfill(posts, tables.read_optional(spark, f"{root}/raw_table"), root)
    assert (again["fetched"], again["after_dedup"], again["written"]) == (3, 0, 0)


def test_periods_are_half_open_and_may_overlap(spark, rows):
    df = spark.createDataFrame([("a", "2020-01-01 00:00:00"), ("b", "2020-02-01 00:00:00")],
                               "k string, ts string").select(
        "k", F.col("ts").cast("timestamp").alias("timestamp"))
    periods = {"x": ("2020-01-01", "2020-02-01"), "y": ("2020-01-01", "2020-03-01")}
    assert rows(normalize.select_periods(df, periods), "k", "period") == [
        ("a", "x"), ("a", "y"), ("b", "y")]


def test_upsert_is_idempotent(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    old = spark.sql("SELECT date'2023-12-31' AS date, 1 AS v UNION ALL SELECT date'2024-01-01', 1 "
                    "UNION ALL SELECT date'2024-01-02', 1")
    new = spark.sql("SELECT date'2024-01-02' AS date, 2 AS v UNION ALL SELECT date'2024-01-03', 2")
    tables.upsert_daily(old, path)
    for _ in range(2):
        tables.upsert_daily(new, path)
    got = rows(spark.read.parquet(path), F.col("date").cast("string"), "v")
    assert got == [("2023-12-31", 1), ("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 2)]


def test_missing_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.load_feature_parts(spark, [str(tmp_path / "none")])
    assert tables.signal_table(spark, str(tmp_path / "none")).count() == 0


def test_run_log_appends(spark, tmp_path, rows):
    path = str(tmp_path / "runs")
    tables.log_run(spark, path, "train", "ok", 5, 1.5)
    tables.log_run(spark, path, "predict", "failed", notes="why")
    got = spark.read.schema(schemas.RUN_LOG).parquet(path)
    assert rows(got, "stage", "status", "records_processed", "notes") == [
        ("predict", "failed", None, "why"), ("train", "ok", 5, None)]


def test_payloads_are_parsed_once(spark, capsys):
    """Conditions on a parsed payload do not parse its text again."""
    landed = spark.range(3).select(F.lit("S").alias("tag"), F.to_json(F.struct(F.array(F.struct(
        F.lit("2024-01-01").alias("date"), F.col("id").cast("string").alias("value"))).alias(
        "observations"))).alias("value"))
    for name in ("fred", "gdelt", "edgar", "reddit"):
        ingest.SOURCES[name](landed).explain()
        assert capsys.readouterr().out.count("from_json(") == 1, name
    assert sorted(r.title for r in ingest.SOURCES["fred"](landed).collect()) == ["S = 0", "S = 1", "S = 2"]
    broken = spark.createDataFrame([("S", "{broken"), ("S", None), ("S", "[]")], "tag string, value string")
    assert ingest.SOURCES["fred"](broken).collect() == []


def test_news_text_is_compared_once(spark, capsys):
    """The body of a news record repeats its title and does not travel beside it."""
    articles = [{"seendate": "20240105T101500Z", "url": "u", "title": t, "tone": n}
                for t, n in (("b", 1.0), ("a", 2.0), ("a", 1.0), ("a", None))]
    landed = spark.createDataFrame([("q", json.dumps({"articles": [a]})) for a in articles], "tag string, value string")
    found = ingest.SOURCES["gdelt"](landed)
    assert found.columns == list(schemas.RAW_COLUMNS)
    assert [(r.title, r.body, json.loads(r.metadata)["tone"]) for r in found.collect()] == [("a", "a", 1.0)]
    found.explain()
    keyed = [line for line in capsys.readouterr().out.splitlines() if "Aggregate(key=" in line]
    assert keyed and not any("body" in line for line in keyed)
