"""Model, streaming and whole-stage runs."""

from __future__ import annotations

import datetime as dt
import itertools
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigtide import streaming
from sigtide.operators import backtest, features, model, shapley, states
from sigtide.plans import serve, stages
from sigtide.sources import raw, tables
from sigtide.streaming import changes

DAY = dt.date(2024, 1, 1)
QUICK = model.TrainParams(trees=10)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    names = ["risk_off", "risk_on", "transition"]
    data = [(DAY + dt.timedelta(days=i), float(c + rng.normal(0, 0.1)), float(rng.normal()), 0.0, names[c])
            for i, c in enumerate(rng.integers(0, 3, 120))]
    return spark.createDataFrame(data, "date date, useful double, noise double, flat double, regime string")


@pytest.fixture(scope="module")
def trained(labelled):
    return model.train(labelled, QUICK)


def test_fold_sizes(spark):
    df = spark.range(11).select(F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date"))
    got = {(r.fold, r.part): r["count"] for r in model.ts_split(df, 2).groupBy("fold", "part").count().collect()}
    assert got == {(0, "train"): 5, (0, "test"): 3, (1, "train"): 8, (1, "test"): 3}


def test_training_finds_the_signal(trained):
    fitted, folds = trained
    assert fitted.classes == ["risk_off", "risk_on", "transition"]
    assert fitted.features == ["useful", "noise", "flat"]
    report = model.class_report(folds).collect()
    assert len(report) == 6 and min(r.accuracy for r in report) > 0.8  # chance is 1 in 3


def test_predictions_are_probabilities(trained, labelled):
    fitted, _ = trained
    got = model.predict_all(fitted, labelled).collect()
    assert len(got) == 120
    for r in got:
        assert sum(r.probabilities.values()) == pytest.approx(1.0)
        assert r.confidence == max(r.probabilities.values()) == r.probabilities[r.regime]
    latest = model.predict_latest(fitted, labelled).collect()
    assert len(latest) == 1 and latest[0].date == max(r.date for r in got)
    unknown = model.predict_latest(None, labelled).first()
    assert unknown.regime == "unknown" and unknown.probabilities == {}


def test_missing_columns_score_as_zero(trained, labelled):
    fitted, _ = trained
    assert model.predict_all(fitted, labelled.select("date", "useful")).count() == 120


def test_boosted_option(labelled):
    fitted, _ = model.train(labelled, model.TrainParams("boosted", trees=3, folds=1))
    r = model.predict_latest(fitted, labelled).first()
    assert sum(r.probabilities.values()) == pytest.approx(1.0)


def test_attribution(spark, trained, labelled):
    fitted, _ = trained
    got = model.attribution(fitted, labelled, n=20).collect()
    assert [r.feature for r in got][0] == "useful" and got[0].mean_shap > 5 * got[1].mean_shap
    assert {r.feature: r.mean_shap for r in got}["flat"] == 0.0
    assert model.top_attribution(model.attribution(fitted, labelled, n=20), 1).first().feature == "useful"
    assert model.split_importance(spark, fitted).first().feature == "useful"


def plain_values(nodes, x, outputs, size):
    """Shapley values of one row by listing all subsets and walking every tree."""
    trees = {}
    for r in nodes:
        trees.setdefault((r["output"], r["tree"]), {})[r["id"]] = r

    def weight(node):
        return node["impurityStats"][0] if node["output"] is not None else sum(node["impurityStats"])

    def walk(key, at, known):
        tree = trees[key]
        node = tree[at]
        if node["leftChild"] < 0:
            value = np.zeros(outputs)
            if key[0] is None:
                value[:len(node["impurityStats"])] = np.array(node["impurityStats"]) / sum(node["impurityStats"])
                return value / len(trees)
            value[key[0]] = node["weight"] * node["prediction"]
            return value
        sides = [node["leftChild"], node["rightChild"]]
        f = node["split"]["featureIndex"]
        if f in known:
            return walk(key, sides[int(x[f] > node["split"]["leftCategoriesOrThreshold"][0])], known)
        sizes = [weight(tree[c]) for c in sides]
        return sum(walk(key, c, known) * n / sum(sizes) for c, n in zip(sides, sizes, strict=True))

    score = {frozenset(s): sum(walk(key, 0, s) for key in trees)
             for k in range(size + 1) for s in itertools.combinations(range(size), k)}
    out = np.zeros((size, outputs))
    for s, v in score.items():
        for f in set(range(size)) - s:
            out[f] += (score[s | {f}] - v) * math.factorial(len(s)) * math.factorial(size - len(s) - 1) / math.factorial(size)
    return out, score[frozenset()]


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_shapley_values_equal_all_subsets(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, 7)).round(2)
    y = np.where(x[:, 0] * x[:, 1] > 0, "a", np.where(x[:, 2] + x[:, 3] > 0.5, "b", "c"))
    names = [f"f{i}" for i in range(7)]
    df = spark.createDataFrame([(DAY + dt.timedelta(days=i), *map(float, x[i]), str(y[i])) for i in range(160)],
                               "date date, " + ", ".join(f"{n} double" for n in names) + ", regime string")
    fitted, _ = model.train(df, model.TrainParams(kind, trees=6 if kind == "forest" else 3, folds=0))
    assert fitted.features == names
    rows_ = df.limit(12)
    got = {}
    for r in model.contributions(fitted, rows_).collect():
        got[r["date"], r["feature"], r["class"]] = (r["phi"], r["base"])
    nodes = shapley.node_table(fitted.stages.stages[-1]).collect()
    scores = {r["date"]: r for r in fitted.stages.transform(rows_).collect()}
    for i in range(160):
        d = DAY + dt.timedelta(days=i)
        if d not in scores:
            continue
        want, base = plain_values(nodes, x[i], 3, 7)
        raw = scores[d]["probability" if kind == "forest" else "rawPrediction"].toArray()
        for c, name in enumerate(fitted.classes):
            assert raw[c] == pytest.approx(base[c] + want[:, c].sum(), abs=1e-9)
            for f, feature in enumerate(names):
                assert got[d, feature, name] == (pytest.approx(want[f, c], abs=1e-9), pytest.approx(base[c], abs=1e-9))


def test_save_and_load(trained, labelled, tmp_path, rows):
    fitted, _ = trained
    model.save_model(fitted, str(tmp_path / "m"))
    loaded = model.load_model(str(tmp_path / "m"))
    assert (loaded.classes, loaded.features) == (fitted.classes, fitted.features)
    assert rows(model.predict_all(loaded, labelled), "date", "regime") == rows(
        model.predict_all(fitted, labelled), "date", "regime")


def test_two_classes_still_predict(labelled):
    fitted, folds = model.train(labelled.where("regime <> 'transition'"), QUICK)
    assert folds.count() > 0
    r = model.predict_all(fitted, labelled).first()
    assert r.transition_prob == 0.0


# ---- streaming -----------------------------------------------------------------------------------

def event_rows(spark, days, per_day=3):
    data = [(f"{d}-{i}", dt.datetime(2024, 1, d, 12, i), float(i * d), d / 100.0) for d in days for i in range(per_day)]
    return spark.createDataFrame(data, "id string, timestamp timestamp, goldstein_scalar double, tone_scalar double")


def test_stream_equals_batch_over_restarts(spark, tmp_path, rows):
    land, out, state = (str(tmp_path / x) for x in ("land", "out", "state"))
    parts = [event_rows(spark, [1, 2]), event_rows(spark, [2, 3], 5), event_rows(spark, [4])]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(land)
        stream = spark.readStream.schema(part.schema).parquet(land)
        streaming.run_to_table(streaming.geo_stream(stream), out, state).awaitTermination()
    everything = spark.read.parquet(land).withColumn("date", F.to_date("timestamp"))
    cols = ["date", "total_events", "conflict_ratio", "mean_goldstein"]
    shown = [F.col("date").cast("string"), "total_events", F.round("mean_goldstein", 9), F.round("std_goldstein", 9)]
    assert rows(spark.read.parquet(out), *shown) == rows(features.geo_daily(everything), *shown)
    assert set(cols) <= set(spark.read.parquet(out).columns)


def test_watermark_dedup(spark, tmp_path):
    land, out, state = (str(tmp_path / x) for x in ("land", "out", "state"))
    for _ in range(2):
        event_rows(spark, [1, 2]).coalesce(1).write.mode("append").parquet(land)
        stream = spark.readStream.schema(event_rows(spark, [1]).schema).parquet(land)
        unique = streaming.dedup_stream(stream, watermark="5 days").select("id")
        (unique.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
            .trigger(availableNow=True).start().awaitTermination())
    assert spark.read.parquet(out).count() == 6


def test_raw_stream(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    event = {"title": "GDP", "comment": "c", "server_name": "en.wikipedia.org", "type": "edit", "timestamp": 1704067200}
    (land / "a.txt").write_text("data: " + json.dumps(event) + "\nnoise\n")
    out = str(tmp_path / "out")
    records = streaming.stream_raw(spark, str(land))
    streaming.write_raw_stream(records, out, str(tmp_path / "state")).awaitTermination()
    r = spark.read.parquet(out).first()
    assert (r.title, r.feed, str(r.ingest_date)) == ("GDP", "wikipedia", "2024-01-01")


def test_states_merge_to_the_batch_table(spark, tmp_path):
    """Batches in any order, replays and rows without a time: the same as all rows at once."""
    rng = np.random.default_rng(6)
    rows_ = [(None if i % 17 == 0 else dt.datetime(2024, 1, 1 + int(rng.integers(0, 4)), 5), float(1e6 + rng.normal()),
              None if i % 5 == 0 else float(rng.normal())) for i in range(200)]
    rows_ += [(dt.datetime(2024, 2, 1), 3.0, None)]
    schema = "timestamp timestamp, goldstein_scalar double, tone_scalar double"
    df = spark.createDataFrame(rows_, schema)
    want = {r["date"]: r for r in features.geo_daily(df.withColumn("date", F.to_date("timestamp"))).collect() if r["date"]}
    land, store, path, side = (str(tmp_path / x) for x in ("land", "store", "daily", "untimed"))
    (tmp_path / "land").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(land)

    def run(log):
        streaming.run_merged(stream, store, states.geo_state, states.geo_from_states, path,
                             str(tmp_path / log), side).awaitTermination()

    for part in range(4):
        spark.createDataFrame(rows_[part::4], schema).coalesce(1).write.mode("append").parquet(land)
        run("log")
    run("new-log")  # every batch comes again under its old name
    got = {r["date"]: r for r in tables.daily_table(spark, path).collect()}
    assert set(got) == set(want)
    for d, w in want.items():
        for c in w.asDict():
            assert got[d][c] == (pytest.approx(w[c], rel=1e-9, abs=1e-9) if isinstance(w[c], float) else w[c]), (d, c)
    assert spark.read.parquet(side).count() == sum(t is None for t, _, _ in rows_)


@pytest.mark.parametrize("seed", range(12))
def test_blocks_of_a_change_stream(tmp_path, monkeypatch, seed):
    """However the bytes are cut into files, ranges and reads, every whole block comes once, in order."""
    rng = random.Random(seed)
    end = rng.choice(["\n", "\r\n"])
    parts = []
    for k in range(60):
        lines = [f"id: {k}", ": note", *[f"data: é{k}-{i}" for i in range(rng.randint(0, 3))], "event:x"]
        rng.shuffle(lines)
        parts.append(end.join(lines) + end * rng.choice([2, 2, 3, 7]))
    whole = "".join(parts).encode()
    want = [x for x in (changes.parse_block(b) for b in re.split(rb"(?:\r?\n){2,}", whole)) if x]
    raw_bytes = whole + b"id: open" + end.encode() + b"data: not ended"
    cuts = sorted(rng.sample(range(1, len(raw_bytes)), 5))
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(raw_bytes)], strict=True)):
        (tmp_path / f"f{i}").write_bytes(raw_bytes[a:b])
    (tmp_path / "_ignored").write_bytes(b"data: no" + end.encode() * 2)
    monkeypatch.setattr(changes, "STEP", rng.choice([3, 17, 1 << 20]))
    reader = changes.ChangeReader({"path": str(tmp_path), "range": str(rng.choice([1, 7, 50, 1 << 20]))})

    def rows_between(start, stop):
        return [r for p in reader.partitions(start, stop) for r in reader.read(p)]

    middle = {"file": None, "byte": 0}
    last = reader.latestOffset()
    assert rows_between(middle, last) == want and len(want) > 30
    assert reader.latestOffset() == last and rows_between(last, last) == []
    # the open block comes when its end does, in a file of its own
    (tmp_path / "f9").write_bytes(end.encode() * 2 + b"data: last" + end.encode() * 2)
    after = reader.latestOffset()
    assert rows_between(last, after) == [("open", None, "not ended"), (None, None, "last")]
    again = changes.ChangeReader({"path": str(tmp_path)})
    assert list(r for p in again.partitions(last, again.latestOffset()) for r in again.read(p)) == rows_between(last, after)


def test_live_loop_publishes(spark, tmp_path, trained, labelled):
    fitted, _ = trained
    paths = {x: str(tmp_path / x) for x in ("matrix", "signals", "state", "messages", "ticks")}
    tables.write_feature(labelled.drop("regime"), paths["matrix"])
    spark.range(1).write.parquet(paths["ticks"])
    ticks = spark.readStream.schema("id long").parquet(paths["ticks"])
    streaming.run_live(ticks, fitted, paths["matrix"], paths["signals"], paths["state"], paths["messages"],
                       availableNow=True).awaitTermination()
    got = tables.signal_table(spark, paths["signals"]).collect()
    assert len(got) == 1 and got[0].date == DAY + dt.timedelta(days=119)
    message = spark.read.parquet(paths["messages"]).first()
    assert message.type == "signal_update" and message.regime == got[0].regime


# ---- stages --------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Sixty days of raw records of four sources."""
    root = str(tmp_path_factory.mktemp("world"))
    rng = np.random.default_rng(8)
    words = "growth gain loss crash market oil inflation prices bond debt fed war trade plain text".split()
    recs = []
    for d in range(60):
        ts = dt.datetime(2024, 1, 1, 9) + dt.timedelta(days=d)
        vix = 12.0 + 16.0 * (d % 3) / 2
        recs.append((f"v{d}", "fred", "macro", ts, f"VIXCLS: {vix}",
                     json.dumps({"series_id": "VIXCLS", "value": vix, "date": str(ts.date())})))
        for i in range(6):
            body = " ".join(rng.choice(words, 12))
            recs.append((f"g{d}-{i}", "gdelt", "news", ts, body,
                         json.dumps({"goldstein_scale": float(rng.normal(vix / 4 - 5, 1)), "tone": 1.0})))
            recs.append((f"r{d}-{i}", "reddit/r/investing", "social", ts, body + " post", "{}"))
    df = spark.createDataFrame(recs, "id string, source string, source_type string, timestamp timestamp, "
                                     "body string, metadata string").selectExpr(
        "id", "source", "source_type", "timestamp", "cast(null as string) title", "body",
        "cast(null as string) url", "metadata")
    raw.append_raw(df, root)
    payload = json.dumps({"markets": [{"ticker": "KXCPI-26APR-T3.0", "title": "t", "yes_bid_dollars": 0.6,
                                       "yes_ask_dollars": 0.7, "open_interest_fp": "10"}]})
    events = spark.createDataFrame([("KXCPI-26APR", payload), ("OTHER-1", payload)], "event_ticker string, value string")
    for when in ("2024-02-01 10:00:00", "2024-02-02 10:00:00", "2024-02-02 11:00:00"):
        stages.stage_markets(spark, root, events, when)
    stages.stage_all(spark, root, QUICK)
    return root


def test_feature_tables(spark, world):
    paths = stages.Paths(world)
    assert spark.read.parquet(paths.sentiment).count() == 60
    assert spark.read.parquet(paths.sentiment_sources).count() == 120  # macro bodies are too short
    assert spark.read.parquet(paths.geopolitical).count() == 60
    assert spark.read.parquet(paths.topic_assignments).count() == 720
    assert stages.matrix(spark, world).count() == 60
    assert len(stages.matrix(spark, world).columns) == 27


def test_served_reads(spark, world):
    assert serve.sentiment_tail(spark, world, 5).count() == 5
    assert serve.geo_tail(spark, world).columns == list(serve.GEO_COLUMNS)
    assert serve.topics_tail(spark, world).count() == 30
    assert serve.topic_summary(spark, world).count() == 8
    market = serve.market_tail(spark, world).collect()
    assert [str(r.date) for r in market] == ["2024-02-02", "2024-02-01"]
    assert market[0].kalshi_n_markets == 1 and market[0].kalshi_regime_scalar == pytest.approx(-0.18)
    newest = serve.latest_markets(spark, world).collect()
    assert [(str(r.date), r["count"]) for r in newest] == [("2024-02-02", 1)]
    latest = {r.feed: r for r in serve.latest_signal(spark, world).collect()}
    assert {k: r.n_days for k, r in latest.items()} == {"fred": 60, "gdelt": 60, "reddit": 60}
    assert latest["gdelt"].n_records == 360 and latest["gdelt"].regime in latest["gdelt"].probabilities
    assert serve.signal_history(spark, world).count() == 1
    with pytest.raises(ValueError):
        serve.geo_tail(spark, world, 0)


def test_predict_all_then_validate_and_backtest(spark, world):
    stages.stage_predict(spark, world, all_days=True)
    assert tables.signal_table(spark, stages.Paths(world).signals).count() == 60
    prices = spark.range(60).select(
        F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date"), F.lit("SPY").alias("ticker"),
        (100 + F.col("id") * 7 % 11).cast("double").alias("close"))
    sheet, rolling = serve.tearsheet(spark, world, prices)
    assert {r.horizon for r in sheet.collect()} == {1, 5, 10} and rolling.count() == 0
    result, frame = serve.run_backtest(spark, world, prices, [
        backtest.Strategy(s, 60, 0.0, 0.0) for s in ("sentiment", "geopolitical", "composite")])
    assert result.count() == 3 and frame.count() == 180


def test_incremental_run_equals_full_run(spark, world, rows):
    paths = stages.Paths(world)
    cols = [F.col("date").cast("string"), F.round("cross_composite", 9), "cross_count"]
    geo = [F.col("date").cast("string"), F.round("geopolitical_risk_score", 9), "total_events"]
    before = rows(tables.daily_table(spark, paths.sentiment), *cols)
    risk = rows(tables.daily_table(spark, paths.geopolitical), *geo)
    n_scores = spark.read.parquet(paths.sentiment_scores).count()
    late = raw.read_raw_table(spark, world, ["gdelt"]).where("ingest_date = '2024-02-20'").limit(3).drop(
        "feed", "ingest_date")
    raw.append_raw(late.withColumn("id", F.concat(F.lit("late"), "id")), world)
    stages.stage_sentiment(spark, world, since="2024-02-15")
    stages.stage_geopolitical(spark, world, since="2024-02-15")
    after = rows(tables.daily_table(spark, paths.sentiment), *cols)
    assert len(after) == 60 and sum(r[2] for r in after) == sum(r[2] for r in before) + 3
    assert [r for r in after if r[0] != "2024-02-20"] == [r for r in before if r[0] != "2024-02-20"]
    assert spark.read.parquet(paths.sentiment_scores).count() == n_scores + 3
    stages.stage_sentiment(spark, world)
    stages.stage_geopolitical(spark, world, date_col="event_date")
    assert rows(tables.daily_table(spark, paths.sentiment), *cols) == after
    now = rows(tables.daily_table(spark, paths.geopolitical), *geo)
    assert [r for r in now if r[0] != "2024-02-20"] == [r for r in risk if r[0] != "2024-02-20"]


def test_run_log(spark, world):
    done = {r.stage for r in spark.read.parquet(stages.Paths(world).runs).where("status = 'ok'").collect()}
    assert {"sentiment", "topics", "geopolitical", "kalshi", "train", "predict", "shap",
            "train_fold_0", "train_fold_1"} <= done


def test_failed_stage_is_logged(spark, tmp_path):
    with pytest.raises(Exception):
        stages.stage_sentiment(spark, str(tmp_path))
    assert spark.read.parquet(stages.Paths(str(tmp_path)).runs).first().status == "failed"


def test_training_without_folds_has_no_accuracy(spark, world):
    result = stages.stage_train(spark, world, model.TrainParams(trees=5, folds=0))
    assert result["mean_cv_accuracy"] is None and result["n_features"] > 0
