"""Deduplication, time series, features, validation and back-test against plain loops."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.functions.stats import spearman_kernel
from sigtide.operators import backtest, dedup, features, labels, model, sentiment, timeseries
from sigtide.operators import topics, validation
from sigtide.plans import queries
from tests.conftest import SMALL

DAY = dt.date(2024, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


def daily(spark, values, name="value", kind="double"):
    return spark.createDataFrame(list(values), f"date date, {name} {kind}")


# ---- deduplication -------------------------------------------------------------------------------

def test_first_copy_wins_even_for_a_hot_key(spark, rows):
    data = [("hot", i, f"b{i}") for i in range(300)] + [("a", 300, "x"), ("a", 301, "y"), ("s", 302, "z")]
    new = spark.createDataFrame(data[::-1], "id string, seq int, body string").repartition(7)
    stored = spark.createDataFrame([("s",)] * 50, "id string")
    once = dedup.dedup_existing(new, stored)
    assert rows(once, "id", "seq", "body") == [("a", 300, "x"), ("hot", 0, "b0")]
    assert rows(dedup.dedup_existing(once, stored)) == rows(once)


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    """Equal times: the row that stays is the same however the table is read."""
    data = [("a", 5, f"t{i % 3}", {"q": f"x{i}"}, [i, 2]) for i in range(6)] + [("a", None, "a0", {}, []), ("b", None, "z", None, None)]
    schema = "id string, seq int, title string, meta map<string,string>, list array<int>"
    seen = set()
    for seed in range(4):
        rows_ = random.Random(seed).sample(data, len(data))
        got = dedup.first_per_key(spark.createDataFrame(rows_, schema).repartition(1 + seed), "id", "seq")
        seen.add(str(sorted(map(tuple, got.collect()))))
    assert seen == {str([("a", 5, "t0", {"q": "x0"}, [0, 2]), ("b", None, "z", None, None)])}


@pytest.mark.parametrize("descending", [False, True])
def test_consecutive_duplicates(spark, descending):
    rng = np.random.default_rng(3)
    # one key and one timestamp hold most rows; NULL is a key like any other
    keys = [None if k == 3 else f"k{k}" for k in rng.choice([0, 0, 0, 0, 1, 2, 3], 2000)]
    data = [(i, int(rng.choice([5, 5, 5, i % 50])), k) for i, k in enumerate(keys)]
    order = sorted(data, key=lambda r: (r[1], r[0]), reverse=descending)
    expected = [r[0] for i, r in enumerate(order) if i == 0 or r[2] != order[i - 1][2]]
    df = spark.createDataFrame(data, "id int, t int, key string").repartition(5)
    got = dedup.dedup_consecutive(df, "key", ["t", "id"], descending)
    assert sorted(r.id for r in got.collect()) == sorted(expected)
    few = dedup.dedup_consecutive(df.where("id < 3"), "key", ["t", "id"], descending).collect()
    first = [r for r in order if r[0] < 3]
    assert sorted(r.id for r in few) == sorted(
        r[0] for i, r in enumerate(first) if i == 0 or r[2] != first[i - 1][2])
    assert dedup.dedup_consecutive(df.limit(0), "key", ["t", "id"], descending).count() == 0


def test_consecutive_blocks_of_many_batches(spark):
    """NaN equals NaN, and keys are compared across Arrow batches and across blocks."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "7")
    try:
        df = spark.range(600).select("id", F.when(F.col("id") < 250, float("nan")).when(
            F.col("id") < 500, 1.5).otherwise((F.col("id") / 10).cast("int").cast("double")).alias("key"))
        got = sorted(r.id for r in dedup.dedup_consecutive(df.repartition(3), "key", ["id"]).collect())
        assert got == [0, 250, *range(500, 600, 10)]
    finally:
        spark.conf.set(conf, before)


# ---- time series ---------------------------------------------------------------------------------

def test_linear_resample(spark, rows):
    points = daily(spark, [(day(0), 10.0), (day(4), 18.0), (day(5), None), (day(6), 20.0)])
    got = dict(rows(timeseries.resample_daily_linear(points), F.datediff("date", F.lit(DAY)), "value"))
    assert got == {0: 10.0, 1: 12.0, 2: 14.0, 3: 16.0, 4: 18.0, 5: 19.0, 6: 20.0}


def test_resample_keeps_series_apart(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(2), 3.0), ("b", day(9), 5.0)],
                               "s string, date date, value double")
    got = timeseries.resample_daily_linear(df, by=["s"]).groupBy("s").count()
    assert {r["s"]: r["count"] for r in got.collect()} == {"a": 3, "b": 1}


@pytest.mark.parametrize("unique", [True, False])
def test_nearest_ties_go_forward(spark, rows, unique):
    right = daily(spark, [(day(0), 0.0), (day(4), 4.0), (day(10), 10.0)])
    left = spark.createDataFrame([(day(i), f"k{i}") for i in (-3, 1, 2, 3, 7, 8, 15)], "date date, k string")
    got = dict(rows(timeseries.nearest_join(left, right, unique_left=unique), "k", "value"))
    assert got == {"k-3": 0.0, "k1": 0.0, "k2": 4.0, "k3": 4.0, "k7": 10.0, "k8": 10.0, "k15": 10.0}


@pytest.mark.parametrize("unique", [True, False])
def test_asof_by_key(spark, rows, unique):
    right = spark.createDataFrame([("a", day(1), 1.0), ("a", day(5), None), ("b", day(0), 9.0)],
                                  "k string, date date, v double")
    left = spark.createDataFrame([("a", day(0)), ("a", day(1)), ("a", day(4)), ("a", day(6)), ("b", day(3)),
                                  ("c", day(3))], "k string, date date")
    got = rows(timeseries.asof_join(left, right, by=["k"], unique_left=unique).select(
        "k", F.datediff("date", F.lit(DAY)).alias("d"), "v"))
    # the last row counts, even when its value is missing
    assert got == [("a", 0, None), ("a", 1, 1.0), ("a", 4, 1.0), ("a", 6, None), ("b", 3, 9.0), ("c", 3, None)]


def test_alignment_modes(spark, rows):
    returns = spark.createDataFrame([(day(i), t) for i in (0, 2, 3) for t in "xy"], "date date, ticker string")
    signals = spark.createDataFrame([(day(0), "on", 0.9), (day(1), "off", 0.1), (day(3), None, 0.5)],
                                    "date date, regime string, p double")
    exact = timeseries.align_signals(returns, signals).where("ticker = 'x'")
    asof = timeseries.align_signals(returns, signals, "asof").where("ticker = 'x'")
    d = F.datediff("date", F.lit(DAY))
    assert rows(exact, d, "regime", "p") == [(0, "on", 0.9), (2, "on", 0.9), (3, "on", 0.5)]
    assert rows(asof, d, "regime", "p") == [(0, "on", 0.9), (2, "off", 0.1), (3, None, 0.5)]


def test_forward_returns_and_tail(spark, rows):
    prices = spark.createDataFrame([(day(i), "x", 2.0 ** i) for i in range(7)], "date date, ticker string, close double")
    got = timeseries.forward_returns(prices, [1, 5]).orderBy("date").collect()
    assert [r.fwd_1d for r in got] == [1.0] * 6 + [None]
    assert [r.fwd_5d for r in got] == [31.0, 31.0] + [None] * 5
    assert rows(timeseries.tail_n(prices, 2, "date", ["ticker"]), "close") == [(32.0,), (64.0,)]
    diff = timeseries.first_difference(prices, "close").orderBy("date").first()
    assert diff["diff"] == 0.0


@pytest.fixture
def many_blocks(spark):
    """Range blocks stay apart although the tables are small."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(3))
def test_order_without_a_key(spark, rows, many_blocks, seed):
    """Values carried across blocks, against loops over the sorted rows."""
    rng = random.Random(seed)
    at = sorted(rng.sample(range(400), 60))
    given = [(day(i), rng.choice([None, None, None, float(i)]), rng.choice([None, f"s{i}"])) for i in at]
    df = spark.createDataFrame(rng.sample(given, len(given)), "date date, value double, word string")
    want, value, word = [], None, None
    for d, v, w in given:
        value, word = v if v is not None else value, w if w is not None else word
        want.append((d, value, word))
    filled = timeseries.forward_fill(df, ["value", "word"])
    assert filled.columns == df.columns
    assert sorted(map(tuple, filled.collect())) == want

    known = [(i, v) for i, (_, v, _) in zip(at, given, strict=True) if v is not None]
    line = []
    for (i, v), (j, w) in zip(known, known[1:], strict=False):
        line += [(i + k, v + (w - v) * k / (j - i)) for k in range(j - i)]
    got = timeseries.resample_daily_linear(df).select(F.datediff("date", F.lit(DAY)).alias("d"), "value")
    got = dict(map(tuple, got.collect()))
    assert sorted(got) == [i for i, _ in [*line, known[-1]]]
    assert all(abs(got[i] - v) < 1e-9 for i, v in [*line, known[-1]])

    right = daily(spark, [(day(i), float(i)) for i, _ in known])
    left = spark.createDataFrame([(day(i), i) for i in range(-5, 405, 3)], "date date, k int")
    for unique in (True, False):
        near = dict(rows(timeseries.nearest_join(left, right, unique_left=unique), "k", "value"))
        assert near == {k: float(min((i for i, _ in known), key=lambda i: (abs(i - k), -i))) for k in near}
        asof = dict(rows(timeseries.asof_join(left, right, unique_left=unique), "k", "value"))
        assert asof == {k: max((float(i) for i, _ in known if i <= k), default=None) for k in asof}
        assert len(near) == len(asof) == left.count()

    parts = {(r["date"], r["fold"]): r["part"] for r in model.ts_split(df.select("date"), 3).collect()}
    size = len(at) // 4
    for fold in range(3):
        start = len(at) - (3 - fold) * size
        for k, i in enumerate(at):
            assert parts.get((day(i), fold)) == ("train" if k < start else "test" if k < start + size else None)


def test_order_of_an_empty_table(spark, many_blocks):
    none = daily(spark, [])
    assert timeseries.forward_fill(none, ["value"]).count() == 0
    assert timeseries.resample_daily_linear(none).count() == 0
    assert timeseries.nearest_join(none, none.withColumnRenamed("value", "v")).count() == 0
    left = daily(spark, [(day(1), 1.0)])
    assert timeseries.asof_join(left, none.withColumnRenamed("value", "v")).first()["v"] is None


@pytest.mark.parametrize("name", ["ffill_align", "asof_align", "vix_interpolated", "nearest_join", "ts_split"])
def test_no_task_orders_a_whole_table(spark, name):
    plan = queries.queries()[name](spark, SMALL)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


# ---- features ------------------------------------------------------------------------------------

def test_goldstein_edges(spark):
    meta = ['{"goldstein_scale": -3.0, "tone": 50}', '{"goldstein_scale": -3.1}', '{"goldstein_scale": 3.0}',
            '{"goldstein_scale": 3.1}', '{"goldstein_scale": null}', "[]"]
    df = spark.createDataFrame([("a", m) for m in meta] + [("b", meta[1])], "date string, metadata string")
    got = {r.date: r for r in features.geo_daily(features.geo_fields(df)).collect()}
    assert (got["a"].conflict_events, got["a"].cooperation_events, got["a"].total_events) == (1, 1, 6)
    assert got["a"].mean_tone == pytest.approx(0.5 / 6)
    assert got["b"].std_goldstein is None
    assert got["b"].geopolitical_risk_score == pytest.approx(0.6 * 0.31 + 0.4)


def test_market_scalar_edges(spark):
    df = spark.createDataFrame([
        ("a", 0.5, 0.9, 0.0), ("a", -1.0, 0.2, 3.0), ("a", 0.7, None, 10.0), ("a", 0.0, 0.5, 99.0),
        ("b", 0.0, 0.5, 1.0), ("c", 1.0, 1.7, None)],
        "date string, directional_weight double, mid_price double, open_interest double")
    got = {r.date: r for r in features.market_daily(df).collect()}
    assert got["a"].kalshi_regime_scalar == pytest.approx((0.8 * 0.5 * 1 + 0.6 * 3) / 4)
    assert (got["a"].kalshi_n_markets, got["a"].kalshi_n_weighted_markets) == (4, 3)
    assert got["a"].kalshi_total_open_interest == 13.0
    assert got["b"].kalshi_regime_scalar == 0.0 and got["b"].kalshi_total_open_interest == 0.0
    assert got["c"].kalshi_regime_scalar == 1.0


def test_feature_matrix_rejects_duplicate_dates(spark):
    a = daily(spark, [(day(0), 1.0), (day(0), 2.0)], "a")
    with pytest.raises(Exception, match="duplicate date"):
        features.feature_matrix([a, daily(spark, [(day(1), 1.0)], "b")]).collect()


def test_feature_matrix_fills_zero(spark, rows):
    parts = [daily(spark, [(day(0), 1.0), (day(1), None)], "a"), daily(spark, [(day(2), 5.0)], "b")]
    got = rows(features.feature_matrix(parts, missing_flags=True).drop("date"))
    assert got == [(0.0, 0.0, 0, 1), (0.0, 5.0, 1, 0), (1.0, 0.0, 0, 1)]


def test_volatility_points_last_write(spark, rows):
    meta = '{"series_id": "VIXCLS", "value": %s, "date": "2024-01-02"}'
    df = spark.createDataFrame([
        ("1", "VIXCLS: 14", meta % 14, day(3)), ("2", "VIXCLS: 16", meta % 16, day(4)),
        ("3", "DGS10: 4", '{"value": 4}', day(4)), ("4", "VIXCLS: 20", None, day(8)),
        ("5", "VIXCLS: bad", None, day(9))], "id string, body string, metadata string, ingest_date date")
    points = labels.volatility_points(df)
    assert rows(points, F.col("date").cast("string"), "value") == [("2024-01-02", 16.0), ("2024-01-09", 20.0)]
    days = spark.createDataFrame([(day(i),) for i in (-5, 1, 2, 50)], "date date")
    got = rows(labels.label_regimes(days, points), F.datediff("date", F.lit(DAY)), "regime")
    assert got == [(-5, "transition"), (1, "transition"), (2, "transition"), (50, "transition")]


def test_missing_series_gives_null_labels(spark):
    got = labels.label_regimes(daily(spark, [(day(0), 1.0)], "x"), daily(spark, [])).first()
    assert got.regime is None


# ---- text ----------------------------------------------------------------------------------------

def scored_input(spark):
    return spark.createDataFrame([
        ("1", "gain gain loss " + "word " * 20), ("2", "short"), ("3", None), ("4", "x" * 21), ("5", "1234567890 " * 3)],
        "id string, body string").selectExpr("id", "'s' source", "'social' source_type", "date'2024-01-01' date", "body")


def test_lexicon_probabilities(spark):
    got = {r.id: r for r in sentiment.score_text(scored_input(spark)).collect()}
    assert set(got) == {"1", "4", "5"}
    assert got["1"].positive == pytest.approx(3 / 7) and got["1"].negative == pytest.approx(2 / 7)
    for r in got.values():
        assert r.positive + r.negative + r.neutral == pytest.approx(1.0)
        assert r.composite == pytest.approx(r.positive - r.negative)
    assert got["5"].neutral == pytest.approx(1 / 3)  # no letters at all


def test_plugged_scorer_keeps_keys(spark):
    def scorer(texts):
        assert len(texts) <= 32
        return [(len(t) / 1000, 0.1, 0.2) for t in texts]
    got = {r.id: r for r in sentiment.score_text(scored_input(spark), scorer).collect()}
    assert set(got) == {"1", "4", "5"}
    assert got["4"].positive == pytest.approx(0.021) and got["4"].text_length == 21


def test_learned_scorer(spark):
    base = [("great gain", "positive"), ("big loss", "negative"), ("plain day", "neutral")] * 8
    train = spark.createDataFrame(base, "body string, label string")
    model = sentiment.fit_text_classifier(train, "label", features=256)
    text = spark.createDataFrame([("1", "great gain great gain great gain")], "id string, body string")
    r = sentiment.score_with_classifier(model, text, keep=["id"]).first()
    assert r.positive > r.negative and r.positive + r.negative + r.neutral == pytest.approx(1.0)


def test_topics_noise_and_probability(spark):
    rng = np.random.default_rng(0)
    centres = [[0.0, 0.0], [20.0, 0.0], [0.0, 20.0]]
    data = [(i, (np.array(centres[c]) + rng.normal(0, 0.1, 2)).tolist())
            for i, c in enumerate([0] * 30 + [1] * 30 + [2] * 4)]
    df = spark.createDataFrame(data, "id int, embedding array<double>")
    fitted = topics.fit_topics(df, k=3, min_topic_size=10)
    got = topics.assign_topics(fitted, df).collect()
    sizes = pd.Series([r.topic_id for r in got]).value_counts().to_dict()
    assert sizes.pop(-1) == 4 and sorted(sizes.values()) == [30, 30]
    assert all(0.99 < r.topic_prob <= 1.0 for r in got)
    expected = fitted.model.transform(df.select("id", F.col("embedding")).withColumn(
        "_features", topics.array_to_vector("embedding"))).select("id", "_topic")
    by_id = {r["id"]: r["_topic"] for r in expected.collect()}
    assert all(r.topic_id in (-1, by_id[r.id]) for r in got)


def test_text_topics_keep_every_document(spark):
    data = [(i, "oil gas barrel " * 5 if i % 2 else "vote senate ballot " * 5) for i in range(40)]
    df = spark.createDataFrame([*data, (40, "?!")], "id int, body string")
    fitted, assigned = topics.fit_assigned(df, "lda", "body", k=2, min_topic_size=5)
    got = {r["id"]: r for r in topics.assign_topics(fitted, df).collect()}
    assert {(r["id"], r["topic_id"], r["body"]) for r in assigned.collect()} == {
        (i, r["topic_id"], r["body"]) for i, r in got.items()}
    assert len(got) == 41 and set(fitted.topics) <= {0, 1}
    assert all(0 < r["topic_prob"] <= 1 for i, r in got.items() if i < 40)
    for part in (0, 1):  # equal texts share a topic
        assert len({(got[i]["topic_id"], round(got[i]["topic_prob"], 6)) for i in range(part, 40, 2)}) == 1


def test_topic_fits_make_twenty_passes(spark):
    df = spark.createDataFrame([(float(i), 1.0, f"word{i % 3} other") for i in range(12)],
                               "x double, y double, body string").withColumn("embedding", F.array("x", "y"))
    assert topics.fit_topics(df, k=2).model.getMaxIter() == 20
    assert topics.fit_topics(df, "lda", "body", k=2).model.stages[-1].getMaxIter() == 20


def test_topic_of_missing_embedding_is_noise(spark):
    df = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(20)], "id int, embedding array<double>")
    fitted = topics.fit_topics(df, k=2, min_topic_size=5)
    odd = topics.assign_topics(fitted, df.limit(1).withColumn("embedding", F.lit(None).cast(
        "array<double>"))).first()
    assert odd.topic_id == -1 and odd.topic_prob is None


def test_topic_labels_and_unknown_topic(spark, rows):
    words = spark.createDataFrame([(0, 1, "oil"), (0, 2, "gas"), (1, 1, "zebra"), (-1, 1, "oil")],
                                  "topic_id int, rank int, word string")
    names = topics.topic_labels(words)
    assert rows(names) == [(-1, "noise"), (0, "energy"), (1, "other")]
    docs = spark.createDataFrame([("d", 0), ("d", 7), ("e", -1)], "date string, topic_id int")
    pivot = topics.topic_pivot(topics.label_documents(docs, names))
    assert len(pivot.columns) == 11
    assert rows(pivot, "date", "energy", "other", "noise") == [("d", 1, 1, 0), ("e", 0, 0, 1)]


# ---- validation ----------------------------------------------------------------------------------

def plain_spearman(x, y):
    a, b = pd.Series(x).rank(), pd.Series(y).rank()
    if a.std() == 0 or b.std() == 0:
        return math.nan
    return float(np.corrcoef(a, b)[0, 1])


def test_row_kernel():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, (700, 63)).astype(float), rng.normal(size=(700, 63))
    x[3] = 1.0
    x[5, :30] = np.nan
    got = spearman_kernel()(x, y)
    assert math.isnan(got[3])
    for i in (0, 5, 511, 512, 699):
        ok = ~np.isnan(x[i])
        assert got[i] == pytest.approx(plain_spearman(x[i][ok], y[i][ok]))


def aligned_frame(spark, n, seed, gaps=()):
    rng = np.random.default_rng(seed)
    recs = []
    for t in ("SPY", "TLT", "OTHER"):
        for i in range(n):
            on = None if i in gaps else float(rng.integers(0, 8)) / 8
            recs.append((day(i), t, on, float(rng.integers(0, 8)) / 8,
                         *[None if i >= n - h else float(rng.integers(-5, 5)) / 10 for h in K.HORIZONS]))
    schema = "date date, ticker string, risk_on_prob double, risk_off_prob double, fwd_1d double, fwd_5d double, fwd_10d double"
    return spark.createDataFrame(recs, schema), recs


def test_tearsheet_against_loops(spark):
    df, recs = aligned_frame(spark, 90, 5, gaps=range(20, 24))
    got = {(r.ticker, r.horizon): r for r in validation.ic_summary(df, digits=10).collect()}
    assert {t for t, _ in got} == {"SPY", "TLT"}
    for (ticker, h), r in got.items():
        own = [x for x in recs if x[1] == ticker]
        s = [x[2] if ticker == "SPY" else -x[3] for x in own]
        y = [x[4 + K.HORIZONS.index(h)] for x in own]
        pairs = [(a, b) for a, b in zip(s, y) if a is not None and b is not None]
        s, y = np.array(pairs).T
        assert r.n_obs == len(pairs)
        assert r.ic == pytest.approx(plain_spearman(s, y))
        assert r.hit_rate == pytest.approx(np.mean(np.sign(s) == np.sign(y)))
        rolls = [plain_spearman(s[i - 63:i], y[i - 63:i]) for i in range(63, len(s))]
        assert r.ir == pytest.approx(np.mean(rolls) / np.std(rolls, ddof=1) * math.sqrt(252))


def test_minimum_observations(spark):
    for n, kept in ((30, 0), (31, 1)):
        df, _ = aligned_frame(spark, n, 2)
        got = validation.ic_summary(df, {"TLT": ("risk_off_prob", -1.0)}, [1])
        assert got.count() == kept  # one return is missing at the end
        assert all(r.ir is None for r in got.collect())


@pytest.mark.parametrize("valid", [19, 20])
def test_rolling_minimum(spark, valid):
    df, _ = aligned_frame(spark, 64, 4, gaps=range(0, 63 - valid))
    got = validation.rolling_ic(df, {"SPY": ("risk_on_prob", 1.0)}).collect()
    assert [str(r.date) for r in got] == ([str(day(63))] if valid == 20 else [])


def test_rolling_against_loops(spark):
    df, recs = aligned_frame(spark, 80, 9, gaps=range(30, 40))
    own = [x for x in recs if x[1] == "SPY"]
    got = {r.date: r.rolling_ic for r in validation.rolling_ic(df, digits=10).where("ticker = 'SPY'").collect()}
    for i in range(63, 80):
        w = [(x[2], x[4]) for x in own[i - 63:i] if x[2] is not None and x[4] is not None]
        assert got[day(i)] == pytest.approx(plain_spearman(*np.array(w).T))
    assert len(got) == 17


def test_constant_signal_gives_no_rolling_row(spark):
    df, _ = aligned_frame(spark, 70, 1)
    flat = df.withColumn("risk_on_prob", F.lit(0.5))
    assert validation.rolling_ic(flat, {"SPY": ("risk_on_prob", 1.0)}).count() == 0
    r = validation.ic_summary(flat, {"SPY": ("risk_on_prob", 1.0)}, [1]).first()
    assert r.ic is None and r.ir is None


# ---- back-test -----------------------------------------------------------------------------------

def walk(prices, signal, entry, leave, fee):
    """The definition, bar by bar."""
    pos, equity, trades, paid, held = 0, [1.0], [], None, [0]
    for i in range(1, len(prices)):
        if pos == 0 and signal[i] > entry:
            pos, paid = 1, prices[i] * (1 + fee)
        elif pos == 1 and signal[i] < leave:
            pos = 0
            trades.append(prices[i] * (1 - fee) / paid - 1)
        held.append(pos)
        equity.append(equity[-1] * (1 + (prices[i] / prices[i - 1] - 1) * pos))
    return held, equity, trades


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(11)
    n = 300
    prices = 100 * np.cumprod(1 + rng.normal(0, 0.02, n))
    signal = rng.uniform(-0.5, 0.5, n)
    days = [day(i) for i in range(n)]
    p = spark.createDataFrame(list(zip(days, prices.tolist())), "date date, close double")
    s = spark.createDataFrame([("composite", d, float(v)) for d, v in zip(days, signal)],
                              "signal_source string, date date, signal double")
    return prices, signal, p, s


CASES = [backtest.Strategy(lookback_days=252), backtest.Strategy(lookback_days=300, entry_threshold=0.0,
         exit_threshold=0.3, fees=0.01), backtest.Strategy(lookback_days=60, entry_threshold=1.0)]


def test_backtest_equals_the_walk(spark, market):
    prices, signal, p, s = market
    params = backtest.strategy_frame(spark, CASES)
    frame = backtest.grid(s, p, params).orderBy("strategy_id", "bar").toPandas()
    result = {r.strategy_id: r for r in backtest.summary_text(backtest.metrics(backtest.grid(s, p, params))).collect()}
    for i, c in enumerate(CASES):
        n = min(c.lookback_days, len(prices))
        held, equity, trades = walk(prices[-n:], signal[-n:], c.entry_threshold, c.exit_threshold, c.fees)
        own = frame[frame.strategy_id == i]
        assert own.position.tolist() == held
        assert np.allclose(own.equity, equity)
        assert (own.drawdown <= 0).all()
        assert np.allclose(own.trade_return.dropna(), trades)
        r = result[i]
        e = pd.Series(equity)
        rets = e.pct_change().dropna()
        ann = e.iloc[-1] ** (252 / n) - 1
        assert (r.n_bars, r.n_trades) == (n, len(trades))
        assert r.annualized_return == pytest.approx(ann)
        vol = rets.std() * math.sqrt(252)
        down = rets[rets < 0].std() * math.sqrt(252)
        low = ((e - e.cummax()) / e.cummax()).min()
        assert r.sharpe_ratio == pytest.approx(ann / vol if vol > 0 else 0)
        assert r.sortino_ratio == pytest.approx(ann / down if down > 0 else 0)
        assert r.max_drawdown == pytest.approx(low)
        assert r.calmar_ratio == pytest.approx(ann / abs(low) if low < 0 else 0)
        assert r.win_rate == pytest.approx(sum(t > 0 for t in trades) / max(len(trades), 1))
        assert f"over {c.lookback_days} days" in r.summary and r.summary.startswith("Composite signal")
    assert result[2].n_trades == 0 and result[2].sharpe_ratio == 0.0


def test_lag_moves_the_return(spark, market):
    _, _, p, s = market
    params = backtest.strategy_frame(spark, CASES[:1])
    now = backtest.grid(s, p, params, 0).orderBy("bar").toPandas()
    late = backtest.grid(s, p, params, 1).orderBy("bar").toPandas()
    change = now.close / now.close.shift(1) - 1
    assert np.allclose(late.period_return[1:], (change * now.position.shift(1))[1:])
    with pytest.raises(ValueError):
        backtest.equity_curve(p, lag=2)


def test_too_few_bars_are_reported(spark, market):
    _, _, p, s = market
    params = backtest.strategy_frame(spark, CASES)
    few = s.orderBy("date").limit(29)
    frame = backtest.bars(few, p, params)
    assert frame.count() == 0 and backtest.rejected(frame, params).count() == 3
    assert backtest.bars(s.orderBy("date").limit(30), p, params).count() == 90


def test_parameters_are_checked():
    for bad in (dict(direction="short"), dict(lookback_days=10), dict(fees=0.1), dict(entry_threshold=2)):
        with pytest.raises(ValueError):
            backtest.Strategy(**bad).check()
