"""Rule tables and edge cases of the column functions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.functions import parse, signals, stats, text


def values(spark, data, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, " + schema)
    return [r[0] for r in df.select(column.alias("x"), "i").orderBy("i").select("x").collect()]


def test_cameo_scores(spark):
    codes = ["14", "01", "1Z", "09", "9", None, "30", "0251", ""]
    got = values(spark, [(c,) for c in codes], "c string", signals.cameo_score(F.col("c")))
    assert got == [-0.9, 1.0, -0.3, 0.4, 0.0, 0.0, 0.0, 0.8, 0.0]


def test_regime_bins_are_right_closed(spark):
    got = values(spark, [(v,) for v in (14.99, 15.0, 15.01, 25.0, 25.01, None)], "v double",
                 signals.regime_label(F.col("v")))
    assert got == ["risk_on", "risk_on", "transition", "transition", "risk_off", None]


@pytest.mark.parametrize("series,ticker,title,weight", [
    ("KXFED", "KXFED-26APR-T4.25", "", -0.7), ("KXFED", "KXFED-26APR-T4.00", "", 0.7),
    ("KXFED", "KXFED-26APR", "a cut", 0.7), ("KXFED", "KXFED-26APR", "a raise", -0.7),
    ("KXFED", "KXFED-26APR", "nothing", 0.0), ("KXCPI", "KXCPI-26APR-B3.1", "", 0.4),
    ("KXCPI", "KXCPI-26APR-T3.1", "", -0.6), ("KXCPI", "KXCPI-26APR", "government", -0.6),
    ("KXINFL", "KXINFL-X", "", -0.3), ("KXFEDDECISION", "KXFEDDECISION-26APR-H25", "", -0.8),
    ("KXFEDDECISION", "KXFEDDECISION-26APR-C25", "Cut 25", 0.6),
    ("KXFEDDECISION", "KXFEDDECISION-26APR", "Hold", 0.3), ("KXRATECUTCOUNT", "X", "", 0.6),
    ("KXGDP", "KXGDP-a1.5", "", 0.5), ("KXGDP", "KXGDP-B1", "", -0.5), ("KXGDP", "KXGDP", "", 0.0),
    ("KXUNEMP", "KXUNEMP", "will rise", -0.4), ("KXUNEMP", "KXUNEMP", "will fall", 0.3),
    ("OTHER", "ABC", "US recession?", -1.0), ("KXRECESSION", "R", None, -1.0),
    ("OTHER", "ABC", None, 0.0),
])
def test_directional_weight(spark, series, ticker, title, weight):
    got = values(spark, [(series, ticker, title)], "s string, t string, n string",
                 signals.directional_weight(F.col("s"), F.col("t"), F.col("n")))
    assert got == [weight]


def test_threshold_takes_the_first_match(spark):
    letter, value = signals.parse_threshold(F.col("t"))
    data = [("kxcpi-25sep-b3.1",), ("A-T4-B5",), ("KXFED-26APR",), ("K-X3",)]
    assert values(spark, data, "t string", letter) == ["B", "T", None, None]
    assert values(spark, data, "t string", value) == [3.1, 4.0, None, None]


def test_mid_price(spark):
    data = [(0.4, 0.0, 0.9), (0.0, 0.0, 0.7), (0.0, 0.0, 0.0), (0.2, 0.4, 0.0)]
    got = values(spark, data, "b double, a double, l double",
                 signals.mid_price(F.col("b"), F.col("a"), F.col("l")))
    assert got == pytest.approx([0.2, 0.7, None, 0.3])


def test_text_length_boundary(spark):
    data = [("  " + "x" * 20 + "\n",), ("x" * 21,), (None,), (" \t  \n",), ("é" * 21,)]
    got = values(spark, data, "b string", text.is_scorable(text.strip_text(F.col("b"))))
    assert got == [False, True, None, False, True]


def test_length_in_bytes_or_characters(spark):
    data = [("é" * 10,), ("x" * 20,)]
    assert values(spark, data, "b string", text.long_enough(F.col("b"))) == [False, True]
    assert values(spark, data, "b string", text.long_enough(F.col("b"), "bytes")) == [True, True]


def test_post_body(spark):
    data = [("t", "[removed]"), ("t", "[deleted]"), ("t", ""), ("t", None), ("t", "more")]
    got = values(spark, data, "t string, s string", text.post_body(F.col("t"), F.col("s")))
    assert got == ["t", "t", "t", "t", "t\n\nmore"]


def test_macro_label_ties_and_misses(spark):
    data = [("fed cpi",), ("nothing here",), ("OPEC oil and cpi",), ("bond debt cpi prices",)]
    got = values(spark, data, "w string", text.macro_label(F.col("w")))
    assert got == ["inflation", "other", "energy", "inflation"]


def test_numbers_and_times_never_raise(spark):
    got = values(spark, [("4.5",), ("abc",), (None,), ("",)], "v string",
                 parse.safe_double(F.col("v")))
    assert got == [4.5, 0.0, 0.0, 0.0]
    assert values(spark, [(".",), ("",), ("4.5",), ("abc",), (None,)], "v string",
                  parse.is_reported(F.col("v"))) == [False, False, True, True, False]
    meta = [('{"a": 1.5}',), ('{"a": null}',), ("[1]",), ("broken",), (None,), ('{"a": "x"}',)]
    assert values(spark, meta, "m string", parse.json_double(F.col("m"), "a")) == [
        1.5, 0.0, 0.0, 0.0, 0.0, 0.0]
    late = parse.parse_timestamp(F.col("v"), "yyyy-MM-dd", F.lit(None).cast("timestamp"))
    assert values(spark, [("2024-02-30",), ("x",)], "v string", late) == [None, None]


def test_series_value_prefers_metadata(spark):
    data = [("VIXCLS: 17.5", '{"value": 18.0}'), ("VIXCLS: 17.5", None), ("VIXCLS: x", "{}")]
    got = values(spark, data, "b string, m string", parse.series_value(F.col("b"), F.col("m")))
    assert got == [18.0, 17.5, None]


def test_clip_keeps_null(spark):
    got = values(spark, [(-3.0,), (0.5,), (7.0,), (None,)], "v double",
                 parse.clip(F.col("v"), -1.0, 1.0))
    assert got == [-1.0, 0.5, 1.0, None]


def test_renormalise(spark):
    shares = F.array(*signals.renormalise(F.col("a"), F.col("b")))
    assert values(spark, [(1.0, 3.0), (0.0, 0.0)], "a double, b double", shares) == [
        [0.25, 0.75], [0.0, 0.0]]


def _t_tail(t: float, v: int) -> float:
    """Two-sided tail by integrating the density over a tangent substitution."""
    phi = np.linspace(0, np.arctan(abs(t) / np.sqrt(v)), 200_001)
    area = np.trapezoid(np.cos(phi) ** (v - 1), phi)
    whole = np.trapezoid(np.cos(w := np.linspace(0, np.pi / 2, 200_001)) ** (v - 1), w)
    return 1 - area / whole


@pytest.mark.parametrize("rho,n", [(0.3, 30), (-0.3, 31), (0.05, 500), (0.01, 2401), (0.9, 40),
                                   (0.02, 20_500), (0.4, 3), (0.4, 4)])
def test_p_value(spark, rho, n):
    got = values(spark, [(rho, n)], "r double, n long",
                 stats.t_two_sided_p(F.col("r"), F.col("n")))[0]
    t = rho * np.sqrt((n - 2) / (1 - rho * rho))
    assert got == pytest.approx(_t_tail(t, n - 2), abs=2e-6)


def test_p_value_of_perfect_correlation(spark):
    assert values(spark, [(1.0, 40), (-1.0, 41)], "r double, n long",
                  stats.t_two_sided_p(F.col("r"), F.col("n"))) == [0.0, 0.0]


def test_constants_cover_the_codes():
    assert len(K.CAMEO_CONFLICT) == 11 and len(K.CAMEO_COOPERATION) == 8
    assert sorted(K.REGIME_CLASSES) == list(K.REGIME_CLASSES)
