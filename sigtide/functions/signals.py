"""Scalar rules of the signal layer: event codes, market weights, regimes, display columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.functions.text import contains_any


def _literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))


def cameo_score(code: Column) -> Column:
    """Conflict / cooperation score of an event code.

    The two-character root decides; an unknown root falls back to its first character, and NULL,
    short or foreign codes score 0. (The daily conflict ratio uses the Goldstein threshold, not
    this table.)
    """
    root = F.substring(code, 1, 2)
    known = F.try_element_at(_literal_map({**K.CAMEO_COOPERATION, **K.CAMEO_CONFLICT}), root)
    fallback = F.try_element_at(_literal_map(K.CAMEO_FALLBACK), F.substring(code, 1, 1))
    return F.when(F.length(code) >= 2, F.coalesce(known, fallback, F.lit(0.0))).otherwise(
        F.lit(0.0))


def parse_threshold(ticker: Column) -> tuple[Column, Column]:
    """Letter and number of the first ``-X<number>`` part of a ticker, NULL when absent."""
    text = F.upper(ticker)
    letter = F.nullif(F.regexp_extract(text, K.THRESHOLD_PATTERN, 1), F.lit(""))
    value = F.nullif(F.regexp_extract(text, K.THRESHOLD_PATTERN, 2), F.lit(""))
    return letter, value.try_cast("double")


def directional_weight(series: Column, ticker: Column, title: Column) -> Column:
    """Risk-on (+) / risk-off (-) weight of a market; the first rule that applies wins.

    Word tests are substring tests on the upper-case title, so OVER also matches GOVERNMENT.
    """
    name = F.upper(F.coalesce(title, F.lit("")))
    code = F.upper(ticker)
    letter, value = parse_threshold(ticker)
    letter = F.coalesce(letter, F.lit(""))
    up_letter, down_letter = letter.isin("A", "T"), letter == "B"

    def graded(up, up_words, up_weight, down_words, down_weight, rest, down=None):
        return (F.when(up | contains_any(name, up_words), up_weight)
                .when((F.lit(False) if down is None else down) | contains_any(name, down_words),
                      down_weight)
                .otherwise(rest))

    rate_level = (F.when(value >= K.HIGH_RATE_THRESHOLD, -0.7)
                  .when(value.isNotNull(), 0.7)
                  .otherwise(graded(F.lit(False), K.HIKE_WORDS, -0.7, K.CUT_WORDS, 0.7, 0.0)))
    return (
        F.when((series == "KXRECESSION") | F.contains(code, F.lit("RECESSION"))
               | F.contains(name, F.lit("RECESSION")), -1.0)
        .when(series == "KXRATECUTCOUNT", 0.6)
        .when(series == "KXFEDDECISION",
              graded(letter == "H", K.HIKE_WORDS, -0.8, K.CUT_WORDS, 0.6, 0.3))
        .when(series == "KXFED", rate_level)
        .when(series.isin("KXCPI", "KXINFL"),
              graded(up_letter, K.HOT_INFLATION_WORDS, -0.6, K.COOL_INFLATION_WORDS, 0.4, -0.3,
                     down_letter))
        .when(series == "KXGDP",
              graded(up_letter, K.GDP_UP_WORDS, 0.5, K.GDP_DOWN_WORDS, -0.5, 0.0, down_letter))
        .when(series == "KXUNEMP",
              graded(up_letter, K.UNEMPLOYMENT_UP_WORDS, -0.4, K.UNEMPLOYMENT_DOWN_WORDS, 0.3,
                     0.0, down_letter))
        .otherwise(0.0)
    )


def mid_price(bid: Column, ask: Column, last: Column) -> Column:
    """Mean of bid and ask when either is quoted, else the last price, else NULL.

    A one-sided quote counts its missing side as 0.
    """
    return (F.when((bid != 0) | (ask != 0), (bid + ask) / 2.0)
            .when(last != 0, last))


def regime_label(vix: Column) -> Column:
    """Right-closed bins: 15 is still risk_on, 25 still transition. NULL stays NULL."""
    return (F.when(vix <= K.REGIME_RISK_ON_MAX, "risk_on")
            .when(vix <= K.REGIME_TRANSITION_MAX, "transition")
            .when(vix.isNotNull(), "risk_off"))


def renormalise(*probs: Column) -> list[Column]:
    """Shares of the total; a total of 0 counts as 1."""
    total = sum(probs[1:], probs[0])
    total = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return [p / total for p in probs]


def ic_class(ic: Column) -> Column:
    """Strength class of an information coefficient."""
    return F.when(ic > 0.05, "positive").when(ic < -0.05, "negative").otherwise("neutral")


def display_day(date: Column) -> Column:
    return F.date_format(date, "MMM d")


def display_label(label: Column) -> Column:
    return F.replace(label, F.lit("_"), F.lit(" "))
