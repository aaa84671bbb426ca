"""Daily aggregates as states that merge: what a later batch adds to a day needs no earlier row.

A state holds, per day and batch, counts and per measured column its number of values, mean and sum of
squared deviations (M2). Two states merge by the pairwise update, which subtracts no large sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.operators.features import geo_scores

GEO_MEASURES = ("goldstein_scalar", "tone_scalar")
GEO_COUNTS = ("conflict_events", "cooperation_events")


def moments(column: str) -> Column:
    """(n, mean, m2) of a column; NULLs do not count."""
    n = F.count(column)
    return F.struct(n.alias("n"), F.coalesce(F.avg(column), F.lit(0.0)).alias("mean"),
                    F.coalesce(F.var_pop(column) * n, F.lit(0.0)).alias("m2")).alias(column)


def _pair(a: Column, b: Column) -> Column:
    """Moments of two disjoint sets of values."""
    n = a["n"] + b["n"]
    gap = b["mean"] - a["mean"]
    share = F.coalesce(F.try_divide(b["n"].cast("double"), n), F.lit(0.0))
    return F.struct(n.alias("n"), (a["mean"] + gap * share).alias("mean"),
                    (a["m2"] + b["m2"] + gap * gap * share * a["n"]).alias("m2"))


def merged(states: DataFrame, measures: Sequence[str], counts: Sequence[str], date: str = "date",
           batch: str = "batch") -> DataFrame:
    """One state per day from those of its batches, merged in the order of their names."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    parts = F.array_sort(F.collect_list(F.struct(batch, *measures)))

    def folded(measure: str) -> Column:
        return F.aggregate("_parts", none, lambda acc, part: _pair(acc, part[measure])).alias(measure)

    return states.groupBy(date).agg(parts.alias("_parts"), *[F.sum(c).alias(c) for c in counts]).select(
        date, *map(folded, measures), *counts)


def geo_state(events: DataFrame, date: str = "date") -> DataFrame:
    """Daily state behind the geopolitical table (input as from ``geo_fields``)."""
    g = F.col("goldstein_scalar")
    return events.groupBy(date).agg(
        *[moments(m) for m in GEO_MEASURES], F.count_if(g < K.CONFLICT_BELOW).alias("conflict_events"),
        F.count_if(g > K.COOPERATION_ABOVE).alias("cooperation_events"))


def geo_from_states(states: DataFrame, date: str = "date") -> DataFrame:
    """The geopolitical table of the days of ``states``, equal to that of all their events."""
    g, tone = F.col("goldstein_scalar"), F.col("tone_scalar")
    spread = F.when(g["n"] > 1, F.sqrt(g["m2"] / (g["n"] - 1)))
    return geo_scores(merged(states, GEO_MEASURES, GEO_COUNTS, date).select(
        date, F.when(g["n"] > 0, g["mean"]).alias("mean_goldstein"), spread.alias("std_goldstein"),
        F.when(tone["n"] > 0, tone["mean"]).alias("mean_tone"), *GEO_COUNTS,
        g["n"].alias("total_events")))
