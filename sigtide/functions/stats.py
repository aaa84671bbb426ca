"""Rank statistics as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

_NODES = 96  # of the quadrature behind p-values


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression once and use it several times inside a higher-order function."""
    return F.transform(F.array(value), body).getItem(0)


def avg_rank(value: Column | str, *partition: Column | str) -> Column:
    """Rank with ties sharing the mean of their positions, over the given partition."""
    spec = Window.partitionBy(*partition).orderBy(value)
    peers = spec.rangeBetween(Window.currentRow, Window.currentRow)
    return F.rank().over(spec) + (F.count(F.lit(1)).over(peers) - 1) / 2.0


def rank_correlation_sums(n: Column, xy: Column, xx: Column, yy: Column) -> Column:
    """Pearson correlation of ranks 1..n from their product sums; NULL for constant input.

    Rank sums are fixed by n, so no means are needed, and all terms are exact in doubles. The
    built-in ``corr`` is avoided: it raises on a constant column in ANSI mode.
    """
    centre = n * (n + 1.0) * (n + 1.0) / 4.0
    return F.try_divide(xy - centre, F.sqrt((xx - centre) * (yy - centre)))


def spearman_kernel() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Row-wise Spearman correlation of two equally shaped matrices; NaN marks missing values.

    Comparing a row with itself gives the ranks (ties averaged) without a sort. Constant rows give
    NaN. The kernel is a closure, so it travels to the workers by value and they need no copy of
    this package.
    """
    def midranks(values: np.ndarray, gone: np.ndarray) -> np.ndarray:
        v = np.where(gone, np.nan, values)
        below = (v[:, None, :] < v[:, :, None]).sum(axis=2)
        same = (v[:, None, :] == v[:, :, None]).sum(axis=2)
        return np.where(gone, 0.0, below + (same + 1) / 2.0)

    def spearman(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        missing = np.isnan(x) | np.isnan(y)
        out = np.empty(len(x))
        for start in range(0, len(x), 512):  # bounds the m x w x w comparison to a few MB
            part = slice(start, start + 512)
            a, b = midranks(x[part], missing[part]), midranks(y[part], missing[part])
            n = (~missing[part]).sum(axis=1)
            centre = n * (n + 1.0) * (n + 1.0) / 4.0
            scale = ((a * a).sum(axis=1) - centre) * ((b * b).sum(axis=1) - centre)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[part] = ((a * b).sum(axis=1) - centre) / np.sqrt(scale)
        return out

    return spearman


def window_spearman(x: Column | str, y: Column | str) -> Column:
    """Rank correlation of two array columns of one fixed length; a NULL array gives NULL.

    A column expression for this costs quadratic interpreted comparisons per window, and exploding
    costs a copy of every row per window. Arrow batches and one matrix comparison avoid both.
    """
    spearman = spearman_kernel()

    def correlate(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=xs.index)
        full = xs.notna()
        if full.any():
            out[full] = spearman(np.stack(xs[full].to_list()), np.stack(ys[full].to_list()))
        return out

    rho = F.pandas_udf(correlate, "double")(x, y)
    return F.when(~F.isnan(rho), rho)


def t_two_sided_p(rho: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation, t distribution with v = n - 2 degrees of freedom.

    The tail and the half line are integrated by one Gauss rule of ``_NODES`` points after mapping
    t = t0 + z / (1 - z); the integrand (1 + t*t/v) ** (-(v + 1) / 2) is smooth for every v, so the
    same steps serve any number of observations. Their ratio is the p-value.
    """
    v = (n - 2).cast("double")
    sine = F.least(F.abs(rho), F.lit(1.0))
    t = F.try_divide(sine * F.sqrt(v), F.sqrt(1.0 - sine * sine))
    at, weight = np.polynomial.legendre.leggauss(_NODES)
    z = (at + 1) / 2
    rule = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w"))
                     for x, w in zip(z / (1 - z), weight / (1 - z) ** 2, strict=True)])

    def beyond(start: Column) -> Column:
        return F.aggregate(rule, F.lit(0.0), lambda acc, k: acc + k["w"] * F.exp(
            -(v + 1.0) / 2.0 * F.log1p((start + k["x"]) * (start + k["x"]) / v)))

    p = F.when(sine >= 1.0, F.lit(0.0)).otherwise(beyond(t) / beyond(F.lit(0.0)))
    return F.when(v >= 1, p)


def calendar_window(order: str, *by: str) -> WindowSpec:
    """Window over a table that holds at most one row per key and day.

    Such a table is bounded by the calendar (about 250 rows a year and key, whatever the size of
    the raw data), so ordering one key in one task is safe. Raw records are never windowed like
    this; they are aggregated to days first.
    """
    return Window.partitionBy(*by).orderBy(order)
