"""Daily time-series operators.

They work on tables that hold one row per key and day (see ``stats.calendar_window``); callers
aggregate raw records to days first. A key's history is then bounded by the calendar, whatever
share of the raw rows it has. Without a key the order is that of the whole table: it is cut into range
blocks and values are carried from block to block (``carry.Ordered``), so no task holds it all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtide.functions.stats import calendar_window
from sigtide.operators.carry import Ordered


def forward_fill(df: DataFrame, cols: Sequence[str], order: str = "date",
                 by: Sequence[str] = ()) -> DataFrame:
    """Replace NULLs by the last earlier value, column by column."""
    if not by:
        filled = Ordered(df, order).last({f"_last_{c}": F.col(c) for c in cols}).done()
        return filled.select(*[F.col(f"_last_{c}").alias(c) if c in cols else c for c in df.columns])
    spec = calendar_window(order, *by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(spec) for c in cols})


def resample_daily_linear(df: DataFrame, date: str = "date", value: str = "value",
                          by: Sequence[str] = ()) -> DataFrame:
    """Daily series between the first and the last known day, linear in days across gaps.

    Each known point expands to the days up to the next one, so no spine join is needed.
    """
    known = df.where(F.col(value).isNotNull()).select(
        *by, F.col(date).alias("_d0"), F.col(value).cast("double").alias("_v0"))
    if by:
        spec = calendar_window("_d0", *by)
        known = known.withColumns({"_d1": F.lead("_d0").over(spec), "_v1": F.lead("_v0").over(spec)})
    else:
        known = Ordered(known, "_d0").last(
            {"_d1": F.col("_d0"), "_v1": F.col("_v0")}, reverse=True, inclusive=False).done()
    until = F.coalesce(F.date_sub("_d1", 1), F.col("_d0"))
    days = known.withColumn(date, F.explode(F.sequence("_d0", until)))
    gap = F.datediff("_d1", "_d0").cast("double")
    step = F.datediff(F.col(date), F.col("_d0")).cast("double")
    line = F.when(step == 0, F.col("_v0")).otherwise(
        F.col("_v0") + (F.col("_v1") - F.col("_v0")) * step / gap)
    return days.select(*by, date, line.alias(value))


def _matched(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], unique_left: bool,
             ahead: bool) -> DataFrame:
    """Attach to ``left`` the last right row up to each (by, on); with ``ahead`` the closer one of
    that and the first one from there on, a tie going to the later.

    Only the distinct left keys are ordered together with the right rows, so a repetitive left
    table is not dragged through the order. When left keys are unique anyway, the left rows go
    along themselves, which saves reading them twice and joining back. The look ahead is a running
    value in reverse order: a frame that ends at the last row would be evaluated anew for every row.
    """
    extra = [c for c in right.columns if c not in (on, *by)]
    rest = [c for c in left.columns if c not in (on, *by)]
    own = F.struct(*rest) if rest else F.lit(None).cast("string")
    keys = (left.select(*by, on, own.alias("_own")) if unique_left
            else left.select(*by, on).distinct()).withColumn("_left", F.lit(True))
    rows = right.select(*by, on, F.struct(F.col(on).alias("_on"), *extra).alias("_row"),
                        F.lit(False).alias("_left"))
    both = rows.unionByName(keys, allowMissingColumns=True)
    if by:
        def seen(order: Column) -> Column:
            return F.last("_row", ignorenulls=True).over(Window.partitionBy(*by).orderBy(
                order, "_left").rowsBetween(Window.unboundedPreceding, Window.currentRow))

        found = both.withColumn("_back", seen(F.col(on).asc()))
        if ahead:
            found = found.withColumn("_ahead", seen(F.col(on).desc()))
    else:
        ordered = Ordered(both, on, ties=["_left"]).last({"_back": F.col("_row")})
        if ahead:
            # right rows of the day itself are found looking back
            ordered = ordered.last({"_ahead": F.col("_row")}, reverse=True)
        found = ordered.done()
    pick = F.col("_back")
    if ahead:
        before, after = F.datediff(F.col(on), "_back._on"), F.datediff("_ahead._on", F.col(on))
        pick = F.when(F.col("_ahead").isNull() | (before < after) | (before == 0), pick).otherwise(
            F.col("_ahead"))
    found = found.withColumn("_hit", pick).where("_left")
    hits = [F.col("_hit")[c].alias(c) for c in extra]
    if unique_left:
        return found.select(
            *by, on, *[F.col("_own")[c].alias(c) for c in rest], *hits)
    return left.join(found.select(*by, on, *hits), [*by, on], "left")


def asof_join(left: DataFrame, right: DataFrame, on: str = "date", by: Sequence[str] = (),
              unique_left: bool = False) -> DataFrame:
    """Last right row at or before each left date, per key; NULLs when there is none.

    ``right`` holds one row per key and date.
    """
    return _matched(left, right, on, by, unique_left, ahead=False)


def nearest_join(left: DataFrame, right: DataFrame, on: str = "date", by: Sequence[str] = (),
                 unique_left: bool = False) -> DataFrame:
    """Right row with the closest date; a tie goes to the later one."""
    return _matched(left, right, on, by, unique_left, ahead=True)


def align_signals(returns: DataFrame, signals: DataFrame, mode: str = "exact_ffill",
                  date: str = "date") -> DataFrame:
    """Put daily signals on the market dates of a long returns table.

    ``exact_ffill``: a signal counts only if its date is a market date, then every column is
    carried forward on its own; a weekend signal is lost. ``asof``: the last signal at or before
    the market date, whatever day it came.
    """
    if mode == "asof":
        return asof_join(returns, signals, date)
    if mode != "exact_ffill":
        raise ValueError(f"unknown mode {mode!r}")
    cols = [c for c in signals.columns if c != date]
    spine = returns.select(date).distinct().join(signals, date, "left")
    return returns.join(forward_fill(spine, cols, date), date, "left")


def pct_change(df: DataFrame, col: str, order: str = "date", by: Sequence[str] = (),
               out: str = "ret") -> DataFrame:
    """Change against the row before; NULL on the first row."""
    prev = F.lag(col).over(calendar_window(order, *by))
    return df.withColumn(out, F.try_divide(F.col(col), prev) - 1.0)


def first_difference(df: DataFrame, col: str, order: str = "date", by: Sequence[str] = (),
                     out: str = "diff") -> DataFrame:
    """Difference to the row before; 0 on the first row."""
    prev = F.lag(col).over(calendar_window(order, *by))
    return df.withColumn(out, F.coalesce(F.col(col) - prev, F.lit(0.0)))


def forward_returns(prices: DataFrame, horizons: Sequence[int] = (1, 5, 10), date: str = "date",
                    by: Sequence[str] = ("ticker",), close: str = "close") -> DataFrame:
    """Return over the next h rows for each horizon; NULL at the end of a series."""
    spec = calendar_window(date, *by)
    return prices.withColumns({
        f"fwd_{h}d": F.try_divide(F.lead(close, h).over(spec), F.col(close)) - 1.0
        for h in horizons})


def tail_n(df: DataFrame, n: int, order: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """Last ``n`` rows, per key when ``by`` is given.

    The filtered row number becomes a per-task group limit before the shuffle, so a hot key sends
    at most ``n`` rows per task.
    """
    if not by:
        return df.orderBy(F.col(order).desc()).limit(n)
    spec = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(spec)).where(F.col("_rn") <= n).drop("_rn")


