"""Whole-table order without one task for it: range blocks, a state per block, states carried across.

The rows are range-partitioned on the order and written, which fixes the blocks. Each block is folded
to a small state (a last value, a count), the states of all blocks, one row each, are scanned in order,
and what comes before a block is handed to its rows. Work inside a block is an ordinary window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sigtide.session import materialised

BLOCK = "_block"


class Ordered:
    """A table cut into range blocks of ``order``; rows with equal order keys share a block."""

    def __init__(self, df: DataFrame, *order: str, ties: Sequence[str] = ()) -> None:
        """``ties`` order rows of one order key; they do not part them."""
        self.order = [*order, *ties]
        self.rows = materialised(
            df.repartitionByRange(*order).withColumn(BLOCK, F.spark_partition_id()), "order-blocks")

    def _carried(self, states: DataFrame, names: Sequence[str], reverse: bool) -> DataFrame:
        """Per block the last state before it that is not NULL, column by column.

        The states come to the driver: one row per block, so at most the number of shuffle partitions.
        """
        found = sorted(states.collect(), key=lambda r: r[BLOCK], reverse=reverse)
        seen = dict.fromkeys(names)
        out = []
        for r in found:
            out.append((r[BLOCK], *(seen[n] for n in names)))
            seen |= {n: r[n] for n in names if r[n] is not None}
        schema = StructType([StructField(BLOCK, IntegerType()), *(
            StructField(f"_before_{n}", states.schema[n].dataType) for n in names)])
        return states.sparkSession.createDataFrame(out, schema)

    def last(self, values: dict[str, Column], reverse: bool = False, inclusive: bool = True) -> Ordered:
        """Add, per name, the last value that is not NULL up to each row (without it unless
        ``inclusive``); ``reverse`` looks from the other end."""
        rows = self.rows.withColumns({f"_own_{n}": v for n, v in values.items()})
        key = F.struct(*self.order)
        pick = F.min_by if reverse else F.max_by
        states = rows.groupBy(BLOCK).agg(*[
            pick(f"_own_{n}", F.when(F.col(f"_own_{n}").isNotNull(), key)).alias(n) for n in values])
        before = self._carried(states, list(values), reverse)
        spec = Window.partitionBy(BLOCK).orderBy(
            *[F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]).rowsBetween(
            Window.unboundedPreceding, Window.currentRow if inclusive else -1)
        joined = rows.withColumns({
            f"_in_{n}": F.last(f"_own_{n}", ignorenulls=True).over(spec) for n in values}).join(
            F.broadcast(before), BLOCK)
        self.rows = joined.select(*self.rows.columns, *[
            F.coalesce(f"_in_{n}", f"_before_{n}").alias(n) for n in values])
        return self

    def numbered(self, name: str) -> tuple[DataFrame, int]:
        """The table with the place of each row from 0 on, and the number of rows."""
        counts = {r[BLOCK]: r["count"] for r in self.rows.groupBy(BLOCK).count().collect()}
        offsets, total = [], 0
        for block in sorted(counts):
            offsets.append((block, total))
            total += counts[block]
        before = self.rows.sparkSession.createDataFrame(offsets, f"{BLOCK} int, _before long")
        place = F.row_number().over(Window.partitionBy(BLOCK).orderBy(*self.order)) - 1
        return self.rows.withColumn("_in", place).join(F.broadcast(before), BLOCK).withColumn(
            name, F.col("_in") + F.col("_before")).drop(BLOCK, "_in", "_before"), total

    def done(self) -> DataFrame:
        return self.rows.drop(BLOCK)
