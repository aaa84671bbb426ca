"""Duplicate removal."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, DataType, MapType, StructField, StructType, VariantType)

from sigtide.session import materialised


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, MapType | VariantType)


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in ``order``; rows without an order value come last.

    Rows that tie are ordered by all their columns, so the row that stays never depends on how the
    table is read (columns without an order take part as their JSON text). An aggregate, not a
    ``row_number`` window: each map task already reduces its copies to one row, so a key that holds
    a third of the table sends one row per task through the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    ties = [F.col(c) if _orderable(df.schema[c].dataType) else F.to_json(F.struct(c))
            for c in rest if c != order]
    first = F.min_by(F.struct(*rest), F.struct(
        F.col(order).isNull().alias("last"), F.col(order), *[
            t.alias(f"tie{k}") for k, t in enumerate(ties)])).alias("_first")
    return df.groupBy(key).agg(first).select(key, "_first.*").select(*df.columns)


def dedup_existing(new: DataFrame, existing: DataFrame | None, key: str = "id",
                   order: str = "seq") -> DataFrame:
    """Drop rows already stored, then keep the first of each remaining key.

    The batch is reduced first and the stored keys are made distinct with map-side combining, so
    neither side of the anti join carries a hot key.
    """
    unique = first_per_key(new, key, order)
    if existing is None:
        return unique
    return unique.join(existing.select(key).distinct(), key, "left_anti")


def dedup_consecutive(df: DataFrame, key: str, order: Sequence[str],
                      descending: bool = False) -> DataFrame:
    """Drop a row when its key equals the key of the row before it in ``order``.

    ``order`` must be a total order. The rows are range-partitioned on it, the only shuffle, which
    splits even one dominant key or timestamp because the tiebreak column takes part. Each block is
    sorted and compared as it streams by, a batch at a time, so a block is never held whole. Rows
    that differ, and the two ends of each block, are stored in the shared folder, which fixes the
    blocks when a task is rerun; first rows are then compared with the end of the block before, a
    table of one row per block.
    """
    sort = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    names = [*df.columns, "_prev", "_head", "_tail"]
    kind = df.schema[key].dataType
    schema = StructType([*df.schema.fields, StructField("_prev", kind),
                         StructField("_head", BooleanType()), StructField("_tail", BooleanType())])

    def previous(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with the key before it in the block, and marks on the block's two ends."""
        def marked(batch: pa.RecordBatch, before: pa.Array | None, tail: bool) -> pa.RecordBatch:
            own, n = batch.column(key), batch.num_rows
            first = pa.nulls(1, own.type) if before is None else before
            return pa.RecordBatch.from_arrays(
                [*batch.columns, pa.concat_arrays([first, own.slice(0, n - 1)]),
                 pa.array([before is None, *[False] * (n - 1)]),
                 pa.array([*[False] * (n - 1), tail])], names)

        held, before = None, None
        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield marked(held, before, False)
                    before = held.column(key).slice(held.num_rows - 1, 1)
                held = batch
        if held is not None:
            yield marked(held, before, True)

    differs = ~F.col("_prev").eqNullSafe(F.col(key))
    rows = materialised(
        df.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(previous, schema)
        .withColumn("_block", F.spark_partition_id())
        .where(F.col("_head") | F.col("_tail") | differs), "blocks")
    ends = rows.where("_tail").select("_block", F.lag(F.struct(key)).over(
        Window.orderBy("_block")).alias("_carry"))
    return (
        rows.join(F.broadcast(ends), "_block")
        .where(F.when(F.col("_head"), ~F.col("_carry").eqNullSafe(F.struct(key))).otherwise(differs))
        .select(*df.columns))
