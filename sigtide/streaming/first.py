"""First record per id from a stream, whole; repeated and late records kept beside it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
SPREAD = 1024  # groups that rows without an id are spread over


class FirstRecord(StatefulProcessor):
    """State per id: the time of the record that was kept. Rows of a group are seen one at a time."""

    def __init__(self, columns: list[str], key: str, ttl_ms: int | None) -> None:
        self.columns, self.key, self.ttl_ms = columns, key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "micros bigint", self.ttl_ms)

    def _row(self, row: Row, status: str) -> Row:
        return Row(*self.columns, "status")(*[row[c] for c in self.columns], status)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        stored = self.kept.get() if self.kept.exists() else None
        best, best_order = None, None
        for row in rows:
            at = row["_micros"]
            if row[self.key] is None:
                yield self._row(row, "unkeyed")
            elif stored is not None:
                late = at is not None and (stored[0] is None or at < stored[0])
                yield self._row(row, "late" if late else "repeat")
            else:
                order = (at is None, at or 0, row["_tie"])
                if best is None or order < best_order:
                    row, best, best_order = best, row, order
                if row is not None:
                    yield self._row(row, "repeat")
        if best is not None:
            self.kept.update((best["_micros"],))
            yield self._row(best, "first")

    def close(self) -> None:
        pass


def first_records(records: DataFrame, key: str = "id", timestamp: str = "timestamp",
                  ttl: float | None = None) -> DataFrame:
    """Every record of a stream with a ``status``; no record is dropped.

    ``first``: nothing with its id came in an earlier batch, and in its own batch it is the first by
    time, then by its JSON text (records without a time come last). ``late``: its id was kept in an
    earlier batch, yet with a later time, or none. ``repeat``: any other copy. ``unkeyed``: no id; such
    rows need no state and are spread over many groups.

    A value per id is kept in RocksDB, for ``ttl`` seconds after it was written or, without it, for
    good; an id that was forgotten is first again. The rows of a group stream by, so a hot id costs
    time in one task but no memory. Columns keep their names and types.
    """
    columns, fields = records.columns, records.schema.fields
    spread = F.pmod(F.xxhash64("_tie"), F.lit(SPREAD))
    keyed = records.withColumns({
        "_micros": F.unix_micros(F.col(timestamp).cast("timestamp")),
        "_tie": F.to_json(F.struct(*columns))}).withColumn(
        "_spread", F.when(F.col(key).isNull(), spread).otherwise(F.lit(0)))
    # times pass Python as numbers, apart from any time zone
    times = [f.name for f in fields if isinstance(f.dataType, TimestampType)]
    plain = keyed.withColumns({c: F.unix_micros(c) for c in times}) if times else keyed
    schema = StructType([StructField(f.name, plain.schema[f.name].dataType) for f in fields]
                        + [StructField("status", StringType())])
    out = plain.withColumn("_key", F.col(key)).groupBy("_key", "_spread").transformWithState(
        FirstRecord(columns, key, None if ttl is None else int(ttl * 1000)), schema, "Update",
        "None" if ttl is None else "ProcessingTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in times}) if times else out


def run_first_records(records: DataFrame, path: str, checkpoint: str, key: str = "id",
                      timestamp: str = "timestamp", ttl: float | None = None, source: str = "live",
                      **trigger) -> StreamingQuery:
    """Write ``first_records`` to a table by ``batch`` and ``status``: the firsts and, beside them, the rest.

    Reading ``status = 'first'`` opens the deduplicated records only. A batch that is replayed after a
    failure replaces what it wrote. State needs RocksDB, and a run that ends with its input no batches
    without data (a state with ``ttl`` asks for them without end); both settings are the query's own,
    the session keeps its values.
    """
    spark = records.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.write.mode("overwrite").option("partitionOverwriteMode", "static")
            .partitionBy("status").parquet(f"{path}/batch={source}-{batch_id}"))

    own = {STORE: ROCKSDB, EMPTY_BATCHES: "false"}
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:  # a query takes a copy of the settings when it starts
        return (first_records(records, key, timestamp, ttl).writeStream.outputMode("update")
                .foreachBatch(write).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
