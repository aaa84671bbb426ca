"""Arrow tasks of bounded memory, and schemas of frames with added columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def extended(schema: StructType, columns: dict[str, str], prefix: str = "") -> StructType:
    """A copy of ``schema`` with named columns at the end; a name that exists already raises."""
    if clash := {prefix + c for c in columns} & set(schema.names):
        raise ValueError(f"columns {sorted(clash)} exist already, choose a prefix")
    return StructType([*schema.fields, *(
        StructField(prefix + c, _parse_datatype_string(kind)) for c, kind in columns.items())])


BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def release() -> None:
    """Give freed memory back to the system, where the C library can: an idle worker keeps little."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: StructType | str) -> DataFrame:
    """``mapInArrow`` for columns of whole texts.

    Batches hold at most ``BATCH_ROWS`` rows (a session setting, lowered here if it is higher), as a
    batch of texts is held by the executor and by its Python worker at once. Workers are reused, so
    Arrow's memory is given back to the system instead of being pooled, and so is what a task freed.
    """
    conf = frame.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_CONF, "10000")) <= BATCH_ROWS:
        conf.set(_BATCH_CONF, str(BATCH_ROWS))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            release()

    return frame.mapInArrow(task, schema)
