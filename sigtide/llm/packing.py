"""Cost-balanced packing of token streams into sequences of fixed capacity.

Every task packs the documents it reads, ``window`` open ends at a time, so nothing is shuffled and
memory does not depend on the input. A document is tokenised whole and closed by the id 0. Full
sequences are cut off its front; the rest is one open piece. The open pieces of a window are placed
in order of falling cost ``linear * n + quadratic * n * n`` (attention inside a piece), each into
the sequence of lowest cost among those with room for it; only when none has, the piece is cut to
fill the cheapest with any room. A window opens no more sequences than its tokens need, so only
its last tokens are padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sigtide.llm import pretoken
from sigtide.llm.arrow import BATCH_ROWS, extended, map_arrow

CAPACITY = 1024
WINDOW = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
END = 0


def place(sizes: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR,
          quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) that place items of at most ``capacity`` tokens.

    Uses ceil(sum / capacity) sequences. Ties in cost go to the lower item and sequence number.
    """
    cost = linear * np.arange(capacity + 1) + quadratic * np.arange(capacity + 1.0) ** 2
    count = -(-int(sizes.sum()) // capacity)
    spent, room = np.zeros(count), np.full(count, capacity, np.int64)
    out = []
    for item in np.argsort(-sizes, kind="stable").tolist():
        start, left = 0, int(sizes[item])
        while left:
            fits = np.where(room >= left, spent, np.inf)
            k = int(fits.argmin())
            if fits[k] == np.inf:  # no sequence has room for all of it
                k = int(np.where(room > 0, spent, np.inf).argmin())
            take = min(left, int(room[k]))
            out.append((item, start, take, k, capacity - int(room[k])))
            room[k] -= take
            spent[k] += cost[take]
            start, left = start + take, left - take
    return out


_PIECE = {"start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long",
          "sequence_id": "long", "offset": "long"}


def pack(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
         capacity: int = CAPACITY, window: int = WINDOW, linear: float = LINEAR,
         quadratic: float = QUADRATIC, with_ids: bool = False) -> DataFrame:
    """One row per piece: the columns ``keep``, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, on request, the ids themselves.

    NULL and empty texts are documents of the closing id alone. Every row is packed, repeated rows
    each for themselves. A sequence id holds the task in its upper bits, so it is unique without a
    global count, and a lost task packs its rows alike when it is run again. Names in ``keep`` that
    clash with the piece columns raise; columns not kept are not read. Empty tables give no rows.
    """
    frame = docs.select(*keep, docs[text].alias("_text"))
    schema = extended(docs.select(*keep).schema,
                      _PIECE | ({"ids": "array<int>"} if with_ids else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pretoken.encoder(path)
        base = TaskContext.get().partitionId() << 33
        sequence = 0
        kept: list[pa.RecordBatch] = []
        tokens: list[np.ndarray] = []

        def sliced(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            return (rows.slice(k, BATCH_ROWS) for k in range(0, rows.num_rows, BATCH_ROWS))

        def flush() -> pa.RecordBatch:
            nonlocal sequence, kept, tokens
            size = np.array([len(t) for t in tokens], np.int64)
            full, rest = size // capacity, size % capacity
            # full sequences first: (document, start, length, sequence, offset)
            doc = np.repeat(np.arange(len(size)), full)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
            rows = np.stack([doc, nth * capacity, np.full(len(doc), capacity),
                             sequence + np.arange(len(doc)), np.zeros(len(doc), np.int64)], 1)
            sequence += len(doc)
            tail = np.flatnonzero(rest)
            placed = np.array(place(rest[tail], capacity, linear, quadratic), np.int64).reshape(-1, 5)
            placed[:, 0] = tail[placed[:, 0]]
            placed[:, 1] += (full * capacity)[placed[:, 0]]
            placed[:, 3] += sequence
            sequence += -(-int(rest.sum()) // capacity)
            rows = np.concatenate([rows, placed])
            parts = [tokens[d][s:s + n] for d, s, n in rows[:, :3].tolist()]
            crc = np.fromiter((zlib.crc32(p) for p in parts), np.int64, len(parts))
            columns = [*pa.Table.from_batches(kept).combine_chunks().take(
                pa.array(rows[:, 0])).columns, *map(pa.array, (
                    rows[:, 1], rows[:, 2], crc, size[rows[:, 0]], rows[:, 3] + base, rows[:, 4]))]
            names = [*keep, *_PIECE]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(rows[:, 2])]).astype(np.int32)
                flat = np.concatenate(parts).view(np.int32) if parts else np.zeros(0, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                names.append("ids")
            kept, tokens = [], []
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            return pa.RecordBatch.from_arrays(columns, names)

        held = 0
        for batch in batches:
            texts = batch.column("_text").fill_null("").to_pylist()
            other = batch.drop_columns(["_text"])
            for i, j in pretoken.chunks(texts):
                while i < j:
                    n = min(j - i, window - len(tokens))
                    ids, offsets = known.ids_of(texts[i:i + n])
                    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                        one = np.zeros(b - a + 1, "<u4")
                        one[:-1] = ids[a:b]
                        one[-1] = END
                        tokens.append(one)
                    held += len(ids)
                    kept.append(other.slice(i, n))
                    i += n
                    if len(tokens) >= window or held >= window * capacity:
                        yield from sliced(flush())
                        held = 0
        if tokens:
            yield from sliced(flush())

    return map_arrow(frame, run, schema)
