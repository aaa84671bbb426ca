"""Vectorised word kernels over Arrow string columns.

A word is a maximal run of ASCII letters, digits and bytes above 0x7F. All work is numpy on the
UTF-8 bytes of a slice of whole texts (about ``SLICE`` bytes, or one longer text), so no Python
runs per word. Memory is about 60 bytes per byte of the slice. NULL texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
SHINGLE = 5

_U = np.uint64
# odd, so that powers have inverses modulo 2**64
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _lower_words() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(256):
        if 65 <= b <= 90:
            table[b] = b + 32
        elif 48 <= b <= 57 or 97 <= b <= 122 or b >= 128:
            table[b] = b
    return table


LOWER_WORDS = _lower_words()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n, base & _MASK, _U)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=_U)


class _Powers:
    """Grown on demand, one per worker."""

    def __init__(self) -> None:
        self.up = self.down = powers(0)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = powers(n), powers(n, _BASE_INV)
        return self.up, self.down


_POWERS = _Powers()


def span_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:stop] for every span, equal for equal content."""
    up, down = _POWERS.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum((values.astype(_U) + _U(1)) * up[:len(values)], out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(_U))


@dataclass
class Words:
    """Words of a slice: byte spans, hashes, the document of each word, first word per document."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # length n_docs + 1

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string array, NULL as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    n = len(texts)
    if not n or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[
        texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``size`` bytes, or one longer text."""
    _, offsets = utf8(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def find_words(texts: pa.Array, table: np.ndarray = LOWER_WORDS) -> Words:
    """Words of whole texts; ``table`` maps bytes to kept values, 0 separates."""
    data, offsets = utf8(texts)
    low = table[data]
    inside = low != 0
    begin = np.zeros(len(low) + 1, bool)
    begin[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | begin[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | begin[1:-1]
    start = np.flatnonzero(opens)
    stop = np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, stop, span_hashes(low, start, stop), doc, first)


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hash of every ``width`` consecutive word hashes (documents not checked)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for k, p in enumerate(powers(width + 1)[1:]):
        out += hashes[k:k + n] * p
    return mix(out + _U(width))


def shingles(words: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle, in order; 1 to width - 1 words make one shingle."""
    hashes = runs(words.hashes, width)
    whole = words.doc[:len(hashes)] == words.doc[width - 1:width - 1 + len(hashes)]
    docs, hashes = words.doc[:len(whole)][whole], hashes[whole]
    few = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(few):
        own = [runs(words.hashes[words.first[d]:words.first[d + 1]], int(words.counts[d]))
               for d in few]
        docs, hashes = np.concatenate([docs, few]), np.concatenate([hashes, *own])
        order = np.argsort(docs, kind="stable")
        docs, hashes = docs[order], hashes[order]
    return docs, hashes
