"""Vectorised pre-tokens of a byte-level BPE vocabulary, with hash tables of their token ids.

A slice of texts becomes one array of code points; the pre-tokens of the vocabulary's pattern
(contractions, letter / number / other runs with one leading space, white space) are found by
comparing neighbouring character classes. Each distinct pre-token is encoded once per worker by
the tokenizer library and looked up by a 64-bit hash afterwards. Texts that hold an added token's
string or a code point this Python does not know are encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import cache

import numpy as np

from sigtide.llm.words import span_hashes

SLICE_CHARS = 1 << 19
CACHE_SLOTS = 1 << 21  # a worker's table is emptied when half full
LIBRARY_PIECES = 1024  # pieces in one call of the library, whose results are larger than their ids

_OTHER, _LETTER, _NUMBER, _SPACE, _END, _UNKNOWN = range(6)
# fixed values: the code points with the property White_Space
_WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
          0x205F, 0x3000)
# fixed values: the suffixes the pattern splits off after an apostrophe
_ONE, _TWO = "stmd", ("re", "ve", "ll")


@cache
def _classes() -> np.ndarray:
    of = {"L": _LETTER, "N": _NUMBER}
    table = np.empty(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        table[c] = _UNKNOWN if kind in ("Cn", "Cs") else of.get(kind[0], _OTHER)
    table[list(_WHITE)] = _SPACE
    return table


class HashTable:
    """Open addressing from 64-bit hashes to small integers, all operations on arrays."""

    def __init__(self, slots: int) -> None:
        self.mask = np.uint64(slots - 1)
        self.keys = np.zeros(slots, np.uint64)
        self.values = np.zeros(slots, np.int32)
        self.used = 0

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """Value per hash, -1 where absent."""
        slot = (hashes & self.mask).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == hashes, self.values[slot], -1)
        open_ = np.flatnonzero((key != hashes) & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            key = self.keys[slot[open_]]
            hit = key == hashes[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Add distinct absent hashes."""
        self.used += len(hashes)
        slot = (hashes & self.mask).astype(np.int64)
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]
            won = self.keys[slot] == hashes
            self.values[slot[won]] = values[won]
            hashes, values, slot = hashes[~won], values[~won], (slot[~won] + 1) & int(self.mask)


def split(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined text; start, stop and hash of every pre-token; first pre-token per text (n + 1);
    which texts hold code points of unknown class."""
    joined = "\0".join(texts) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind = _classes()[code]
    kind[ends] = _END
    begin = np.empty(len(kind), bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    begin &= kind != _END
    after = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _END)) + 1
    begin[after - 1] = True
    begin[after] = code[after - 1] != 32
    quote = np.flatnonzero((code[:-1] == 39) & begin[:-1] & (kind[1:] == _LETTER))
    for p in quote.tolist():
        size = 2 if joined[p + 1] in _ONE else 3 if joined[p + 1:p + 3] in _TWO else 0
        if size:
            begin[p + 1] = False
            begin[p + size] |= kind[p + size] == _LETTER
    bounds = np.flatnonzero(begin | (kind == _END))
    is_start = begin[bounds]
    start = bounds[is_start]
    stop = bounds[1:][is_start[:-1]]
    first = np.concatenate([[0], np.searchsorted(start, ends)])
    unknown = np.add.reduceat(kind == _UNKNOWN, np.concatenate([[0], ends[:-1] + 1])) > 0
    hashes = span_hashes(code, start, stop)
    hashes[hashes == 0] = 1
    return joined, start, stop, hashes, first, unknown


class Encoder:
    """One per worker and vocabulary: token ids of whole texts through a bounded cache."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        # a task has one core: threads of the library would take those of other tasks, and memory each
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f)["added_tokens"]]
        self._clear()

    def _clear(self, slots: int = CACHE_SLOTS) -> None:
        self.table = HashTable(slots)
        self.size = np.zeros(1024, np.int32)
        self.at = np.zeros(1024, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.n = self.n_ids = 0

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pre-tokens or whole texts, by the library."""
        return [e.ids for i in range(0, len(pieces), LIBRARY_PIECES)
                for e in self.tokenizer.encode_batch_fast(pieces[i:i + LIBRARY_PIECES],
                                                          add_special_tokens=False)]

    def _learn(self, joined, start, stop, hashes) -> None:
        got = self.encode_pieces([joined[a:b] for a, b in zip(start.tolist(), stop.tolist(),
                                                             strict=True)])
        size = np.fromiter(map(len, got), np.int32, len(got))
        flat = np.fromiter((i for g in got for i in g), np.uint32, int(size.sum()))
        self.size = _room(self.size, self.n, len(got))
        self.at = _room(self.at, self.n, len(got))
        self.ids = _room(self.ids, self.n_ids, len(flat))
        self.size[self.n:self.n + len(got)] = size
        self.at[self.n:self.n + len(got)] = self.n_ids + np.cumsum(size) - size
        self.ids[self.n_ids:self.n_ids + len(flat)] = flat
        self.table.put(hashes, np.arange(self.n, self.n + len(got), dtype=np.int32))
        self.n, self.n_ids = self.n + len(got), self.n_ids + len(flat)

    def entries(self, joined, start, stop, hashes) -> np.ndarray:
        """Index into ``size`` and ``at`` per pre-token; unseen ones are encoded now."""
        found = self.table.get(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            if self.table.used + len(new) > len(self.table.keys) // 2:
                fit = len(new) <= CACHE_SLOTS // 4
                # one very long text may need more slots than the cache has
                self._clear(CACHE_SLOTS if fit else 1 << (4 * len(new)).bit_length())
                return self.entries(joined, start, stop, hashes)
            at = missing[at]
            self._learn(joined, start[at], stop[at], new)
            found[missing] = self.table.get(hashes[missing])
        return found

    def whole(self, texts: list[str], unknown: np.ndarray) -> np.ndarray:
        """Texts the library must encode as a whole."""
        return np.flatnonzero(unknown | np.array(
            [any(a in t for a in self.added) for t in texts], bool))

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and n + 1 offsets."""
        joined, start, stop, hashes, first, unknown = split(texts)
        entry = self.entries(joined, start, stop, hashes)
        size = self.size[entry].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.repeat(self.at[entry] - (ends - size), size) + np.arange(total)]
        offsets = np.concatenate([[0], ends])[first]
        whole = self.whole(texts, unknown)
        if not len(whole):
            return flat, offsets
        own = dict(zip(whole.tolist(), self.encode_pieces([texts[i] for i in whole]), strict=True))
        parts = [np.array(own[i], np.uint32) if i in own else flat[offsets[i]:offsets[i + 1]]
                 for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _room(a: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(a):
        return a
    out = np.zeros(max(2 * len(a), used + more), a.dtype)
    out[:used] = a[:used]
    return out


@cache
def encoder(path: str) -> Encoder:
    """The worker's encoder."""
    return Encoder(path)


def chunks(texts: list[str], size: int = SLICE_CHARS):
    """Row ranges of about ``size`` characters, or one longer text."""
    i = total = 0
    for j, t in enumerate(texts):
        if total and total + len(t) > size:
            yield i, j
            i, total = j, 0
        total += len(t)
    if i < len(texts):
        yield i, len(texts)
