"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and how widely each
pair of their ids is linked.

Two tokens of one text are linked where their byte ranges overlap. The index over the corpus is
inverted: per (id pair, chunk of rows) one posting holds the rows of the chunk that link the pair,
as 16-bit positions or, where shorter, as a bitmap; rows linked more than once are told by
multiplicity planes, bit k of the number of links in bitmap k over the posting's rows. A chunk is a
run of rows of one task, at most ``CHUNK_ROWS`` rows (or one Arrow batch) and about ``CHUNK_LINKS`` links, so postings of a
pair over all chunks are disjoint: OR-merging them adds their popcounts. Scores of a pair go back
through its postings to the rows. A pair that every row holds has one posting a chunk, never a list
in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sigtide.llm import pretoken
from sigtide.llm.arrow import map_arrow
from sigtide.llm.words import utf8
from sigtide.session import materialised

CHUNK_ROWS = 60_000  # positions are 16-bit
CHUNK_LINKS = 1 << 21
LONG_TEXT = 1 << 16  # characters a piece model encodes at once

_POSTING = "chunk long, pair long, n int, rows binary, planes binary"
_DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class Pieces:
    """Ragged byte strings of small ids, gathered in one step."""

    def __init__(self, parts: list[bytes]) -> None:
        self.size = np.array([len(p) for p in parts], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated bytes of the ids, and the end of each."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.repeat(self.at[ids] - (ends - size), size) + np.arange(total)], ends


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteLevel:
    """Tokens of a byte-level BPE file; strings of special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        self.encoder = pretoken.Encoder(path)
        self.encoder.tokenizer.encode_special_tokens = True
        known = _byte_of_char()
        parts = [b""] * self.encoder.tokenizer.get_vocab_size()
        for token, i in self.encoder.tokenizer.get_vocab().items():
            parts[i] = bytes(known[c] for c in token) if all(c in known for c in token) else token.encode()
        self.bytes = Pieces(parts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, offsets = self.encoder.ids_of([" " + t for t in texts])
        return ids.astype(np.int64), offsets


class PieceModel:
    """Tokens of a sentencepiece file that puts a space before a text itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = Pieces([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(
            "\u2581", " ").encode() for i, p in enumerate(names)])
        # no piece spans the place where a word ends and a space begins: such texts can be cut there
        self.by_words = not any("\u2581" in p.lstrip("\u2581") for p in names)

    def _parts(self, text: str) -> list[str]:
        out, start = [], 0
        while self.by_words and len(text) - start > LONG_TEXT:
            cut = text.find(" ", start + LONG_TEXT)
            while 0 <= cut < len(text) - 1 and " " in (text[cut - 1], text[cut + 1]):
                cut = text.find(" ", cut + 1)
            if not 0 <= cut < len(text) - 1:
                break
            out.append(text[start:cut])  # the model gives the next part its space back
            start = cut + 1
        return [*out, text[start:]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, of = [], []
        for t in texts:
            cut = self._parts(t)
            parts += cut
            of.append(len(cut))
        ids = self.model.encode(parts, num_threads=1)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(size.sum()))
        return flat, np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(of)])]


@cache
def _tokenizer(path: str) -> ByteLevel | PieceModel:
    return ByteLevel(path) if path.endswith(".json") else PieceModel(path)


@cache
def _numbers(path: str) -> Pieces:
    """Decimal ids, each with one byte of room for the separator behind it."""
    return Pieces([b"%d," % i for i in range(len(_tokenizer(path).bytes.size))])


def _drop(ids: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the kept texts only; the others have none."""
    size = np.where(keep, np.diff(offsets), 0)
    return ids[np.repeat(keep, np.diff(offsets))], np.concatenate([[0], np.cumsum(size)])


def _spelled(pieces: Pieces, ids: np.ndarray, offsets: np.ndarray, want: np.ndarray,
             want_at: np.ndarray) -> np.ndarray:
    """Which texts the tokens spell exactly."""
    data, ends = pieces.join(ids)
    at = np.concatenate([[0], ends])[offsets]
    same = np.diff(at) == np.diff(want_at)
    if not same.all():
        # other lengths shift all that follows: compare those of equal length only
        data = data[np.repeat(same, np.diff(at))]
        want = want[np.repeat(same, np.diff(want_at))]
    bad = np.concatenate([[0], np.cumsum(data != want)])
    size = np.where(same, np.diff(want_at), 0)
    stop = np.cumsum(size)
    return same & (bad[stop] == bad[stop - size])


class Aligned:
    """Token ids of both vocabularies for a slice of texts, cut where both end."""

    def __init__(self, texts: list[str], path_a: str, path_b: str) -> None:
        a, b = _tokenizer(path_a), _tokenizer(path_b)
        some = np.array([bool(t) for t in texts])
        want, want_at = utf8(pa.array([" " + t for t in texts], pa.large_string()))
        ids_a, off_a = a.encode(texts)
        ids_b, off_b = b.encode(texts)
        good = some & _spelled(a.bytes, ids_a, off_a, want, want_at) & _spelled(
            b.bytes, ids_b, off_b, want, want_at)
        self.a, self.at_a = _drop(ids_a, off_a, good)
        self.b, self.at_b = _drop(ids_b, off_b, good)
        # ends of tokens on one axis of bytes; a text's last end is common to both
        self.end_a, self.end_b = np.cumsum(a.bytes.size[self.a]), np.cumsum(b.bytes.size[self.b])
        ends = np.sort(np.concatenate([self.end_a, self.end_b]), kind="stable")
        twice = ends[1:] == ends[:-1]
        self.groups = ends[1:][twice]
        ends = ends[np.concatenate([[True], ~twice])[:len(ends)]]
        # between two neighbouring ends lies one overlap of one A and one B token
        self.link_a = np.searchsorted(self.end_a, ends)
        self.link_b = np.searchsorted(self.end_b, ends)
        self.link_at = np.searchsorted(self.link_a, self.at_a)
        self.group_at = np.searchsorted(self.groups, np.concatenate([[0], self.end_a])[self.at_a], "right")

    def digests(self, path_a: str, path_b: str) -> list[str]:
        """SHA-256 of the groups of each text; empty without tokens."""
        group_a = np.searchsorted(self.groups, self.end_a)
        group_b = np.searchsorted(self.groups, self.end_b)
        size_a, size_b = (np.bincount(g, minlength=len(self.groups)) for g in (group_a, group_b))
        # the A ids of a group, then its B ids
        before = np.cumsum(size_a + size_b) - size_a - size_b
        place_a = np.arange(len(self.a)) - (np.cumsum(size_a) - size_a)[group_a] + before[group_a]
        place_b = np.arange(len(self.b)) - (np.cumsum(size_b) - size_b)[group_b] + (before + size_a)[group_b]
        a, b = _numbers(path_a), _numbers(path_b)
        n = len(self.a) + len(self.b)
        which = np.empty(n, np.int64)
        which[place_a], which[place_b] = self.a, self.b + len(a.size)
        both = Pieces.__new__(Pieces)
        both.size = np.concatenate([a.size, b.size])
        both.at = np.concatenate([a.at, b.at + len(a.data)])
        both.data = np.concatenate([a.data, b.data])
        text, ends = both.join(which)
        text = text.copy()
        text[ends[before + size_a - 1] - 1] = ord("|")
        text[ends[before + size_a + size_b - 1] - 1] = ord(";")
        stops = np.concatenate([[0], ends])[self.at_a + self.at_b].tolist()
        raw = text.tobytes()
        return [hashlib.sha256(raw[i:j - 1]).hexdigest() if j > i else ""
                for i, j in zip(stops[:-1], stops[1:], strict=True)]


def _encode_postings(chunk: int, n_rows: int, pair: np.ndarray, row: np.ndarray, n_links: np.ndarray) -> pa.RecordBatch:
    """Postings of one chunk from its (pair, row) entries in order, each with a number of links."""
    start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])[:len(pair)])
    size = np.diff(np.concatenate([start, [len(pair)]]))
    rank = np.arange(len(pair)) - np.repeat(start, size)
    of = np.repeat(np.arange(len(start)), size)
    # positions take 2 bytes a row, a bitmap an eighth of a byte per row of the chunk
    width = (n_rows + 7) // 8
    dense = 2 * size > width
    n_bytes = np.where(dense, width, 2 * size)
    at = np.cumsum(n_bytes) - n_bytes
    rows = np.zeros(int(n_bytes.sum()), np.uint8)
    listed = ~dense[of]
    place = at[of[listed]] + 2 * rank[listed]
    rows[place], rows[place + 1] = row[listed] & 255, row[listed] >> 8
    number = np.cumsum(dense) - 1
    bitmap = np.zeros((int(dense.sum()), width * 8), bool)
    bitmap[number[of[~listed]], row[~listed]] = True
    rows[at[dense][:, None] + np.arange(width)] = np.packbits(bitmap, axis=1)
    # planes only where some row has more than one link
    planes = np.zeros(len(start), np.int64)
    most = np.maximum.reduceat(n_links, start) if len(start) else n_links
    while (more := (most >> planes) > 0).any():
        planes += more
    planes[most == 1] = 0
    wide = (size + 7) // 8
    plane_at = np.cumsum(planes * wide) - planes * wide
    bits = np.zeros(int((planes * wide).sum()) * 8, bool)
    for k in range(int(planes.max(initial=0))):
        has = planes[of] > k
        bits[(plane_at[of[has]] + k * wide[of[has]]) * 8 + rank[has]] = n_links[has] >> k & 1
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(start), chunk)), pa.array(pair[start]), pa.array(size.astype(np.int32)),
        _binary(rows, n_bytes), _binary(np.packbits(bits), planes * wide)],
        ["chunk", "pair", "n", "rows", "planes"])


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _blob(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def _decode_postings(n: np.ndarray, rows: pa.Array, planes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per entry of the postings: index of its posting, row, number of links."""
    data, at = _blob(rows)
    width = np.diff(at)
    dense = width != 2 * n
    of = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    row = np.zeros(len(of), np.int64)
    listed = ~dense[of]
    place = at[of[listed]] + 2 * rank[listed]
    row[listed] = data[place].astype(np.int64) | data[place + 1].astype(np.int64) << 8
    if dense.any():
        each = int(width[dense][0])
        bitmap = data[np.repeat(dense, width)].reshape(-1, each)
        row[~listed] = np.nonzero(np.unpackbits(bitmap, axis=1))[1]
    data, at = _blob(planes)
    wide = (n + 7) // 8
    count = np.diff(at) // wide
    bits = np.unpackbits(data)
    links = np.where(count[of] == 0, 1, 0)
    for k in range(int(count.max(initial=0))):
        has = count[of] > k
        links[has] += bits[(at[of[has]] + k * wide[of[has]]) * 8 + rank[has]].astype(np.int64) << k
    return of, row, links


class _Chunk:
    """Entries of the rows of a task, held until the chunk is full."""

    def __init__(self) -> None:
        self.task = TaskContext.get().partitionId() if TaskContext.get() else 0
        self.number = -1
        self.open()

    def open(self) -> None:
        self.number += 1
        self.rows = self.links = 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @property
    def name(self) -> int:
        return self.task << 32 | self.number

    def add(self, pair: np.ndarray, row: np.ndarray, n_rows: int) -> None:
        """Links of the next rows, ``row`` counted from the first of them."""
        order = np.lexsort((row, pair))
        pair, row = pair[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])])[:len(pair)])
        self.parts.append((pair[first], row[first] + self.rows, np.diff(np.concatenate([first, [len(pair)]]))))
        self.rows += n_rows
        self.links += len(first)

    def postings(self) -> pa.RecordBatch:
        pair, row, n = (np.concatenate([p[k] for p in self.parts]) if self.parts else np.zeros(0, np.int64)
                        for k in range(3))
        # slices are in the order of rows: a stable sort by pair merges their postings
        order = np.argsort(pair, kind="stable")
        return _encode_postings(self.name, self.rows, pair[order], row[order], n[order])


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", chunk_rows: int = CHUNK_ROWS,
          chunk_links: int = CHUNK_LINKS) -> tuple[DataFrame, DataFrame]:
    """(rows, postings) of one pass over the texts, both written below ``spark.checkpoint.dir``.

    ``rows`` are the rows of ``docs`` without the text in the struct ``doc``, with n_a, n_b, n_groups,
    n_links, groups_sha256, and the place (chunk, row) that postings name. ``postings`` are
    (chunk, pair, n, rows, planes); ``pair`` is the A id times 2**32 plus the B id.
    """
    kept = StructType([f for f in docs.schema.fields if f.name != text])
    names = kept.names
    digest = StructType.fromDDL(_DIGEST)
    posting = StructType.fromDDL(_POSTING)
    schema = StructType([StructField("doc", StructType([*kept.fields])), StructField(
        "row", posting["n"].dataType), *digest.fields, *posting.fields])

    def of_rows(batch: pa.RecordBatch, chunk: int, row: np.ndarray, columns: list) -> pa.RecordBatch:
        doc = pa.StructArray.from_arrays([batch.column(c) for c in names], fields=[
            pa.field(c, batch.schema.field(c).type) for c in names])
        n = batch.num_rows
        return pa.RecordBatch.from_arrays([
            doc, pa.array(row, pa.int32()), *columns, pa.array(np.full(n, chunk)),
            *(pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], schema.names)

    def of_postings(found: pa.RecordBatch, doc: pa.DataType) -> pa.RecordBatch:
        n = found.num_rows
        return pa.RecordBatch.from_arrays([
            pa.nulls(n, doc), pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.int64()) for _ in range(4)),
            pa.nulls(n, pa.string()), *found.columns], schema.names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, doc = _Chunk(), None
        for batch in batches:
            texts = batch.column(text).fill_null("").to_pylist()
            doc = pa.struct([pa.field(c, batch.schema.field(c).type) for c in names])
            for i, j in pretoken.chunks(texts):
                if chunk.rows + j - i > chunk_rows or chunk.links > chunk_links:
                    yield of_postings(chunk.postings(), doc)
                    chunk.open()
                found = Aligned(texts[i:j], path_a, path_b)
                n = np.diff(found.link_at)
                yield of_rows(batch.slice(i, j - i), chunk.name, chunk.rows + np.arange(j - i), [
                    pa.array(np.diff(found.at_a)), pa.array(np.diff(found.at_b)),
                    pa.array(np.diff(found.group_at)), pa.array(n),
                    pa.array(found.digests(path_a, path_b), pa.string())])
                chunk.add(found.a[found.link_a] << 32 | found.b[found.link_b],
                          np.repeat(np.arange(j - i), n), j - i)
        if chunk.rows:
            yield of_postings(chunk.postings(), doc)

    both = materialised(map_arrow(docs, task, schema), "aligned")
    return (both.where("row is not null").select("doc", "chunk", "row", *digest.names),
            both.where("pair is not null").select(*posting.names))


def pair_scores(postings: DataFrame) -> DataFrame:
    """(pair, count, best): rows that hold the pair, and whether no pair of its A id has more."""
    counts = postings.groupBy("pair").agg(F.sum(F.col("n").cast("long")).alias("count"))
    top = Window.partitionBy(F.shiftright("pair", 32))
    return counts.withColumn("best", F.col("count") == F.max("count").over(top))


def return_scores(postings: DataFrame, scores: DataFrame) -> DataFrame:
    """(chunk, row, n_best, count_sum): scores summed over the links of each row with any.

    Only names of postings meet the scores; the postings themselves move once, to their chunk.
    """

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("pair"), right.sort_by("of_pair")
        n = left.column("n").to_numpy().astype(np.int64)
        of, row, links = _decode_postings(n, left.column("rows"), left.column("planes"))
        best, count = (right.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("best", "count"))
        total = int(row.max(initial=-1)) + 1
        n_best, count_sum, seen = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, bool)
        np.add.at(n_best, row, links * best[of])
        np.add.at(count_sum, row, links * count[of])
        seen[row] = True
        at = np.flatnonzero(seen)
        chunk = left.column("chunk").to_numpy()[:1]
        return pa.table({"chunk": np.repeat(chunk, len(at)), "row": pa.array(at, pa.int32()),
                         "n_best": n_best[at], "count_sum": count_sum[at]})

    named = postings.select(F.col("chunk").alias("in_chunk"), "pair").join(scores, "pair").select(
        "in_chunk", F.col("pair").alias("of_pair"), "count", "best")
    return postings.groupBy("chunk").cogroup(named.groupBy("in_chunk")).applyInArrow(
        sums, "chunk long, row int, n_best long, count_sum long")


def scored(docs: DataFrame, path_a: str, path_b: str, text: str = "text", prefix: str = "",
           chunk_rows: int = CHUNK_ROWS, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """The rows of ``docs`` without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256 of each.

    ``path_a`` is a byte-level BPE file that gets a space and the text, ``path_b`` a sentencepiece file
    that adds the space itself; strings of special tokens are text. NULL and empty texts, and texts
    that either vocabulary does not spell byte by byte, have no tokens: zeros and an empty digest.
    Every row counts as a document, repeated rows and rows without an id too. Texts of any length are
    read whole. A new column whose name exists raises; choose a ``prefix``. An empty table gives no rows.
    """
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    others = [c for c in docs.columns if c != text]
    if clash := {prefix + n for n in names} & set(others):
        raise ValueError(f"columns {sorted(clash)} exist already, choose a prefix")
    rows, postings = align(docs, path_a, path_b, text, chunk_rows, chunk_links)
    back = return_scores(postings, materialised(pair_scores(postings), "pair-scores"))
    out = rows.join(back, ["chunk", "row"], "left")
    return out.select(*[F.col("doc").getField(c).alias(c) for c in others], *[
        (F.coalesce(n, F.lit(0).cast("long")) if n in ("n_best", "count_sum") else F.col(n)).alias(prefix + n)
        for n in names])
