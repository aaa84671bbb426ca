"""N-gram Jaccard join by MinHash banding, verified on full shingle sets.

1. Texts with one word sequence form a class; one member stands for it, so copies cost one row.
2. ``BANDS`` band hashes of ``ROWS`` minima each: a pair of similarity s shares a band with
   probability 1 - (1 - s**ROWS)**BANDS, which is 1 - 4.7e-8 at 0.8 (4 rows, 32 bands).
3. Rows are shuffled on band hashes only; every class of a bucket is tied to the bucket's smallest
   class, so a bucket of m classes gives m - 1 edges, never its pairs.
4. Classes tied together form a candidate set. A set is cut into blocks of bounded rows and bytes;
   a task verifies one pair of blocks on full shingle sets through an inverted index and reports
   link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtide.llm.graph import components, forest
from sigtide.llm.arrow import extended, map_arrow, release
from sigtide.llm.cells import KeyFilter
from sigtide.llm.words import SHINGLE, Words, find_words, mix, powers, shingles, slices
from sigtide.session import materialised

THRESHOLD = (4, 5)  # similarity as a fraction, compared in whole numbers
BANDS, ROWS = 32, 4
BLOCK_ROWS, BLOCK_BYTES = 1024, 16 << 20


def signatures(shingle_doc: np.ndarray, hashes: np.ndarray, n: int, bands: int = BANDS,
               rows: int = ROWS) -> np.ndarray:
    """n x bands band hashes; documents without shingles get rows of zeros."""
    out = np.zeros((n, bands), np.uint64)
    edge = np.flatnonzero(np.diff(shingle_doc, prepend=-1))
    if not len(edge):
        return out
    full = shingle_doc[edge]
    salts = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    for b in range(bands):
        band = np.full(len(edge), b + 1, np.uint64)
        for r in range(rows):
            # an odd factor alone keeps the order of low bits, so the high half is folded in
            h = hashes * salts[b * rows + r]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x9E3779B97F4A7C15)
            band = mix(band * np.uint64(0xD6E8FEB86659FD93) ^ np.minimum.reduceat(h, edge))
        out[full, b] = band
    return out


def sequence_hash(words: Words, salt: int) -> np.ndarray:
    """Hash per document, equal for equal word sequences."""
    weights = powers(int(words.counts.max(initial=0)) + 1, 0xC2B2AE3D27D4EB4F)
    place = np.arange(len(words.doc)) - words.first[words.doc]
    terms = mix(words.hashes + np.uint64(salt)) * weights[place]
    sums = np.zeros(len(terms) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    return mix(sums[words.first[1:]] - sums[words.first[:-1]]
               + words.counts.astype(np.uint64)).view(np.int64)


def sketch(docs: DataFrame, doc: str, text: str, width: int = SHINGLE) -> DataFrame:
    """(_doc, _node, _check, _bands): id, two hashes of the word sequence, band hashes.

    Rows without an id or without words have no node and take part in nothing.
    """
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            for i, j in slices(column):
                words = find_words(column.slice(i, j - i))
                n = words.n_docs
                bands = signatures(*shingles(words, width), n)
                keys = [sequence_hash(words, salt) for salt in (1, 2)]
                empty = words.counts == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_doc").slice(i, j - i), pa.array(keys[0], mask=empty),
                     pa.array(keys[1], mask=empty),
                     pa.array([r.tobytes() for r in bands], pa.binary(), mask=empty)],
                    ["_doc", "_node", "_check", "_bands"])

    return map_arrow(docs.select(docs[doc].alias("_doc"), text), run, f"_doc {kind}, _node long, _check long, _bands binary")


def bucket_edges(classes: DataFrame, bands: int = BANDS) -> DataFrame:
    """(src, dst): every class of a bucket tied to the bucket's smallest class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("_node").to_numpy(zero_copy_only=False)
            bands_ = np.frombuffer(b"".join(batch.column("_bands").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(node, bands)), pa.array(bands_)], ["src", "bucket"])

    # a band's number is part of its hash
    rows = map_arrow(classes.select("_node", "_bands"), run, "src long, bucket long")
    low = rows.groupBy("bucket").agg(F.min("src").alias("dst"), F.max("src").alias("high")).where(
        "dst <> high").select("bucket", "dst")
    return rows.join(low, "bucket").where("src <> dst").select("src", "dst").distinct()


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) pairs of all texts, and the set size per text."""
    docs, hashes, base = [], [], 0
    for i, j in slices(texts):
        d, h = shingles(find_words(texts.slice(i, j - i)), width)
        order = np.lexsort((h, d))
        d, h = d[order], h[order]
        new = np.ones(len(d), bool)
        if len(d):
            new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        docs.append(d[new] + i)
        hashes.append(h[new])
        base = j
    d = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return d, h, np.bincount(d, minlength=base)


def verified(texts: pa.Array, side: np.ndarray, width: int = SHINGLE,
             threshold: tuple[int, int] = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right) index arrays of pairs at or above the threshold, per left text.

    With ``side`` all 0 every pair is compared once; else texts of side 0 with those of side 1. The
    postings of a left text's shingles are counted at once, so no pair list is built.
    """
    d, h, size = _sets(texts, width)
    # shingles of one text alone match nothing
    values, column, held = np.unique(h, return_inverse=True, return_counts=True)
    shared = held[column] > 1
    d, column = d[shared], column[shared]
    two = bool(side.any())
    right = np.flatnonzero(side[d] == 1) if two else np.arange(len(d))
    order = right[np.argsort(column[right], kind="stable")]
    posting = d[order]
    starts = np.searchsorted(column[order], np.arange(len(values) + 1))
    del values
    rows = np.searchsorted(d, np.arange(len(size) + 1))
    num, den = threshold
    for left in np.flatnonzero(side == 0) if two else range(len(size)):
        own = column[rows[left]:rows[left + 1]]
        n = starts[own + 1] - starts[own]
        total = int(n.sum())
        if not total:
            continue
        at = np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(total)
        common = np.bincount(posting[at], minlength=len(size))
        hit = common * den >= num * (size[left] + size - common)
        hit[:0 if two else left + 1] = False
        hit &= common > 0
        found = np.flatnonzero(hit)
        if len(found):
            yield np.full(len(found), left), found


def _verify_blocks(sets: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """(node, links, root) per class and pair of blocks, from rows (_set, _p, _q, _side, _node, _n,
    _text)."""
    def run(table: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        side = table.column("_side").to_numpy().astype(np.int64)
        node, n = table.column("_node").to_numpy(), table.column("_n").to_numpy()
        links = np.zeros(len(node), np.int64)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        root = np.arange(len(node))
        for left, right in verified(table.column("_text").combine_chunks(), side, width, threshold):
            links[left[0]] += n[right].sum()
            links[right] += n[left[0]]
            a.append(left)
            b.append(right)
            if sum(map(len, a)) > 1 << 20:  # keep the forest only
                root = forest(len(node), np.concatenate([*a, np.arange(len(node))]),
                              np.concatenate([*b, root]))
                a, b = [], []
        root = forest(len(node), np.concatenate([*a, np.arange(len(node))]),
                      np.concatenate([*b, root]))
        some = np.flatnonzero(links)
        out = pa.table({"node": node[some], "links": links[some], "root": node[root[some]]})
        release()
        return out

    return sets.groupBy("_set", "_p", "_q").applyInArrow(run, "node long, links long, root long")


def links(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = SHINGLE,
          threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc, class_id, component_id, n_links, kept.

    Similarity is that of the sets of ``width``-word shingles, A-Z lower-cased; a text of fewer words
    is one shingle. ``class_id`` is the smallest id with the same words, ``component_id`` the smallest
    id reachable by links, ``n_links`` the number of other rows linked directly, copies included.
    ``kept`` marks the rows of the smallest id of each component; rows that repeat it with another
    text of the same component are kept too, an id is one document. Texts without words and rows
    with a NULL id link with nothing, are their own class, and are kept.
    """
    found = materialised(sketch(docs, doc, text, width).withColumn(
        "_node", F.when(F.col("_doc").isNotNull(), F.col("_node"))), "sketch")
    classes = materialised(found.where("_node is not null").groupBy(
        "_node").agg(F.min("_doc").alias("_rep"), F.count("*").alias("_n"),
                     F.min("_bands").alias("_bands")), "classes")
    tied = components(bucket_edges(classes)).select(
        F.col("node").alias("_node"), F.col("root").alias("_set"))
    # one text of every tied class
    members = tied.join(classes.select("_node", "_rep", "_n"), "_node")
    texts = sketch_texts(docs, doc, text, members)
    sizes = texts.groupBy("_set").agg(
        F.count("*").alias("_rows"), F.sum(F.octet_length("_text")).alias("_bytes"))
    blocks = sizes.select("_set", F.greatest(
        F.ceil(F.col("_rows") / BLOCK_ROWS), F.ceil(F.col("_bytes") / BLOCK_BYTES)).cast(
        "int").alias("_k"))
    placed = texts.join(blocks, "_set").withColumn("_b", F.pmod(F.xxhash64("_node"), "_k"))
    every = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda o: F.struct(
        F.least(F.col("_b"), o.cast("long")).alias("p"), F.greatest(F.col("_b"), o.cast("long")).alias("q"),
        (F.col("_b") > o).cast("int").alias("side")))
    paired = placed.select("_set", "_node", "_n", "_text", F.explode(every).alias("_o")).select(
        "_set", F.col("_o.p").alias("_p"), F.col("_o.q").alias("_q"), F.col("_o.side").alias("_side"),
        "_node", "_n", "_text")
    checked = materialised(_verify_blocks(paired, width, threshold), "links")
    roots = components(checked.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    direct = checked.groupBy(F.col("node").alias("_node")).agg(F.sum("links").alias("_links"))
    linked = classes.select("_node", "_rep", "_n").join(
        roots.select(F.col("node").alias("_node"), F.col("root").alias("_root")), "_node", "left").join(
        direct, "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))
    lowest = linked.groupBy("_root").agg(F.min("_rep").alias("_component"))
    linked = materialised(linked.join(lowest, "_root").select(
        "_node", F.col("_rep").alias("class_id"), F.col("_component").alias("component_id"),
        (F.col("_n") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links")), "linked")
    out = found.select(F.col("_doc").alias(doc), "_node").join(linked, "_node", "left")
    return out.select(
        doc, F.coalesce("class_id", doc).alias("class_id"),
        F.coalesce("component_id", doc).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce(F.col(doc) == F.coalesce("component_id", doc), F.lit(True)).alias("kept"))


def sketch_texts(docs: DataFrame, doc: str, text: str, members: DataFrame) -> DataFrame:
    """One text per tied class, found by the id of the class's smallest member.

    An id may occur with several texts; the word-sequence hash of the text decides. Texts of other
    ids are told by a filter on the map side and never move.
    """
    some, _ = KeyFilter(members, F.xxhash64("_rep")).split(
        docs.select(docs[doc].alias("_rep"), docs[text].alias("_text")), F.xxhash64("_rep"))
    # a class has one _rep, so the join's partitioning serves the grouping too
    return materialised(sketch_nodes(some).join(members, ["_node", "_rep"]).groupBy(
        "_node", "_rep", "_set", "_n").agg(F.min("_text").alias("_text")).drop("_rep"), "texts")


def sketch_nodes(rows: DataFrame) -> DataFrame:
    """Adds the word-sequence hash of ``_text`` as ``_node``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_text")
            parts = [sequence_hash(find_words(column.slice(i, j - i)), 1) for i, j in slices(column)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))],
                [*batch.schema.names, "_node"])

    return map_arrow(rows, run, extended(rows.schema, {"_node": "long"}))
