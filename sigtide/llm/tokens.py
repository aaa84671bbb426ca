"""Token counts of whole texts by a two-tier table of pre-token lengths.

Tier one is a compact hash table of frequent pre-tokens, broadcast once; its size is the parameter
``frequent`` (12 bytes an entry). Misses go to the worker's cache, which encodes each distinct
pre-token once by the tokenizer library. No pre-token is shuffled. The table only saves work: it is
filled from about ``sample_docs`` documents, and any content gives the same counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtide.llm import pretoken
from sigtide.llm.arrow import extended, map_arrow

FREQUENT = 1 << 16
SAMPLE_DOCS = 2_000
LIMIT = 512


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return batch.column(name).fill_null("").to_pylist()


def frequent_lengths(docs: DataFrame, path: str, text: str, frequent: int,
                     sample_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and token counts of the most frequent pre-tokens of a sample (at most ``frequent``).

    The sample is every document whose hash falls into a share of about ``sample_docs`` documents.
    Each task reports its ``frequent`` most frequent pre-tokens at most.
    """
    share = max(1, docs.count() // sample_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pretoken.encoder(path)
        seen = np.zeros(0, np.int64)
        hashes = np.zeros(0, np.uint64)
        sizes = np.zeros(0, np.int64)
        for batch in batches:
            texts = _texts(batch, text)
            for i, j in pretoken.chunks(texts):
                joined, start, stop, h, _, _ = pretoken.split(texts[i:j])
                entry = known.entries(joined, start, stop, h)
                n = known.size[entry]
                h, n = np.concatenate([hashes, h]), np.concatenate([sizes, n])
                weight = np.concatenate([seen, np.ones(len(start), np.int64)])
                hashes, at, of = np.unique(h, return_index=True, return_inverse=True)
                seen, sizes = np.bincount(of, weight).astype(np.int64), n[at]
                if len(hashes) > 4 * frequent:
                    top = np.argsort(-seen, kind="stable")[:frequent]
                    hashes, seen, sizes = hashes[top], seen[top], sizes[top]
        top = np.argsort(-seen, kind="stable")[:frequent]
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes[top].view(np.int64)), pa.array(sizes[top].astype(np.int64)),
             pa.array(seen[top])], ["hash", "size", "seen"])

    some = docs.where(F.pmod(F.xxhash64(text), F.lit(share)) == 0).select(text)
    top = map_arrow(some, count, "hash long, size long, seen long").groupBy("hash").agg(
        F.min("size").alias("size"), F.sum("seen").alias("seen")).orderBy(
        F.desc("seen"), "hash").limit(frequent).select("hash", "size").toPandas()
    return (top["hash"].to_numpy(np.int64).view(np.uint64), top["size"].to_numpy(np.int32))


def token_counts(docs: DataFrame, path: str, text: str = "text", frequent: int = FREQUENT,
                 sample_docs: int = SAMPLE_DOCS, prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens`` of every whole text.

    ``path`` is a byte-level BPE file of the tokenizers library; counts are without begin, end or
    added tokens; an added token's string inside a text is one token, the library's default. NULL
    texts count as empty (0, 0). Repeated rows and NULL ids stay as they are. New columns that
    would clash with existing ones need a ``prefix``; a clash raises. Empty tables give no rows.
    """
    names = (prefix + "n_bytes", prefix + "n_tokens")
    schema = extended(docs.schema, dict.fromkeys(names, "long"))
    broadcast = docs.sparkSession.sparkContext.broadcast(
        frequent_lengths(docs, path, text, frequent, sample_docs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sizes = broadcast.value
        tier = pretoken.HashTable(1 << max(4, (2 * len(hashes)).bit_length()))
        tier.put(hashes, sizes)
        known = pretoken.encoder(path)
        for batch in batches:
            texts = _texts(batch, text)
            out = np.zeros(len(texts), np.int64)
            for i, j in pretoken.chunks(texts):
                part = texts[i:j]
                joined, start, stop, hashes, first, unknown = pretoken.split(part)
                size = tier.get(hashes).astype(np.int64)
                miss = np.flatnonzero(size < 0)
                if len(miss):
                    entry = known.entries(joined, start[miss], stop[miss], hashes[miss])
                    size[miss] = known.size[entry]
                out[i:j] = np.diff(np.concatenate([[0], np.cumsum(size)])[first])
                whole = known.whole(part, unknown)
                if len(whole):
                    out[i + whole] = [len(x) for x in known.encode_pieces(
                        [part[k] for k in whole])]
            size = pc.binary_length(batch.column(text)).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, size, pa.array(out)],
                                             [*batch.schema.names, *names])

    return map_arrow(docs, count, schema)
