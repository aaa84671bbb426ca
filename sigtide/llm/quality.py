"""Quality classifier: random-indexing word vectors, pooled, and a small two-layer network.

Words are runs of letters and digits or runs of signs, as they stand. They are hashed to
``BUCKETS`` rows. Random indexing: every row has a fixed sparse random index vector, and a row's word
vector is the sum of the index vectors of its neighbours within ``REACH`` words, counted over all
documents. A document's features are the mean of its word vectors and a few shares of its text. The
network (tanh, then logistic) is trained in numpy on at most ``SAMPLE`` labelled rows, and its
logits are divided by a temperature fitted on rows it has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtide.llm.arrow import extended, map_arrow
from sigtide.llm.words import find_words, mix, slices
from sigtide.session import materialised

BUCKETS, WIDTH, NONZERO, REACH = 8192, 32, 4, 2
SAMPLE, HIDDEN, EPOCHS, SEED = 20_000, 32, 60, 7
STATS = 7


def _token_table() -> tuple[np.ndarray, np.ndarray]:
    """Byte tables that keep letters, digits and bytes above 0x7F, or printable signs."""
    letters, signs = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for b in range(33, 256):
        if b >= 128 or chr(b).isalnum():
            letters[b] = b
        elif b < 127:
            signs[b] = b
    return letters, signs


_LETTERS, _SIGNS = _token_table()


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero parts of every row's index vector."""
    h = mix(np.arange(1, BUCKETS * NONZERO + 1, dtype=np.uint64))
    return ((h >> np.uint64(8)) % np.uint64(WIDTH)).astype(np.int64).reshape(BUCKETS, NONZERO), \
        np.where(h & np.uint64(1), 1.0, -1.0).reshape(BUCKETS, NONZERO)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, object]:
    """Row, document, hash and kind (True: signs) of every token in order, and the word spans."""
    words, signs = find_words(texts, _LETTERS), find_words(texts, _SIGNS)
    order = np.argsort(np.concatenate([words.start, signs.start]), kind="stable")
    hashes = np.concatenate([words.hashes, signs.hashes])[order]
    docs = np.concatenate([words.doc, signs.doc])[order]
    kind = (np.arange(len(order)) >= len(words.start))[order]
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), docs, hashes, kind, words


def context_sums(docs: DataFrame, text: str = "text") -> np.ndarray:
    """BUCKETS x WIDTH word vectors over all documents. Each task sums its own; sums are added by
    row in Spark, so the driver gets one matrix of fixed size."""
    names = [f"d{k}" for k in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = _index_vectors()
        sums = np.zeros(BUCKETS * WIDTH)
        for batch in batches:
            column = batch.column(text)
            for i, j in slices(column):
                row, doc, _, _, _ = _tokens(column.slice(i, j - i))
                for k in range(1, REACH + 1):
                    near = np.flatnonzero(doc[k:] == doc[:-k])
                    for a, b in ((row[near], row[near + k]), (row[near + k], row[near])):
                        cell = (a * WIDTH)[:, None] + place[b]
                        sums += np.bincount(cell.ravel(), sign[b].ravel(), BUCKETS * WIDTH)
        sums = sums.reshape(BUCKETS, WIDTH)
        used = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *[pa.array(sums[used, k]) for k in range(WIDTH)]], ["row", *names])

    schema = "row long, " + ", ".join(f"{n} double" for n in names)
    got = map_arrow(docs.select(text), run, schema).groupBy("row").agg(
        *[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((BUCKETS, WIDTH))
    out[got["row"].to_numpy(np.int64)] = got[names].to_numpy()
    return out


def features(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Pooled vector and shares per text; an empty text has zeros only."""
    row, doc, hashes, kind, words = _tokens(texts)
    n = words.n_docs
    count = np.bincount(doc, minlength=n).astype(float)
    safe = np.maximum(count, 1)
    first = np.concatenate([[0], np.cumsum(count[:-1])]).astype(np.int64)
    pooled = np.zeros((n, WIDTH))
    full = np.flatnonzero(count)
    if len(full):
        # in pieces, so that one long text does not unfold all its vectors at once
        for a in range(0, len(row), 1 << 16):
            part = slice(a, a + (1 << 16))
            edge = np.flatnonzero(np.diff(doc[part], prepend=-1))
            pooled[doc[part][edge]] += np.add.reduceat(vectors[row[part]], edge)
    pooled /= safe[:, None]
    size = np.diff(words.offsets).astype(float)
    byte_doc = np.repeat(np.arange(n), np.diff(words.offsets))
    share = lambda mask: np.bincount(byte_doc, mask, n) / np.maximum(size, 1)
    data = words.data
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order], new, n)
    stats = np.stack([
        np.log1p(count), distinct / safe, np.bincount(doc, kind, n) / safe, np.log1p(size / safe),
        share((data >= 65) & (data <= 90)), share((data >= 48) & (data <= 57)),
        share(data == 10)], 1)
    stats[count == 0] = 0
    del first
    return np.concatenate([pooled, stats], 1)


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(vectors: np.ndarray, x: np.ndarray, y: np.ndarray) -> Model:
    """The network on rows ``x`` with labels ``y``; a fifth of them only fits the temperature.

    Without rows of both labels the score is their share everywhere (0.5 without any row).
    """
    rng = np.random.default_rng(SEED)
    share = float(y.mean()) if len(y) else 0.5
    width = x.shape[1] if len(x) else WIDTH + STATS
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-9)) if len(x) else (
        np.zeros(width), np.ones(width))
    model = Model(vectors, mean, scale, rng.normal(0, width ** -0.5, (width, HIDDEN)),
                  np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    clear = float(np.clip(share, 0.01, 0.99))
    model.b2 = float(np.log(clear / (1 - clear)))
    if not len(y) or not 0 < share < 1:
        return model
    order = rng.permutation(len(y))
    held, own = order[:max(1, len(y) // 5)], order[max(1, len(y) // 5):]
    params = [model.w1, model.b1, model.w2, np.array([model.b2])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    z = np.clip((x - mean) / scale, -8, 8)
    step = 0
    for _ in range(EPOCHS):
        mixed = rng.permutation(own)
        for a in range(0, len(mixed), 256):
            rows = mixed[a:a + 256]
            hidden = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -30, 30)))
            d = (p - y[rows]) / len(rows)
            back = d[:, None] * params[2] * (1 - hidden ** 2)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(0),
                     hidden.T @ d + 1e-4 * params[2], np.array([d.sum()])]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] -= 0.005 * (first[i] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = *params[:3], float(params[3][0])
    logit = model.logits(x[held])
    grid = np.geomspace(0.25, 8, 81)
    loss = [np.mean(np.logaddexp(0, -np.where(y[held] == 1, 1, -1) * logit / t)) for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def held_out(doc: Column) -> Column:
    """The fold whose labels are never learnt; false for NULL ids."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text",
        label: str = "quality", sample: int = SAMPLE) -> Model:
    """Word vectors over all documents, the network from labelled rows outside the held-out fold.

    At most ``sample`` labelled ids are taken: all of them if they are no more, else those whose hash
    falls into a share that gives nine tenths of ``sample``. An id with several texts gives one row.
    Contradicting labels of one id count as 0; NULL labels and ids are left out.
    """
    sums = context_sums(docs, text)
    vectors = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            parts = [features(column.slice(i, j - i), shared.value) for i, j in slices(column)]
            x = np.concatenate(parts) if parts else np.zeros((0, WIDTH + STATS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc"), pa.array([r.tobytes() for r in x], pa.binary())],
                ["_doc", "_x"])

    known = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull() & ~held_out(F.col(doc)))
    known = known.groupBy(F.col(doc).alias("_doc")).agg(F.min(label).cast("int").alias("_y"))
    ids = docs.where(F.col(doc).isNotNull()).select(F.col(doc).alias("_doc"))
    n = known.join(ids, "_doc", "left_semi").count()
    share = 1 if n <= sample else -(-10 * n // (9 * sample))
    drawn = F.pmod(F.xxhash64("_doc"), F.lit(share)) == 0
    # at most ``sample`` rows, so the broadcast is bounded; only their texts become features
    chosen = materialised(known.where(drawn).join(ids.where(drawn), "_doc", "left_semi").limit(
        sample), "labelled")
    kind = docs.schema[doc].dataType.simpleString()
    texts = docs.select(F.col(doc).alias("_doc"), text).join(
        F.broadcast(chosen.select("_doc")), "_doc", "left_semi")
    rows = map_arrow(texts, run, f"_doc {kind}, _x binary").groupBy("_doc").agg(
        F.min("_x").alias("_x")).join(chosen, "_doc").select("_doc", "_x", "_y").toPandas()
    rows = rows.sort_values("_doc", ignore_index=True)
    x = np.frombuffer(b"".join(rows["_x"]), float).reshape(len(rows), WIDTH + STATS)
    return train(vectors, x, rows["_y"].to_numpy(float))


def score(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with score (higher: label 1 likelier) and predicted (score >= 0.5).

    Only the text is read. NULL texts count as empty, which have a score too. Equal texts have
    equal scores. A new column whose name exists raises; choose a ``prefix``.
    """
    names = [prefix + "score", prefix + "predicted"]
    schema = extended(docs.schema, {"score": "double", "predicted": "int"}, prefix)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column(text)
            parts = [own.scores(features(column.slice(i, j - i), own.vectors))
                     for i, j in slices(column)]
            p = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                [*batch.schema.names, *names])

    return map_arrow(docs, run, schema)
