"""Latent Dirichlet allocation by the online rule of Spark ML, documents inferred in blocks.

Draws, steps and stop are those of ``LDA(optimizer="online")``, so the topics are the same but for
rounding. A document drawn into a pass several times is inferred once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import LDA, LocalLDAModel
from pyspark.mllib.common import _py2java
from pyspark.mllib.linalg import DenseMatrix, DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtide.operators.inference import expectation, infer, trigamma

GAMMA_SHAPE = 100.0  # fixed value of Spark ML
DRAWN, KEPT = -2, -1  # rows of a pass beside its words: documents drawn, documents with words


def fit(counted: DataFrame, column: str, k: int, seed: int,
        max_iter: int) -> LocalLDAModel:
    """The model after ``max_iter`` passes over the word counts in ``column``.

    ``counted`` must give the same rows in the same partitions each time, as a stored table does.
    A pass gives one row per word, summed over all tasks; the driver holds these, the weights and
    nothing else, all bounded by the width of the counts.
    """
    lda = LDA(featuresCol=column, topicDistributionCol="_mix", k=k, seed=seed, maxIter=max_iter,
              optimizer="online", subsamplingRate=1.0)
    # start weights come from the width and the seed, so one row shows them
    begin = lda.copy({lda.maxIter: 0}).fit(counted.select(column).limit(1))
    found, alpha = begin.topicsMatrix().toArray(), begin.estimatedDocConcentration().toArray()
    draws, step = _longs(seed), 0
    next(draws)  # drew the start weights
    drawn_by = next(draws)
    for _ in range(max_iter):
        begun_by, weights = next(draws), np.exp(expectation(found.T))
        sums = _sums(counted, column, drawn_by, begun_by, weights, alpha)
        if DRAWN not in sums:  # an empty draw is no step
            drawn_by = begun_by
            continue
        drawn_by, step = next(draws), step + 1
        if KEPT in sums:
            words = [w for w in sums if w >= 0]
            counts = np.zeros_like(found)
            counts[words] = [sums[w][1:] for w in words]
            rho = (lda.getLearningOffset() + step) ** -lda.getLearningDecay()
            found = (1 - rho) * found + rho * (counts * weights.T + 1 / k)
            alpha = _concentration(alpha, sums[KEPT], rho)
    return _model(counted, lda, found, alpha, drawn_by)


def shares(df: DataFrame, model: LocalLDAModel, column: str) -> Column:
    """Topic shares of the word counts in ``column``, as ``model`` gives them; 0 without words."""
    weights = df.sparkSession.sparkContext.broadcast(
        np.exp(expectation(model.topicsMatrix().toArray().T)))
    alpha = model.estimatedDocConcentration().toArray()
    first = _gammas(model._java_obj.oldLocalModel().seed(), len(alpha))

    def shares(features: pa.Array) -> pa.Array:
        starts, sizes, ids, counts = _documents(features)
        full, out = sizes > 0, np.zeros((len(sizes), len(alpha)))
        out[full], _ = infer(starts[full], sizes[full], ids, counts, weights.value, alpha, first)
        out[full] /= out[full].sum(axis=1, keepdims=True)
        return pa.ListArray.from_arrays(
            np.arange(len(out) + 1, dtype=np.int32) * len(alpha), out.ravel())

    return F.arrow_udf(shares, "array<double>")(F.col(column))


def _documents(features: pa.StructArray) -> tuple[np.ndarray, ...]:
    """Start, size, words and counts of sparse vectors."""
    ids, counts = features.field("indices"), features.field("values")
    ends = ids.offsets.to_numpy()
    return ends[:-1], np.diff(ends), ids.values.to_numpy(), counts.values.to_numpy()


def _sums(counted: DataFrame, column: str, drawn_by: int, begun_by: int, weights: np.ndarray,
          alpha: np.ndarray) -> dict[int, np.ndarray]:
    """A pass: per word 0 and its sums by topic, not yet times its weights; ``KEPT`` has its
    documents and the sums of their mean logarithms, ``DRAWN`` the documents drawn."""
    k, width = weights.shape
    shared = counted.sparkSession.sparkContext.broadcast(weights)
    names = ["n", *(f"s{i}" for i in range(k))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _gammas(begun_by + TaskContext.get().partitionId(), k)
        total, logs, drawn, kept = np.zeros((k, width)), np.zeros(k), 0, 0
        for batch in batches:
            starts, sizes, ids, counts = _documents(batch.column(1))
            row = batch.column(0).to_numpy()
            if not len(row):
                continue
            # copies of a row follow each other
            one = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
            times = np.zeros(len(row))
            times[one] = np.diff(one, append=len(row))
            drawn += len(row)
            one = one[sizes[one] > 0]
            kept += int(times[one].sum())
            gammas, ratios = infer(
                starts[one], sizes[one], ids, counts, shared.value, alpha, first)
            mean = expectation(gammas)
            logs += times[one] @ mean
            share = np.zeros((len(row), k))
            share[one] = np.exp(mean) * times[one, None]
            inner = slice(starts[0], starts[-1] + sizes[-1])
            for i in range(k):
                total[i] += np.bincount(
                    ids[inner], ratios[inner] * np.repeat(share[:, i], sizes), width)
        words = np.flatnonzero(total.any(axis=0))
        ids = np.concatenate([words, [DRAWN] * (drawn > 0), [KEPT] * (kept > 0)])
        rows = np.concatenate([
            np.column_stack([np.zeros(len(words)), *total[:, words]]),
            np.array([[drawn, *np.zeros(k)]] * (drawn > 0) + [[kept, *logs]] * (kept > 0)
                     ).reshape(-1, k + 1)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids.astype(np.int32)), *(pa.array(c) for c in rows.T)],
            names=["word", *names])

    drawn = counted.select(F.monotonically_increasing_id().alias("_row"), column).sample(
        True, 1.0, drawn_by)
    table = drawn.mapInArrow(task, ", ".join(["word int", *(f"{c} double" for c in names)])).groupBy(
        "word").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    shared.destroy()
    return dict(zip(table["word"].to_pylist(), np.column_stack(
        [table[c].to_numpy() for c in names])))


def _concentration(alpha: np.ndarray, kept: np.ndarray, rho: float) -> np.ndarray:
    """A Newton step of the document concentration towards the mean logarithms of a pass."""
    n = kept[0]
    slope = n * (kept[1:] / n - expectation(alpha))
    c, q = n * trigamma(alpha.sum()[None])[0], -n * trigamma(alpha)
    moved = alpha - rho * (slope - (slope / q).sum() / (1 / c + (1 / q).sum())) / q
    return moved if (moved > 0).all() else alpha


def _model(counted: DataFrame, lda: LDA, found: np.ndarray, alpha: np.ndarray,
           seed: int) -> LocalLDAModel:
    """The fitted stage of Spark ML from its numbers."""
    spark = counted.sparkSession
    sc, jvm = spark.sparkContext, spark._jvm.org.apache.spark
    old = jvm.mllib.clustering.LocalLDAModel(
        _py2java(sc, DenseMatrix(*found.shape, found.ravel("F"))),
        _py2java(sc, DenseVector(alpha)), 1 / len(alpha), GAMMA_SHAPE)
    return lda._copyValues(LocalLDAModel(jvm.ml.clustering.LocalLDAModel(
        lda.uid, len(found), old.setSeed(seed), spark._jsparkSession)))


def _longs(seed: int) -> Iterator[int]:
    """The long numbers of ``java.util.Random``, which Spark ML draws from."""
    state = (seed ^ 0x5DEECE66D) % (1 << 48)
    while True:
        halves = []
        for _ in range(2):
            state = (state * 0x5DEECE66D + 0xB) % (1 << 48)
            halves.append((state >> 16) - (state >> 47 << 32))
        yield ((halves[0] << 32) + halves[1] + (1 << 63)) % (1 << 64) - (1 << 63)


def _gammas(seed: int, k: int) -> np.ndarray:
    """First parameters of a document: gamma draws as Spark ML takes them (Marsaglia and Tsang)."""
    bits = np.random.RandomState([seed >> 32 & 0xFFFFFFFF, seed & 0xFFFFFFFF])

    def uniform() -> float:
        high, low = bits.randint(0, 1 << 32, 2, np.uint32).tolist()
        return ((high >> 6 << 26) | low >> 6) * 2.0 ** -52

    def normals() -> Iterator[float]:
        while True:
            angle, length = 2 * np.pi * uniform(), np.sqrt(-2 * np.log(uniform()))
            yield length * np.cos(angle)
            yield length * np.sin(angle)

    d, normal, out = GAMMA_SHAPE - 1 / 3, normals(), []
    c = 1 / np.sqrt(9 * d)
    while len(out) < k:
        x = next(normal)
        v = (1 + c * x) ** 3
        if v > 0:
            u = uniform()
            if u < 1 - 0.0331 * x ** 4 or np.log(u) < 0.5 * x * x + d * (1 - v + np.log(v)):
                out.append(d * v / GAMMA_SHAPE)
    return np.array(out)
