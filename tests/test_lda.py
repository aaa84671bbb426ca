"""Topics of texts against Spark ML's own fit, and the block inference against a loop."""

import math

import numpy as np
import pytest
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql.types import IntegerType, StructField, StructType

from sigtide.operators import inference, lda


def test_fit_is_that_of_spark_ml(spark, tmp_path):
    """Same draws, steps and stop: repeated, empty and one-word documents, several partitions."""
    rng, rows = np.random.default_rng(3), []
    for i in range(60):
        words = sorted(rng.choice(40, i % 13, replace=False).tolist())
        rows.append((i, Vectors.sparse(40, words, rng.integers(1, 30, len(words)).astype(float))))
    rows += [(60 + i, rows[7][1]) for i in range(5)]
    spark.createDataFrame(rows, StructType([
        StructField("id", IntegerType()), StructField("_features", VectorUDT())])).repartition(
            3).write.parquet(str(tmp_path / "counts"))
    df = spark.read.parquet(str(tmp_path / "counts"))
    known = LDA(featuresCol="_features", topicDistributionCol="_mix", k=3, seed=42, maxIter=20,
                optimizer="online", subsamplingRate=1.0).fit(df)
    got = lda.fit(df, "_features", 3, 42, 20)
    np.testing.assert_allclose(
        got.topicsMatrix().toArray(), known.topicsMatrix().toArray(), rtol=1e-5)
    np.testing.assert_allclose(got.estimatedDocConcentration().toArray(),
                               known.estimatedDocConcentration().toArray(), rtol=1e-6)
    expected = {r["id"]: r["mix"] for r in known.transform(df).select(
        "id", vector_to_array("_mix").alias("mix")).collect()}
    found = {r["id"]: r["mix"] for r in df.select(
        "id", lda.shares(df, got, "_features").alias("mix")).collect()}
    assert len(found) == 65 and found[0] == [0.0, 0.0, 0.0]
    for i, mix in expected.items():
        np.testing.assert_allclose(found[i], list(mix), atol=1e-5)


def test_few_documents_with_empty_draws(spark):
    """With one document a third of the passes draw nothing; they take a number and no step."""
    df = spark.createDataFrame([(Vectors.sparse(9, [2, 5], [3.0, 4.0]),)], ["_features"])
    known = LDA(k=2, seed=7, maxIter=20, optimizer="online", subsamplingRate=1.0,
                featuresCol="_features").fit(df)
    np.testing.assert_allclose(lda.fit(df, "_features", 2, 7, 20).topicsMatrix().toArray(),
                               known.topicsMatrix().toArray(), rtol=1e-6)


@pytest.mark.parametrize("block", [1, 200, 1 << 17])
def test_blocks_give_what_a_loop_gives(monkeypatch, block):
    """Documents share blocks and leave them in any order; a long one has a block of its own."""
    monkeypatch.setattr(inference, "BLOCK", block)
    rng = np.random.default_rng(5)
    sizes = np.array([1, 90, 3, 3, 17, 2, 40, 1, 25, 8])
    starts = np.cumsum(sizes) - sizes
    ids, counts = rng.integers(0, 50, sizes.sum()), rng.integers(1, 9, sizes.sum()).astype(float)
    weights, alpha = rng.random((4, 50)) + 1e-3, np.array([0.3, 0.2, 0.1, 0.4])
    first = rng.gamma(100, 0.01, 4)
    gammas, ratios = inference.infer(starts, sizes, ids, counts, weights, alpha, first)
    for i, (start, size) in enumerate(zip(starts, sizes)):
        table, count = weights[:, ids[start:start + size]], counts[start:start + size]
        gamma, moved = first, 1.0
        share = np.exp(inference.expectation(gamma))
        while moved > 1e-3:
            last = gamma
            gamma = share * (table @ (count / (share @ table + 1e-100))) + alpha
            share = np.exp(inference.expectation(gamma))
            moved = np.abs(gamma - last).mean()
        np.testing.assert_allclose(gammas[i], gamma, rtol=1e-9)
        np.testing.assert_allclose(ratios[start:start + size], count / (share @ table), rtol=1e-9)


def test_digamma_and_its_slope():
    x = np.array([0.02, 0.5, 1.0, 7.3, 4000.0])
    near = [(math.lgamma(v + 1e-5 * v) - math.lgamma(v - 1e-5 * v)) / (2e-5 * v) for v in x]
    np.testing.assert_allclose(inference.digamma(x), near, rtol=1e-6)
    assert inference.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert inference.trigamma(np.array([1.0]))[0] == pytest.approx(math.pi ** 2 / 6, abs=1e-11)
