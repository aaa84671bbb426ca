"""Topics: fit, assign, describe by words, label, and daily counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.functions.text import TOKEN_BREAK, macro_label
from sigtide.operators import lda
from sigtide.session import materialised

TOP_WORDS = 10


@dataclass
class TopicModel:
    """Fitted stages, the column they read, and the clusters large enough to count as topics."""

    method: str
    column: str
    model: PipelineModel | KMeansModel
    topics: list[int]


def fit_assigned(df: DataFrame, method: str = "kmeans", column: str = "embedding", k: int = 10,
                 min_topic_size: int = 10, seed: int = 42, max_iter: int = 20,
                 width: int = 1 << 16) -> tuple[TopicModel, DataFrame]:
    """Cluster documents and assign them: k-means on supplied embeddings, or LDA on word counts.

    Every LDA pass reads all documents (no mini-batches). Words are hashed to ``width`` columns, so
    none is dropped and the model's size does not depend on the data. Texts are split into words
    once and documents are assigned once: word counts and assignments are tables in the shared
    folder, spread evenly over tasks, which the passes, the cluster sizes and the caller read.

    Clusters smaller than ``min_topic_size`` are not topics; their documents become noise (-1).
    Only the cluster sizes (k rows) reach the driver. The frame is what ``assign_topics`` gives.
    """
    if method == "kmeans":
        data = df.withColumn("_features", array_to_vector(F.col(column).cast("array<double>")))
        model = KMeans(featuresCol="_features", predictionCol="_topic", k=k, seed=seed,
                       maxIter=max_iter).fit(data)
        mixed = df.withColumn("_mix", _shares(model, column))
    elif method == "lda":
        words = PipelineModel([
            RegexTokenizer(inputCol=column, outputCol="_words", pattern=TOKEN_BREAK),
            HashingTF(inputCol="_words", outputCol="_features", numFeatures=width)])
        counted = materialised(words.transform(df).drop("_words").hint("rebalance"), "word-counts")
        mixture = lda.fit(counted, "_features", k, seed, max_iter)
        model = PipelineModel([*words.stages, mixture])
        mixed = counted.withColumn("_mix", lda.shares(counted, mixture, "_features"))
    else:
        raise ValueError(f"unknown method {method!r}")
    found = materialised(_largest(mixed).select(*df.columns, "topic_id", "topic_prob"), "topics")
    sizes = found.groupBy("topic_id").count().where(F.col("count") >= min_topic_size)
    fitted = TopicModel(method, column, model, sorted(
        r["topic_id"] for r in sizes.where("topic_id is not null").collect()))
    return fitted, _without_small(fitted, found)


def fit_topics(df: DataFrame, *args, **options) -> TopicModel:
    """The model of ``fit_assigned`` alone, to assign other documents."""
    return fit_assigned(df, *args, **options)[0]


def _largest(scored: DataFrame) -> DataFrame:
    """``topic_id`` and ``topic_prob``: place and value of the largest share in ``_mix``."""
    best = F.array_max("_mix")
    return scored.withColumns({
        "topic_id": (F.array_position("_mix", best) - 1).cast("int"), "topic_prob": best})


def _without_small(fitted: TopicModel, assigned: DataFrame) -> DataFrame:
    """Ids outside the kept topics become noise."""
    kept = F.col("topic_id").isin(*fitted.topics) if fitted.topics else F.lit(False)
    return assigned.withColumn("topic_id", F.when(kept, F.col("topic_id")).otherwise(
        F.lit(K.NOISE_TOPIC_ID)))


def _shares(model: KMeansModel, column: str) -> Column:
    """Softmax over negative squared distances to the centres, on whole Arrow batches; NULL for
    NULL points."""
    centres = np.array(model.clusterCenters())

    def shares(points: pd.Series) -> pd.Series:
        out = np.full(len(points), None, object)
        full = np.flatnonzero(points.notna().to_numpy())
        if len(full):
            x = np.stack(points.to_numpy()[full]).astype(float)
            near = -((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
            near = np.exp(near - near.max(axis=1, keepdims=True))
            out[full] = list(near / near.sum(axis=1, keepdims=True))
        return pd.Series(out)

    return F.pandas_udf(shares, "array<double>")(F.col(column).cast("array<double>"))


def assign_topics(fitted: TopicModel, df: DataFrame) -> DataFrame:
    """``topic_id`` and ``topic_prob`` per row; ids outside the kept topics become -1.

    The k-means probability is a softmax over negative squared distances to the centres; LDA
    reports its largest topic share.
    """
    if fitted.method == "kmeans":
        mixed = df.withColumn("_mix", _shares(fitted.model, fitted.column))
    else:
        *words, mixture = fitted.model.stages
        counted = PipelineModel(words).transform(df)
        mixed = counted.withColumn("_mix", lda.shares(df, mixture, "_features"))
    return _without_small(fitted, _largest(mixed).select(*df.columns, "topic_id", "topic_prob"))


def class_tfidf(df: DataFrame, topic: str = "topic_id", text: str = "body",
                top: int = TOP_WORDS) -> DataFrame:
    """Best words of each topic by class-based TF-IDF: tf in the topic times log(1 + A / f).

    ``f`` is the word's count over all topics and ``A`` the mean word count per topic. Words are
    counted per (topic, word) with map-side combining, so a frequent word costs one row per task;
    the per-word total runs over at most one row per topic, and the top-k rank is cut to k rows
    per task before its shuffle.
    """
    pieces = F.explode(F.split(F.lower(F.col(text)), TOKEN_BREAK)).alias("word")
    counts = (df.select(topic, pieces).where(F.col("word") != "").groupBy(topic, "word")
              .agg(F.count(F.lit(1)).alias("n")))
    # One value: number of words over number of topics.
    mean = counts.groupBy(topic).agg(F.sum("n").alias("total")).agg(F.avg("total")).scalar()
    sized = counts.withColumn("f", F.sum("n").over(Window.partitionBy("word"))).withColumn(
        "score", F.col("n") * F.log(1.0 + mean / F.col("f")))
    rank = Window.partitionBy(topic).orderBy(F.round("score", 9).desc(), "word")
    return (sized.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)
            .select(topic, "rank", "word", "n", "score"))


def topic_words(words: DataFrame, topic: str = "topic_id") -> DataFrame:
    """Top words of a topic joined in rank order (at most ``top`` words a topic)."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "word")))
    return words.groupBy(topic).agg(
        F.array_join(F.transform(ordered, lambda w: w["word"]), " ").alias("words"))


def topic_labels(words: DataFrame, topics: dict[str, Sequence[str]] | None = None,
                 topic: str = "topic_id") -> DataFrame:
    """Macro label per topic; -1 is ``noise``."""
    label = F.when(F.col(topic) == K.NOISE_TOPIC_ID, K.TOPIC_NOISE).otherwise(
        macro_label(F.col("words"), topics))
    return topic_words(words, topic).select(topic, label.alias("macro_label"))


def label_documents(assigned: DataFrame, labels: DataFrame,
                    topic: str = "topic_id") -> DataFrame:
    """Attach the macro label of each document's topic; a topic without one is ``other``.

    No broadcast hint: the label table has a row per topic, but topic ids may come from outside,
    so adaptive execution decides by its measured size and splits a topic that most documents
    share.
    """
    return assigned.join(labels, topic, "left").withColumn(
        "macro_label", F.coalesce("macro_label", F.lit(K.TOPIC_OTHER)))


def topic_pivot(assigned: DataFrame, labels: Sequence[str] | None = None,
                date: str = "date") -> DataFrame:
    """Documents per day and label, one column per label, 0 where there is none.

    The label list is fixed, so the table always has the same columns.
    """
    labels = labels or [*K.MACRO_TOPICS, K.TOPIC_OTHER, K.TOPIC_NOISE]
    return assigned.groupBy(date).agg(
        *[F.count_if(F.col("macro_label") == label).alias(label) for label in labels])


def dominant_topics(pivot: DataFrame, k: int = 8, date: str = "date") -> DataFrame:
    """Labels with the largest totals and their share of the largest."""
    labels = [c for c in pivot.columns if c != date]
    totals = pivot.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in labels])
    top = totals.unpivot([], labels, "label", "total").orderBy(
        F.col("total").desc(), "label").limit(k)
    largest = F.max("total").over(Window.partitionBy())  # at most k rows
    return top.withColumn("share", F.col("total") / F.greatest(largest, F.lit(1)))
