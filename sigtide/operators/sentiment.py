"""Text scoring: three class probabilities and a composite per record."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, StringIndexer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.functions.stats import let
from sigtide.functions.text import is_scorable, strip_text, tokens

BATCH_SIZE = 32
# Weight of a token outside both lists; keeps long neutral prose from drowning its few hits.
NEUTRAL_WEIGHT = 0.05

Scorer = Callable[[list[str]], "Sequence[Sequence[float]]"]


def scorable(df: DataFrame, body: str = "body") -> DataFrame:
    """Records whose stripped body has more than 20 characters; the stripped body is kept."""
    return df.withColumn(body, strip_text(F.col(body))).where(is_scorable(F.col(body)))


def lexicon_probabilities(body: Column, positive: Sequence[str] = K.POSITIVE_WORDS,
                          negative: Sequence[str] = K.NEGATIVE_WORDS,
                          neutral_weight: float = NEUTRAL_WEIGHT) -> Column:
    """Softmax over the logs of 1 + evidence for positive, negative and neutral words.

    Evidence is a count over the whole text, so the softmax reduces to shares and cannot overflow
    on long documents.
    """
    def shares(words: Column) -> Column:
        pos = F.size(F.filter(words, lambda t: t.isin(*positive))).cast("double")
        neg = F.size(F.filter(words, lambda t: t.isin(*negative))).cast("double")
        return let(F.struct(pos.alias("p"), neg.alias("n")), lambda c: let(
            c["p"] + c["n"] + (F.size(words) - c["p"] - c["n"]) * neutral_weight + 3.0,
            lambda total: F.struct(
                ((c["p"] + 1.0) / total).alias("positive"),
                ((c["n"] + 1.0) / total).alias("negative"),
                (((F.size(words) - c["p"] - c["n"]) * neutral_weight + 1.0) / total).alias(
                    "neutral"))))
    return let(tokens(body), shares)


def score_text(df: DataFrame, scorer: str | Scorer = "lexicon", body: str = "body",
               keep: Sequence[str] = ("id", "source", "source_type", "date"),
               **lexicon) -> DataFrame:
    """Score every scorable record: ``keep`` columns, three probabilities, composite, length.

    ``scorer='lexicon'`` is a column expression. A callable gets a list of at most 32 texts and
    returns (positive, negative, neutral) rows; it runs in Arrow batches on the executors and its
    key columns travel in the same row, so scores never have to be matched back by position. Such
    a scorer may cut its own input; this function passes whole texts.
    """
    rows = scorable(df, body).select(*keep, body)
    if scorer == "lexicon":
        scored = rows.withColumn("_s", lexicon_probabilities(F.col(body), **lexicon)).select(
            *keep, "_s.positive", "_s.negative", "_s.neutral",
            F.length(body).cast("long").alias("text_length"))
    else:
        scored = _score_with(rows, scorer, body, keep)
    return scored.select(
        *keep, "positive", "negative", "neutral",
        (F.col("positive") - F.col("negative")).alias("composite"), "text_length")


def _score_with(rows: DataFrame, scorer: Scorer, body: str, keep: Sequence[str]) -> DataFrame:
    schema = rows.select(
        *keep, *[F.lit(0.0).alias(c) for c in ("positive", "negative", "neutral")],
        F.lit(0).cast("long").alias("text_length")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), BATCH_SIZE):
                part = batch.iloc[start:start + BATCH_SIZE]
                probs = pd.DataFrame(
                    list(scorer(part[body].tolist())), index=part.index, dtype="float64",
                    columns=["positive", "negative", "neutral"])
                out = part[list(keep)].join(probs)
                out["text_length"] = part[body].str.len()
                yield out

    return rows.mapInPandas(run, schema)


def fit_text_classifier(df: DataFrame, label: str, body: str = "body",
                        features: int = 1 << 16) -> PipelineModel:
    """Learned alternative on Spark ML: hashed TF-IDF and a multinomial logistic regression.

    ``label`` holds ``positive`` / ``negative`` / ``neutral``.
    """
    classes = StringIndexer(inputCol=label, outputCol="_label",
                            stringOrderType="alphabetAsc")
    words = Tokenizer(inputCol=body, outputCol="_words")
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features)
    idf = IDF(inputCol="_tf", outputCol="_features")
    lr = LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=20,
                            regParam=0.01, family="multinomial")
    return Pipeline(stages=[classes, words, tf, idf, lr]).fit(df)


def score_with_classifier(model: PipelineModel, df: DataFrame, body: str = "body",
                          keep: Sequence[str] = ("id", "source", "source_type", "date"),
                          ) -> DataFrame:
    """Apply a model of ``fit_text_classifier``; classes it never saw get probability 0."""
    order = list(model.stages[0].labelsArray[0])
    # The label indexer is only needed while fitting.
    scored = scorable(df, body)
    for stage in model.stages[1:]:
        scored = stage.transform(scored)
    p = vector_to_array("probability")
    cols = {c: (p[order.index(c)] if c in order else F.lit(0.0)) for c in (
        "positive", "negative", "neutral")}
    return scored.select(
        *keep, *[v.alias(c) for c, v in cols.items()],
        (cols["positive"] - cols["negative"]).alias("composite"),
        F.length(body).cast("long").alias("text_length"))
