"""Regime classifier on Spark ML: split, train, evaluate, predict, attribute.

The estimator is a random forest by default (it yields class probabilities in few jobs) or
one-vs-rest gradient-boosted trees. Neither is the boosting library originally used, so published
accuracy figures are not comparable.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sigtide.operators.carry import Ordered
from sigtide.operators.features import select_features
from sigtide.operators.shapley import leaves_of, node_table, shapley
from sigtide.operators.timeseries import tail_n
from sigtide.session import materialised


@dataclass(frozen=True)
class TrainParams:
    estimator: str = "forest"       # or "boosted"
    trees: int = 200
    depth: int = 4
    learning_rate: float = 0.05
    row_sample: float = 0.8
    bootstrap: bool = True          # a forest's rows are drawn with replacement
    column_sample: float = 0.8
    seed: int = 42
    folds: int = 2


@dataclass
class RegimeModel:
    """Fitted stages with the class list and the feature order they expect."""

    stages: PipelineModel
    classes: list[str]
    features: list[str]
    params: dict = field(default_factory=dict)


def ts_split(df: DataFrame, k: int = 2, order: str = "date") -> DataFrame:
    """Expanding chronological folds: one copy per (fold, part) a row belongs to.

    With n rows the test block of fold i has floor(n / (k + 1)) rows and ends (k - i - 1) blocks
    before the end; its training part is everything earlier. Dates are unique. Rows are numbered
    block by block, without a task that orders all of them.
    """
    numbered, n = Ordered(df, order).numbered("_i")
    numbered = numbered.select(*df.columns, "_i", F.lit(n).cast("long").alias("_n"))
    fold = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")
    size = F.floor(F.col("_n") / (k + 1))
    start = F.col("_n") - (k - F.col("fold")) * size
    part = F.when(F.col("_i") < start, "train").when(F.col("_i") < start + size, "test")
    return numbered.select("*", fold).withColumn("part", part).where(
        F.col("part").isNotNull()).drop("_i", "_n")


def confusion(df: DataFrame, classes: Sequence[str], label: str = "label",
              prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Rows are actual classes, one column per predicted class."""
    return df.groupBy(*by, label).agg(*[
        F.count_if(F.col(prediction) == c).alias(str(c)) for c in classes])


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                 by: Sequence[str] = ("fold",)) -> DataFrame:
    """Precision, recall, F1 and support per class, and the accuracy of its fold.

    Counts per (label, prediction) are the only pass over the rows; all else is arithmetic on at
    most classes squared rows per fold. Zero denominators give 0.
    """
    cells = df.groupBy(*by, label, prediction).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(*by, "n", (F.col(label) == F.col(prediction)).alias("hit"), F.explode(
        F.array(F.struct(F.lit("actual").alias("side"), F.col(label).cast("string").alias("c")),
                F.struct(F.lit("predicted").alias("side"), F.col(prediction).cast("string").alias(
                    "c")))).alias("_s")
    ).select(*by, "n", "hit", "_s.*")
    actual = F.col("side") == "actual"
    counts = sides.groupBy(*by, F.col("c").alias("class")).agg(
        F.coalesce(F.sum(F.when(actual & F.col("hit"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(actual, F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(~actual, F.col("n"))), F.lit(0)).alias("_predicted"))
    fold = Window.partitionBy(*by)  # one row per class
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide("tp", "_predicted"), zero)
    recall = F.coalesce(F.try_divide("tp", "support"), zero)
    return counts.withColumns({"precision": precision, "recall": recall}).withColumns({
        "f1": F.coalesce(F.try_divide(2.0 * F.col("precision") * F.col("recall"),
                                      F.col("precision") + F.col("recall")), zero),
        "accuracy": F.sum("tp").over(fold) / F.sum("support").over(fold),
    }).select(*by, "class", "precision", "recall", "f1", "support", "accuracy")


def _estimator(p: TrainParams):
    if p.estimator == "forest":
        return RandomForestClassifier(
            featuresCol="_features", labelCol="_label", numTrees=p.trees, maxDepth=p.depth,
            subsamplingRate=p.row_sample, bootstrap=p.bootstrap,
            featureSubsetStrategy=str(p.column_sample), seed=p.seed)
    if p.estimator == "boosted":
        return OneVsRest(
            featuresCol="_features", labelCol="_label", rawPredictionCol="rawPrediction",
            classifier=GBTClassifier(
                featuresCol="_features", labelCol="_label", maxIter=p.trees, maxDepth=p.depth,
                stepSize=p.learning_rate, subsamplingRate=p.row_sample,
                featureSubsetStrategy=str(p.column_sample), seed=p.seed))
    raise ValueError(f"unknown estimator {p.estimator!r}")


def _fit(p: TrainParams, data: DataFrame):
    """Fit and keep the model without its training summary.

    The summary of a two-class forest refers to the session, which makes later use of the model
    fail to serialise; a copy has none.
    """
    return _estimator(p).fit(data).copy()


def train(labelled: DataFrame, params: TrainParams | None = None, label: str = "regime",
          order: str = "date") -> tuple[RegimeModel, DataFrame | None]:
    """Cross-validate over chronological folds, refit on everything; no folds, no validation.

    ``labelled`` is the daily feature matrix with a label column; unlabelled days are dropped.
    Classes are indexed once over the whole set, so a fold that lacks a class still trains.
    Returns the model and the fold predictions (fold, label, prediction), from which
    ``class_report`` derives all metrics.
    """
    p = params or TrainParams()
    known = labelled.where(F.col(label).isNotNull())
    names = [c for c in known.columns if c not in (order, label, "vix")]
    # A daily table: cached so that labelling runs once, not once per fold.
    rows = select_features(known, names, (order, label)).persist()
    try:
        indexer: StringIndexerModel = StringIndexer(
            inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
        assembler = VectorAssembler(inputCols=names, outputCol="_features")
        data = assembler.transform(indexer.transform(rows)).select(
            order, label, "_label", "_features")
        scored = None
        if p.folds:
            split = ts_split(data, p.folds, order)
        for i in range(p.folds):
            fold = split.where(F.col("fold") == i)
            fitted = _fit(p, fold.where(F.col("part") == "train"))
            out = fitted.transform(fold.where(F.col("part") == "test")).select(
                F.lit(i).alias("fold"), F.col(label).alias("label"),
                _class_name(indexer.labels, F.col("prediction")).alias("prediction"))
            scored = out if scored is None else scored.unionByName(out)
        if scored is not None:  # one row per test day; kept, so reports do not predict again
            scored = materialised(scored, "folds")
        final = _fit(p, data)
    finally:
        rows.unpersist()
    stages = PipelineModel(stages=[assembler, final])
    return RegimeModel(stages, list(indexer.labels), names, dict(vars(p))), scored


def _class_name(classes: Sequence[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in classes]), (index + 1).cast("int"))


def _probabilities(model: RegimeModel, scored: DataFrame) -> Column:
    """Class probabilities as an array; boosted one-vs-rest scores are squashed and rescaled."""
    if "probability" in scored.columns:
        return vector_to_array("probability")
    raw = F.transform(vector_to_array("rawPrediction"), lambda s: 1.0 / (1.0 + F.exp(-2.0 * s)))
    total = F.aggregate(raw, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(raw, lambda v: v / total)


def predict_all(model: RegimeModel, matrix: DataFrame, order: str = "date") -> DataFrame:
    """Regime, confidence and class probabilities of each day."""
    data = select_features(matrix, model.features, (order,))
    scored = model.stages.transform(data)
    scored = scored.withColumn("_p", _probabilities(model, scored))
    best = F.array_max("_p")
    out = scored.select(
        order, best.alias("confidence"), _class_name(
            model.classes, F.array_position("_p", best) - 1).alias("regime"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in model.classes]), F.col("_p")).alias(
            "probabilities"))
    prob = {c: F.coalesce(F.try_element_at("probabilities", F.lit(c)), F.lit(0.0))
            for c in ("risk_on", "risk_off", "transition")}
    return out.select(order, "regime", "confidence", "probabilities",
                      *[v.alias(f"{c}_prob") for c, v in prob.items()])


def predict_latest(model: RegimeModel | None, matrix: DataFrame, order: str = "date"
                   ) -> DataFrame:
    """The newest day only; without a model its regime is ``unknown``."""
    latest = tail_n(matrix, 1, order)
    if model is None:
        return latest.select(
            order, F.lit("unknown").alias("regime"), F.lit(None).cast("double").alias(
                "confidence"), F.create_map().cast("map<string,double>").alias("probabilities"))
    return predict_all(model, latest, order).select(
        order, "regime", "confidence", "probabilities")


def contributions(model: RegimeModel, matrix: DataFrame, order: str = "date") -> DataFrame:
    """(day, feature, class, phi, base): exact Shapley values of every day's score of every class.

    For a forest the score is the class probability, for the boosted form the class's margin before
    it is squashed. ``base`` is the score with no feature known; base and a day's phi sum to its
    score. Days are explained in Arrow batches; the trees, bounded by the training parameters, travel
    with the kernel.
    """
    names, classes = model.features, model.classes
    data = select_features(matrix, names, (order,))
    groups, base = leaves_of(node_table(model.stages.stages[-1]).collect(), len(classes))
    schema = StructType([data.schema[order], *StructType.fromDDL(
        "feature string, class string, phi double, base double").fields])

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
                                 for c in names])
            phi = shapley(groups, x, len(classes))
            n, cells = len(x), len(names) * len(classes)
            yield pa.RecordBatch.from_arrays([
                batch.column(order).take(np.repeat(np.arange(n), cells)),
                pa.array(np.tile(np.repeat(names, len(classes)), n), pa.string()),
                pa.array(np.tile(classes, n * len(names)), pa.string()), pa.array(phi.ravel()),
                pa.array(np.tile(base, n * len(names)))], schema.names)

    return data.mapInArrow(explain, schema)


def attribution(model: RegimeModel, matrix: DataFrame, n: int = 50, order: str = "date") -> DataFrame:
    """Mean absolute Shapley value of each feature over the last ``n`` days and all classes."""
    return contributions(model, tail_n(matrix, n, order), order).groupBy("feature").agg(
        F.avg(F.abs("phi")).alias("mean_shap")).orderBy(F.col("mean_shap").desc(), "feature")


def top_attribution(scores: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` features with the largest mean contribution; ties by name."""
    return scores.orderBy(F.col("mean_shap").desc(), "feature").limit(n)


def split_importance(spark: SparkSession, model: RegimeModel) -> DataFrame:
    """Impurity-based importances of a forest: a cheap first look."""
    forest = model.stages.stages[-1]
    pairs = zip(model.features, forest.featureImportances.toArray().tolist())
    return spark.createDataFrame(list(pairs), "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature")


def save_model(model: RegimeModel, path: str) -> None:
    """Stages through Spark ML's writer, classes and feature order as a one-row table."""
    spark = SparkSession.active()
    model.stages.write().overwrite().save(f"{path}/stages")
    meta = [(model.classes, model.features, json.dumps(model.params))]
    spark.createDataFrame(
        meta, "classes array<string>, features array<string>, params string",
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_optional(path: str) -> RegimeModel | None:
    """The stored model, or None where none was saved yet."""
    try:
        return load_model(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_model(path: str) -> RegimeModel:
    meta = SparkSession.active().read.parquet(f"{path}/meta").first()
    return RegimeModel(PipelineModel.load(f"{path}/stages"), list(meta["classes"]),
                       list(meta["features"]), json.loads(meta["params"]))
