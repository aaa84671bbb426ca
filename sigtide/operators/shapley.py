"""Exact Shapley values of tree ensembles, path-dependent: an unknown feature follows both branches
of a split, weighted by the training rows that went each way.

A leaf is a box: the interval each feature of its path must lie in, and the share of rows that reach
it when that feature is unknown. Its part of a feature's value is a sum over subsets of the other
features of its path, which is a polynomial product, so no subset is ever listed. All leaves with
equally many features are worked on together, for a batch of rows at once.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from math import factorial

import numpy as np
from pyspark.ml.classification import OneVsRestModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtide.session import scratch_path

CELLS = 1 << 21  # rows x leaves x features held at once


@dataclass
class Leaves:
    """Leaves with the same number of path features, one row each."""

    feature: np.ndarray  # leaves x path features
    low: np.ndarray      # exclusive
    high: np.ndarray     # inclusive
    share: np.ndarray    # of the rows of the path that follow the feature's splits
    value: np.ndarray    # leaves x outputs


def node_table(model) -> DataFrame:
    """(output, tree, weight, and the fields of a node) of a fitted forest or boosted ensemble.

    ``output`` is NULL where a node's statistics hold all outputs (a forest), else the class a
    one-vs-rest ensemble scores. The table has trees times 2 ** (depth + 1) rows at most.
    """
    spark = SparkSession.active()
    parts = [(k, m) for k, m in enumerate(model.models)] if isinstance(model, OneVsRestModel) else [(None, model)]
    out = None
    for output, one in parts:
        path = scratch_path(spark, "trees")
        one.write().save(path)
        weights = F.array(*[F.lit(float(w)) for w in one.treeWeights])
        nodes = spark.read.parquet(f"{path}/data").select(
            F.lit(output).cast("int").alias("output"), F.col("treeID").alias("tree"),
            F.element_at(weights, F.col("treeID") + 1).alias("weight"), "nodeData.*")
        out = nodes if out is None else out.unionByName(nodes)
    return out


def leaves_of(nodes: list, n_outputs: int) -> tuple[list[Leaves], np.ndarray]:
    """Leaves grouped by their number of path features, and the mean output over all leaves.

    ``nodes`` are the rows of ``node_table``. A forest's trees vote with equal weight.
    """
    trees: dict = defaultdict(dict)
    for r in nodes:
        trees[r["output"], r["tree"]][r["id"]] = r
    found = defaultdict(list)
    base = np.zeros(n_outputs)
    for (output, _), tree in trees.items():
        todo = [(0, {}, 1.0)]
        while todo:
            at, path, reached = todo.pop()
            node = tree[at]
            if node["leftChild"] < 0:
                value = np.zeros(n_outputs)
                if output is None:
                    stats = np.array(node["impurityStats"])
                    value[:len(stats)] = stats / stats.sum() / len(trees)
                else:
                    value[output] = node["weight"] * node["prediction"]
                base += reached * value
                found[len(path)].append((path, value))
                continue
            split = node["split"]
            f, threshold = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
            if split["numCategories"] != -1:
                raise ValueError("only splits of continuous features are explained")
            size = {c: _size(tree[c]) for c in (node["leftChild"], node["rightChild"])}
            for child, side in ((node["leftChild"], "high"), (node["rightChild"], "low")):
                part = size[child] / sum(size.values())
                low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
                box = (low, min(high, threshold)) if side == "high" else (max(low, threshold), high)
                todo.append((child, {**path, f: (*box, share * part)}, reached * part))
    groups = []
    for width, leaves in sorted(found.items()):
        if width:
            box = np.array([list(p.values()) for p, _ in leaves])
            groups.append(Leaves(np.array([list(p) for p, _ in leaves]), box[:, :, 0], box[:, :, 1],
                                 box[:, :, 2], np.array([v for _, v in leaves])))
    return groups, base


def _size(node) -> float:
    """Training weight of a node: class counts of a classifier, the count of a regressor."""
    return node["impurityStats"][0] if node["output"] is not None else sum(node["impurityStats"])


def shapley(groups: list[Leaves], x: np.ndarray, n_outputs: int) -> np.ndarray:
    """Shapley values, rows x features x outputs."""
    out = np.zeros((*x.shape, n_outputs))
    for g in groups:
        leaves, width = g.feature.shape
        # sizes of subsets of the others: k! (width - 1 - k)! / width!
        weight = [factorial(k) * factorial(width - 1 - k) / factorial(width) for k in range(width)]
        step = max(1, CELLS // (leaves * width))
        for start in range(0, len(x), step):
            values = x[start:start + step][:, g.feature]
            inside = ((values > g.low) & (values <= g.high)).astype(float)
            for i in range(width):
                subsets = [np.ones(inside.shape[:2])]
                for j in range(width):
                    if j != i:
                        known, unknown = inside[:, :, j], g.share[:, j]
                        grown = [s * unknown for s in subsets] + [np.zeros(inside.shape[:2])]
                        for k, s in enumerate(subsets):
                            grown[k + 1] += s * known
                        subsets = grown
                part = sum(w * s for w, s in zip(weight, subsets, strict=True)) * (
                    inside[:, :, i] - g.share[:, i])
                for f in np.unique(g.feature[:, i]):
                    of = g.feature[:, i] == f
                    out[start:start + step, f] += part[:, of] @ g.value[of]
    return out
