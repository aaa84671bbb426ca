"""Connected components and blocks of bounded size, shared by the pair operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtide.llm.arrow import map_arrow
from sigtide.session import materialised

SALTS = 8
ONE_TASK = 1 << 21  # edges that one task links in memory, about 120 bytes each


def _salted_min(pairs: DataFrame) -> DataFrame:
    """(src, dst, low): every pair with the smallest node among src and its partners.

    The minimum is combined before the shuffle. A node with very many partners meets its minimum
    in ``SALTS`` tasks; the minima are repeated so often, the pairs are not.
    """
    low = pairs.groupBy("src").agg(F.min("dst").alias("low")).select(
        "src", F.least("src", "low").alias("low"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return pairs.withColumn("salt", F.pmod(F.hash("dst"), F.lit(SALTS))).join(low, ["src", "salt"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst: long); root is the smallest node reachable.

    Up to ``ONE_TASK`` distinct edges are linked by one task. More of them are rewired in two ways by
    turns: each node's larger neighbours to its smallest one, then each node's smaller neighbours
    likewise, until one task can hold what is left or nothing changes. Both keep the components; the
    number of rounds is logarithmic. A round loads the driver with many stages to plan, however few
    edges it has. No adjacency list is ever gathered. Every round and the result are written below
    ``spark.checkpoint.dir``.
    """
    now = materialised(edges.where("src <> dst").select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(),
        "edges")
    sign = None
    got = (now.count(),)
    while True:
        if got[0] <= ONE_TASK:
            return materialised(_linked(now), "roots")
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        large = _salted_min(both).where("dst > src").select(
            F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        small = _salted_min(large)
        small = small.where("dst <> low").select(
            F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(
            small.select("src", F.col("low").alias("dst"))).where("src <> dst").distinct()
        now = materialised(small, "edges")
        got = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if got == sign:
            break
        sign = got
    return materialised(now.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(
        now.select(F.col("dst").alias("node"), F.col("dst").alias("root"))).distinct(), "roots")


def _linked(edges: DataFrame) -> DataFrame:
    """(node, root) of all ``edges``, by one task that holds them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([b.column(c).to_numpy() for c in ("src", "dst")]) for b in batches]
        ends = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)
        del parts
        # nodes are numbered in their order, so the smallest number is the smallest node
        nodes, at = np.unique(ends, return_inverse=True)
        root = nodes[forest(len(nodes), *at.reshape(ends.shape))]
        for i in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[i:i + (1 << 16)]), pa.array(root[i:i + (1 << 16)])], ["node", "root"])

    return map_arrow(edges.select("src", "dst").coalesce(1), run, "node long, root long")


def forest(n: int, left, right):
    """Root per item after linking left[i] with right[i]: a union-find inside one task."""
    root = np.arange(n)
    while True:
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
