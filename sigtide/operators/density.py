"""Density topics: components of mutual reachability over growing radii, cut by stability.

The number of topics is found, not given, and rows in thin places are noise. Two points are linked at a
radius when both have ``min_samples`` points (themselves included) within it and they lie no further
apart. Components grow with the radius; those of at least ``min_topic_size`` rows form a tree, and the
cut through that tree with the largest stability gives the topics.

Equal vectors are one weighted point, so a hot vector costs one row. Points lie in blocks of bounded size
inside the cells of a k-d tree, whose boxes are measured. A point meets another block only where that
block's box lies within the point's own reach, so in few dimensions a point meets a bounded number of
blocks, however many there are. A pair of blocks reports nearest distances, or one link for each pair of
their inner components and radius, never its pairs of points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.functions.text import TOKEN_BREAK
from sigtide.session import materialised

BLOCK = 1024  # most points of a block, on average; a larger cell becomes several blocks
CELLS = 4096  # bound on the cells
SAMPLE = 32  # points per cell that the tree is built from
BOXES = 1 << 18  # bound on cells times dimensions
SOURCES = 16  # neighbouring blocks whose points ask a block together
UNLINKED = np.iinfo(np.int16).max


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances from plain differences: the same value for a pair wherever it is computed."""
    out = np.zeros((len(a), len(b)))
    step = max(1, (1 << 17) // max(1, len(b)))
    for start in range(0, len(a), step):
        part = out[start:start + step]
        for own, other in zip(a[start:start + step].T, b.T):
            gap = own[:, None] - other[None]
            part += np.multiply(gap, gap, out=gap)
        np.sqrt(part, out=part)
    return out


def text_points(df: DataFrame, column: str = "body", dims: int = 5, width: int = 512,
                out: str = "embedding", keep: Sequence[str] | None = None) -> DataFrame:
    """Rows with a point of few dimensions per whole text: principal axes of normalised TF-IDF counts.

    Words are hashed to ``width`` columns; the axes come from all rows by one aggregation of a matrix of
    ``width`` squared. A NULL text counts as empty, and empty texts lie at the origin. Texts are split
    once, into a table of word counts in the shared folder that holds the columns ``keep`` (default:
    all) and that the fits and the caller read.
    """
    kept = list(df.columns if keep is None else keep)
    words = PipelineModel([
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=TOKEN_BREAK),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=width)])
    counted = materialised(words.transform(df.withColumn(
        "_text", F.coalesce(column, F.lit("")))).select(*kept, "_counts"), "density-counts")
    fitted = Pipeline(stages=[
        IDF(inputCol="_counts", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="_unit"),
        PCA(inputCol="_unit", outputCol="_axes", k=dims)]).fit(counted)
    return fitted.transform(counted).select(*kept, vector_to_array("_axes").alias(out))


class _Tree:
    """Median splits of a sample along its widest axis; leaves are numbered from low to high."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.leaves, self.splits = 0, []
        self.root = self._grow(sample, leaves)
        self.axis, self.cut, self.low, self.high = (
            np.array(c, kind) for c, kind in zip(zip(*self.splits), (int, float, int, int))
        ) if self.splits else (np.zeros(0, int),) * 4

    def _grow(self, rows: np.ndarray, leaves: int) -> int:
        """Place of the split, or a leaf's number as its complement."""
        axis = int(np.ptp(rows, axis=0).argmax()) if len(rows) > 1 else 0
        values = np.sort(rows[:, axis])
        if leaves < 2 or len(rows) < 2 or values[0] == values[-1]:
            self.leaves += 1
            return ~(self.leaves - 1)
        cut = values[len(values) // 2]
        if cut == values[0]:
            cut = values[values > cut][0]
        below, at = rows[:, axis] < cut, len(self.splits)
        share = min(leaves - 1, max(1, round(leaves * float(below.mean()))))
        self.splits.append(None)
        self.splits[at] = (axis, cut, self._grow(rows[below], share),
                           self._grow(rows[~below], leaves - share))
        return at

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        at = np.full(len(x), self.root)
        while len(left := np.flatnonzero(at >= 0)):
            split = at[left]
            at[left] = np.where(x[left, self.axis[split]] < self.cut[split],
                                self.low[split], self.high[split])
        return ~at


class _Cells:
    """Points placed in the leaves of a tree, in blocks."""

    def __init__(self, points: DataFrame) -> None:
        spark = points.sparkSession
        total, dims = points.agg(F.count(F.lit(1)), F.max(F.size("x"))).head()
        wanted = max(1, min(CELLS, BOXES // dims, -(-2 * total // BLOCK)))
        # about SAMPLE rows per cell reach the driver
        drawn = points.where(F.pmod(F.xxhash64("x"), F.lit(total)) < SAMPLE * wanted)
        sample = np.array([r["x"] for r in drawn.select("x").orderBy("x").collect()], float)
        tree = _Tree(sample.reshape(-1, dims), wanted)
        self.count, self.dims = tree.leaves, dims

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield batch.assign(cell=tree.place(np.stack(batch["x"].to_numpy())))

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
        placed = materialised(points.mapInPandas(place, f"{kinds}, cell int"), "density-cells")
        found = dict(placed.groupBy("cell").count().collect())
        parts = [-(-found.get(c, 0) // BLOCK) for c in range(self.count)]
        starts = np.concatenate([[0], np.cumsum(parts)]).astype(int)
        self.table = spark.createDataFrame(
            [(c, int(starts[c]), int(parts[c])) for c in range(self.count) if parts[c]],
            "cell int, start long, parts long")
        self.points = placed.join(F.broadcast(self.table), "cell").withColumn(
            "block", F.col("start") + F.pmod(F.xxhash64("node"), "parts")).drop("start", "parts")

    def boxes(self, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest coordinates of the rows of each cell; an empty cell is out of reach."""
        low = np.full((self.count, self.dims), np.inf)
        high = -low
        found = rows.select("cell", F.posexplode("x").alias("axis", "v")).groupBy("cell", "axis").agg(
            F.min("v").alias("low"), F.max("v").alias("high")).collect()  # at most BOXES rows
        for r in found:
            low[r["cell"], r["axis"]], high[r["cell"], r["axis"]] = r["low"], r["high"]
        return low, high

    def meetings(self, rows: DataFrame) -> DataFrame:
        """Rows once per other block (``target``) of the cells in their column ``cells``."""
        at = F.explode(F.sequence("start", F.col("start") + F.col("parts") - 1))
        return (rows.withColumn("cell", F.explode("cells")).drop("cells")
                .join(F.broadcast(self.table), "cell").withColumn("target", at)
                .where("target <> block").drop("cell", "start", "parts"))


def _reached(x: np.ndarray, reach: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Per point the cells whose box lies within its reach."""
    first, last = x.min(axis=0), x.max(axis=0)
    apart = np.sqrt((np.maximum(np.maximum(low - last, first - high), 0) ** 2).sum(axis=1))
    cells = np.flatnonzero(apart <= reach.max() * (1 + 1e-9))
    out = []
    step = max(1, (1 << 20) // max(1, len(cells)))
    for start in range(0, len(x), step):
        part = x[start:start + step]
        gaps = np.zeros((len(part), len(cells)))
        for own, lo, hi in zip(part.T, low[cells].T, high[cells].T):
            gaps += np.maximum(np.maximum(lo - own[:, None], own[:, None] - hi), 0) ** 2
        near = np.sqrt(gaps) <= reach[start:start + step, None] * (1 + 1e-9)
        out += [cells[hit].astype("int32") for hit in near]
    return out


def _nearest(gaps: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and weights of the nearest ``k`` columns of each row, nearest first."""
    if gaps.shape[1] > k:
        some = np.argpartition(gaps, k - 1, axis=1)[:, :k]
    else:
        some = np.broadcast_to(np.arange(gaps.shape[1]), gaps.shape)
    near = np.take_along_axis(gaps, some, axis=1)
    order = np.argsort(near, axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1), weight[np.take_along_axis(some, order, axis=1)]


def _near_inside(k: int, low: np.ndarray, high: np.ndarray) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Kernel: per point its nearest ``k`` points of its own block, and the cells it must ask."""
    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["x"].to_numpy())
        near, weight = _nearest(_distances(x, x), pdf["weight"].to_numpy(), k)
        enough = weight.cumsum(axis=1) >= k
        bound = np.where(enough.any(axis=1), near[np.arange(len(x)), enough.argmax(axis=1)], np.inf)
        return pdf[["node", "x", "block"]].assign(
            bound=bound, d=list(near), w=list(weight), cells=_reached(x, bound, low, high))

    return nearest


def _near_across(k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Kernel: per asking point its nearest ``k`` points of a block, if any lies within its bound."""
    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["weight"].isna()
        asking, block = pdf[asks], pdf[~asks]
        x, weight = np.stack(block["x"].to_numpy()), block["weight"].to_numpy().astype("int64")
        out = [pd.DataFrame({"node": [], "d": [], "w": []}, dtype=object)]
        for start in range(0, len(asking), BLOCK):
            part = asking.iloc[start:start + BLOCK]
            gaps = _distances(np.stack(part["x"].to_numpy()), x)
            hit = gaps.min(axis=1) <= part["bound"].to_numpy()
            if hit.any():
                near, heavy = _nearest(gaps[hit], weight, k)
                out.append(pd.DataFrame({"node": part["node"].to_numpy()[hit], "d": list(near),
                                         "w": list(heavy)}))
        return pd.concat(out[1:] or out)

    return nearest


def _forest(level: np.ndarray) -> list[tuple[int, int, int]]:
    """Edges (from, to, level) of a smallest spanning forest of a symmetric matrix of levels."""
    size = len(level)
    best = np.full(size, UNLINKED, np.int32)
    via = np.zeros(size, int)
    todo = np.ones(size, bool)
    out = []
    for _ in range(size):
        node = int(np.where(todo, best, UNLINKED + 1).argmin())
        if best[node] < UNLINKED:
            out.append((int(via[node]), node, int(best[node])))
        todo[node] = False
        better = todo & (level[node] < best)
        best[better] = level[node][better]
        via[better] = node
    return out


def _link_inside(radii: Sequence[float], low: np.ndarray, high: np.ndarray
                 ) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Kernel: a spanning forest of the links inside a block, as one link per point (roots: to
    themselves); the component of each point at each radius; and the cells that the point may link to."""
    steps = np.array(radii)

    def linking(pdf: pd.DataFrame) -> pd.DataFrame:
        x, core, nodes = np.stack(pdf["x"].to_numpy()), pdf["core"].to_numpy(), pdf["node"].to_numpy()
        level = np.searchsorted(steps, np.maximum(
            _distances(x, x), np.maximum(core[:, None], core[None])), side="left").astype(np.int32)
        level[level == len(steps)] = UNLINKED
        up, at = np.arange(len(x)), np.zeros(len(x), int)
        name = np.arange(len(x), dtype=np.int32)
        labels = np.empty((len(x), len(steps)), np.int32)
        found = _forest(level)
        for t in range(len(steps)):
            for i, j, _ in (link for link in found if link[2] == t):
                up[j], at[j] = i, t
                name[name == name[j]] = name[i]
            labels[:, t] = name
        return pdf[["node", "x", "block", "core"]].assign(
            up=nodes[up], level=at, labels=list(labels),
            cells=_reached(x, np.full(len(x), steps[-1]), low, high))

    return linking


def _link_across(radii: Sequence[float]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Kernel: links between two blocks, one per pair of their inner components and radius, and only
    where no smaller radius has linked the same two.

    Together with the forests inside the blocks they have the components of all links, radius by radius.
    """
    steps = np.array(radii)

    def linking(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["block"] == pdf["low"]
        a, b = pdf[own], pdf[~own]
        if a.empty or b.empty:
            return pd.DataFrame({"a": [], "b": [], "level": []})
        gaps = _distances(np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy()))
        i, j = np.nonzero(gaps <= steps[-1])
        level = np.searchsorted(steps, np.maximum(gaps[i, j], np.maximum(
            a["core"].to_numpy()[i], b["core"].to_numpy()[j])), side="left")
        names = [np.stack(side["labels"].to_numpy()).astype(np.int64) for side in (a, b)]
        kept = np.zeros(0, int)
        for t in np.unique(level):
            pair = (names[0][i, t] << 32) | names[1][j, t]
            fresh = np.flatnonzero(level == t)
            fresh = fresh[~np.isin(pair[fresh], pair[kept])]
            kept = np.concatenate([kept, fresh[np.unique(pair[fresh], return_index=True)[1]]])
        return pd.DataFrame({"a": a["node"].to_numpy()[i[kept]], "b": b["node"].to_numpy()[j[kept]],
                             "level": level[kept]})

    return linking


def core_distances(cells: _Cells, min_samples: int) -> DataFrame:
    """Points with ``core``, the radius that holds ``min_samples`` rows; NULL where there are fewer.

    The own block gives each point an upper bound; it asks only the blocks within that bound. Points of
    neighbouring blocks ask together, so a block is copied once for several of them.
    """
    rows = cells.points
    id_type = rows.schema["node"].dataType.simpleString()
    near = f"node {id_type}, d array<double>, w array<bigint>"
    inside = materialised(rows.groupBy("block").applyInPandas(
        _near_inside(min_samples, *cells.boxes(rows)),
        f"{near}, x array<double>, block long, bound double, cells array<int>"), "density-near")
    asking = cells.meetings(inside.select("node", "x", "block", "bound", "cells")).select(
        "target", F.floor(F.col("block") / SOURCES).alias("source"), "node", "x", "bound",
        F.lit(None).cast("bigint").alias("weight"))
    asked = asking.select("target", "source").distinct().join(
        rows.select(F.col("block").alias("target"), "node", "x", "weight"), "target")
    across = asking.unionByName(asked, allowMissingColumns=True).groupBy(
        "target", "source").applyInPandas(_near_across(min_samples), near)
    lists = inside.select("node", "d", "w").unionByName(across).select(
        "node", F.arrays_zip("d", "w").alias("near"))
    merged = lists.groupBy("node").agg(F.flatten(F.collect_list("near")).alias("near"))
    taken = F.aggregate(
        F.array_sort("near"), F.struct(F.lit(0).cast("bigint").alias("w"), F.lit(None).cast(
            "double").alias("d")),
        lambda s, e: F.struct((s["w"] + e["w"]).alias("w"), F.when(
            s["w"] < min_samples, e["d"]).otherwise(s["d"]).alias("d")))
    found = merged.select("node", taken.alias("_taken")).select(
        "node", F.when(F.col("_taken.w") >= min_samples, F.col("_taken.d")).alias("core"))
    return materialised(rows.join(found, "node"), "density-core")


def density_links(cells: _Cells, dense: DataFrame, radii: Sequence[float]) -> DataFrame:
    """Links (a, b, level of the radius) with the components of all links at every radius."""
    id_type = dense.schema["node"].dataType.simpleString()
    inside = materialised(dense.groupBy("block").applyInPandas(
        _link_inside(radii, *cells.boxes(dense)),
        f"node {id_type}, x array<double>, block long, core double, up {id_type}, level int, "
        "labels array<int>, cells array<int>"), "density-inside")
    across = cells.meetings(inside.drop("up", "level")).withColumns({
        "low": F.least("block", "target"), "high": F.greatest("block", "target")}).drop(
        "target").groupBy("low", "high").applyInPandas(
        _link_across(radii), f"a {id_type}, b {id_type}, level int")
    own = inside.where("up <> node").select(
        F.col("up").alias("a"), F.col("node").alias("b"), "level")
    return materialised(own.unionByName(across), "density-links")


def density_radii(cores: DataFrame, levels: int = 10) -> list[float]:
    """Growing radii: quantiles 0.05 to 0.95 of the core distances (equal ones once).

    Quantiles are approximate beyond 10,000 points. Points with a larger core distance are noise.
    """
    shares = [float(q) for q in np.linspace(0.05, 0.95, levels)]
    found = cores.agg(F.percentile_approx("core", shares, 10000)).head()[0]
    return sorted(set(found or []))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (a, b); ``comp`` is the smallest node it reaches.

    Alternates large and small stars until only stars are left; each round is one stored table, and a
    node never gathers its neighbours.
    """
    stars = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        large = both.join(low, "a").where("b > a").select(
            F.col("b").alias("a"), F.least("a", "low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where(
            "a <> b").unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        stars = materialised(small, "density-stars")
        # a star: no node has two targets, and none that has one is a target
        ends = stars.select(F.col("a").alias("n"), F.lit(1).alias("from")).unionByName(
            stars.select(F.col("b").alias("n"), F.lit(None).cast("int").alias("from")))
        if ends.groupBy("n").agg(F.count("from").alias("out"), F.count(F.lit(1)).alias("all")).where(
                "out > 1 or (out = 1 and all > 1)").isEmpty():
            break
    names = stars.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return names.unionByName(roots)


def _hierarchy(points: DataFrame, edges: DataFrame, levels: int) -> list[DataFrame]:
    """Per radius the components (and points new at it) below, the component they join, and their rows."""
    ups: list[DataFrame] = []
    linked = {r["level"] for r in edges.select("level").distinct().collect()}  # at most one per radius
    for t in range(levels):
        active = points.where(F.col("entry") == t).select(
            F.col("node").alias("comp"), F.col("weight").alias("size"), F.lit(True).alias("new"))
        if ups:
            active = active.unionByName(ups[-1].groupBy(F.col("to").alias("comp")).agg(
                F.sum("size").alias("size"), F.lit(False).alias("new")))
        if t not in linked:
            ups.append(materialised(active.withColumn("to", F.col("comp")), "density-level"))
            continue
        stars = components(edges.where(F.col("level") == t))
        ups.append(materialised(active.join(
            stars.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left")
            .withColumn("to", F.coalesce("to", "comp")), "density-level"))
        if t + 1 < levels:
            for end in ("a", "b"):
                edges = edges.join(stars.select(F.col("node").alias(end), F.col("comp").alias("_to")),
                                   end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
            edges = materialised(edges.where((F.col("level") > t) & (F.col("a") != F.col("b"))).groupBy(
                F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
                F.min("level").alias("level")), "density-links")
    return ups


def _segments(ups: list[DataFrame], radii: Sequence[float], min_topic_size: int) -> list[DataFrame]:
    """Per radius the components that are large enough, with the stability of the cluster they belong to.

    A cluster is a chain of components in which no two large ones meet. Its stability ``own`` is the sum
    of rows times the fall of 1 / radius from one step to the next; ``below`` is the best of the clusters
    that meet at its lower end, ``parts`` how many large components a component has directly below.
    """
    density = [1 / max(r, 1e-300) for r in radii]
    out: list[DataFrame] = []
    for t, up in enumerate(ups):
        width = density[t] - density[t + 1] if t + 1 < len(radii) else 0.0
        large = up.groupBy(F.col("to").alias("comp")).agg(F.sum("size").alias("size")).where(
            F.col("size") >= min_topic_size)
        gain = F.col("size") * F.lit(width)
        if not out:
            seg = large.withColumns({"own": gain, "below": F.lit(0.0), "parts": F.lit(0).cast("long")})
        else:
            kids = out[-1].join(up.where("not new").select("comp", "to"), "comp").groupBy(
                F.col("to").alias("comp")).agg(
                F.count(F.lit(1)).alias("parts"), F.max("own").alias("kid_own"),
                F.max("below").alias("kid_below"),
                F.sum(F.greatest("own", "below")).alias("kid_best"))
            one = F.col("parts") == 1
            seg = large.join(kids, "comp", "left").select(
                "comp", "size", (gain + F.when(one, F.col("kid_own")).otherwise(0.0)).alias("own"),
                F.when(one, F.col("kid_below")).when(F.col("parts") > 1, F.col("kid_best")).otherwise(
                    0.0).alias("below"), F.coalesce("parts", F.lit(0)).alias("parts"))
        out.append(materialised(seg, "density-segments"))
    return out


def _cut(ups: list[DataFrame], segments: list[DataFrame]) -> DataFrame:
    """(node, topic) of all points in a topic: the highest clusters no less stable than what lies below."""
    chosen = F.col("own") >= F.col("below")
    labels = segments[-1].where(chosen).select("comp", F.col("comp").alias("topic"))
    nodes = None
    for t in reversed(range(len(ups))):
        named = labels.withColumnRenamed("comp", "to")
        got = materialised(ups[t].join(named, "to"), "density-labels")
        own = got.where("new").select(F.col("comp").alias("node"), "topic")
        nodes = own if nodes is None else nodes.unionByName(own)
        if t:
            meets = segments[t].where("parts > 1").select(F.col("comp").alias("to")).join(
                named, "to", "left_anti")
            tops = segments[t - 1].where(chosen).join(
                ups[t].where("not new").select("comp", "to"), "comp").join(meets, "to", "left_semi")
            labels = got.where("not new").select("comp", "topic").unionByName(
                tops.select("comp", F.col("comp").alias("topic")))
    return nodes


def density_topics(df: DataFrame, column: str = "embedding", key: str = "doc_id",
                   min_topic_size: int = 10, min_samples: int = 5, levels: int = 10,
                   radii: Sequence[float] | None = None) -> DataFrame:
    """Each row with ``topic_id``, the smallest ``key`` of its topic, and ``topic_prob``.

    The hierarchy is looked at in at most ``levels`` radii (``density_radii``) or in the given ``radii``.
    The probability is the topic's smallest radius at which a point takes part, over that of the row's
    point. Rows in no topic, without a vector, or with components that are missing or not finite are
    noise (-1, probability 0); an empty table gives an empty one. Vectors have one length; keys are not
    negative. Exact for its radii; where no box separates the vectors every pair of blocks meets, so
    reduce many dimensions first.
    """
    x = F.col(column).cast("array<double>")
    # -0.0 and 0.0 are one value; anything that is not finite fails the comparison or is NULL
    sound = F.size(x) > 0
    sound = sound & F.forall(x, lambda v: F.coalesce(
        ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = df.withColumn("_x", F.when(sound, F.transform(x, lambda v: v + F.lit(0.0))))
    points = materialised(rows.where(F.col("_x").isNotNull()).groupBy(F.col("_x").alias("x")).agg(
        F.min(key).alias("node"), F.count(F.lit(1)).alias("weight")), "density-points")
    noise = F.lit(K.NOISE_TOPIC_ID).cast(df.schema[key].dataType)
    none = df.withColumns({"topic_id": noise, "topic_prob": F.lit(0.0)})
    if points.isEmpty():
        return none
    cells = _Cells(points)
    cores = core_distances(cells, min_samples)
    steps = sorted(set(radii)) if radii is not None else density_radii(cores, levels)
    if not steps:
        return none
    entry = F.array_min(F.array(*[
        F.when(F.col("core") <= r, F.lit(i)) for i, r in enumerate(steps)]))
    dense = materialised(cores.withColumn("entry", entry).where(F.col("entry").isNotNull()),
                         "density-dense")
    edges = density_links(cells, dense, steps)
    ups = _hierarchy(dense, edges, len(steps))
    found = _cut(ups, _segments(ups, steps, min_topic_size))
    radius = F.element_at(F.array(*[F.lit(float(r)) for r in steps]), F.col("entry") + 1)
    named = materialised(dense.join(found, "node").select("x", "topic", radius.alias("radius")),
                         "density-named")
    least = named.groupBy("topic").agg(F.min("radius").alias("least"))
    share = F.when(F.col("radius") > 0, F.col("least") / F.col("radius")).otherwise(1.0)
    topics = named.join(least, "topic").select(
        F.col("x").alias("_x"), F.col("topic").alias("_topic"), share.alias("_share"))
    return rows.join(topics, "_x", "left").select(
        *df.columns, F.coalesce("_topic", noise).alias("topic_id"),
        F.coalesce("_share", F.lit(0.0)).alias("topic_prob"))
