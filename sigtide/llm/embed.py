"""Exact near-duplicates of embeddings by dual traversal of cover trees.

1. Equal vectors form a class; one stands for it. Vectors are normalised in double precision.
2. Pivots (a bounded farthest-first set from a bounded sample) are the top level; every vector goes
   to its nearest pivot. Cells are cut into blocks of at most about ``BLOCK`` rows, so the number of
   pivots only steers how well cells separate, never how much a task holds.
3. Each block builds its cover tree once: nested nets with halving radii, ``RADII``; every vector
   carries its node on each level. Covering radii are measured, not assumed.
4. Pairs of cells, then pairs of nodes level by level, are dropped when the distance of their
   centres exceeds both radii and the threshold, and accepted whole when it and both radii lie
   within it; what is left is compared by its cosine. Only link counts and a spanning forest leave
   a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtide.llm.graph import components, forest
from sigtide.session import materialised

THRESHOLD = 0.95
BLOCK = 8192
SAMPLE, MAX_PIVOTS = 4096, 1024
RADII = (0.5, 0.25, 0.125)
SLACK = 1e-7  # bounds keep this distance from a decision; cosines decide there
SINGLE = 1e-5  # the same for cosines in single precision


def unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def net(x: np.ndarray, rows: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Greedy net of x[rows]: every row's centre, as an index into x, and the order of centres.

    Centres come in row order; rows within ``radius`` of an earlier centre are covered by it.
    Candidates are compared in batches, so the work is matrix products; single precision will do,
    as covering radii are measured afterwards.
    """
    single = x[rows].astype(np.float32)
    least = 1 - radius * radius / 2
    centre = np.full(len(rows), -1)
    found: list[int] = []
    open_ = np.arange(len(rows))
    while len(open_):
        batch = open_[:256]
        covers = single[batch] @ single[open_].T >= least
        new = []
        for i in range(len(batch)):
            if centre[batch[i]] < 0:
                new.append(i)
                near = open_[covers[i] & (centre[open_] < 0)]
                centre[near] = batch[i]
                centre[batch[i]] = batch[i]
        found += [int(batch[i]) for i in new]
        open_ = open_[centre[open_] < 0]
    return rows[centre], rows[np.array(found, np.int64)]


def build(x: np.ndarray) -> np.ndarray:
    """Node of every row on every level, as the row index of the node's centre."""
    path = np.zeros((len(x), len(RADII)), np.int64)
    path[:, 0], _ = net(x, np.arange(len(x)), RADII[0])
    for level in range(1, len(RADII)):
        above = path[:, level - 1]
        path[:, level] = above
        order = np.argsort(above, kind="stable")
        edge = np.flatnonzero(np.diff(above[order], prepend=-1))
        for a, b in zip(edge, [*edge[1:], len(order)], strict=True):
            if b - a > 1:
                rows = order[a:b]
                # the centre above is the first centre here too: nets are nested
                rows = np.concatenate([[above[rows[0]]], rows[rows != above[rows[0]]]])
                path[rows, level], _ = net(x, rows, RADII[level])
    return path


class Tree:
    """Nodes of one block, rows in node order so that every node is a range of rows."""

    def __init__(self, x: np.ndarray, path: np.ndarray, weight: np.ndarray) -> None:
        order = np.lexsort(path.T[::-1])
        self.order, self.x, self.weight = order, x[order], weight[order]
        path = path[order]
        n = len(x)
        self.levels = []
        new = np.zeros(n, bool)
        for level in range(path.shape[1]):
            new = new | (np.diff(path[:, level], prepend=-1) != 0)
            start = np.flatnonzero(new)
            stop = np.append(start[1:], n)
            centre = x[path[start, level]]
            far = np.linalg.norm(self.x - np.repeat(centre, stop - start, 0), axis=1)
            self.levels.append((start, stop, centre, np.maximum.reduceat(far, start)))
        self.levels.append((np.arange(n), np.arange(1, n + 1), self.x, np.zeros(n)))
        self.sums = np.concatenate([[0], np.cumsum(self.weight)])

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child on the next level and number of children."""
        start, stop, _, _ = self.levels[level]
        below = self.levels[level + 1][0]
        first = np.searchsorted(below, start[nodes])
        return first, np.searchsorted(below, stop[nodes]) - first


def near_centres(ca: np.ndarray, ra: np.ndarray, cb: np.ndarray, rb: np.ndarray, reach: float):
    """Pairs of balls that may hold linked vectors, in strips: a superset, found in single precision.

    Balls of similar radius share a strip, so a strip's bound is nearly that of its members.
    """
    def strips(centre, radius, size):
        kind = np.ceil(radius / RADII[-1])
        for k in np.unique(kind):
            rows = np.flatnonzero(kind == k)
            for i in range(0, len(rows), size):
                part = rows[i:i + size]
                yield part, centre[part].astype(np.float32), radius[part].max()

    others = list(strips(cb, rb, 4096))
    for rows, one, far in strips(ca, ra, 1024):
        for cols, other, wide in others:
            least = 1 - min(reach + far + wide, 2) ** 2 / 2 - SINGLE
            p, q = np.nonzero(one @ other.T >= least)
            yield rows[p], cols[q]


def traverse(a: Tree, b: Tree, threshold: float = THRESHOLD):
    """Links of a's rows in b: (weight per row of a, weight per row of b, forest root per row).

    Node pairs accepted whole tie all their rows to one row. Row numbers are in node order, those of
    b follow a's (with ``b is a`` they are the same, and a row's tie to itself is not counted).
    """
    reach = np.sqrt(2 - 2 * threshold)
    same = a is b
    wa, wb = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    shift, total = (0, len(a.x)) if same else (len(a.x), len(a.x) + len(b.x))
    root = np.arange(total)
    ties: list[tuple[np.ndarray, np.ndarray]] = []
    step = 1 << 18

    def fold(least: int) -> None:
        """Keep only a forest of the ties once there are many."""
        nonlocal root
        if sum(len(t[0]) for t in ties) > least:
            root = forest(total, np.concatenate([t[0] for t in ties] + [np.arange(total)]),
                          np.concatenate([t[1] for t in ties] + [root]))
            ties.clear()

    def whole(level: int, p: np.ndarray, q: np.ndarray) -> None:
        sa, ea = a.levels[level][0][p], a.levels[level][1][p]
        sb, eb = b.levels[level][0][q], b.levels[level][1][q]
        for total, s, e, other, os, oe in ((wa, sa, ea, b, sb, eb), (wb, sb, eb, a, sa, ea)):
            change = np.zeros(len(total) + 1, np.int64)
            weight = other.sums[oe] - other.sums[os]
            np.add.at(change, s, weight)
            np.subtract.at(change, e, weight)
            total += np.cumsum(change)[:-1]
        for s, e, one in ((sa, ea, sb), (sb, eb, sa)):
            rows = np.repeat(s - np.cumsum(e - s) + (e - s), e - s) + np.arange(int((e - s).sum()))
            ones = np.repeat(one, e - s)
            ties.append((rows, ones + shift) if one is sb else (ones, rows + shift))
        fold(1 << 21)

    def visit(level: int, p: np.ndarray, q: np.ndarray) -> None:
        """Decide node pairs, then go on with the children of the undecided, in bounded pieces."""
        for i in range(0, len(p), step):
            pp, qq = p[i:i + step], q[i:i + step]
            d = np.linalg.norm(a.levels[level][2][pp] - b.levels[level][2][qq], axis=1)
            both = a.levels[level][3][pp] + b.levels[level][3][qq]
            near = d <= reach + both + SLACK
            if level + 1 == len(a.levels):
                hit = near.copy()
                hit[near] = np.einsum("ij,ij->i", a.x[pp[near]], b.x[qq[near]]) >= threshold
                if same:
                    hit |= pp == qq
                whole(level, pp[hit], qq[hit])
                continue
            inside = near & (d + both <= reach - SLACK)
            whole(level, pp[inside], qq[inside])
            near &= ~inside
            expand(level, pp[near], qq[near])

    def expand(level: int, p: np.ndarray, q: np.ndarray) -> None:
        fa, na = a.children(level, p)
        fb, nb = b.children(level, q)
        ends = np.cumsum(na * nb)
        i = 0
        while i < len(p):
            done = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + step, "right")))
            size = (na * nb)[i:j]
            of = np.repeat(np.arange(i, j), size)
            k = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            visit(level + 1, fa[of] + k // nb[of], fb[of] + k % nb[of])
            i = j

    # the top levels meet as matrix products, in strips
    for p, q in near_centres(*a.levels[0][2:], *b.levels[0][2:], reach):
        visit(0, p, q)
    fold(0)
    if same:
        wa -= a.weight
    return wa, wb, root


def _pack(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _unpack(column) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, float).reshape(len(column), -1)


def pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first rows of a sample."""
    chosen = [0]
    far = distances(x, x[:1])[:, 0]
    while len(chosen) < min(count, len(x)):
        i = int(far.argmax())
        if far[i] <= 1e-9:
            break
        chosen.append(i)
        far = np.minimum(far, distances(x, x[i:i + 1])[:, 0])
    return x[chosen]


def near_duplicates(vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding",
                    threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec, n_links, component_id, kept.

    Two vectors link when the cosine of their doubles is at least ``threshold``. NULL, empty and
    zero vectors and vectors with NULL or non-finite parts link with nothing; so do vectors of
    another length. Repeated ids count as rows; a NULL id links with nothing. ``kept`` marks rows
    whose id is their component's smallest.
    """
    e = F.col(embedding)
    usable = F.coalesce(
        F.col(vec).isNotNull() & (F.size(e) > 0) & F.exists(e, lambda v: v != 0) & F.forall(
            e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col(vec).alias("_vec"), F.when(usable, e.cast("array<double>")).alias("_e"))
    keyed = rows.withColumns({"_key": F.when(F.col("_e").isNotNull(), F.xxhash64("_e")),
                              "_dim": F.size("_e")})
    classes = keyed.where("_e is not null").groupBy("_e", "_key", "_dim").agg(
        F.min("_vec").alias("_rep"), F.count("*").alias("_n"))

    def normalise(batches):
        for batch in batches:
            e_ = batch.column("_e")
            lists = e_.to_pylist()
            x = [np.array(v, float) for v in lists]
            x = [v / np.abs(v).max() for v in x]
            out = [(v / np.linalg.norm(v)).tobytes() for v in x]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("_key", "_dim", "_n", "_rep")), pa.array(out, pa.binary())],
                ["_key", "_dim", "_n", "_rep", "_x"])

    kind = vectors.schema[vec].dataType.simpleString()
    # a class is named by a 64-bit hash of its vector
    classes = materialised(classes.select("_key", "_dim", "_n", "_rep", "_e").mapInArrow(
        normalise, f"_key long, _dim int, _n long, _rep {kind}, _x binary"), "vectors")
    parts = [_links_of_length(classes.where(F.col("_dim") == r["_dim"]), r["n"], threshold, block)
             for r in classes.groupBy("_dim").agg(F.count("*").alias("n")).collect()]
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = materialised(found, "links")
        roots = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
        linked = classes.select("_key", "_rep", "_n").join(
            roots.select(F.col("node").alias("_key"), "root"), "_key", "left").join(
            found.groupBy(F.col("node").alias("_key")).agg(F.sum("links").alias("_links")),
            "_key", "left").withColumn("root", F.coalesce("root", "_key"))
        lowest = linked.groupBy("root").agg(F.min("_rep").alias("_component"))
        linked = linked.join(lowest, "root").select(
            "_key", "_component", (F.col("_n") - 1 + F.coalesce("_links", F.lit(0))).alias("_total"))
    else:
        linked = classes.select("_key", F.col("_rep").alias("_component"), F.col("_n").alias("_total"))
    out = keyed.select("_vec", "_key").join(materialised(linked, "linked"), "_key", "left")
    component = F.coalesce("_component", "_vec")
    return out.select(
        F.col("_vec").alias(vec), F.coalesce("_total", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("_vec") == component, F.lit(True)).alias("kept"))


def _links_of_length(classes: DataFrame, count: int, threshold: float, block: int) -> DataFrame:
    """(node, links, root) over the classes of one vector length."""
    sample = classes.select("_key", "_x").orderBy(F.xxhash64("_key"), "_key").limit(SAMPLE).toPandas()
    tops = pivots(np.frombuffer(b"".join(sample["_x"]), float).reshape(len(sample), -1),
                  min(MAX_PIVOTS, -(-count // block)))
    reach = float(np.sqrt(2 - 2 * threshold))

    def assign(batches):
        for batch in batches:
            x = _unpack(batch.column("_x"))
            d = distances(x, tops)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("_n"), batch.column("_x"), pa.array(cell),
                 pa.array(d[np.arange(len(d)), cell])], ["_key", "_n", "_x", "_cell", "_d"])

    placed = materialised(classes.select("_key", "_n", "_x").mapInArrow(
        assign, "_key long, _n long, _x binary, _cell long, _d double"), "cells")
    cells = {r["_cell"]: (r["n"], r["far"]) for r in placed.groupBy("_cell").agg(
        F.count("*").alias("n"), F.max("_d").alias("far")).collect()}  # at most MAX_PIVOTS rows
    # blocks of a cell share its centre and radius; blocks are numbered over all cells
    blocks = [(c, k) for c, (n, _) in sorted(cells.items()) for k in range(-(-n // block))]
    number = {cb: i for i, cb in enumerate(blocks)}
    session = classes.sparkSession
    split = F.broadcast(session.createDataFrame(
        [(c, -(-n // block), number[c, 0]) for c, (n, _) in cells.items()],
        "_cell long, _k int, _base int"))
    built = placed.join(split, "_cell").select("_key", "_n", "_x", (
        F.col("_base") + F.pmod(F.xxhash64("_key"), "_k")).cast("int").alias("_block"))

    def grow(table: pa.Table) -> pa.Table:
        x = _unpack(table.column("_x"))
        return table.append_column("_path", _pack(build(x))).append_column(
            "_row", pa.array(np.arange(len(x))))

    trees = materialised(built.groupBy("_block").applyInArrow(
        grow, "_key long, _n long, _x binary, _block int, _path binary, _row long"), "trees")

    def partners(batches):
        """Every row goes to the pairs of blocks whose cells can hold linked vectors."""
        cell = np.array([c for c, _ in blocks])
        far = np.array([cells[c][1] for c in cell])
        centre = tops[cell]
        for batch in batches:
            own = batch.column("_block").to_numpy()
            index, p, q = [], [], []
            for k in np.unique(own):
                d = distances(centre[k:k + 1], centre)[0]
                near = np.flatnonzero(d <= reach + far[k] + far + SLACK)
                rows = np.flatnonzero(own == k)
                index.append(np.repeat(rows, len(near)))
                p.append(np.tile(np.minimum(near, k), len(rows)))
                q.append(np.tile(np.maximum(near, k), len(rows)))
            table = pa.Table.from_batches([batch]).take(pa.array(np.concatenate(index)))
            table = table.append_column("_p", pa.array(np.concatenate(p).astype(np.int32)))
            table = table.append_column("_q", pa.array(np.concatenate(q).astype(np.int32)))
            yield from table.to_batches(max_chunksize=4096)

    pairs = trees.mapInArrow(
        partners, "_key long, _n long, _x binary, _block int, _path binary, _row long, _p int, _q int")

    nothing = pa.table({c: np.zeros(0, np.int64) for c in ("node", "links", "root")})

    def compare(table: pa.Table) -> pa.Table:
        own = table.column("_block").to_numpy()
        key, n = table.column("_key").to_numpy(), table.column("_n").to_numpy()
        row = table.column("_row").to_numpy()
        x = _unpack(table.column("_x"))
        path = np.frombuffer(b"".join(table.column("_path").to_pylist()), np.int64).reshape(len(x), -1)
        keys, trees_ = [], []
        for k in np.unique(own):
            mine = np.flatnonzero(own == k)
            mine = mine[np.argsort(row[mine])]
            trees_.append(Tree(x[mine], path[mine], n[mine]))
            keys.append(key[mine][trees_[-1].order])
        a, b = trees_[0], trees_[-1]
        if a is b and table.column("_p")[0] != table.column("_q")[0]:
            return nothing  # the other block got no rows
        wa, wb, root = traverse(a, b, threshold)
        links, names = (wa, keys[0]) if a is b else (
            np.concatenate([wa, wb]), np.concatenate(keys))
        some = np.flatnonzero(links)
        return pa.table({"node": names[some], "links": links[some], "root": names[root[some]]})

    return pairs.groupBy("_p", "_q").applyInArrow(compare, "node long, links long, root long")
