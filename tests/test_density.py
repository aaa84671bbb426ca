"""Density topics against a slow version that knows all pairs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from sigtide.operators import density


def slow_topics(vectors, min_size, min_samples, radii):
    """{id: topic} for {id: vector}: components by search at every radius, tree walked by recursion."""
    ids = sorted(vectors)
    x = {i: np.array(vectors[i], float) for i in ids}
    gap = {i: {j: float(np.sqrt(((x[i] - x[j]) ** 2).sum())) for j in ids} for i in ids}
    core = {i: sorted(gap[i].values())[min_samples - 1] if len(ids) >= min_samples else np.inf for i in ids}
    levels = []
    for r in radii:
        dense = [i for i in ids if core[i] <= r]
        left, groups = set(dense), []
        while left:
            todo, group = [min(left)], set()
            while todo:
                i = todo.pop()
                if i in left:
                    left.remove(i)
                    group.add(i)
                    todo += [j for j in left if gap[i][j] <= r]
            groups.append(frozenset(group))
        levels.append(groups)
    rate = [1 / max(r, 1e-300) for r in radii]

    def below(t, group):
        return [g for g in levels[t - 1] if g <= group and len(g) >= min_size] if t else []

    def best(t, group):
        """(stability of the best cut, topics of the cut) of the cluster whose top is this component."""
        own, parts = 0.0, []
        top = group
        while True:
            own += len(group) * (rate[t] - rate[t + 1] if t + 1 < len(radii) else 0.0)
            parts = below(t, group)
            if len(parts) != 1:
                break
            t, group = t - 1, parts[0]
        cuts = [best(t - 1, g) for g in parts]
        under = sum(c[0] for c in cuts)
        return (own, [top]) if own >= under else (under, [g for c in cuts for g in c[1]])

    out = dict.fromkeys(ids, -1)
    for group in levels[-1]:
        if len(group) >= min_size:
            for topic in best(len(radii) - 1, group)[1]:
                out |= dict.fromkeys(topic, min(topic))
    return out


def blobs(seed):
    """Tight and loose groups, one of them made of two, copies, and scattered points."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, s, (n, 3)) for c, s, n in [
        ((0, 0, 0), 0.1, 30), ((0.9, 0, 0), 0.1, 25), ((8, 8, 0), 0.5, 40), ((-9, 3, 1), 0.02, 12)]]
    parts += [np.repeat([[4.0, -6.0, 2.0]], 15, axis=0), rng.uniform(-15, 15, (20, 3))]
    points = np.concatenate(parts)
    return {int(i): [float(v) for v in p] for i, p in zip(rng.permutation(len(points)), points)}


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 16), (3, 16)])
def test_equals_slow_version(spark, monkeypatch, seed, block):
    monkeypatch.setattr(density, "BLOCK", block)
    vectors = blobs(seed)
    df = spark.createDataFrame(list(vectors.items()), "doc_id long, embedding array<double>")
    radii = [0.01, 0.05, 0.1, 0.3, 0.8, 1.5, 4.0]
    got = {r["doc_id"]: r["topic_id"] for r in density.density_topics(
        df, min_topic_size=10, min_samples=4, radii=radii).collect()}
    assert got == slow_topics(vectors, 10, 4, radii)
    assert len(set(got.values())) > 4 and Counter(got.values())[-1] > 5


def test_radii_found(spark):
    """Without given radii: groups far apart are topics, scattered points are noise."""
    vectors = blobs(4)
    df = spark.createDataFrame(list(vectors.items()), "doc_id long, embedding array<double>")
    got = density.density_topics(df, min_topic_size=10, min_samples=4).collect()
    topics = Counter(r["topic_id"] for r in got)
    assert 4 <= len(topics) - 1 <= 6 and topics[-1] >= 5
    assert all((r["topic_prob"] == 0) == (r["topic_id"] == -1) and r["topic_prob"] <= 1 for r in got)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    kind = "doc_id long, embedding array<double>, node string, x int"
    odd = [(1, None, "a", 1), (2, [], None, 2), (3, [nan, 0.0], "b", None), (4, [inf, 1.0], "c", 3),
           (5, [None, 1.0], "d", 4)]
    copies = [(10 + i, [0.0, -0.0] if i % 2 else [0.0, 0.0], None, i) for i in range(12)]
    got = density.density_topics(spark.createDataFrame(odd + copies, kind), min_topic_size=5)
    assert got.columns == ["doc_id", "embedding", "node", "x", "topic_id", "topic_prob"]
    assert {r["doc_id"]: (r["topic_id"], r["topic_prob"]) for r in got.collect()} == {
        **{i: (-1, 0.0) for i in range(1, 6)}, **{10 + i: (10, 1.0) for i in range(12)}}
    few = density.density_topics(spark.createDataFrame(copies[:3], kind), min_topic_size=2, min_samples=5)
    assert {r["topic_id"] for r in few.collect()} == {-1}
    assert density.density_topics(spark.createDataFrame([], kind)).collect() == []


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 107), (107, 103), (200, 200)]
    got = density.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["comp"] for r in got.collect()} == {
        **dict.fromkeys(range(41), 0), **dict.fromkeys([100, 103, 107], 100)}
    assert got.count() == 44


def test_points_meet_few_blocks(spark, monkeypatch):
    """Far outliers make no other point meet more blocks; core distances are those of all pairs."""
    monkeypatch.setattr(density, "BLOCK", 16)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.uniform(0, 1, (800, 2)), [[50.0, -70.0], [-90.0, 40.0]]])
    points = spark.createDataFrame([(i, [float(v) for v in p], 1) for i, p in enumerate(x)],
                                   "node long, x array<double>, weight long")
    cells = density._Cells(points)
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = np.sort(gaps, axis=1)[:, 3]
    got = {r["node"]: r["core"] for r in density.core_distances(cells, 4).collect()}
    assert got == pytest.approx(dict(enumerate(want)))
    kernel = density._near_inside(4, *cells.boxes(cells.points))
    asked = [len(c) for _, part in cells.points.toPandas().groupby("block") for c in kernel(part)["cells"]]
    assert cells.count > 50 and len(asked) == 802
    assert np.mean(asked) < 8
