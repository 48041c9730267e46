"""Kernels on few units, and tails of distributions, against plain definitions and known values."""

import math
from itertools import combinations

import numpy as np
import pytest

from tidewave.functions import similarity, special, stats


def groups(labels):
    return {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels.tolist()) if k >= 0}


def two_clouds():
    rng = np.random.default_rng(3)
    points = np.vstack((rng.normal(0, 0.05, (12, 2)), rng.normal(3, 0.05, (9, 2)), [[30.0, -20.0]]))
    return points, np.linalg.norm(points[:, None] - points[None], axis=2)


def test_clusters_of_two_clouds():
    points, dist = two_clouds()
    clouds = {frozenset(range(12)), frozenset(range(12, 21))}
    assert groups(similarity.linkage_labels(dist, 1.0)[0]) == clouds | {frozenset([21])}
    labels, share = similarity.density_hierarchy(dist, 3)
    assert groups(labels) == clouds and labels[21] == -1 and (share[:21] > 0).all()
    sim = np.exp(-dist[:21, :21])
    assert groups(similarity.affinity(sim)) == clouds
    assert groups(similarity.communities(np.exp(-dist), 0.7)) == clouds
    scaled = dist[:21, :21] / dist[:21, :21].max()
    assert groups(similarity.linkage_labels(scaled, similarity.automatic_threshold(scaled), "average")[0]) == clouds


def test_merge_heights_are_those_of_single_links():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(15, 2))
    dist = np.linalg.norm(points[:, None] - points[None], axis=2)
    # The heights of single links are the edges of a least spanning tree.
    left, tree = set(range(1, 15)), []
    while left:
        j = min(left, key=lambda j: min(dist[i, j] for i in set(range(15)) - left))
        tree.append(min(dist[i, j] for i in set(range(15)) - left))
        left.remove(j)
    assert np.allclose(similarity.linkage_labels(dist, np.inf, "single")[1], sorted(tree))


def test_causes():
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    y = np.append(0, 0.9 * x[:-1]) + 0.1 * rng.normal(size=400)
    assert similarity.granger(x, y)[1] < 1e-6 < 0.001 < similarity.granger(y, x)[1]
    f = similarity.granger_matrix(np.stack((x, y), axis=1), 1)
    assert f[0, 1] > 100 > 20 > f[1, 0]


def test_triangles_have_empty_circles():
    points = np.random.default_rng(6).normal(size=(40, 2))
    edges = similarity.delaunay_edges(points)
    slow = set()
    for i, j, k in combinations(range(40), 3):
        a, b, c = points[i], points[j] - points[i], points[k] - points[i]
        turn = 2 * (b[0] * c[1] - b[1] * c[0])
        off = np.array([c[1] * (b @ b) - b[1] * (c @ c), b[0] * (c @ c) - c[0] * (b @ b)]) / turn
        if (((points - a - off) ** 2).sum(axis=1) >= off @ off - 1e-9).all():
            slow |= {(i, j), (i, k), (j, k)}
    # The outermost triangles may miss a side of the hull that is almost straight.
    assert edges <= slow and len(slow - edges) <= 1
    box = (-5.0, -5.0, 5.0, 5.0)
    for i, j, x0, y0, x1, y1 in similarity.ridges(points, box):
        for end in ((x0, y0), (x1, y1)):
            d = np.linalg.norm(points - end, axis=1)
            assert d[i] == pytest.approx(d[j]) and d.min() == pytest.approx(d[i]) and max(map(abs, end)) <= 5 + 1e-9


def test_hull_and_growth():
    assert similarity.hull_area(np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [1, 0]], float)) == 4
    assert similarity.hull_area(np.array([[0, 0], [1, 1], [2, 2]], float)) == 0
    x = np.arange(30.0)
    assert similarity.logistic_fit(x, 8 / (1 + np.exp(-0.5 * (x - 12)))) == pytest.approx((8, 0.5, 12), rel=1e-4)


def test_tails():
    assert special.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert special.student_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert special.gamma_rest(1, 3.0) == pytest.approx(math.exp(-3)) and special.gamma_rest(0.5, 3.841458820694124 / 2) == pytest.approx(0.05)
    assert special.f_tail(2.2281388519649385**2, 1, 10) == pytest.approx(0.05)
    # All orders of 4 and 3 members.
    counts: dict = {}
    for at in combinations(range(7), 4):
        u = sum(at) - 6
        counts[u] = counts.get(u, 0) + 1
    for u in counts:
        top = max(u, 12 - u)
        assert special.exact_u_tail(u, 4, 3) == pytest.approx(min(1, 2 * sum(c for k, c in counts.items() if k >= top) / 35))


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in np.round(rng.exponential(50, 700), 1)] + [("one", 3.0), ("same", 2.0), ("same", 2.0), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.lo, r.mid, r.hi) for r in stats.quantiles(frame, ["g"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.99}).collect()}
    for g in got:
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g], [0.1, 0.5, 0.99]))
    assert set(got) == {"a", "b", None, "one", "same"}
    assert stats.quantiles(frame, [], "v", {"m": 0.25}).first().m == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.25))
    kept = stats.iqr_split(frame, "v", ["g"], 0.0, 1.5).collect()
    assert len(kept) == 2103 and {r.g for r in kept} == {"a", "b", None, "one", "same"}


def test_components_and_levels(spark):
    from tidewave.operators import graph

    rng = np.random.default_rng(8)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2)) if a != b] + [(i, i + 1) for i in range(200, 260)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    frame = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.label for r in graph.connected(frame).collect()} == {x: root(x) for x in parent}
    steps = {r.node: (r.level, r.parent) for r in graph.levels(spark.createDataFrame([(200,)], "node long"), frame).collect()}
    assert steps[200] == (0, None) and steps[207] == (7, 206) and len(steps) == 61


def test_equal_growth_curves_are_fitted_once(spark, monkeypatch):
    from tidewave.plans import archive

    grown = [(root, i, y) for root in range(20) for i, y in enumerate((1, 2, 6, 9, 10))] + [(90, 0, 1), (90, 1, 2)]
    monkeypatch.setattr(archive, "_growth", lambda spark, d: spark.createDataFrame(grown, "root long, i long, y long"))
    found = archive.logistic_growth(spark, "")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("MapInArrow")[1] and "FlatMapGroups" not in plan
    got = {r["root"]: (r["ceiling"], r["rate"], r["middle"]) for r in found.collect()}
    assert got.pop(90) == (None, None, None)
    assert got == dict.fromkeys(range(20), similarity.logistic_fit(np.arange(5.0), np.array([1.0, 2, 6, 9, 10])))


def test_growth_of_hulls_takes_the_outer_points_of_columns_only(spark, monkeypatch):
    from tidewave.plans import archive

    rng = np.random.default_rng(4)
    rows = [(e, int(rng.integers(0, 25)), 10.0 * int(rng.integers(0, 5)), 10.0 * int(rng.integers(0, 40))) for e in range(12) for _ in range(5 * e + 1)]
    rows += [(90, t, 10.0, 10.0 * t) for t in range(30)] + [(91, t, 10.0 * t, 20.0 * t) for t in range(9)] + [(91, 9, 0.0, 10.0), (91, 14, 0.0, 0.0)]
    want = {}
    for e in {r[0] for r in rows}:
        at = sorted({r[1] for r in rows if r[0] == e})
        areas = [(t, similarity.hull_area(np.array([r[2:] for r in rows if r[0] == e and r[1] <= t]))) for t in at]
        grown = [x for x in areas if x[1] > 0]
        want[e] = (areas[-1][1], (grown[-1][1] - grown[0][1]) / (grown[-1][0] - grown[0][0]) if len(grown) > 1 else 0.0)
    p = spark.createDataFrame(rows, "root long, frame long, x double, y double")
    got = {r.root: (r.area, r.speed) for r in archive._hull_growth(p).collect()}
    assert got == want
