"""Voronoi cells from surroundings against the kernel on all points at once."""

import numpy as np
import pytest

from tidewave.functions import similarity
from tidewave.operators import voronoi


def table(spark, at):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "cell long, x double, y double")


@pytest.mark.parametrize("kind", ["even", "clumps", "line", "two"])
def test_sides_and_neighbours_equal_the_kernel(spark, kind):
    rng = np.random.default_rng(5)
    at = {
        "even": rng.uniform(0, 100, (220, 2)),
        "clumps": np.concatenate([rng.normal(size=(60, 2)) * 0.1, rng.normal(size=(40, 2)) + 80, rng.uniform(-50, 150, (15, 2))]),
        "line": np.column_stack((np.arange(30.0), rng.normal(size=30) * 1e-3)),
        "two": np.array([[0.0, 0.0], [3.0, 4.0]]),
    }[kind]
    sides, pairs = voronoi.voronoi(table(spark, at))
    box = (*(at.min(axis=0) - 10), *(at.max(axis=0) + 10))
    assert {(r.cell_a, r.cell_b) for r in pairs.collect()} == similarity.delaunay_edges(at)
    got = {(r.cell_a, r.cell_b): sorted([(r.x0, r.y0), (r.x1, r.y1)]) for r in sides.collect()}
    want = {(i, j): sorted([(a, b), (c, d)]) for i, j, a, b, c, d in similarity.ridges(at, box)}
    long = {k for k, (p, q) in want.items() if np.hypot(p[0] - q[0], p[1] - q[1]) > 1e-6}
    assert long <= set(got) and set(got) <= set(want)
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in long)


def test_one_point_and_one_place(spark):
    assert [t.count() for t in voronoi.voronoi(table(spark, [(1, 1)]))] == [0, 0]
    sides, pairs = voronoi.voronoi(table(spark, [(0, 0), (0, 0), (5, 5)]))
    assert {(r.cell_a, r.cell_b) for r in sides.collect()} == {(0, 2), (1, 2)}
