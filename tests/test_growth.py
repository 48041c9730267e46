"""Steps that must not grow with the square of a group: their tables stay small, their results those of all pairs."""

import numpy as np
import pandas as pd
import pytest

from tidewave.functions import similarity, stats
from tidewave.operators import joins
from tidewave.plans import archive, waves
from tidewave.plans.catalog import QUERIES, _links
from tidewave.sources.tables import neighbours


def test_extent_pairs_only_column_ends(spark, monkeypatch):
    rng = np.random.default_rng(1)
    cells = rng.choice(15 * 200, 600, replace=False)
    rows = [(1, int(c), int(rng.integers(0, 30))) for c in cells]
    held = spark.createDataFrame(rows, "event long, cell long, frame long")
    monkeypatch.setattr(waves, "_globals", lambda spark, d: held)
    written = []
    cut = waves.graph.cut
    monkeypatch.setattr(waves.graph, "cut", lambda df: written.append(cut(df)) or written[-1])
    found = waves.global_direction(spark, "").first()
    x, y = 10.0 * (cells % 15), 10.0 * (cells // 15)
    assert found["extent"] == round(float(np.hypot(x[:, None] - x, y[:, None] - y).max()), 6)
    assert written[-1].columns == ["event", "x", "y"] and written[-1].count() <= 30


def test_lagged_similarities_meet_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    traces = {int(c): rng.integers(0, 4, 12).astype(float) for c in rng.choice(1000, 40, replace=False)}
    traces[5], traces[6] = np.full(12, 3.0), np.zeros(12)
    daily = spark.createDataFrame([(c, v.tolist()) for c, v in traces.items()], "cell long, values array<double>")
    monkeypatch.setattr(archive, "_daily", lambda spark, d: daily)
    monkeypatch.setattr(archive, "BLOCK", 7)

    def corr(x, y):
        return np.corrcoef(x, y)[0, 1] if x.std() > 1e-6 and y.std() > 1e-6 else None

    def best(f, a, b):
        found = [f(a[max(k, 0) : 12 + min(k, 0)], b[max(-k, 0) : 12 + min(-k, 0)]) for k in range(-2, 3)]
        return max((v for v in found if v is not None), default=0.0)

    pairs = [(a, b) for a in traces for b in traces if a <= b]
    plain = {
        "lagged_pearson": corr,
        "lagged_spearman": lambda x, y: corr(pd.Series(x).rank().to_numpy(), pd.Series(y).rank().to_numpy()),
        "lagged_jaccard": lambda x, y: ((x > 1) & (y > 1)).sum() / max(1, ((x > 1) | (y > 1)).sum()),
    }
    monkeypatch.setattr(archive, "ACTIVE", 1.0)
    for name, f in plain.items():
        got = [((r.cell_a, r.cell_b), r.similarity) for r in QUERIES[name](spark, "").collect()]
        assert len(got) == len(pairs)
        assert dict(got) == pytest.approx({(a, b): best(f, traces[a], traces[b]) for a, b in pairs}, abs=2e-6)
    norm = np.linalg.norm
    got = {(r.cell_a, r.cell_b): r.similarity for r in archive.lagged_xcorr(spark, "").collect()}
    assert got == pytest.approx({(a, b): best(np.dot, traces[a], traces[b]) / (norm(traces[a]) * norm(traces[b]) + 1e-8) for a, b in pairs}, abs=2e-6)
    assert archive._compared(spark, "", lambda a, b: {0: np.zeros((len(a), len(b)))})._jdf.queryExecution().toString().count("NestedLoop") == 0


def test_causes_on_a_grid_take_one_shuffle_of_the_peaks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 15 * 20)), "ab"[int(rng.integers(0, 2))], int(rng.integers(0, 60))) for i in range(1500)]
    rows += [(2000 + i, 130, "a", int(rng.integers(20, 40))) for i in range(300)]
    p = spark.createDataFrame(rows, "event_id long, cell long, dataset string, frame long")
    found = joins.farthest_back_on_grid(p, 15)
    plain = joins.farthest_back(p, neighbours(p.select("cell").distinct()), 15)
    assert found.columns == plain.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    assert _links(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_slopes_are_counted_not_kept(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 40, 120).astype(float), np.round(rng.normal(size=120), 1)
    monkeypatch.setattr(stats, "BLOCK", 17)
    written, cut = [], stats.cut
    monkeypatch.setattr(stats, "cut", lambda df: written.append(cut(df)) or written[-1])
    found = stats.theil_sen(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double"), "x", "y").first()
    i, j = np.triu_indices(120, 1)
    i, j = i[x[i] != x[j]], j[x[i] != x[j]]
    k, c = np.sort((y[j] - y[i]) / (x[j] - x[i])), np.unique(x, return_counts=True)[1]
    spread = 1.959963984540054 * np.sqrt((120 * 119 * 245 - (c * (c - 1) * (2 * c + 5)).sum()) / 18)
    slope = np.median(k)
    want = (slope, np.median(y) - slope * np.median(x), k[round((len(k) - spread) / 2) - 1], k[round((len(k) + spread) / 2) - 1])
    assert tuple(found) == pytest.approx(want, abs=1e-4) and sum(w.count() for w in written) <= 120
    assert stats.theil_sen(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), "x", "y").first()[0] is None


def test_dense_traces_need_no_table_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    traces = [(i, rng.random(8).tolist()) for i in range(50)]
    t = spark.createDataFrame(traces, "cell long, values array<double>")
    monkeypatch.setattr(archive, "BLOCK", 9)
    for bar in (0.9, 0.94, 0.97):
        m = similarity.cosine(*[np.array([v for _, v in traces])] * 2) >= bar
        pairs = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(m))], "a long, b long")
        want = {r.cell: r.label for r in archive.density_clusters(pairs, t.select("cell"), 4).collect()}
        assert {r.cell: r.label for r in archive.dense_traces(t, similarity.cosine, bar, 4).collect()} == want


def test_causes_on_a_grid_of_negative_cells(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(-60, 60)), "a", int(rng.integers(0, 50))) for i in range(400)]
    place = lambda c: (int(np.fmod(c, 15)), c // 15)
    want = {}
    for i, cell, _, frame in rows:
        (x, y), near = place(cell), []
        for j, other, _, at in rows:
            u, v = place(other)
            if other != cell and abs(x - u) <= 1 and abs(y - v) <= 1 and frame - 15 <= at < frame:
                near.append((at, j))
        if near:
            want[i] = min(near)[1]
    found = joins.farthest_back_on_grid(spark.createDataFrame(rows, "event_id long, cell long, dataset string, frame long"), 15)
    assert {r.event_id: r.cause_id for r in found.collect()} == want


def test_kruskal_of_more_rows_than_a_long_holds_the_cube_of(spark):
    rows = spark.range(2_200_000).selectExpr("id % 3 AS g", "(id * id) % 7 + if(id % 3 = 0, id % 2, 0) AS v")
    n = np.array([[r["n"] for r in sorted(rows.groupBy("v").pivot("g", [0, 1, 2]).count().na.fill(0).selectExpr("v", "array(`0`, `1`, `2`) AS n").collect())]], float)[0]
    ties, size = n.sum(axis=1), n.sum()
    mid = np.cumsum(ties) - ties + (ties + 1) / 2
    h = (12 / (size * (size + 1)) * ((mid @ n) ** 2 / n.sum(axis=0)).sum() - 3 * (size + 1)) / (1 - (ties**3 - ties).sum() / (size**3 - size))
    found = stats.kruskal(rows, "g", "v").first()
    assert (found["n"], found["k"]) == (2_200_000, 3) and found["h"] == pytest.approx(h, rel=1e-9)


def test_pair_distances_take_no_row_a_pair(spark, monkeypatch):
    rng = np.random.default_rng(8)
    even = np.array([(10.0 * x, 10.0 * y) for x, y in rng.integers(0, [4, 90], (300, 2))])
    odd = np.vstack((rng.normal(size=(40, 2)), rng.normal(size=(5, 2)).repeat(3, axis=0)))
    seen = []
    monkeypatch.setattr(stats, "AT_ONCE", 7)
    for points in (even, even[:, ::-1], odd):
        d = np.hypot(*(points[:, None] - points).transpose(2, 0, 1))[np.triu_indices(len(points), 1)]
        found = stats.pair_distances(spark.createDataFrame(points.tolist(), "x double, y double"))
        assert tuple(found.first()) == pytest.approx((d.mean(), d.max()), abs=1e-6)
        seen.append(found._jdf.queryExecution().toString())
    assert not any("explode" in s.lower() for s in seen) and stats._column_distances(0.0, [{"v": 1.0, "n": 2}], [{"v": 1.0, "n": 2}]) == (0.0, 0.0)
    assert tuple(stats.pair_distances(spark.createDataFrame([(1.0, 2.0)], "x double, y double")).first()) == (None, None)


def test_traces_are_not_copied_to_more_and_more_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    traces = rng.random((150, 6)).round(2)
    t = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(traces)], "cell long, values array<double>")
    for name, value in {"BLOCK": 2, "SIDE": 5, "PIECE": 8}.items():
        monkeypatch.setattr(archive, name, value)
    monkeypatch.setattr(archive, "_daily", lambda spark, d: t)
    assert archive._met(t).count() == 5 * 150
    want = {(7 * i, 7 * j): round(m, 6) for i, row in enumerate(similarity.cosine(traces, traces)) for j, m in enumerate(row) if i <= j}
    got = [((r.cell_a, r.cell_b), r.similarity) for r in archive._similar(spark, "", similarity.cosine).collect()]
    assert len(got) == len(want) and dict(got) == pytest.approx(want, abs=2e-6)
    m = similarity.cosine(traces, traces) >= 0.97
    pairs = spark.createDataFrame([(7 * int(i), 7 * int(j)) for i, j in zip(*np.nonzero(m))], "a long, b long")
    dense = {r.cell: r.label for r in archive.density_clusters(pairs, t.select("cell"), 4).collect()}
    assert {r.cell: r.label for r in archive.dense_traces(t, similarity.cosine, 0.97, 4).collect()} == dense
    monkeypatch.setattr(archive, "MOST", 10)
    assert archive._met(t).count() == 15 * 150
