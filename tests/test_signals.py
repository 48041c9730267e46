"""Trace kernels against plain definitions."""

import numpy as np

from tidewave.functions import signals


def test_smoothing_and_scaling():
    x = np.random.default_rng(1).normal(size=200).cumsum()
    assert np.allclose(signals.moving_average(np.full(30, 4.0), 7), 4)
    mirrored = np.concatenate([x[::-1], x, x[::-1]])
    assert np.allclose(signals.moving_average(x, 9), [mirrored[200 + i - 4 : 200 + i + 5].mean() for i in range(200)])
    assert np.isclose(signals.gaussian(x, 2.0).mean(), x.mean(), atol=0.5)
    assert np.allclose(signals.savitzky_golay(np.arange(50.0) ** 2, 7, 2)[3:-3], np.arange(50.0)[3:-3] ** 2)
    assert np.allclose(signals.polynomial(3 + np.arange(40.0), 1), 3 + np.arange(40.0))
    assert signals.min_max(x).min() == 0 and signals.min_max(x).max() <= 1
    assert np.array_equal(signals.min_max(np.array([1.0, 1.5]), 1.0), [0, 0.5])
    assert np.array_equal(signals.noise_score(np.ones(20)), np.ones(20))


def test_baseline_stays_below():
    x = np.abs(np.random.default_rng(2).normal(size=300)) + np.linspace(0, 5, 300)
    assert (signals.minima_baseline(x, 10) <= x + 1e-9).all()
    assert (signals.detrend(x, 10) >= 0).all()
    assert np.array_equal(signals.minima_baseline(np.ones(30), 3), np.ones(30))


def test_peaks():
    x = np.array([0, 1, 3, 3, 3, 1, 0, 2, 0, 5, 0.0])
    assert list(signals.maxima(x)) == [3, 7, 9]
    assert signals.find_peaks(x, 0.0) == [(3, 3.0), (7, 2.0), (9, 5.0)]
    assert [p for p, _ in signals.find_peaks(x, 2.5)] == [3, 9]
    assert [p for p, _ in signals.find_peaks(x, 0.0, 3)] == [3, 9]
    assert signals.bounds(x, 9, 5.0, 0.5) == (8.5, 9.5)
    assert signals.grouping([(0, 4), (3, 8), (10, 12)], [1.0, 2.0, 1.0]) == [1, 1, 2]


def test_rows(spark):
    points = spark.createDataFrame([(1, 2, 5.0), (1, 2, 1.0), (1, 9, 1.0), (2, 0, 1.0)], "cell int, frame int, height double")
    traces = signals.dense(points, ["cell"], "frame", "height", 5)
    assert {r.cell: r["values"] for r in traces.collect()} == {1: [0, 0, 6, 0, 0], 2: [1, 0, 0, 0, 0]}
    found = signals.detect(traces, ["cell"], 1.0)
    assert [(r.cell, r.frame, r.onset, r.offset, r.symmetry) for r in found.collect()] == [(1, 2, 1, 3, 1.0)]
    assert sorted(r.frame for r in signals.binary(found, ["cell"], 3).collect()) == [1, 2]
    assert signals.detect(traces.limit(0), ["cell"], 1.0).count() == 0


def test_traces_are_filled_behind_the_shuffle(spark):
    """Repeated and missing frames, frames outside and null keys; no spine of all frames is joined."""
    rows = [(1, 2, 1.0), (1, 2, 2.0), (1, 5, None), (1, -1, 9.0), (2, 0, 4.0), (2, 7, 1.5), (3, 9, 1.0), (None, 1, 5.0)]
    p = spark.createDataFrame(rows, "cell long, frame long, v double")
    whole = signals.dense(p, ["cell"], "frame", "v")
    assert {r["cell"]: r["values"] for r in whole.collect()} == {1: [0, 0, 3.0] + [0] * 7, 2: [4.0] + [0] * 6 + [1.5, 0, 0], 3: [0] * 9 + [1.0], None: [0] * 10}
    assert {r["cell"]: r["values"] for r in signals.dense(p, ["cell"], "frame", "v", 6).collect()} == {1: [0, 0, 3.0, 0, 0, 0], 2: [4.0, 0, 0, 0, 0, 0], 3: [0] * 6, None: [0] * 6}
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "explode" not in plan


def test_workers_give_results_back_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([[float(i)] * 50 for i in range(100)])], names=["k", "values"])
    monkeypatch.setattr(signals, "PIECE", 500)
    sizes = [(part.num_rows, [list(x[:1]) for x in found]) for part, found in signals._pieces([batch])]
    assert [n for n, _ in sizes] == [10] * 10 and sizes[3][1] == [[float(i)] for i in range(30, 40)]


def test_scaled_traces_seek_their_ends_once(spark):
    from tidewave.plans import traces

    plan = traces.minmax_traces(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_min" in plan.split("Generate")[-1] and "array_min" not in plan.split("Generate")[0]
