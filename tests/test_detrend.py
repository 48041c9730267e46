"""Detrenders on made traces whose parts are known, and peak options on small ones."""

import numpy as np
import pytest

from tidewave.functions import detrend, signals

T = np.arange(600.0)
BUMPS = sum(10 * np.exp(-0.5 * ((T - c) / 4) ** 2) for c in (80, 230, 300, 470))


@pytest.mark.parametrize("method", sorted(detrend.METHODS))
def test_drift_goes_and_peaks_stay(method):
    out = detrend.METHODS[method](BUMPS - 0.02 * T + 15)
    assert len(out) == len(T) and np.isfinite(out).all()
    assert abs(np.polyfit(T, out, 1)[0]) < 0.01
    assert [int(np.argmax(out[c - 20 : c + 20])) + c - 20 for c in (80, 230, 300, 470)] == pytest.approx([80, 230, 300, 470], abs=2)


def test_high_passes_stop_a_constant_and_pass_fast_waves():
    fast = np.sin(2 * np.pi * 0.2 * T)
    for f in (detrend.butterworth, detrend.fir):
        assert np.abs(f(np.full(600, 7.0))).max() < 0.2  # few taps leak a little
        assert np.allclose(f(fast)[100:-100], fast[100:-100], atol=0.05)
    b, a = detrend.butterworth_high(2, 0.1, 1.0)
    # At the cutoff the power is halved.
    z = np.exp(-2j * np.pi * 0.1)
    assert np.isclose(abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z)), np.sqrt(0.5))


def test_wavelet_steps_are_orthogonal():
    x = np.random.default_rng(1).normal(size=64)
    rest = detrend.wavelet(x, 2)
    assert np.isclose((x**2).sum(), (rest**2).sum() + ((x - rest) ** 2).sum())
    assert np.abs(detrend.wavelet(np.full(65, 3.0), 3)).max() < 1e-9


def test_robust_and_exponential_fits():
    x = 2 + 0.5 * T
    wild = x.copy()
    wild[::20] += 300
    assert np.abs(detrend.huber_baseline(wild, 1) - x).max() < 2 and np.abs(detrend.ransac_baseline(wild, 1) - x).max() < 1e-6
    decay = 5 * np.exp(-0.01 * T) + 1
    assert np.abs(detrend.exponential_baseline(decay) - decay).max() < 0.05


def test_steps_of_the_minima_baseline():
    p = detrend.Minima(order=1, edge_window=3, edge_delta=0.0, shoulder_distance=10, shoulder_window=3, angle=20, least_distance=1, rounds=5)
    x = np.array([0, 5, 1, 6, 4, 7, 1, 8, 2, 9, 0.0])
    assert list(detrend.strict_minima(x, 1)) == [2, 4, 6, 8]
    assert list(detrend.edge_anchors(x, np.array([2, 6]), p)) == [0, 2, 6, 10]
    assert list(detrend.without_shoulders(x, np.array([2, 4, 6]), p)) == [2, 6]
    assert list(detrend.without_sharp_turns(np.array([0, 0, 5, 0, 0.0]), np.array([0, 2, 4]), p)) == [0, 4]
    assert list(detrend.below_trace(np.array([0, 0, -3, 0, 0.0]), np.array([0, 4]), p)) == [0, 2, 4]
    assert not detrend.through_minima(np.arange(20.0)).any()


def test_peak_options():
    x = np.array([0, 4, 0, 9, 8, 9.5, 0, 6, 0, 0.0])
    assert [p for p, _ in signals.find_peaks(x, 0, height=5)] == [3, 5, 7]
    assert [p for p, _ in signals.find_peaks(x, 0, threshold=2)] == [1, 7]
    assert [p for p, _ in signals.find_peaks(x, 0, width=1.5)] == [5]
    assert signals.valleys(x, 5, search=4, window=1) == (4, 6)
    assert np.allclose(signals.savitzky_golay_ends(T[:40] ** 2, 7, 2), T[:40] ** 2)


def test_children_go_and_numbers_are_dense(spark):
    trace = spark.createDataFrame([(1, [0.0, 3.0, 1.0, 3.0, 9.0, 9.5, 7.0, 2.0, 0.0, 0.0, 4.0, 0.0])], "cell int, values array<double>")
    every = signals.detect(trace, ["cell"], 0.1).collect()
    assert [(r.peak_id, r.frame, r.parent_id) for r in every] == [(0, 1, 0), (1, 5, 1), (2, 10, 2)]
    wide = signals.detect(trace, ["cell"], 0.1, part=0.95).collect()
    assert [(r.peak_id, r.frame, r.parent_id) for r in wide] == [(0, 1, 1), (1, 5, 1), (2, 10, 2)]
    kept = signals.detect(trace, ["cell"], 0.1, part=0.95, parents_only=True).collect()
    assert [(r.peak_id, r.frame, r.parent_id) for r in kept] == [(0, 5, 0), (1, 10, 1)]
    refined = signals.detect(trace, ["cell"], 0.1, refine=True).collect()
    assert all(a.onset <= b.onset and a.offset >= b.offset for a, b in zip(every, refined))
