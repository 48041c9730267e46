"""Detrending kernels over one trace: filters, wavelet, robust and exponential baselines, double curves, and baselines through minima."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidewave.functions import signals


def cut_start(x: np.ndarray, n: int) -> np.ndarray:
    """Without the first ``n`` samples; empty if there are no more."""
    return x[n:]


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """A recursive filter in transposed form, started with ``state``."""
    out, state = np.empty_like(x), state.copy()
    tail_b, tail_a = b[1:], a[1:]
    for i, v in enumerate(x):
        y = b[0] * v + (state[0] if len(state) else 0.0)
        state = np.append(state[1:], 0.0) + tail_b * v - tail_a * y
        out[i] = y
    return out


def both_ways(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The filter run forwards and backwards over the trace, which is extended oddly at its ends, so that phases stay."""
    n = max(len(a), len(b))
    b, a = (np.pad(np.asarray(c, float), (0, n - len(c))) / a[0] for c in (b, a))
    pad = min(3 * n, len(x) - 1)
    wide = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    # The state in which a constant input of 1 gives a constant output.
    level = b.sum() / a.sum() if abs(a.sum()) > 1e-12 else 0.0
    steady = np.cumsum((b[1:] - a[1:] * level)[::-1])[::-1]
    ahead = _filter(b, a, wide, steady * wide[0])[::-1]
    return _filter(b, a, ahead, steady * ahead[0])[::-1][pad : pad + len(x)]


def butterworth_high(order: int, cutoff: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a digital high-pass with maximally flat pass band, by the bilinear transform."""
    angles = np.pi * (2 * np.arange(order) + order + 1) / (2 * order)
    low = np.exp(1j * angles)
    warped = 4 * np.tan(np.pi * cutoff / rate)
    poles = warped / low
    gain = np.real(1 / np.prod(-low))
    digital = (4 + poles) / (4 - poles)
    gain *= np.real(np.prod(np.full(order, 4.0)) / np.prod(4 - poles))
    return gain * np.real(np.poly(np.ones(order))), np.real(np.poly(digital))


def butterworth(x: np.ndarray, order: int = 2, cutoff: float = 0.01, rate: float = 1.0) -> np.ndarray:
    return both_ways(*butterworth_high(order, cutoff, rate), x)


def fir_high(taps: int, cutoff: float, rate: float) -> np.ndarray:
    """A high-pass of an odd number of taps: a windowed sinc, scaled to pass the highest frequency whole."""
    at = np.arange(taps) - (taps - 1) / 2
    edge = cutoff / (rate / 2)
    h = (np.sinc(at) - edge * np.sinc(edge * at)) * np.hamming(taps)
    return h / (h * np.cos(np.pi * at)).sum()


def fir(x: np.ndarray, taps: int = 101, cutoff: float = 0.01, rate: float = 1.0) -> np.ndarray:
    return both_ways(fir_high(taps, cutoff, rate), np.ones(1), x)


#: The scaling filter of the orthogonal wavelet with four vanishing moments.
DB4 = np.array([0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278])


def wavelet(x: np.ndarray, level: int = 5) -> np.ndarray:
    """The trace without its approximation after ``level`` periodic wavelet steps. Odd lengths repeat their last sample."""
    sizes, approx = [], x
    for _ in range(level):
        if len(approx) < len(DB4):
            break
        sizes.append(len(approx))
        even = np.append(approx, approx[-1]) if len(approx) % 2 else approx
        at = (2 * np.arange(len(even) // 2)[:, None] + np.arange(len(DB4))) % len(even)
        approx = even[at] @ DB4
    # The approximation alone, brought back to the length of the trace.
    for size in reversed(sizes):
        even = size + size % 2
        at = (2 * np.arange(len(approx))[:, None] + np.arange(len(DB4))) % even
        back = np.zeros(even)
        np.add.at(back, at, approx[:, None] * DB4)
        approx = back[:size]
    return x - approx if sizes else x - x.mean()


def _design(n: int, degree: int) -> np.ndarray:
    return np.vander(np.linspace(-1, 1, n), degree + 1, increasing=True)


def huber_baseline(x: np.ndarray, degree: int = 2, bend: float = 1.35, rounds: int = 50) -> np.ndarray:
    """A polynomial by reweighted least squares; residuals beyond ``bend`` deviations weigh less."""
    m, weight, fit = _design(len(x), degree), np.ones(len(x)), None
    for _ in range(rounds):
        root = np.sqrt(weight)
        new = np.linalg.lstsq(m * root[:, None], x * root, rcond=None)[0]
        rest = np.abs(x - m @ new)
        scale = max(np.median(rest) / 0.6744897501960817, 1e-12)
        weight = np.minimum(1, bend * scale / np.maximum(rest, 1e-300))
        if fit is not None and np.abs(new - fit).max() < 1e-9:
            break
        fit = new
    return m @ new


def ransac_baseline(x: np.ndarray, degree: int = 2, reach: float = 5.0, tries: int = 100, seed: int = 0) -> np.ndarray:
    """A polynomial through the largest set of samples within ``reach`` of one through few random samples."""
    rng, m, best = np.random.default_rng(seed), _design(len(x), degree), np.ones(len(x), bool)
    count = -1
    for _ in range(tries):
        some = rng.choice(len(x), degree + 1, replace=False)
        near = np.abs(x - m @ np.linalg.lstsq(m[some], x[some], rcond=None)[0]) <= reach
        if near.sum() > count:
            count, best = near.sum(), near
    return m @ np.linalg.lstsq(m[best], x[best], rcond=None)[0]


def exponential_baseline(x: np.ndarray, rates: int = 60) -> np.ndarray:
    """A decay a * exp(-k t) + c with a and k not negative: linear in a and c, so only k is searched, ever more finely."""
    t = np.arange(len(x)) / max(1, len(x) - 1)

    def fit(k):
        e = np.exp(-k * t)
        spread = e - e.mean()
        a = max(0.0, (spread @ (x - x.mean())) / max(spread @ spread, 1e-300))
        line = a * e + (x - a * e).mean()
        return ((x - line) ** 2).sum(), line

    lo, hi = 1e-3, 1e3
    for _ in range(4):
        ks = np.geomspace(lo, hi, rates)
        at = int(np.argmin([fit(k)[0] for k in ks]))
        lo, hi = ks[max(0, at - 1)], ks[min(rates - 1, at + 1)]
    return fit(ks[at])[1]


def masked(x: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """The trace with straight lines over the ``spans`` (ends included); nothing is left to draw them from if they cover it all."""
    free = np.ones(len(x), bool)
    for lo, hi in spans:
        free[max(0, lo) : hi + 1] = False
    at = np.arange(len(x))
    return np.interp(at, at[free], x[free]) if free.any() else x


def subtract_baseline(x: np.ndarray, fit, prominence: float, distance: int = 1, cut: int = 0) -> np.ndarray:
    """The trace less a baseline fitted to it without its peaks: they are detected, drawn over, and the start is cut from both."""
    found = signals.find_peaks(x, prominence, distance)
    spans = [(int(np.floor(lo)), int(np.ceil(hi))) for lo, hi in (signals.bounds(x, p, depth, 0.5) for p, depth in found)]
    return cut_start(x, cut) - fit(cut_start(masked(x, spans), cut))


def double_curve(x: np.ndarray, width: int = 101, part: tuple[float, float] | None = (10, 90), rounds: int = 5) -> np.ndarray:
    """The trace less a moving average that is drawn anew, ``rounds`` times, over samples whose residuals lie in a band.

    The band lies between two percentiles, or, without ``part``, within the half-height width of a normal curve through the histogram of the residuals.
    """
    at, drawn, base = np.arange(len(x)), x, np.zeros(len(x))
    for _ in range(rounds):
        half = min(width // 2, len(x) - 1)
        base = np.convolve(np.pad(drawn, half, mode="reflect"), np.full(2 * half + 1, 1 / (2 * half + 1)), mode="valid")
        rest = x - base
        lo, hi = np.percentile(rest, part) if part else _half_width(rest)
        inside = (rest >= lo) & (rest <= hi)
        if not inside.any():
            break
        drawn = np.interp(at, at[inside], x[inside])
    return x - base


def _half_width(rest: np.ndarray, bins: int = 100) -> tuple[float, float]:
    """Ends of the half-height width of the normal curve nearest to the histogram: a damped Gauss-Newton search."""
    count, edges = np.histogram(rest, bins)
    at = (edges[1:] + edges[:-1]) / 2
    p, damp = np.array([count.max(), at[count.argmax()], max(at.std(), 1e-12)], float), 1e-2

    def curve(p):
        return p[0] * np.exp(-((at - p[1]) ** 2) / (2 * p[2] ** 2))

    error = ((count - curve(p)) ** 2).sum()
    for _ in range(200):
        y = curve(p)
        slope = np.stack([y / p[0] if p[0] else np.zeros_like(y), y * (at - p[1]) / p[2] ** 2, y * (at - p[1]) ** 2 / p[2] ** 3], axis=1)
        square = slope.T @ slope
        step = np.linalg.lstsq(square + damp * np.diag(np.diag(square) + 1e-12), slope.T @ (count - y), rcond=None)[0]
        new = p + step
        trial = ((count - curve(new)) ** 2).sum() if new[2] != 0 else np.inf
        if trial < error:
            done = error - trial < 1e-10 * error
            p, error, damp = new, trial, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    reach = 2.355 * abs(p[2]) / 2
    return p[1] - reach, p[1] + reach


@dataclass(frozen=True)
class Minima:
    """Figures of the baseline through minima."""

    order: int = 20
    edge_window: int = 50
    edge_delta: float = 0.03
    shoulder_distance: int = 60
    shoulder_window: int = 100
    angle: float = 20.0
    least_distance: int = 10
    rounds: int = 10


def strict_minima(x: np.ndarray, order: int) -> np.ndarray:
    """Samples below each of their ``order`` neighbours on both sides; the ends never are."""
    wide = np.pad(x, order, constant_values=np.inf)
    near = np.lib.stride_tricks.sliding_window_view(wide, 2 * order + 1)
    low = x < np.delete(near, order, axis=1).min(axis=1)
    if len(low):
        low[[0, -1]] = False
    return np.flatnonzero(low)


def edge_anchors(x: np.ndarray, anchors: np.ndarray, p: Minima) -> np.ndarray:
    """``anchors`` with the least sample in front of the first and behind the last, if it is low enough beside them."""
    if not len(anchors):
        return anchors
    first, last, more = anchors[0], anchors[-1], []
    head, tail = x[: min(p.edge_window, first)], x[max(len(x) - p.edge_window, last + 1) :]
    if len(head) and head.min() <= x[first] * (1 - p.edge_delta):
        more.append(int(head.argmin()))
    if len(tail) and tail.min() <= x[last] * (1 + p.edge_delta):
        more.append(len(x) - len(tail) + int(tail.argmin()))
    return np.union1d(anchors, np.array(more, np.int64))


def without_shoulders(x: np.ndarray, anchors: np.ndarray, p: Minima) -> np.ndarray:
    """Anchors above both neighbours, which lie near, go; so does a last one near the end above its near neighbour. Repeated until none goes."""
    while len(anchors) > 1:
        near, rise = np.diff(anchors) <= p.shoulder_distance, np.diff(x[anchors])
        up, down = np.append(False, near & (rise > 0)), np.append(near & (rise < 0), False)
        away = up & down
        away[-1] = up[-1] and anchors[-1] > len(x) - p.shoulder_window
        if not away.any():
            break
        anchors = anchors[~away]
    return anchors


def without_sharp_turns(x: np.ndarray, anchors: np.ndarray, p: Minima) -> np.ndarray:
    """Inner anchors at which the line turns down by more than an angle go, unless it rises steeply on both sides. Repeated until none goes."""
    while len(anchors) > 2:
        run, rise = np.diff(anchors).astype(float), np.diff(x[anchors])
        angle = np.degrees(np.arctan2(rise, run))
        turn = np.abs(np.diff(angle))
        turn = np.minimum(turn, 360 - turn)
        bends_down = run[:-1] * rise[1:] - rise[:-1] * run[1:] < 0
        away = bends_down & (turn > p.angle) & ~((angle[:-1] > 30) & (angle[1:] > 30))
        if not away.any():
            break
        anchors = np.concatenate((anchors[:1], anchors[1:-1][~away], anchors[-1:]))
    return anchors


def below_trace(x: np.ndarray, anchors: np.ndarray, p: Minima) -> np.ndarray:
    """Anchors with the worst sample of each segment that lies below its line, if that is far enough from every anchor."""
    for _ in range(p.rounds):
        over = np.interp(np.arange(len(x)), anchors, x[anchors]) - x
        held = set(anchors.tolist())
        for lo, hi in zip(anchors[:-1], anchors[1:]):
            worst = int(lo) + int(np.argmax(over[lo : hi + 1]))
            if over[worst] > 0 and all(abs(worst - h) > p.least_distance for h in held):
                held.add(worst)
        if len(held) == len(anchors):
            break
        anchors = np.array(sorted(held))
    return anchors


def minima_anchors(x: np.ndarray, p: Minima = Minima()) -> np.ndarray:
    anchors = edge_anchors(x, strict_minima(x, p.order), p)
    anchors = without_sharp_turns(x, without_shoulders(x, anchors, p), p)
    return below_trace(x, anchors, p) if len(anchors) > 1 else anchors


def through_minima(x: np.ndarray, p: Minima = Minima()) -> np.ndarray:
    """The trace above the straight lines through its minima, 0 where it is below; zeros if fewer than two minima are left."""
    anchors = minima_anchors(x, p)
    if len(anchors) < 2:
        return np.zeros(len(x))
    return np.maximum(x - np.interp(np.arange(len(x)), anchors, x[anchors]), 0)


#: Detrenders by name; each takes a trace and gives one.
METHODS = {
    "butterworth": butterworth,
    "fir": fir,
    "wavelet": wavelet,
    "moving_average": lambda x: subtract_baseline(x, lambda v: signals.moving_average(v, 101), 50.0, 5),
    "polynomial": lambda x: subtract_baseline(x, lambda v: signals.polynomial(v, 2), 50.0, 5),
    "robust_polynomial": lambda x: subtract_baseline(x, huber_baseline, 50.0, 5),
    "exponential": lambda x: subtract_baseline(x, exponential_baseline, 50.0, 5),
    "savitzky_golay": lambda x: subtract_baseline(x, lambda v: signals.savitzky_golay(v, 101, 2), 50.0, 5),
    "double_curve": double_curve,
    "local_minima": through_minima,
}


def run(x: np.ndarray, method: str | None = "local_minima", normalise=signals.noise_score, sigma: float | None = 3.0, cut: int = 0) -> dict[str, np.ndarray]:
    """All versions of a trace on its way: cut, detrended, normalised, smoothed; steps without a method are left out."""
    out = {"raw": x}
    out["detrended"] = METHODS[method](cut_start(x, cut)) if method else cut_start(x, cut)
    out["normalised"] = normalise(out["detrended"]) if normalise else out["detrended"]
    out["smoothed"] = signals.gaussian(out["normalised"], sigma) if sigma else out["normalised"]
    return out
