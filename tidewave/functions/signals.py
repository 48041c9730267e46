"""Kernels over one trace (a float array) and their application to rows that hold one trace each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-8
#: Samples a worker takes up and gives back at a time.
PIECE = 1 << 18


def dense(points: DataFrame, keys: list[str], frame: str, value: str, length=None) -> DataFrame:
    """One row a key with ``values``: the summed value of each frame from 0, 0 where there is none. Frames outside go.

    ``length`` is a number or, by default, that of the last frame of all points. Only sums that exist are shuffled; the zeros between them are
    filled in behind the shuffle, in one pass over a trace. A key that is null equals no other, so its trace is 0 throughout.
    """
    known = sum((F.col(k).isNull().cast("int") for k in keys), F.lit(0)) == 0
    sums = points.filter(F.col(frame) >= 0).groupBy(*keys, F.col(frame).cast("int").alias("_f")).agg(F.sum(value).cast("double").alias("_v"))
    last = points.agg(F.max(frame).cast("int").alias("_last")) if length is None else points.sparkSession.range(1).select(F.lit(length - 1).alias("_last"))
    sums = sums.select(*keys, F.struct("_f", F.when(known, F.coalesce("_v", F.lit(0.0))).otherwise(F.lit(0.0)).alias("v")).alias("_s"))
    each = sums.groupBy(*keys).agg(F.array_sort(F.collect_list("_s")).alias("_all")).crossJoin(F.broadcast(last))
    each = each.withColumn("_all", F.filter("_all", lambda s: s["_f"] <= F.col("_last")))
    zeros = lambda start, end: F.array_repeat(F.lit(0.0), F.coalesce(end, F.col("_last") + 1) - start)
    filled = F.flatten(F.transform("_all", lambda s, i: F.concat(F.array(s["v"]), zeros(s["_f"] + 1, F.get("_all", i + 1)["_f"]))))
    return each.select(*keys, F.concat(zeros(F.lit(0), F.get("_all", F.lit(0))["_f"]), filled).alias("values"))


def convolve(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Weighted mean around each sample; beyond the ends the trace is mirrored, its end samples repeated."""
    half = len(kernel) // 2
    return np.convolve(np.pad(x, half, mode="symmetric"), kernel[::-1], mode="valid")[: len(x)]


def moving_average(x: np.ndarray, width: int) -> np.ndarray:
    return convolve(x, np.full(width, 1 / width))


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    reach = np.arange(-int(4 * sigma + 0.5), int(4 * sigma + 0.5) + 1)
    weights = np.exp(-0.5 * (reach / sigma) ** 2)
    return convolve(x, weights / weights.sum())


def savitzky_golay(x: np.ndarray, width: int, order: int) -> np.ndarray:
    at = np.arange(width) - width // 2
    return convolve(x, np.linalg.pinv(np.vander(at, order + 1, increasing=True))[0])


def polynomial(x: np.ndarray, degree: int) -> np.ndarray:
    at = np.linspace(-1, 1, len(x))
    return np.polyval(np.polyfit(at, x, degree), at)


def min_max(x: np.ndarray, least_range: float = 0.0) -> np.ndarray:
    span = np.ptp(x)
    return x - x.min() if span < least_range else (x - x.min()) / (span + EPS)


def percentile_scale(x: np.ndarray, q: float) -> np.ndarray:
    base = np.percentile(x, q)
    return (x - base) / (x.max() - base + EPS)


def delta_f(x: np.ndarray, q: float, least_range: float) -> np.ndarray:
    base = max(np.percentile(x, q), least_range)
    d = (x - base) / (base + EPS)
    return d / (np.abs(d).max() + EPS)


def noise_score(x: np.ndarray, sigma: float = 3.0, clip: float = 80.0, least: int = 10) -> np.ndarray:
    """The trace in units of its noise: the spread of the smaller residuals from a smooth. Too few of them leave it as it is."""
    rest = x - gaussian(x, sigma)
    small = rest[np.abs(rest) < np.percentile(np.abs(rest), clip)]
    return x if len(small) < least else x / (small.std() + EPS)


def minima_baseline(x: np.ndarray, order: int) -> np.ndarray:
    """Straight lines through minima strictly below their ``order`` neighbours on both sides, flat outside; lowered where the trace dips below."""
    pad = np.pad(x, order, constant_values=np.inf)
    near = np.lib.stride_tricks.sliding_window_view(pad, 2 * order + 1)
    others = np.delete(near, order, axis=1).min(axis=1)
    anchors = np.flatnonzero(x < others)
    if not len(anchors):
        return np.full(len(x), x.min())
    at = np.arange(len(x))
    while True:
        base = np.interp(at, anchors, x[anchors])
        over = base - x
        worst = [lo + int(np.argmax(over[lo : hi + 1])) for lo, hi in zip(np.r_[0, anchors], np.r_[anchors, len(x) - 1])]
        new = [i for i in worst if over[i] > 1e-12]
        if not new:
            return base
        anchors = np.union1d(anchors, new)


def detrend(x: np.ndarray, order: int = 20) -> np.ndarray:
    return np.maximum(x - minima_baseline(x, order), 0)


def maxima(x: np.ndarray) -> np.ndarray:
    """Samples, or middles of level runs (rounded down), that both neighbouring runs are below."""
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    ends = np.r_[starts[1:], len(x)] - 1
    level = x[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (starts[top] + ends[top]) // 2


def prominence(x: np.ndarray, peak: int) -> float:
    higher = np.flatnonzero(x > x[peak])
    lo = higher[higher < peak].max(initial=-1) + 1
    hi = higher[higher > peak].min(initial=len(x))
    return float(x[peak] - max(x[lo : peak + 1].min(), x[peak:hi].min()))


def bounds(x: np.ndarray, peak: int, depth: float, part: float) -> tuple[float, float]:
    """Where the trace falls to ``part`` of the prominence below the peak, by straight lines between samples."""
    bar = x[peak] - part * depth
    lo = peak
    while lo > 0 and x[lo] > bar:
        lo -= 1
    hi = peak
    while hi < len(x) - 1 and x[hi] > bar:
        hi += 1
    left = lo + (bar - x[lo]) / (x[lo + 1] - x[lo]) if x[lo] < bar else float(lo)
    right = hi - (bar - x[hi]) / (x[hi - 1] - x[hi]) if x[hi] < bar else float(hi)
    return left, right


def savitzky_golay_ends(x: np.ndarray, width: int, order: int) -> np.ndarray:
    """Savitzky-Golay with a polynomial through the first and last ``width`` samples in place of mirrored ends."""
    out, half = savitzky_golay(x, width, order), width // 2
    if len(x) >= width:
        at = np.arange(width)
        out[:half] = np.polyval(np.polyfit(at, x[:width], order), at[:half])
        out[len(x) - half :] = np.polyval(np.polyfit(at, x[-width:], order), at[width - half :])
    return out


def find_peaks(x: np.ndarray, least_prominence: float, distance: int = 1, *, height: float | None = None, threshold: float | None = None, width: float | None = None) -> list[tuple[int, float]]:
    """(sample, prominence), in order. Peaks pass height, steps to both neighbours, then, of peaks closer than ``distance``, the taller stays;
    then the prominence and the width at half of it decide."""
    found = maxima(x)
    if height is not None:
        found = found[x[found] >= height]
    if threshold is not None and len(found):
        found = found[np.minimum(x[found] - x[found - 1], x[found] - x[found + 1]) >= threshold]
    free = np.ones(len(found), bool)
    for i in np.argsort(-x[found], kind="stable"):
        if free[i]:
            free[(np.abs(found - found[i]) < distance) & (np.arange(len(found)) != i)] = False
    out = [(int(p), depth) for p in found[free] if (depth := prominence(x, p)) >= least_prominence]
    return out if width is None else [(p, depth) for p, depth in out if np.subtract(*bounds(x, p, depth, 0.5)[::-1]) >= width]


def valleys(x: np.ndarray, peak: int, search: int = 350, window: int = 15) -> tuple[int, int]:
    """The nearest samples on both sides, within ``search``, that no sample within ``window`` is below; else the ends of the search."""
    wide = np.lib.stride_tricks.sliding_window_view(np.pad(x, window, constant_values=np.inf), 2 * window + 1)
    low = np.flatnonzero(x <= wide.min(axis=1))
    left, right = low[(low < peak) & (low >= peak - search)], low[(low > peak) & (low <= peak + search)]
    return int(left.max(initial=max(0, peak - search))), int(right.min(initial=min(len(x) - 1, peak + search)))


def grouping(spans: list[tuple[int, int]], heights: list[float], least: int = 2) -> list[int]:
    """Each peak's parent (its own number if none): the tallest peak, ties to the earlier, it shares ``least`` frames with."""
    out = []
    for i, (lo, hi) in enumerate(spans):
        taller = [j for j, (a, b) in enumerate(spans) if min(hi, b) - max(lo, a) + 1 >= least and (heights[j], -j) > (heights[i], -i)]
        out.append(max(taller, key=lambda j: (heights[j], -j)) if taller else i)
    return out


def _pieces(batches):
    """Rows of Arrow batches, at most ``PIECE`` samples (or one trace) together, with their traces."""
    for batch in batches:
        n = len(batch.column("values").flatten())
        rows = max(1, PIECE * batch.num_rows // max(n, 1))
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, (np.array(v.values.to_numpy(zero_copy_only=False), float) for v in part.column("values"))


def transform(traces: DataFrame, keys: list[str], kernel, name: str = "values") -> DataFrame:
    """``kernel`` applied to each row's ``values``. Rows are traces, so nothing is shuffled; a worker holds the results of a few at a time."""

    def run(batches):
        for part, found in _pieces(batches):
            values = pa.array([np.asarray(kernel(x), float) for x in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), values], names=[*keys, name])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in traces.select(keys).schema)
    return traces.select(*keys, "values").mapInArrow(run, f"{head}, {name} array<double>")


def detect(traces: DataFrame, keys: list[str], least_prominence: float, distance: int = 1, *, part: float = 0.5, base_part: float = 0.9, refine: bool = False, parents_only: bool = False, **limits) -> DataFrame:
    """One row a peak: number in its trace, frame, height, prominence, span at ``part`` of the prominence and at ``base_part``, parent, symmetry
    (null if it has no width). ``refine`` lets spans shrink to the valleys around; ``parents_only`` drops peaks with a parent and numbers the rest anew."""
    kinds = {"peak_id": pa.int32(), "frame": pa.int32(), "height": pa.float64(), "prominence": pa.float64(), **dict.fromkeys(["onset", "offset", "base_onset", "base_offset", "parent_id"], pa.int32()), "symmetry": pa.float64()}

    def run(batches):
        for some, found_in in _pieces(batches):
            rows, of = [], []
            for row, x in enumerate(found_in):
                found = find_peaks(x, least_prominence, distance, **limits)
                spans, bases = ([(int(np.floor(lo)), int(np.ceil(hi))) for lo, hi in (bounds(x, p, depth, q) for p, depth in found)] for q in (part, base_part))
                if refine:
                    near = [valleys(x, p) for p, _ in found]
                    spans, bases = ([(max(a, c), min(b, d)) for (a, b), (c, d) in zip(old, near)] for old in (spans, bases))
                parents = grouping(spans, [x[p] for p, _ in found])
                kept = [i for i, parent in enumerate(parents) if parent == i or not parents_only]
                number = {i: k for k, i in enumerate(kept)}
                for i in kept:
                    (p, depth), (lo, hi) = found[i], spans[i]
                    symmetry = 1 - abs((p - lo) - (hi - p)) / (hi - lo) if hi > lo else None
                    rows.append((number[i], p, float(x[p]), depth, lo, hi, *bases[i], number[parents[i]], symmetry))
                of += [row] * len(kept)
            columns = zip(*rows) if rows else ((),) * len(kinds)
            own = [some.column(k).take(pa.array(of, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, kind) for c, kind in zip(columns, kinds.values()))], names=[*keys, *kinds])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in traces.select(keys).schema)
    schema = f"{head}, peak_id int, frame int, height double, prominence double, onset int, offset int, base_onset int, base_offset int, parent_id int, symmetry double"
    return traces.select(*keys, "values").mapInArrow(run, schema)


def binary(detected: DataFrame, keys: list[str], recording: DataFrame | int) -> DataFrame:
    """(keys, frame): frames inside the span of any detected peak, clamped to the frames of ``recording`` (or to that many frames)."""
    last = detected.sparkSession.range(1).select(F.lit(recording - 1).alias("_last")) if isinstance(recording, int) else recording.agg(F.max("frame").cast("int").alias("_last"))
    span = F.sequence(F.greatest("onset", F.lit(0)), F.least("offset", F.col("_last")))
    return detected.crossJoin(F.broadcast(last)).select(*keys, F.explode(span).alias("frame")).distinct()
