"""Clusters and causes among few units, each on one small matrix: the units of one window or recording, never of a corpus."""

from __future__ import annotations

import numpy as np
import pandas as pd

from tidewave.functions.special import f_tail


def _overlaps(a: np.ndarray, b: np.ndarray, lag: int):
    """The parts of two sets of traces (unit by time) that lie beside each other at each shift: ``a`` at time t + k beside ``b`` at t."""
    for k in range(-lag, lag + 1):
        n = a.shape[1] - abs(k)
        if n > 0:
            yield a[:, max(k, 0) : max(k, 0) + n], b[:, max(-k, 0) : max(-k, 0) + n]


def lagged_xcorr(a: np.ndarray, b: np.ndarray, lag: int) -> np.ndarray:
    """Greatest product of each trace of ``a`` with each of ``b`` over the shifts, by their lengths."""
    size = lambda v: np.sqrt((v * v).sum(axis=1))
    return np.max([x @ y.T for x, y in _overlaps(a, b, lag)], axis=0) / (np.outer(size(a), size(b)) + 1e-8)


def lagged_jaccard(a: np.ndarray, b: np.ndarray, lag: int) -> np.ndarray:
    """Greatest share of the times both are on among those one is, over the shifts; 0 if there are none."""
    best = np.zeros((len(a), len(b)))
    for x, y in _overlaps(a.astype(float), b.astype(float), lag):
        both = x @ y.T
        best = np.maximum(best, both / np.maximum(x.sum(axis=1)[:, None] + y.sum(axis=1) - both, 1))
    return best


def mid_ranks(v: np.ndarray) -> np.ndarray:
    """Ranks within each row; ties share their mean."""
    return pd.DataFrame(v).rank(axis=1).to_numpy()


def lagged_correlation(a: np.ndarray, b: np.ndarray, lag: int, of=lambda v: v) -> np.ndarray:
    """Greatest correlation over the shifts of what ``of`` makes of the parts beside each other; flat parts have none, and 0 stands for none at all."""
    best = np.full((len(a), len(b)), -np.inf)
    for x, y in _overlaps(a, b, lag):
        x, y = of(x), of(y)
        (x, p), (y, q) = ((v - v.mean(axis=1, keepdims=True), v.std(axis=1)) for v in (x, y))
        some = (p > 1e-6)[:, None] & (q > 1e-6)
        best = np.where(some, np.maximum(best, x @ y.T / x.shape[1] / np.where(some, np.outer(p, q), 1.0)), best)
    return np.where(best == -np.inf, 0.0, best)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return np.clip(unit(a) @ unit(b).T, -1, 1)


def merges(dist: np.ndarray, kind: str = "complete") -> list[tuple[int, int, float]]:
    """(i, j, height) of agglomerative merges, in order; the cluster of ``j`` joins that of ``i``. Distances to a merged cluster follow from those to its parts."""
    n = len(dist)
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, out = np.ones(n), []
    for _ in range(n - 1):
        i, j = sorted(map(int, np.unravel_index(np.argmin(d), d.shape)))
        out.append((i, j, float(d[i, j])))
        if kind == "complete":
            row = np.maximum(d[i], d[j])
        elif kind == "single":
            row = np.minimum(d[i], d[j])
        else:
            row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
    return out


def labels_at(n: int, tree: list[tuple[int, int, float]], threshold: float) -> np.ndarray:
    """Labels of ``n`` units after the merges up to ``threshold``."""
    owner = np.arange(n)
    for i, j, height in tree:
        if height <= threshold:
            owner[owner == owner[j]] = owner[i]
    return np.unique(owner, return_inverse=True)[1]


def linkage_labels(dist: np.ndarray, threshold: float, kind: str = "complete") -> tuple[np.ndarray, np.ndarray]:
    """(labels, merge heights) of agglomerative clusters cut at ``threshold``."""
    tree = merges(dist, kind)
    return labels_at(len(dist), tree, threshold), np.array([h for _, _, h in tree])


def silhouette(dist: np.ndarray, labels: np.ndarray) -> float:
    """Mean of (b - a) / max(a, b): mean distance to the nearest other cluster and to the own one; 0 for clusters of one."""
    kinds = np.unique(labels)
    if not 1 < len(kinds) < len(labels):
        return -1.0
    sums = np.stack([dist[:, labels == k].sum(axis=1) for k in kinds], axis=1)
    counts = np.array([(labels == k).sum() for k in kinds])
    own = np.searchsorted(kinds, labels)
    at = np.arange(len(labels))
    inner = sums[at, own] / np.maximum(counts[own] - 1, 1)
    means = sums / counts
    means[at, own] = np.inf
    outer = means.min(axis=1)
    return float(np.where(counts[own] > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0).mean())


def automatic_threshold(dist: np.ndarray, kind: str = "average", window: int = 30, spread: float = 0.2) -> float:
    """The height to cut at: within ``spread`` of the merge behind the largest jump among the last ``window``, with the best silhouette (ties: the lowest).

    One linkage serves all tries, as labels change at merge heights only: the lower end of the range and the heights inside it are enough.
    """
    tree = merges(dist, kind)
    last = sorted(h for _, _, h in tree)[-window:]
    if len(last) < 2:
        return last[0] if last else 0.0
    behind = int(np.diff(last).argmax()) + 1
    low = last[behind] * (1 - spread)
    near = {low} | {h for h in last if low < h <= last[behind] * (1 + spread)}
    best, height = max((silhouette(dist, labels_at(len(dist), tree, h)), -h) for h in near)
    return -height if best > -1 else last[behind]


def density_hierarchy(dist: np.ndarray, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(labels, probabilities) of the most stable clusters of the hierarchy of mutual reachability; -1 and 0 for noise."""
    n = len(dist)
    labels, share = np.full(n, -1), np.zeros(n)
    if n <= least:
        return labels, share
    core = np.sort(dist, axis=1)[:, min(least, n - 1)]
    reach = np.maximum(dist, np.maximum(core[:, None], core[None, :]))

    def split(members: np.ndarray, born: float) -> tuple[float, list]:
        """Stability of the best choice below, and its clusters as (members, the density at which each leaves)."""
        part, leave, at = members, {}, born
        while True:
            sub = reach[np.ix_(part, part)].copy()
            np.fill_diagonal(sub, 0)
            height = linkage_labels(sub, np.inf, "single")[1].max() if len(part) > 1 else 0.0
            density = 1 / max(height, 1e-12)
            pieces = linkage_labels(sub, height * (1 - 1e-12), "single")[0] if len(part) > 1 else np.zeros(1, int)
            groups = [part[pieces == k] for k in np.unique(pieces)]
            large = [g for g in groups if len(g) >= least]
            for g in groups:
                if len(g) < least or len(large) != 1:
                    leave.update((int(i), density) for i in g)
            at = density
            if len(large) != 1 or len(large[0]) == len(part):
                break
            part = large[0]
        leave.update((int(i), at) for i in part if int(i) not in leave)
        own = sum(leave[int(i)] - born for i in members)
        below = [split(g, at) for g in large] if len(large) > 1 else []
        if below and sum(s for s, _ in below) > own:
            return sum(s for s, _ in below), [c for _, cs in below for c in cs]
        return own, [(members, leave)]

    _, found = split(np.arange(n), 0.0)
    if len(found) == 1 and len(found[0][0]) == n:
        return labels, share
    for k, (members, leave) in enumerate(found):
        most = max(leave.values())
        for i in members:
            labels[i], share[i] = k, min(1.0, leave[int(i)] / most)
    return labels, share


def affinity(sim: np.ndarray, preference: float | None = None, damping: float = 0.9, rounds: int = 200, still: int = 15) -> np.ndarray:
    """Labels by messages of responsibility and availability between units and their possible examples."""
    n = len(sim)
    s = sim.astype(float).copy()
    np.fill_diagonal(s, np.median(sim) if preference is None else preference)
    r, a, last, calm = np.zeros((n, n)), np.zeros((n, n)), None, 0
    at = np.arange(n)
    for _ in range(rounds):
        both = a + s
        first = both.argmax(axis=1)
        top = both[at, first]
        both[at, first] = -np.inf
        new = s - top[:, None]
        new[at, first] = s[at, first] - both.max(axis=1)
        r = damping * r + (1 - damping) * new
        positive = np.maximum(r, 0)
        positive[at, at] = r[at, at]
        total = positive.sum(axis=0)
        new = np.minimum(0, total[None, :] - positive)
        new[at, at] = total - r[at, at]
        a = damping * a + (1 - damping) * new
        chosen = np.flatnonzero(np.diag(a + r) > 0)
        calm = calm + 1 if last is not None and np.array_equal(chosen, last) else 0
        last = chosen
        if calm >= still and len(chosen):
            break
    if last is None or not len(last):
        return np.full(n, -1)
    labels = s[:, last].argmax(axis=1)
    labels[last] = np.arange(len(last))
    return labels


def communities(sim: np.ndarray, threshold: float = 0.7) -> np.ndarray:
    """Labels by greedy merges that raise modularity, over edges of similarity ``threshold`` or more; the largest community is 0."""
    n = len(sim)
    w = np.where(sim >= threshold, sim, 0.0)
    np.fill_diagonal(w, 0)
    total = w.sum()
    if total == 0:
        return np.full(n, -1)
    e, group = w / total, np.arange(n)
    alive = np.ones(n, bool)
    while alive.sum() > 1:
        share = e.sum(axis=1)
        gain = np.where(e > 0, 2 * (e - np.outer(share, share)), -np.inf)
        np.fill_diagonal(gain, -np.inf)
        gain[~alive], gain[:, ~alive] = -np.inf, -np.inf
        i, j = sorted(np.unravel_index(np.argmax(gain), gain.shape))
        if gain[i, j] <= 0:
            break
        e[i] += e[j]
        e[:, i] += e[:, j]
        e[j], e[:, j] = 0, 0
        alive[j] = False
        group[group == j] = i
    kinds, size = np.unique(group, return_counts=True)
    number = {k: i for i, k in enumerate(kinds[np.lexsort((kinds, -size))])}
    labels = np.array([number[g] for g in group])
    labels[w.sum(axis=1) == 0] = -1
    return labels


def _lags(x: np.ndarray, lag: int) -> np.ndarray:
    return np.stack([x[lag - k : len(x) - k] for k in range(1, lag + 1)], axis=1)


def granger(cause: np.ndarray, effect: np.ndarray, lag: int = 3) -> tuple[float, float]:
    """(F, p): do the last values of ``cause`` help to foretell ``effect`` beyond its own? Least squares with and without them."""
    y = effect[lag:]
    own = np.column_stack((np.ones(len(y)), _lags(effect, lag)))
    both = np.column_stack((own, _lags(cause, lag)))
    rest = [((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum() for m in (own, both)]
    free = len(y) - both.shape[1]
    if free <= 0 or rest[1] <= 1e-12:
        return 0.0, 1.0
    f = max(0.0, (rest[0] - rest[1]) / lag / (rest[1] / free))
    return float(f), f_tail(f, lag, free)


def granger_matrix(traces: np.ndarray, lag: int = 3) -> np.ndarray:
    """F of each cause (row) for each effect (column) in one model of all traces (time by unit)."""
    t, n = traces.shape
    past = np.hstack([_lags(traces[:, i], lag) for i in range(n)])
    m = np.column_stack((np.ones(t - lag), past))
    y = traces[lag:]
    inverse = np.linalg.pinv(m.T @ m)
    coefficients = inverse @ m.T @ y
    free = max(1, len(y) - m.shape[1])
    noise = ((y - m @ coefficients) ** 2).sum(axis=0) / free
    out = np.zeros((n, n))
    for i in range(n):
        at = slice(1 + i * lag, 1 + (i + 1) * lag)
        middle = np.linalg.pinv(inverse[at, at])
        wald = np.einsum("kj,kl,lj->j", coefficients[at], middle, coefficients[at])
        out[i] = wald / lag / np.maximum(noise, 1e-300)
    np.fill_diagonal(out, 0)
    return out


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull: the points in order of x, walked along both sides."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return 0.0

    def side(order):
        out: list = []
        for q in order:
            while len(out) > 1 and np.linalg.det(np.array([out[-1] - out[-2], q - out[-1]])) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    ring = np.array(side(p) + side(p[::-1]))
    x, y = ring[:, 0], ring[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def delaunay_edges(points: np.ndarray) -> set[tuple[int, int]]:
    """Pairs of points whose Voronoi cells share a side, by adding points one at a time and opening the circles they lie in."""
    n = len(points)
    if n < 3:
        return {(0, 1)} if n == 2 else set()
    centre, span = points.mean(axis=0), max(np.ptp(points, axis=0).max(), 1.0) * 1e3
    p = np.vstack((points, centre + span * np.array([[-2, -1], [2, -1], [0, 2]]))).astype(float)

    def circles(tri):
        a, b, c = p[tri[:, 0]], p[tri[:, 1]] - p[tri[:, 0]], p[tri[:, 2]] - p[tri[:, 0]]
        turn = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
        bb, cc = (b**2).sum(axis=1), (c**2).sum(axis=1)
        off = np.stack(((c[:, 1] * bb - b[:, 1] * cc) / turn, (b[:, 0] * cc - c[:, 0] * bb) / turn), axis=1)
        return a + off, (off**2).sum(axis=1)

    held = np.array([[n, n + 1, n + 2]])
    middle, square = circles(held)
    for k in range(n):
        bad = ((middle - p[k]) ** 2).sum(axis=1) < square * (1 - 1e-12)
        sides = np.sort(held[bad][:, [0, 1, 1, 2, 2, 0]].reshape(-1, 2), axis=1)
        rim, times = np.unique(sides, axis=0, return_counts=True)
        new = np.column_stack((rim[times == 1], np.full((times == 1).sum(), k)))
        m, q = circles(new)
        held, middle, square = np.vstack((held[~bad], new)), np.vstack((middle[~bad], m)), np.concatenate((square[~bad], q))
    sides = np.sort(held[:, [0, 1, 1, 2, 2, 0]].reshape(-1, 2), axis=1)
    return {(int(i), int(j)) for i, j in sides if j < n}


def ridges(points: np.ndarray, box: tuple[float, float, float, float]) -> list[tuple[int, int, float, float, float, float]]:
    """(i, j, x0, y0, x1, y1): the side the cells of two neighbours share, cut at the ``box`` (x0, y0, x1, y1).

    The side is the part of the line of equal distance on which no third point is nearer, so rays that never end need no case of their own.
    """
    out = []
    for i, j in sorted(delaunay_edges(points)):
        mid, way = (points[i] + points[j]) / 2, (points[j] - points[i])[::-1] * np.array([-1.0, 1.0])
        lo, hi = -np.inf, np.inf
        # Each bound is a half plane (normal, limit): normal @ point <= limit.
        others = np.delete(np.arange(len(points)), [i, j])
        normal = np.vstack((points[others] - points[i], [[-1, 0], [1, 0], [0, -1], [0, 1]]))
        limit = np.concatenate((((points[others] ** 2).sum(axis=1) - (points[i] ** 2).sum()) / 2, [-box[0], box[2], -box[1], box[3]]))
        slope, room = normal @ way, limit - normal @ mid
        up, down = slope > 1e-12, slope < -1e-12
        hi, lo = min(hi, (room[up] / slope[up]).min(initial=np.inf)), max(lo, (room[down] / slope[down]).max(initial=-np.inf))
        if (room[~up & ~down] >= -1e-9).all() and hi - lo > 1e-12:
            out.append((i, j, *(mid + lo * way), *(mid + hi * way)))
    return out


def logistic_fit(x: np.ndarray, y: np.ndarray, rounds: int = 500) -> tuple[float, float, float]:
    """(limit, rate, middle) of the logistic curve nearest to the points: a damped Gauss-Newton search."""
    p, damp = np.array([max(y.max(), 1e-9), 1.0, x.mean()]), 1e-2
    curve = lambda p: p[0] / (1 + np.exp(np.clip(-p[1] * (x - p[2]), -500, 500)))
    error = ((y - curve(p)) ** 2).sum()
    for _ in range(rounds):
        f = curve(p)
        s = f / p[0] if p[0] else np.zeros_like(f)
        slope = np.stack([s, p[0] * s * (1 - s) * (x - p[2]), -p[0] * s * (1 - s) * p[1]], axis=1)
        square = slope.T @ slope
        new = p + np.linalg.lstsq(square + damp * np.diag(np.diag(square) + 1e-9), slope.T @ (y - f), rcond=None)[0]
        trial = ((y - curve(new)) ** 2).sum()
        if trial < error:
            small = error - trial <= 1e-12 * error
            p, error, damp = new, trial, max(damp / 3, 1e-12)
            if small:
                break
        else:
            damp *= 4
            if damp > 1e15:
                break
    return tuple(float(v) for v in p)
