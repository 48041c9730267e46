"""Voronoi cells of a table of points: each cell is cut out of its own surroundings, and a wider look is taken only where that does not settle it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.functions import similarity
from tidewave.operators import graph, spatial

#: Sides of a cell shorter than this share of the box are no sides.
THIN = 1e-12
_SIDES = "array<struct<other: bigint, x0: double, y0: double, x1: double, y1: double>>"


def cut_out(point: np.ndarray, others: np.ndarray, box: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(corners, labels) of the part of ``box`` nearer to ``point`` than to any of ``others``: the side behind a corner lies against the point of that
    label, or against the box (-1). Others are taken from near to far, until half their distance exceeds that of the farthest corner."""
    x0, y0, x1, y1 = box
    corners, labels = np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float), np.full(4, -1)
    away = others - point
    square = (away**2).sum(axis=1)
    for k in np.argsort(square, kind="stable"):
        if square[k] == 0:
            continue
        if square[k] > 4 * ((corners - point) ** 2).sum(axis=1).max():
            break
        beyond = (corners - point) @ away[k] - square[k] / 2
        out = beyond > 0
        if not out.any():
            continue
        new, named = [], []
        for t in range(len(corners)):
            u = (t + 1) % len(corners)
            if not out[t]:
                new.append(corners[t])
                named.append(labels[t])
            if out[t] != out[u]:
                new.append(corners[t] + (corners[u] - corners[t]) * (beyond[t] / (beyond[t] - beyond[u])))
                named.append(k if out[u] else labels[t])
        corners, labels = np.array(new), np.array(named)
    return corners, labels


def _cells(near: DataFrame, radius: float, box: tuple[float, float, float, float]) -> DataFrame:
    """(cell, sure, rim, sides) of points with the points within ``radius``: is the cell settled, does it reach the box, and its sides against others."""
    thin = THIN * max(box[2] - box[0], box[3] - box[1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for cell, x, y, held in zip(pdf["cell"], pdf["x"], pdf["y"], pdf["near"]):
                ids, point = [h["other"] for h in held], np.array([x, y])
                corners, labels = cut_out(point, np.array([[h["x2"], h["y2"]] for h in held]).reshape(-1, 2), box)
                after = np.roll(corners, -1, axis=0)
                long = np.abs(after - corners).max(axis=1) > thin
                sides = [(ids[k], *a, *b) for k, a, b, fit in zip(labels, corners, after, long) if fit and k >= 0]
                sure = 4 * ((corners - point) ** 2).sum(axis=1).max() <= radius**2
                out.append((cell, bool(sure), bool((labels[long] < 0).any()), [dict(zip(("other", "x0", "y0", "x1", "y1"), s)) for s in sides]))
            yield pd.DataFrame(out, columns=["cell", "sure", "rim", "sides"])

    return near.mapInPandas(run, f"cell long, sure boolean, rim boolean, sides {_SIDES}")


def voronoi(points: DataFrame, margin: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(sides, neighbours) of ``points(cell, x, y)``, cells once each: the sides (cell_a, cell_b, x0, y0, x1, y1) of Voronoi cells inside the box ``margin`` around all
    points, and the pairs (cell_a, cell_b) whose cells share a side anywhere; ``cell_a`` is the smaller.

    A point sees the points within a radius; its cell is settled if no corner is farther away than half of it, as no point beyond could cut it. Where
    it is not, the radius doubles, for those points alone. Outside the box only cells that reach it meet, so sides out there follow from those
    cells: about as many as the rim is long, in one task. Points in one place share a cell and are not neighbours.
    """
    spark = points.sparkSession
    p = graph.cut(points.select("cell", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    b = p.agg(F.count("*").alias("n"), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    schema = "cell_a long, cell_b long, x0 double, y0 double, x1 double, y1 double"
    if b["n"] < 2:
        return spark.createDataFrame([], schema), spark.createDataFrame([], "cell_a long, cell_b long")
    box = (b[1] - margin, b[2] - margin, b[3] + margin, b[4] + margin)
    reach = float(np.hypot(box[2] - box[0], box[3] - box[1]))
    radius = min(max(((box[2] - box[0]) * (box[3] - box[1]) / b["n"]) ** 0.5 * 2, 1e-6 * reach), 2 * reach)
    todo, settled = p, []
    while True:
        other = p.select(F.col("cell").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        met = spatial.within(todo, other, radius).filter("cell <> other").groupBy("cell").agg(F.collect_list(F.struct("other", "x2", "y2")).alias("near"))
        near = todo.join(met, "cell", "left").withColumn("near", F.coalesce("near", F.array().cast("array<struct<other: bigint, x2: double, y2: double>>")))
        found = graph.cut(_cells(near, radius, box))
        settled.append(found.filter("sure"))
        left = graph.cut(todo.join(found.filter("NOT sure").select("cell"), "cell", "left_semi"))
        if not left.limit(1).count():
            break
        todo, radius = left, min(2 * radius, 2 * reach)
    cells = settled[0]
    for more in settled[1:]:
        cells = cells.union(more)
    sides = graph.cut(cells.select(F.col("cell").alias("cell_a"), F.explode("sides").alias("s")).select("cell_a", F.col("s.other").alias("cell_b"), "s.x0", "s.y0", "s.x1", "s.y1").filter("cell_a < cell_b"))
    rim = p.join(cells.filter("rim").select("cell"), "cell", "left_semi")

    def outside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell", ignore_index=True)
        at, ids = pdf[["x", "y"]].to_numpy(float), pdf["cell"].to_numpy()
        pairs = [(ids[i], ids[j]) for i, j in similarity.delaunay_edges(at) if _leaves(at, i, j, box)]
        return pd.DataFrame(pairs, columns=["cell_a", "cell_b"])

    far = rim.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(outside, "cell_a long, cell_b long")
    return sides, graph.cut(sides.select("cell_a", "cell_b").union(far).distinct())


def _leaves(points: np.ndarray, i: int, j: int, box: tuple[float, float, float, float]) -> bool:
    """Whether the side between two of ``points`` has a part outside the box."""
    mid, way = (points[i] + points[j]) / 2, (points[j] - points[i])[::-1] * np.array([-1.0, 1.0])
    others = np.delete(points, [i, j], axis=0)
    slope = (others - points[i]) @ way
    room = ((others**2).sum(axis=1) - (points[i] ** 2).sum()) / 2 - (others - points[i]) @ mid
    hi = (room[slope > 1e-12] / slope[slope > 1e-12]).min(initial=np.inf)
    lo = (room[slope < -1e-12] / slope[slope < -1e-12]).max(initial=-np.inf)
    if hi - lo <= 1e-12:
        return False
    ends = [mid + t * way for t in (lo, hi) if np.isfinite(t)]
    return len(ends) < 2 or any(not (box[0] <= x <= box[2] and box[1] <= y <= box[3]) for x, y in ends)
