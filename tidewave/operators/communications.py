"""Communications between peaks: causes of co-peaking groups, breadth-first parents inside them, and farthest-back causes of the rest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.functions import planar
from tidewave.operators import graph, joins, spatial

#: Peaks of the fullest frame above which frames are taken whole; below, a task a frame costs more than a table of the few pairs.
FEW = 16


def _by_edges(rows: DataFrame, other: DataFrame, edges: DataFrame, lo: int, hi: int) -> DataFrame:
    spans = rows.join(edges, "cell").withColumns({"lo": F.col("frame") + lo, "hi": F.col("frame") + hi}).withColumnRenamed("neighbour", "other_cell")
    return joins.range_join(spans, other, ["other_cell", "dataset"], "lo", "hi", "other_frame", hi - lo + 1).drop("lo", "hi")


def _earliest(near, rows: DataFrame, reach: int, key: str, pick) -> DataFrame:
    """``pick`` of the peaks each ``key`` of ``rows`` meets 1 to ``reach`` frames before; all rows of a key have one frame.

    The earliest frame wins, so only keys that find nothing ``reach`` frames before look at the frames behind it, and where peaks are dense
    hardly any does.
    """
    found = graph.cut(pick(near(rows, -reach, -reach)))
    if reach == 1:
        return found
    late = graph.cut(pick(near(rows.join(found.select(key), key, "left_anti"), 1 - reach, -1)))
    return found.unionByName(late)


def communications(peaks: DataFrame, edges: DataFrame | None, reach: int, radius: float | None = None) -> DataFrame:
    """(cause_id, event_id, cause_cell, cell, dataset, cause_frame, frame): every peak's cause, if it has one.

    Cells are next to each other by ``edges(cell, neighbour)``, or if they are at most ``radius`` apart; peaks then have x and y, and meet by
    squares and frames, so that no peak is joined with all neighbours of its cell, active or not.

    A co-peaking group is caused by the earliest peak (ties: cell, id) of a cell next to a member and outside the group, at most ``reach``
    frames before. That peak is linked to the members next to it; without one, the group's first member (by cell, id) is its root. Other
    members are reached breadth-first, from the neighbour of the level before with the least cell and id. Peaks in no group are caused by
    the neighbour's peak farthest back within ``reach``. Tables are cut between the steps and deleted, but for the one returned.

    With ``radius`` and more than ``FEW`` peaks in a frame there is no table of pairs, which grow with the square of the peaks of a frame: frames are taken
    whole by ``_by_frames``.
    """
    place = [] if radius is None else ["x", "y"]
    p = graph.cut(peaks.select("event_id", "cell", "dataset", "frame", *place))
    if radius is not None and (p.groupBy("dataset", "frame").count().agg(F.max("count")).first()[0] or 0) > FEW:
        out = _by_frames(p, reach, radius)
        graph.release(p)
        return out
    other = p.select(F.col("event_id").alias("other_id"), F.col("cell").alias("other_cell"), "dataset", F.col("frame").alias("other_frame"), *[F.col(c).alias(f"{c}2") for c in place])
    if radius is None:
        edges = graph.cut(edges.select("cell", "neighbour"))
        near = lambda rows, lo, hi: _by_edges(rows, other, edges, lo, hi)
    else:
        near = lambda rows, lo, hi: spatial.within(rows, other, radius, keys=["dataset"], times=("frame", "other_frame"), lag=(lo, hi)).filter("cell <> other_cell")
    pairs = graph.cut(near(p, 0, 0).select(F.col("event_id").alias("a"), F.col("other_id").alias("b"), F.col("cell").alias("rank")))
    groups = graph.connected(pairs.filter("a < b").select("a", "b"))
    members = graph.cut(groups.toDF("event_id", "grp").join(p, "event_id"))
    own = members.select("grp", F.col("cell").alias("other_cell")).distinct()

    def outside(met: DataFrame) -> DataFrame:
        seen = met.groupBy("grp", "other_cell").agg(F.min("other_frame").alias("frame")).join(own, ["grp", "other_cell"], "left_anti")
        return seen.groupBy("grp").agg(F.min(F.struct("frame", "other_cell")).alias("o")).select("grp", "o.frame", F.col("o.other_cell").alias("cell"))

    sources = _earliest(near, members, reach, "grp", outside)
    first = sources.join(members.groupBy("grp").agg(F.min("dataset").alias("dataset")), "grp").join(p, ["dataset", "cell", "frame"])
    origins = graph.cut(first.groupBy("grp", F.col("cell").alias("neighbour"), *[F.col(c).alias(f"{c}2") for c in place]).agg(F.min("event_id").alias("cause_id")))
    direct = members.join(origins, "grp")
    if radius is None:
        direct = direct.join(edges, ["cell", "neighbour"], "left_semi")
    else:
        dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
        direct = direct.filter(dx * dx + dy * dy <= float(radius) ** 2)
    direct = graph.cut(direct.select("event_id", "cause_id"))
    lone = members.join(origins, "grp", "left_anti").groupBy("grp").agg(F.min(F.struct("cell", "event_id")).alias("m")).select(F.col("m.event_id").alias("event_id"))
    found = graph.parents(direct.select("event_id").union(lone).withColumnRenamed("event_id", "node"), pairs)
    inner = found.filter("parent IS NOT NULL").select(F.col("node").alias("event_id"), F.col("parent").alias("cause_id"))
    alone = p.join(members.select("event_id"), "event_id", "left_anti")
    farthest = lambda met: met.groupBy("event_id").agg(F.min(F.struct("other_frame", "other_id")).alias("m")).select("event_id", F.col("m.other_id").alias("cause_id"))
    rest = _earliest(near, alone, reach, "event_id", farthest)
    side = p.select(F.col("event_id").alias("cause_id"), F.col("cell").alias("cause_cell"), F.col("frame").alias("cause_frame"))
    links = direct.unionByName(inner).unionByName(rest)
    out = graph.cut(links.join(p, "event_id").join(side, "cause_id").select("cause_id", "event_id", "cause_cell", "cell", "dataset", "cause_frame", "frame"))
    graph.release(p, pairs, groups, members, sources, origins, direct, found, rest, *([] if radius is not None else [edges]))
    return out


def _causes(xy: np.ndarray, cell: np.ndarray, ids: np.ndarray, frame: np.ndarray, start: int, reach: int, radius: float) -> np.ndarray:
    """For each peak the number of its cause, or -1, as far as its frame is ``start`` or a later one; peaks are in order of frame, cell and id."""
    at = np.full(len(ids), -1)
    kinds, code = np.unique(cell, return_inverse=True)
    span = lambda f: slice(*np.searchsorted(frame, [f, f + 1]))
    for f in np.unique(frame[frame >= start]):
        now, n = span(f), int((frame == f).sum())
        place, own = xy[now], cell[now]
        same = planar.Near(place, place, radius, (own, own))
        label, member = planar.components(same), same.degrees() > 0
        held = np.unique((label * len(kinds) + code[now])[member])
        cause, source, left = np.full(n, -1), np.full(n, -1), np.full(n, True)
        for lag in range(reach, 0, -1):
            before, asked = span(f - lag), np.flatnonzero(left)
            m = before.stop - before.start
            if not m or not len(asked):
                continue
            met = planar.Near(place[asked], xy[before], radius, (own[asked], cell[before]))
            # Of a peak in no group, the least id before it.
            order = np.argsort(ids[before])
            rank = np.empty(m, np.int64)
            rank[order] = np.arange(m)
            first = met.least(rank, m)
            found = ~member[asked] & (first < m)
            cause[asked[found]] = before.start + order[first[found]]
            # Of a group, the least cell outside it: peaks are in order of cells, of each the one of least id first.
            best = np.full(n, m)
            for rows, starts, cols in met if member[asked].any() else ():
                row = asked[np.repeat(rows, np.diff(np.append(starts, len(cols))))]
                used = member[row]
                row, col = label[row[used]], cols[used]
                out = ~np.isin(row * len(kinds) + code[before][col], held)
                np.minimum.at(best, row[out], col[out])
            best = best[label]
            some = member & (best < m)
            source[some] = before.start + np.searchsorted(cell[before], cell[before][best[some]], "left")
            left[asked[found]], left[some] = False, False
        dx, dy = (place - xy[source]).T
        direct = (source >= 0) & (dx * dx + dy * dy <= float(radius) ** 2)
        cause[direct] = source[direct]
        parent = planar.parents(same, direct | (member & (source < 0) & (label == np.arange(n))))
        cause[parent >= 0] = now.start + parent[parent >= 0]
        at[now] = cause
    return at


def _by_frames(p: DataFrame, reach: int, radius: float) -> DataFrame:
    """``communications`` of peaks ``p`` with places: a task holds ``reach`` frames of a recording and as many before them, finds groups, causes and parents
    there, and hands on links; no pair is ever a row, and a peak is sent twice."""
    known = p.filter("dataset IS NOT NULL AND frame IS NOT NULL AND cell IS NOT NULL")
    block = F.floor(F.col("frame") / reach)
    dealt = known.withColumn("block", F.explode(F.array(block, block + 1)))

    def causes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame", "cell", "event_id"], ignore_index=True)
        cell, ids, frame = (rows[c].to_numpy() for c in ("cell", "event_id", "frame"))
        at = _causes(rows[["x", "y"]].to_numpy(float), cell, ids, frame, int(key[1]) * reach, reach, radius)
        to, by = np.flatnonzero(at >= 0), at[at >= 0]
        return pd.DataFrame({"cause_id": ids[by], "event_id": ids[to], "cause_cell": cell[by], "cell": cell[to], "dataset": key[0], "cause_frame": frame[by], "frame": frame[to]})

    # As many tasks as shuffles have: the work of a block is not in its bytes.
    tasks = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = "cause_id long, event_id long, cause_cell long, cell long, dataset string, cause_frame long, frame long"
    return graph.cut(dealt.repartition(tasks, "dataset", "block").groupBy("dataset", "block").applyInPandas(causes, kinds))


def events(links: DataFrame, least: int = 2) -> DataFrame:
    """``links`` with ``event``: the least peak of each component over cause and effect that has ``least`` peaks or more."""
    labels = graph.connected(links.select(F.col("cause_id").alias("a"), F.col("event_id").alias("b")))
    large = labels.groupBy("label").count().filter(F.col("count") >= least).select("label")
    kept = labels.join(large, "label", "left_semi").select(F.col("node").alias("event_id"), F.col("label").alias("event"))
    out = graph.cut(links.join(kept, "event_id"))
    graph.release(labels)
    return out


def dag_metrics(edges: DataFrame) -> DataFrame:
    """Metrics of each ``event`` of the directed graph ``edges(event, a, b)``; several causes of a node, cycles and missing roots are allowed.

    (event, n_nodes, n_edges, n_roots, depth, width, mean_out_degree, mean_path): distances are fewest steps from a root (no edge leads to
    it). Depth is the greatest distance of a root and a leaf, the mean path their mean distance; width is the most (root, node) pairs at one
    distance. Without a root, depth and mean path are 0 and width is 1. Repeated edges count once.
    """
    e = graph.cut(edges.select("event", "a", "b").distinct())
    ends = e.select("event", F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("s")).select("event", "s.*")
    nodes = graph.cut(ends.groupBy("event", "node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")))
    far = graph.distances(nodes.filter("into = 0").select("event", F.col("node").alias("root")), e)
    steps = far.groupBy("event", "steps").agg(F.count("*").alias("n")).groupBy("event").agg(F.max("n").alias("width"))
    leaves = nodes.filter("out = 0").select("event", "node")
    paths = far.join(leaves, ["event", "node"]).groupBy("event").agg(F.max("steps").alias("depth"), F.round(F.sum("steps") / F.count("*"), 3).alias("mean_path"))
    basic = nodes.groupBy("event").agg(
        F.count("*").alias("n_nodes"), F.sum("out").alias("n_edges"), F.count_if(F.col("into") == 0).alias("n_roots"), F.round(F.sum("out") / F.count_if(F.col("out") > 0), 3).alias("mean_out_degree")
    )
    whole = basic.join(steps, "event", "left").join(paths, "event", "left")
    out = graph.cut(whole.select("event", "n_nodes", "n_edges", "n_roots", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("width", F.lit(1)).cast("long").alias("width"), "mean_out_degree", F.coalesce("mean_path", F.lit(0.0)).alias("mean_path")))
    graph.release(e, nodes, far)
    return out


def origins(links: DataFrame) -> DataFrame:
    """(event, origin_cell, has_root): the cell no link leads to; of several the one active first, as of all if there is none (ties: cell)."""
    sides = F.array(F.struct(F.col("cause_cell").alias("c"), F.col("cause_frame").alias("t"), F.lit(0).alias("into")), F.struct(F.col("cell").alias("c"), F.col("frame").alias("t"), F.lit(1).alias("into")))
    cells = links.select("event", F.explode(sides).alias("s")).select("event", "s.*").groupBy("event", "c").agg(F.min("t").alias("t"), F.max("into").alias("into"))
    first = cells.groupBy("event").agg(F.min(F.struct("into", "t", "c")).alias("m"))
    return first.select("event", F.col("m.c").alias("origin_cell"), (F.col("m.into") == 0).alias("has_root"))
