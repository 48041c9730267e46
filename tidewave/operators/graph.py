"""Forests of causes: every peak has at most one cause, which lies earlier, so roots and depths follow by pointer doubling."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges times roots of an event that one task walks.
LOCAL = 1 << 22


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the folder the session names in spark.checkpoint.dir: lost executors then cost a read, not a recomputation.

    Only a local session, which has one machine, may do without such a folder.
    """
    spark = df.sparkSession
    named = spark.sparkContext._jsc.sc().getCheckpointDir()
    path = named.get() if named.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewave-"))
        path = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{path}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing will read again, or frames over nothing but such tables."""
    for df in tables:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ancestry(links: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, depth) of every node in ``links`` that is a child; each round doubles the reach, so rounds grow with log depth."""
    jumps = cut(links.select(F.col(node).alias("node"), F.col(parent).alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = jumps.select(F.col("node").alias("root"), F.col("root").alias("_far"), F.col("depth").alias("_more"))
        new = jumps.join(up, "root", "left").select("node", F.coalesce("_far", "root").alias("root"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_far").isNotNull().alias("moved"))
        new = cut(new)
        release(jumps)
        jumps = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            return jumps


def trees(links: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, depth) of all nodes in ``links``, roots with depth 0 included."""
    below = ancestry(links, node, parent)
    roots = below.select(F.col("root").alias("node")).distinct()
    return below.union(roots.select("node", F.col("node").alias("root"), F.lit(0).cast("long")))


def connected(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links(a, b)``: the least node reachable.

    In a round every node moves to the node of least hash at most two links away, then to where that one moves; links between nodes moved
    together go, the others are links of the nodes moved to. The hash is another one each round, so no order of the nodes, as of chains in
    time, keeps the rest from shrinking by a share a round: all rounds together cost about as much as the first two.
    """
    rest = cut(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    moves = []
    while True:
        turn = lambda c: F.xxhash64(c, F.lit(len(moves)))
        to = lambda near: near.select("a", F.when(F.col("h") < turn("a"), F.col("via")).otherwise(F.col("a")).alias("via"))
        one = to(rest.groupBy("a").agg(F.min(turn("b")).alias("h"), F.min_by("b", turn("b")).alias("via")))
        two = to(rest.join(one.toDF("b", "via"), "b").groupBy("a").agg(F.min(turn("via")).alias("h"), F.min_by("via", turn("via")).alias("via")))
        moves.append(cut(two.join(two.toDF("via", "label"), "via").select(F.col("a").alias("node"), "label")))
        ends = rest.join(moves[-1].toDF("a", "x"), "a").join(moves[-1].toDF("b", "y"), "b").filter("x <> y")
        fewer = cut(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        release(rest)
        rest = fewer
        if not rest.limit(1).count():
            break
    least = moves[0].groupBy("label").agg(F.min("node").alias("least"))
    for move in moves[1:]:
        # Nodes without links left are where they stay.
        least = least.withColumnRenamed("label", "node").join(move, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("least").alias("least"))
    found = moves[-1]
    for move in reversed(moves[:-1]):
        found = move.withColumnRenamed("label", "via").join(found.toDF("via", "far"), "via", "left").select("node", F.coalesce("far", "via").alias("label"))
    out = cut(found.join(least, "label").select("node", F.col("least").alias("label")))
    release(rest, *moves)
    return out


def levels(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, parent): breadth-first levels from ``roots(node)`` over ``edges(a, b)``; a parent is the least node of the level before.

    Each round reads the edges of the frontier only; rounds end with the deepest level.
    """
    found = cut(roots.select("node", F.lit(0).cast("long").alias("level"), F.lit(None).cast("long").alias("parent")))
    front, level = found, 0
    while True:
        level += 1
        next_ones = edges.join(front.select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        front = cut(next_ones.join(found.select("node"), "node", "left_anti").select("node", F.lit(level).cast("long").alias("level"), "parent"))
        if not front.limit(1).count():
            return found
        found = found.union(front)


def parents(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, parent): breadth-first levels from ``roots(node)`` over ``edges(a, b, rank)``; a parent has the least (rank, a) of its level."""
    found = cut(roots.distinct().select("node", F.lit(0).cast("long").alias("level"), F.lit(None).cast("long").alias("parent")))
    front, level = found, 0
    while True:
        level += 1
        reached = edges.join(front.select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.min(F.struct("rank", "a")).alias("m"))
        front = cut(reached.join(found.select("node"), "node", "left_anti").select("node", F.lit(level).cast("long").alias("level"), F.col("m.a").alias("parent")))
        if not front.limit(1).count():
            release(front)
            return found
        found = found.union(front)


def _walk(arcs: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    """``distances`` of whole events in one task, all their roots side by side, a step at a time."""
    ends = [arcs[["event", "a"]].to_numpy(np.int64), arcs[["event", "b"]].to_numpy(np.int64), starts[["event", "root"]].to_numpy(np.int64)]
    nodes, code = np.unique(np.concatenate(ends), axis=0, return_inverse=True)
    a, b, front = np.split(code.ravel(), np.cumsum([len(ends[0]), len(ends[1])]))
    order = np.argsort(a, kind="stable")
    first, b = np.searchsorted(a[order], np.arange(len(nodes) + 1)), b[order]
    lo, hi = (np.searchsorted(nodes[:, 0], ends[2][:, 0], side) for side in ("left", "right"))
    # Root i has met node j if seen[at[i] + j].
    at = np.cumsum(hi - lo) - hi
    seen = np.zeros(int((hi - lo).sum()), bool)
    root, steps, parts = np.arange(len(front)), 0, []
    seen[at + front] = True
    while len(front):
        parts.append((root, front, np.full(len(front), steps)))
        steps += 1
        n = first[front + 1] - first[front]
        root, met = np.repeat(root, n), b[np.repeat(first[front] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        new = np.flatnonzero(~seen[at[root] + met])
        new = new[np.unique(at[root[new]] + met[new], return_index=True)[1]]
        root, front = root[new], met[new]
        seen[at[root] + front] = True
    root, node, steps = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
    return pd.DataFrame({"event": ends[2][root, 0], "root": ends[2][root, 1], "node": nodes[node, 1], "steps": steps})


def distances(roots: DataFrame, edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(event, root, node, steps): fewest steps over ``edges(event, a, b)`` from every root of ``roots(event, root)`` to each node it reaches.

    Events of at most ``local`` edges times roots are dealt to tasks that take about as many, and walked there. The others take a job a
    step, which extends the frontier of all roots of all events at once; nodes seen before are not extended again, so cycles end.
    """
    roots = roots.distinct()
    sizes = cut(roots.groupBy("event").count().join(edges.groupBy("event").agg(F.count("*").alias("n")), "event", "left").select("event", (F.col("count") * F.coalesce("n", F.lit(1))).alias("weight")))
    total = sizes.filter(F.col("weight") <= local).agg(F.sum("weight")).first()[0] or 0
    parts = max(1, -(-total // local))
    few = sizes.filter(F.col("weight") <= local).select("event", F.pmod(F.xxhash64("event"), F.lit(parts)).alias("part"))
    arcs = edges.join(few, "event").select("part", "event", "a", "b").groupBy("part")
    starts = roots.join(few.toDF("event", "portion"), "event").select("portion", "event", "root").groupBy("portion")
    found = cut(arcs.cogroup(starts).applyInPandas(_walk, "event long, root long, node long, steps long"))
    many = sizes.filter(F.col("weight") > local).select("event")
    front = cut(roots.join(many, "event", "left_semi").select("event", "root", F.col("root").alias("node"), F.lit(0).cast("long").alias("steps")))
    edges = edges.join(many, "event", "left_semi")
    met, steps = front, 0
    while front.limit(1).count():
        steps += 1
        reached = front.select("event", "root", F.col("node").alias("a")).join(edges, ["event", "a"]).select("event", "root", F.col("b").alias("node")).distinct()
        front = cut(reached.join(met.select("event", "root", "node"), ["event", "root", "node"], "left_anti").withColumn("steps", F.lit(steps).cast("long")))
        met = met.union(front)
        if steps % 8 == 0:
            # One table again, so that no round reads more of them than a few.
            whole = cut(met)
            release(met)
            met, front = whole, whole.filter(F.col("steps") == steps)
    release(sizes)
    return found.union(met)
