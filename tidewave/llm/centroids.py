"""Centroid clustering by ball-tree filtering: whole balls of vectors go to a centroid at once, in exact integers.

Every partition packs its vectors into blocks and builds a metric tree over each; a node of the tree holds the radius, the count and the
integer sum of its vectors. In a round a centroid is refused for a ball if the triangle inequality leaves it no vector; a ball with one
centroid left gives it count and sum as a whole, others go on to their halves, and vectors of leaves still open are compared one by one
in integers. The blocks are written once and read by each round; a round sends k x 64 sums a task, never a vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, release, tidy

#: Vectors of a block, and of a leaf at most. Both bound memory only; results do not depend on them.
BLOCK, LEAF = 2048, 16
#: Components beyond this have squared distances that a long cannot hold.
REACH = 1 << 27
#: Slack of bounds taken in floating point; it only keeps centroids that exact integers then decide on.
SLACK = 1e-9

BLOCKS = "ids array<long>, vectors binary, radii binary, counts binary, sums binary"


def spans(n: int) -> list[np.ndarray]:
    """Levels of the tree over ``n`` vectors: edges of the nodes in the order of the vectors; each node is halved until it fits a leaf."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > LEAF:
        edges = levels[-1]
        middle = (edges[:-1] + edges[1:]) // 2
        levels.append(np.sort(np.concatenate([edges, middle])))
    return levels


def build(ids: list, vectors: np.ndarray) -> tuple:
    """A block: vectors in the order of the leaves, and radius, count and sum of every node, level by level from the root."""
    order, levels = np.arange(len(ids)), spans(len(ids))
    for edges, finer in zip(levels, levels[1:]):
        for lo, hi in zip(edges[:-1], edges[1:]):
            held = vectors[order[lo:hi]]
            axis = held[:, (held.max(axis=0) - held.min(axis=0)).argmax()]
            order[lo:hi] = order[lo:hi][np.argpartition(axis, (hi - lo) // 2)]
    vectors = vectors[order]
    radii, counts, sums = [], [], []
    for edges in levels:
        n = np.diff(edges)
        total = np.add.reduceat(vectors, edges[:-1], axis=0)
        centre = np.repeat(total / n[:, None], n, axis=0)
        far = np.sqrt(((vectors - centre) ** 2).sum(axis=1))
        radii.append(np.maximum.reduceat(far, edges[:-1]))
        counts.append(n)
        sums.append(total)
    return [ids[i] for i in order], vectors, np.concatenate(radii), np.concatenate(counts), np.concatenate(sums)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each vector, in integers; ties go to the smaller number."""
    best, least = np.zeros(len(vectors), np.int64), np.full(len(vectors), np.iinfo(np.int64).max)
    for c, centroid in enumerate(centroids):
        d = ((vectors - centroid) ** 2).sum(axis=1)
        best, least = np.where(d < least, c, best), np.minimum(d, least)
    return best, least


def filtered(row: dict, centroids: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(lo, hi, node, centroid): balls decided as a whole; (lo, hi, -1, -1): vectors of open leaves. Together they are the whole block."""
    levels, at = spans(len(row["ids"])), 0
    open_nodes = np.ones(1, bool)
    allowed = np.ones((1, len(centroids)), bool)
    for depth, edges in enumerate(levels):
        n = len(edges) - 1
        centre = row["sums"][at : at + n] / row["counts"][at : at + n, None]
        radius = row["radii"][at : at + n]
        todo = np.flatnonzero(open_nodes)
        gap = np.full((n, len(centroids)), np.inf)
        gap[todo] = np.sqrt(((centre[todo, None, :] - centroids[None]) ** 2).sum(axis=2))
        gap[~allowed] = np.inf
        # A centroid is out if even the ball's nearest point is farther from it than the ball's farthest point is from the best one.
        reach = (gap.min(axis=1) + 2 * radius) * (1 + SLACK) + SLACK
        allowed &= gap <= reach[:, None]
        whole = open_nodes & (allowed.sum(axis=1) == 1)
        for i in np.flatnonzero(whole):
            yield edges[i], edges[i + 1], at + i, int(allowed[i].argmax())
        open_nodes &= ~whole
        if depth + 1 == len(levels):
            for i in np.flatnonzero(open_nodes):
                yield edges[i], edges[i + 1], -1, -1
            return
        # Halves keep the order of their node; a node of one vector has one half only.
        parent = np.searchsorted(edges, levels[depth + 1][:-1], side="right") - 1
        open_nodes, allowed, at = open_nodes[parent], allowed[parent], at + n


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column("ids")[i].as_py()
            raw = {k: np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in (("vectors", np.int32), ("radii", np.float64), ("counts", np.int64), ("sums", np.int64))}
            dims = len(raw["vectors"]) // len(ids)
            yield {"ids": ids, "vectors": raw["vectors"].reshape(-1, dims).astype(np.int64), "radii": raw["radii"], "counts": raw["counts"], "sums": raw["sums"].reshape(-1, dims)}


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("radii", pa.binary()), ("counts", pa.binary()), ("sums", pa.binary())])

    def sent(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        ids, vectors, radii, counts, sums = build(ids, np.concatenate(parts))
        held = [ids, vectors.astype(np.int32).tobytes(), radii.tobytes(), counts.astype(np.int64).tobytes(), sums.astype(np.int64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(held, schema)], schema=schema)

    ids, parts = [], []
    for batch in batches:
        got = batch.column(0).to_pylist()
        column = batch.column(1)
        matrix = column.flatten().to_numpy(zero_copy_only=False).reshape(len(got), -1) if got else np.zeros((0, 1), np.int64)
        for lo in range(0, len(got), BLOCK):
            ids += got[lo : lo + BLOCK]
            parts.append(matrix[lo : lo + BLOCK])
            if len(ids) >= BLOCK:
                yield sent(ids, parts)
                ids, parts = [], []
    if ids:
        yield sent(ids, parts)
    tidy()


def _partial(centroids: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        counts, sums = [0] * k, [[0] * dims for _ in range(k)]
        for row in _blocks(batches):
            part, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
            loose = []
            for lo, hi, node, c in filtered(row, centroids):
                if node >= 0:
                    part[c] += row["sums"][node]
                    n[c] += row["counts"][node]
                else:
                    loose.append(np.arange(lo, hi))
            if loose:
                vectors = row["vectors"][np.concatenate(loose)]
                best = nearest(vectors, centroids)[0]
                n += np.bincount(best, minlength=k)
                for c in np.unique(best):
                    part[c] += vectors[best == c].sum(axis=0)
            for c in range(k):
                counts[c] += int(n[c])
                sums[c] = [a + int(b) for a, b in zip(sums[c], part[c])]
        held = [(c, i, counts[c], str(sums[c][i])) for c in range(k) if counts[c] for i in range(dims)]
        yield pa.RecordBatch.from_pydict({"cluster": pa.array([x[0] for x in held], pa.int32()), "axis": pa.array([x[1] for x in held], pa.int32()), "n": pa.array([x[2] for x in held], pa.int64()), "total": pa.array([x[3] for x in held], pa.string())})

    return work


def _assigned(centroids: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _blocks(batches):
            best = np.full(len(row["ids"]), -1, np.int64)
            far = np.zeros(len(row["ids"]), np.int64)
            for lo, hi, node, c in filtered(row, centroids):
                if node >= 0:
                    best[lo:hi], far[lo:hi] = c, ((row["vectors"][lo:hi] - centroids[c]) ** 2).sum(axis=1)
                else:
                    best[lo:hi], far[lo:hi] = nearest(row["vectors"][lo:hi], centroids)
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(row["ids"], pa.int64()), "cluster": pa.array(best.astype(np.int32)), "distance": pa.array(far)})
        tidy()

    return work


OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, *, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of ``dims`` finite components.

    Components become ``floor(scale * x)``. The ``k`` vectors with the least sha256 of ``seed:id`` start as centroids (ties: by components;
    a null id is hashed as no digits); a centroid no vector is nearest to stays. Repeated rows and ids are vectors like any other; fewer
    than ``k`` vectors give as many centroids; none give an empty result. Null vectors, vectors of another length or with a component that
    is null, not finite or beyond 2**27 once scaled (its squared distance is no long) take no part. A sum of distances that is no long is null.
    Other columns are not read.
    """
    spark = embeddings.sparkSession
    x = F.col("_x")
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    fit = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) <= F.lit((REACH - 1) / scale)), F.lit(False)))
    kept = embeddings.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_x")).filter(F.size("_x") == dims).filter(fit).select("_id", whole.alias("_x"))
    # Plain bytes: a file split of a given size then holds that many bytes of blocks, even if all vectors are equal.
    blocks = cut(kept.mapInArrow(_trees, BLOCKS), compression="none", **{"parquet.enable.dictionary": "false"})
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    first = kept.select(hashed.alias("h"), "_x").orderBy("h", "_x").limit(k).collect()
    if not first:
        release(blocks)
        return spark.createDataFrame([], OUT)
    centroids = np.array([r["_x"] for r in first], np.int64)
    for _ in range(rounds):
        got = blocks.mapInArrow(_partial(centroids), "cluster int, axis int, n long, total string").groupBy("cluster", "axis").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(28,0)")).alias("total")).collect()
        moved = centroids.copy()
        for r in got:
            moved[r["cluster"], r["axis"]] = int(r["total"]) // r["n"]
        if (moved == centroids).all():
            break
        centroids = moved
    out = cut(blocks.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"))
    release(blocks)
    exact = F.sum(F.col("distance").cast("decimal(20,0)"))
    inertia = {r["cluster"]: int(r["n"]) for r in out.groupBy("cluster").agg(exact.alias("n")).collect()}
    total = sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of(values: dict, kind: str):
        return F.element_at(F.create_map(*[F.lit(v) for c, x in values.items() for v in (c, x)]).cast(T.MapType(T.IntegerType(), T.StringType())), F.col("cluster")).try_cast(kind)

    return out.select(
        "vec_id", "cluster", "distance", of({c: str(v) for c, v in inertia.items()}, "long").alias("cluster_inertia"), F.lit(str(total)).try_cast("long").alias("inertia"), of(dict(enumerate(digest)), "string").alias("centroid_sha256")
    )
