"""Centroid clustering by ball-tree filtering, exact in integers.

Vectors with ``dims`` components, none null or non-finite, are kept and each component x becomes floor(scale * x). Every task
builds metric trees over its own vectors, at most ``TREE`` in each: a ball holds its radius, count and integer sum, a leaf
its vectors. The trees are a table in the shared folder, written once. A round is one pass over them: a ball for which the
triangle inequality leaves one centroid goes to it whole, with its count and sum; otherwise the pass descends, with the
centroids that are still possible, and leaves compare exact squared distances.

Scale and skew. The vectors are read and dealt once and never shuffled; a round sends one row for each task and centroid, which
are summed by (centroid, component) and come to the driver as at most ``k * dims`` numbers. Copies of one vector are balls of
radius 0 and move whole, wherever they lie. What is broadcast are the ``k`` centroids. Vectors of no neighbourhood (random
directions in many dimensions) leave balls open, and the pass costs what plain rounds cost.

Defined cases: null vectors and those of another length, or with null or non-finite components, take no part; rows that repeat a
vec_id are vectors of their own, drawn as start centroids in the order of their components; a null vec_id is clustered and comes last
among start centroids; fewer vectors than ``k`` give as many centroids; an empty table gives no rows; other columns are ignored. A
component above 2**27 after scaling is refused, since its squared distance would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

TREE, LEAF = 2048, 32
LARGEST = 1 << 27
TREES = "depth int, ids array<long>, points binary, radii array<double>, sums array<long>"
#: The triangle inequality is used with this relative slack for rounding: a ball goes whole only if it is clear beyond it.
SLACK = 1e-9


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for each kept vector."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "balls")
    cast = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    kept = cast.where((F.size("e") == dims) & finite)

    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(draw.asc_nulls_last(), "e").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = scaled(np.array([r["e"] for r in first], np.float64), scale)

    trees = scratch.keep(kept.mapInArrow(_forest(dims, scale), TREES), "trees")
    for _ in range(rounds):
        parts = trees.mapInArrow(_round(centroids), "cluster int, n long, sums array<long>")
        sums = parts.select("cluster", "n", F.posexplode("sums").alias("place", "x")).groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        centroids = centroids.copy()
        for r in sums.collect():  # at most k * dims numbers
            centroids[r["cluster"], r["place"]] = r["x"] // r["n"]

    placed = scratch.keep(trees.mapInArrow(_last(centroids), "vec_id long, cluster int, distance long"), "placed")
    scratch.drop(trees)
    by = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # at most k rows
    total = sum(r["cluster_inertia"] for r in by)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], total, digest[r["cluster"]]) for r in by], "t_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(told), F.col("cluster") == F.col("t_cluster")).drop("t_cluster")


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    y = np.floor(x * scale)
    if y.size and np.abs(y).max() > LARGEST:
        raise ValueError("a component is too large for squared distances in a long")
    return y.astype(np.int64)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact: in doubles where all terms are whole numbers below 2**53, else in integers."""
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * points.shape[1] * largest**2 < 2**53 else np.int64
    p, c = points.astype(kind), centroids.astype(kind)
    return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)


def bounds(n: int, depth: int) -> list[np.ndarray]:
    """Where the balls of each level begin and end in the order of the leaves: every ball is halved, so counts follow from n."""
    levels = [np.array([0, n])]
    for _ in range(depth):
        last = levels[-1]
        out = np.empty(2 * len(last) - 1, np.int64)
        out[::2] = last
        out[1::2] = (last[:-1] + last[1:]) // 2
        levels.append(out)
    return levels


class Tree:
    """A balanced metric tree; ``levels[i]`` are the bounds of level i, and radius, count and sum of its balls lie at ``at[i]``."""

    def __init__(self, points: np.ndarray, depth: int, radii: np.ndarray, sums: np.ndarray):
        self.points, self.levels, self.radii, self.sums = points, bounds(len(points), depth), radii, sums
        self.at = [slice(2**i - 1, 2 ** (i + 1) - 1) for i in range(depth + 1)]

    @staticmethod
    def grow(points: np.ndarray) -> tuple[np.ndarray, Tree]:
        """Halves each ball along the line between a vector far from its centre and the one farthest from that."""
        depth = max(0, int(np.ceil(np.log2(len(points) / LEAF))))
        order, x = np.arange(len(points)), points.astype(np.float64)
        levels = bounds(len(points), depth)
        for level in levels[:-1]:
            for a, b in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
                p = x[order[a:b]]
                far = p[((p - p.mean(0)) ** 2).sum(1).argmax()]
                other = p[((p - far) ** 2).sum(1).argmax()]
                order[a:b] = order[a:b][np.argpartition(p @ (other - far), (b - a) // 2)]
        points, radii, sums = points[order], [], []
        for level in levels:
            sums.append(np.add.reduceat(points, level[:-1], axis=0))
            counts = np.diff(level)
            centre = np.repeat(sums[-1] / counts[:, None], counts, axis=0)
            radii.append(np.sqrt(np.maximum.reduceat(((points - centre) ** 2).sum(1), level[:-1])) * (1 + SLACK))
        return order, Tree(points, depth, np.concatenate(radii), np.concatenate(sums))

    def filter(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The centroid of each vector, and count and sum of each centroid's vectors."""
        k = len(centroids)
        label, n, total = np.zeros(len(self.points), np.int32), np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64)
        open_, possible = np.array([0]), np.ones((1, k), bool)
        for level, at in zip(self.levels, self.at, strict=True):
            counts, sums = np.diff(level)[open_], self.sums[at][open_]
            away = np.sqrt((((sums / counts[:, None])[:, None, :] - centroids) ** 2).sum(2))
            nearest = np.where(possible, away, np.inf).min(1)
            possible &= away <= ((nearest + 2 * self.radii[at][open_]) * (1 + SLACK))[:, None]
            whole = possible.sum(1) == 1
            for ball, c, count, s in zip(open_[whole].tolist(), possible[whole].argmax(1).tolist(), counts[whole], sums[whole], strict=True):
                label[level[ball] : level[ball + 1]] = c
                n[c] += count
                total[c] += s
            if level is not self.levels[-1]:
                open_ = (2 * open_[~whole][:, None] + [0, 1]).ravel()
                possible = np.repeat(possible[~whole], 2, axis=0)
            else:
                open_, possible = open_[~whole], possible[~whole]
            if not len(open_):
                return label, n, total
        level = self.levels[-1]
        counts = np.diff(level)[open_]
        rows = np.repeat(level[open_] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        found = np.where(np.repeat(possible, counts, axis=0), squared(self.points[rows], centroids), np.iinfo(np.int64).max).argmin(1)
        label[rows] = found
        n += np.bincount(found, minlength=k)
        for c in np.unique(found):
            total[c] += self.points[rows[found == c]].sum(0)
        return label, n, total


def _forest(dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                piece = batch.slice(at, TREE)
                points = scaled(piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)
                order, tree = Tree.grow(points)
                cells = [len(tree.levels) - 1], [piece.column(0).take(pa.array(order)).to_pylist()], [tree.points.astype("<i4").tobytes()], [tree.radii], [tree.sums.ravel()]
                kinds = pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=["depth", "ids", "points", "radii", "sums"])

    return run


def _trees(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, Tree]]:
    for i in range(batch.num_rows):
        points = np.frombuffer(batch.column(2)[i].as_buffer(), "<i4").reshape(-1, dims).astype(np.int64)
        radii, sums = (batch.column(c)[i].values.to_numpy() for c in (3, 4))
        yield batch.column(1)[i].values, Tree(points, batch.column(0)[i].as_py(), radii, sums.reshape(-1, dims))


def _round(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, tree in _trees(batch, centroids.shape[1]):
                _, count, s = tree.filter(centroids)
                n += count
                total += s
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(n[full]), pa.array(list(total[full]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _last(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _trees(batch, centroids.shape[1]):
                label = tree.filter(centroids)[0]
                away = ((tree.points - centroids[label]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(label), pa.array(away)], names=["vec_id", "cluster", "distance"])

    return run
