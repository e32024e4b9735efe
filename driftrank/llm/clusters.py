"""Exact centroid clustering by filtering balls.

Each block of rows of a partition becomes a metric tree once: rows are halved at the median of their widest component, and
every node stores its rows' integer sum, their count, and the ball around their mean. A round walks the tree level by
level. A node keeps those centroids that can be nearest to a point of its ball by the triangle inequality; where one is
left, the whole ball goes to it by its stored sum and count; leaves that stay undecided are settled by exact integer
distances. The tests on balls are made in floating point with a margin above their rounding error, and a ball goes whole
only where its centroid is strictly nearest, so ties are always settled exactly, to the smaller number.

Trees are written to the shared folder and read again each round; what reaches the driver in a round is one sum and count
for each centroid and component. Nothing is dealt out by a key, so equal vectors, however many, are no hot group.

Defined results: rows whose vector is null, has another number of components, or a component that is null, not finite or
beyond 2^27 as a whole number take no part; rows equal in id are separate rows; a null id comes last among the starting
centroids, equal hashes in the order of their vectors; with fewer rows than centroids there are that many centroids; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftrank.llm import vectors
from driftrank.tables import park, release

BLOCK, LEAF = 4096, 32
_TREE = "n int, ids binary, rows binary, sums binary, means binary, radii binary"
_SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def levels_of(n: int) -> int:
    """Levels of halving until no leaf holds more than LEAF rows."""
    out = 0
    while -(-n >> out) > LEAF and n >> out > 1:
        out += 1
    return out


def edges(n: int, level: int) -> np.ndarray:
    """Bounds of the nodes of a level over n rows: node i holds rows edges[i] to edges[i + 1]."""
    return np.arange((1 << level) + 1, dtype=np.int64) * n >> level


def grow(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows, integer sums, means, radii) of a block's tree, nodes level by level."""
    n = len(rows)
    order = np.arange(n)
    depth = levels_of(n)
    for level in range(depth):
        at, below = edges(n, level), edges(n, level + 1)
        for i in range(1 << level):
            part = order[at[i] : at[i + 1]]
            own = rows[part]
            wide = int((own.max(0) - own.min(0)).argmax())
            half = int(below[2 * i + 1] - at[i])
            order[at[i] : at[i + 1]] = part[np.argpartition(own[:, wide], half)] if 0 < half < len(part) else part
    rows = rows[order]
    sums, means, radii = [], [], []
    for level in range(depth + 1):
        at = edges(n, level)
        size = np.diff(at)
        s = np.add.reduceat(rows, at[:-1], axis=0)
        m = s / size[:, None]
        far = np.sqrt(((rows - np.repeat(m, size, axis=0)) ** 2).sum(1))
        sums.append(s), means.append(m), radii.append(np.maximum.reduceat(far, at[:-1]))
    return order, np.concatenate(sums), np.concatenate(means), np.concatenate(radii)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row, exact."""
    d = (rows**2).sum(1)[:, None] - 2 * vectors.inner(rows, centroids) + (centroids**2).sum(1)[None, :]
    at = d.argmin(1)
    return at, d[np.arange(len(rows)), at]


class Tree:
    """One block, as stored."""

    def __init__(self, n: int, rows: bytes, sums: bytes, means: bytes, radii: bytes, width: int) -> None:
        self.n, self.width = n, width
        self.packed_rows = rows
        self.sums = vectors.unpack(sums).reshape(-1, width)
        self.means = np.frombuffer(means, "<f8").reshape(-1, width)
        self.radii = np.frombuffer(radii, "<f8")

    @property
    def rows(self) -> np.ndarray:
        return vectors.unpack(self.packed_rows).reshape(self.n, self.width)

    def filter(self, centroids: np.ndarray) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
        """([(node, first row, end row, centroid) of balls that go whole], [(first row, end row) of leaves left])."""
        whole, leaves = [], []
        depth = levels_of(self.n)
        c = centroids.astype(np.float64)
        c2 = (c**2).sum(1)
        alive = np.zeros(1, np.int64)
        can = np.ones((1, len(c)), bool)
        for level in range(depth + 1):
            at, node = edges(self.n, level), alive + (1 << level) - 1
            m, r = self.means[node], self.radii[node]
            m2 = (m**2).sum(1)
            d = np.sqrt(np.maximum(m2[:, None] - 2 * (m @ c.T) + c2, 0))
            # Rounding: the squares cancel, so the error of a root is bounded by that of the squares' root.
            slack = np.sqrt((m2[:, None] + c2 + 1) * 1e-11) + r[:, None] * 1e-9
            d_high, d_low = d + slack, np.maximum(d - slack, 0)
            d_high[~can] = np.inf
            best = d_high.argmin(1)
            reach = d_high[np.arange(len(best)), best]
            can &= d_low - r[:, None] <= (reach + r)[:, None]
            sure = can.sum(1) == 1
            for i in np.flatnonzero(sure):
                whole.append((int(node[i]), int(at[alive[i]]), int(at[alive[i] + 1]), int(can[i].argmax())))
            alive, can = alive[~sure], can[~sure]
            if level == depth:
                leaves += [(int(at[i]), int(at[i + 1])) for i in alive]
            else:
                alive, can = np.repeat(alive * 2, 2), np.repeat(can, 2, axis=0)
                alive[1::2] += 1
        return whole, leaves

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(integer sum, count) of the rows nearest to each centroid."""
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        whole, leaves = self.filter(centroids)
        for node, a, b, k in whole:
            total[k] += self.sums[node]
            count[k] += b - a
        if leaves:
            rows = self.rows
            rows = np.concatenate([rows[a:b] for a, b in leaves])
            k, _ = nearest(rows, centroids)
            np.add.at(total, k, rows)
            count += np.bincount(k, minlength=len(centroids))
        return total, count

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each row in stored order."""
        rows, out, far = self.rows, np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        whole, leaves = self.filter(centroids)
        for _, a, b, k in whole:
            out[a:b] = k
            far[a:b] = ((rows[a:b] - centroids[k]) ** 2).sum(1)
        if leaves:
            at = np.concatenate([np.arange(a, b) for a, b in leaves])
            out[at], far[at] = nearest(rows[at], centroids)
        return out, far


def _trees(kept: DataFrame, width: int) -> DataFrame:
    def make(t: pa.Table) -> dict[str, list]:
        t = t.combine_chunks()
        rows = vectors.matrix(t.column("v").chunk(0), width)
        order, sums, means, radii = grow(rows)
        key = vectors.ids(t.column("vec_id").chunk(0))[order]
        return {"n": pa.array([len(rows)], pa.int32()), "ids": [key.tobytes()], "rows": [vectors.pack(rows[order])], "sums": [vectors.pack(sums)], "means": [means.tobytes()], "radii": [radii.tobytes()]}

    return vectors.in_blocks(kept.select("vec_id", "v"), BLOCK, make, _TREE)


def _read(batch: pa.RecordBatch, width: int) -> Iterator[tuple[Tree, np.ndarray]]:
    for r in batch.to_pylist():
        yield Tree(r["n"], r["rows"], r["sums"], r["means"], r["radii"], width), np.frombuffer(r["ids"], np.int64)


def _round(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floor of the mean; those without rows stay."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centroids), np.zeros(k, np.int64)
        for batch in batches:
            for tree, _ in _read(batch, width):
                t, n = tree.totals(centroids)
                total, count = total + t, count + n
        has = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.repeat(has, width), pa.int32()), "dim": pa.array(np.tile(np.arange(width), len(has)), pa.int32()), "total": total[has].ravel(), "n": np.repeat(count[has], width)})

    summed = trees.select("n", "ids", "rows", "sums", "means", "radii").mapInArrow(run, "k int, dim int, total long, n long").groupBy("k", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in summed.collect():  # k * width rows
        out[r.k, r.dim] = r.total // r.n
    return out


def cluster(embeddings: DataFrame, k: int = 16, rounds: int = 3, factor: int = 64, width: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept row."""
    spark = embeddings.sparkSession
    vector = F.col("embedding")
    fits = F.coalesce(F.size(vector) == width, F.lit(False)) & vectors.usable(vector, factor)
    kept = embeddings.where(fits).select(F.col("vec_id").cast("long").alias("vec_id"), vectors.whole(vector, factor).alias("v"))
    trees = park(_trees(kept, width), "trees")
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last(), "v").limit(k).collect()  # k rows
    if not first:
        return spark.createDataFrame([], _SCHEMA)
    centroids = np.array([r.v for r in first], np.int64)
    for _ in range(rounds):
        centroids = _round(trees, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, key in _read(batch, width):
                at, far = tree.assign(centroids)
                yield pa.RecordBatch.from_pydict({"vec_id": pa.array(key, pa.int64(), mask=key == vectors.NO_ID), "cluster": pa.array(at, pa.int32()), "distance": far})

    placed = park(trees.mapInArrow(run, "vec_id long, cluster int, distance long"), "placed")
    release(trees)
    inertia = {r.cluster: r.total for r in placed.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # k rows
    told = [(c, t, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, t in inertia.items()]
    return placed.join(F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
