"""K-means on integer vectors, exact, by filtering ball trees.

Each task builds trees of the vectors it holds, BLOCK at a time, once; the trees are a table that every round reads.
A ball stores its pivot, radius, count and integer sum.  A round sends the centroids to the tasks: by the triangle
inequality a ball with only one centroid possible is assigned as a whole, others pass the possible ones down to their
halves, and what is left in the leaves is compared exactly.  Sums are integers, so centroids do not depend on how the
vectors are dealt.  Of a round, (centroids x dimensions) sums reach the driver.

Vectors of another length, with null or non-finite components, or with components of more than LARGEST (their
distances would not fit a long) are left out, as are null ones.  Repeated rows and ids count each.  A null id hashes as
an empty text; equal hashes are ordered by the vector.  With fewer vectors than centroids there are fewer centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, stored

SCALE = 1024
#: Largest size of a component: 64 squares of 2 * SCALE * LARGEST fit a long.
LARGEST = float(1 << 17)
#: Vectors of a tree at most, and of a leaf.
BLOCK = 8192
LEAF = 16
#: Room for the rounding of radii and distances, which are square roots of exact integers.
ROOM = 1e-9

TREE = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), ("pivots", pa.binary()), ("sums", pa.binary()), ("radii", pa.list_(pa.float64()))])
TREE_SQL = "ids array<long>, points binary, pivots binary, sums binary, radii array<double>"


def integers(vector: Column, dims: int) -> Column:
    """The vector as floor(SCALE * component), or null if it is left out."""
    fit = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) <= F.lit(LARGEST), F.lit(False)))
    return F.when((F.size(vector) == dims) & fit, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long")))


def cuts(n: int) -> list[np.ndarray]:
    """Bounds of the balls of a tree of n points by depth: each ball is halved while its half would hold LEAF."""
    out = [np.array([0, n])]
    while n >> len(out) >= LEAF:
        a = out[-1]
        out.append(np.sort(np.concatenate([a, (a[:-1] + a[1:]) // 2])))
    return out


def tree(ids: np.ndarray, points: np.ndarray) -> tuple:
    """Order the points so that each ball is a slice, by halving at the median of the widest dimension."""
    order, depths = np.arange(len(points)), cuts(len(points))
    for bounds, finer in zip(depths, depths[1:], strict=False):
        for k in range(len(bounds) - 1):
            a, mid, b = finer[2 * k], finer[2 * k + 1], finer[2 * k + 2]
            held = points[order[a:b]]
            axis = int(np.argmax(held.max(axis=0) - held.min(axis=0)))
            order[a:b] = order[a:b][np.argpartition(held[:, axis], mid - a)]
    points = points[order]
    pivots, sums, radii = [], [], []
    for bounds in depths:
        total, size = np.add.reduceat(points, bounds[:-1], axis=0), np.diff(bounds)
        pivot = total // size[:, None]
        away = ((points - np.repeat(pivot, size, axis=0)) ** 2).sum(axis=1)
        pivots.append(pivot), sums.append(total), radii.append(np.sqrt(np.maximum.reduceat(away, bounds[:-1])))
    return ids[order], points, np.concatenate(pivots), np.concatenate(sums), np.concatenate(radii)


def plant(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Trees of a task's vectors; null ids are written as they are."""

    def trees(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(rows)
        at = np.arange(held.num_rows)
        order, points, pivots, sums, radii = tree(at, held["x"].combine_chunks().flatten().to_numpy().reshape(-1, dims))
        ids = held["id"].combine_chunks().take(pa.array(order))
        one = lambda a, kind: pa.array([a], kind)
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one(points.astype("<i4").tobytes(), pa.binary()), one(pivots.astype("<i4").tobytes(), pa.binary()), one(sums.astype("<i8").tobytes(), pa.binary()), one(radii, TREE.field("radii").type)],
            schema=TREE,
        )

    rows, n = [], 0
    for batch in batches:
        while batch.num_rows:
            rows.append(batch.slice(0, BLOCK - n))
            n, batch = n + rows[-1].num_rows, batch.slice(BLOCK - n)
            if n == BLOCK:
                yield trees(rows)
                rows, n = [], 0
    if n:
        yield trees(rows)


def assign(points: np.ndarray, pivots: np.ndarray, sums: np.ndarray, radii: np.ndarray, centroids: np.ndarray) -> tuple:
    """Of each point the nearest centroid (the smaller number if equal), of each centroid count and sum, and the number of distances of single points."""
    depths, k = cuts(len(points)), len(centroids)
    nearest, count, total = np.full(len(points), -1, dtype=np.int32), np.zeros(k, dtype=np.int64), np.zeros_like(centroids)
    possible, open_, base = np.ones((1, k), dtype=bool), np.array([0]), 0
    for depth, bounds in enumerate(depths):
        if len(open_):
            at = base + open_
            away = np.sqrt(((pivots[at, None, :] - centroids[None]) ** 2).sum(axis=2, dtype=np.int64).astype(np.float64))
            away[~possible] = np.inf
            first = away.min(axis=1)
            possible &= away - first[:, None] <= 2 * radii[at, None] * (1 + ROOM) + ROOM * (1 + first[:, None])
            whole = possible.sum(axis=1) == 1
            owner = possible[whole].argmax(axis=1)
            np.add.at(count, owner, np.diff(bounds)[open_[whole]])
            np.add.at(total, owner, sums[at[whole]])
            for ball, c in zip(open_[whole], owner, strict=True):
                nearest[bounds[ball] : bounds[ball + 1]] = c
            open_, possible = open_[~whole], possible[~whole]
            if depth + 1 < len(depths):
                open_, possible = np.stack([2 * open_, 2 * open_ + 1], axis=1).ravel(), np.repeat(possible, 2, axis=0)
        base += len(bounds) - 1
    compared = 0
    if len(open_):
        size = np.diff(depths[-1])[open_]
        rest = np.concatenate([np.arange(depths[-1][b], depths[-1][b + 1]) for b in open_])
        may, best = np.repeat(possible, size, axis=0), np.full(len(rest), np.iinfo(np.int64).max)
        for c in range(k):
            own = np.flatnonzero(may[:, c])
            away = ((points[rest[own]] - centroids[c]) ** 2).sum(axis=1)
            closer = away < best[own]
            best[own[closer]], nearest[rest[own[closer]]] = away[closer], c
            compared += len(own)
        for c in range(k):
            own = rest[nearest[rest] == c]
            count[c] += len(own)
            total[c] += points[own].sum(axis=0)
    return nearest, count, total, compared


def _opened(batch: pa.RecordBatch, dims: int) -> Iterator[tuple]:
    read = lambda name, k, kind: np.frombuffer(batch[name][k].as_py(), dtype=kind).astype(np.int64).reshape(-1, dims)
    for k in range(batch.num_rows):
        yield batch["ids"][k].values, read("points", k, "<i4"), read("pivots", k, "<i4"), read("sums", k, "<i8"), batch["radii"][k].values.to_numpy()


class Trees:
    """Vectors as a table of ball trees.  ``df`` needs a long ``id`` and an array ``x`` of ``dims`` longs."""

    def __init__(self, df: DataFrame, dims: int):
        self.dims = dims
        self.table = stored(df.select(F.col("id").cast("long").alias("id"), "x").mapInArrow(lambda batches: plant(batches, dims), TREE_SQL))

    def sums(self, centroids: list[list[int]]) -> DataFrame:
        """cluster, dim, total and n of each task's vectors added up: (centroids x dims) rows; ``compared`` sums the distances of single points."""
        dims, c = self.dims, np.array(centroids, dtype=np.int64)

        def work(batches):
            count, total, compared = np.zeros(len(c), dtype=np.int64), np.zeros_like(c), 0
            for batch in batches:
                for _, *balls in _opened(batch, dims):
                    _, n, s, m = assign(*balls, c)
                    count, total, compared = count + n, total + s, compared + m
            number = np.repeat(np.arange(len(c)), dims)
            yield pa.RecordBatch.from_pydict({"cluster": number.astype(np.int32), "dim": np.tile(np.arange(dims), len(c)).astype(np.int32), "total": total.ravel(), "n": count[number], "compared": np.where(np.arange(len(number)) == 0, compared, 0)})

        parts = self.table.mapInArrow(work, "cluster int, dim int, total long, n long, compared long")
        wide = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
        return parts.groupBy("cluster", "dim").agg(wide("total"), wide("n"), wide("compared"))

    def nearest(self, centroids: list[list[int]]) -> DataFrame:
        """id, cluster and distance (squared) of every vector."""
        dims, c = self.dims, np.array(centroids, dtype=np.int64)

        def work(batches):
            for batch in batches:
                for ids, points, *balls in _opened(batch, dims):
                    nearest, *_ = assign(points, *balls, c)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(nearest), pa.array(((points - c[nearest]) ** 2).sum(axis=1))], ["id", "cluster", "distance"])

        return self.table.mapInArrow(work, "id long, cluster int, distance long")


def first_centroids(df: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of seed and id; k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r.x) for r in df.orderBy(key, "x").limit(k).select("x").collect()]


def fit(trees: Trees, centroids: list[list[int]], rounds: int) -> list[list[int]]:
    """Centroids after the rounds (fewer if a round changes nothing, as then none would): the floor of each mean; those without vectors stay."""
    for _ in range(rounds if centroids else 0):
        now = [list(c) for c in centroids]
        for r in trees.sums(centroids).filter("n > 0").collect():
            now[r.cluster][r.dim] = int(r.total) // int(r.n)
        if now == centroids:
            break
        centroids = now
    return centroids


def cluster_vectors(df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: str = "3:") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each row of ``df`` (id, vector) that is not left out."""
    spark = df.sparkSession
    whole = spread(df.select(F.col("id").cast("long").alias("id"), integers(F.col("vector"), dims).alias("x"))).filter("x is not null")
    centroids = first_centroids(whole, k, seed)
    trees = Trees(whole, dims)
    centroids = fit(trees, centroids, rounds)
    out = trees.nearest(centroids)
    held = {r.cluster: int(r.d) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()} if centroids else {}
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(c, held.get(c, 0), sum(held.values()), sha(centroids[c])) for c in range(len(centroids))]
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(per), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
