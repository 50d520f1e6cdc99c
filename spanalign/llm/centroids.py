"""Clustering around centroids with exact integer arithmetic; the nearest centroid is found by Orchard's search.

Vectors with the wanted number of components, none null or non-finite, become integers ``floor(SCALE * x)``.
The first centroids are the vectors whose ids hash smallest.  A round assigns every vector to the nearest
centroid (squared Euclidean distance, ties to the smaller number) and moves every non-empty centroid to
``floor(sum / count)`` of its vectors, component by component.

Orchard's search: every centroid has the list of all centroids sorted by distance from it.  A vector starts at
some centroid and walks along that centroid's list; at a centroid closer than the best so far it jumps to the
list of that one, centroids compared before are marked and passed over, and the walk ends at a centroid
strictly further than twice the best distance from the owner of the list, as nothing behind can be closer or
equally close.  All vectors of an Arrow batch walk in step.

Shape on a cluster: each round is one scan that gives one row of exact sums per centroid, component and task;
Spark adds them up and the driver sees ``centroids * (dimension + 1)`` numbers, whatever the size of the table.
The assignment of the last round is written once and read for the sums and for the result; only the sums (one
row per centroid) are broadcast.

Edge cases: null vectors and those of other lengths or with null, non-finite or out-of-range components
(``floor(SCALE * x)`` beyond ``+-LARGEST``, whose squared distances would not fit a long) take no part; rows with
null ids are clustered but cannot be first centroids; repeated rows are vectors of their own; of equal hashes
the smaller vector comes first; with fewer vectors than centroids there are fewer centroids, and without any
the result is empty.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanalign.session import written

DIMENSION, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5
LARGEST = 1 << 27
#: Vectors that walk in step.
STEP = 4096


def integer_vectors(vectors: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``point`` (array of long) of the vectors that take part."""
    x = F.col("embedding")
    value = F.transform(x, lambda v: v.cast("double") * F.lit(float(scale)))
    # NaN counts as larger than every number
    fits = F.forall(value, lambda v: v.isNotNull() & (v >= -float(LARGEST)) & (v < float(LARGEST)))
    return (vectors.select(F.col("vec_id").cast("long"), F.col("embedding"))
            .where(x.isNotNull() & (F.size(x) == dimension) & F.coalesce(fits, F.lit(False)))
            .select("vec_id", F.transform(value, lambda v: F.floor(v).cast("long")).alias("point")))


def first_centroids(points: DataFrame, count: int = CENTROIDS, salt: str = "2") -> np.ndarray:
    """The points with the smallest hashes of ``salt:vec_id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = points.where("vec_id is not null").select(key.alias("key"), "point").orderBy("key", "point").limit(count).collect()
    return np.array([r.point for r in rows], np.int64)


class Orchard:
    """Nearest centroid by walks along sorted neighbour lists."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        apart = np.array([self._squares(centroids, c) for c in centroids])
        self.lists = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.lists, 1)

    @staticmethod
    def _squares(points: np.ndarray, others: np.ndarray) -> np.ndarray:
        return ((points - others) ** 2).sum(axis=-1)

    @staticmethod
    def _further_than_twice(apart: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Whether the root of ``apart`` is strictly more than twice the root of ``best``, without overflow."""
        return (apart >> 2 > best) | ((apart >> 2 == best) & (apart & 3 > 0))

    def nearest(self, points: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each point's nearest centroid."""
        n, k = len(points), len(self.centroids)
        owner = np.full(n, start)
        best = self._squares(points, self.centroids[start])
        seen = np.zeros((n, k), bool)
        seen[:, start] = True
        at = np.zeros(n, np.int64)
        walking = np.arange(n)
        while len(walking):
            own, place = owner[walking], at[walking]
            more = place < k
            walking, own, place = walking[more], own[more], place[more]
            near = ~self._further_than_twice(self.apart[own, place], best[walking])
            walking, own, place = walking[near], own[near], place[near]
            candidate = self.lists[own, place]
            at[walking] += 1
            new = ~seen[walking, candidate]
            rows, candidate = walking[new], candidate[new]
            seen[rows, candidate] = True
            distance = self._squares(points[rows], self.centroids[candidate])
            closer = (distance < best[rows]) | ((distance == best[rows]) & (candidate < owner[rows]))
            rows = rows[closer]
            owner[rows], best[rows], at[rows] = candidate[closer], distance[closer], 0
        return owner, best


def _points(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _sums(points: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and component sums (Python integers) of the vectors nearest to each centroid."""
    k, dimension = centroids.shape

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, counts, sums = Orchard(centroids), np.zeros(k, np.int64), np.zeros((k, dimension), object)
        for batch in batches:
            every = _points(batch.column(0), dimension)
            for low in range(0, len(every), STEP):
                own = every[low:low + STEP]
                cluster, _ = search.nearest(own)
                order = np.argsort(cluster, kind="stable")
                found, first = np.unique(cluster[order], return_index=True)
                # STEP values below LARGEST add up within a long; beyond that Python integers do
                sums[found] += np.add.reduceat(own[order], first).astype(object)
                counts += np.bincount(cluster, minlength=k)
        rows = [(c, d, int(v)) for c in np.flatnonzero(counts).tolist() for d, v in enumerate([counts[c], *sums[c]])]
        yield pa.record_batch({"cluster": pa.array([r[0] for r in rows], pa.int32()), "place": pa.array([r[1] for r in rows], pa.int32()),
                               "total": pa.array([r[2] for r in rows], pa.decimal128(38, 0))})

    parts = points.select("point").mapInArrow(scan, "cluster int, place int, total decimal(38,0)")
    counts, sums = np.zeros(k, object), np.zeros((k, dimension), object)
    for r in parts.groupBy("cluster", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect():
        if r.place:
            sums[r.cluster, r.place - 1] = int(r.total)
        else:
            counts[r.cluster] = int(r.total)
    return counts, sums


def fitted(points: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after so many rounds."""
    for _ in range(rounds):
        if not len(centroids):
            break
        counts, sums = _sums(points, centroids)
        centroids = np.array([[s // n for s in own] if n else old.tolist() for n, own, old in zip(counts, sums, centroids)], np.int64)
    return centroids


def clustered(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """Every vector's ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    points = integer_vectors(vectors, dimension, scale)
    final = fitted(points, first_centroids(points, centroids), rounds)
    schema = "vec_id long, cluster int, distance long"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(final)
        for batch in batches:
            every = _points(batch.column(1), dimension)
            for low in range(0, len(every), STEP):
                cluster, distance = search.nearest(every[low:low + STEP])
                yield pa.record_batch({"vec_id": batch.column(0).slice(low, STEP), "cluster": cluster.astype(np.int32), "distance": distance})

    spark = vectors.sparkSession
    if not len(final):
        assigned = spark.createDataFrame([], schema)
    else:
        assigned = written(points.mapInArrow(assign, schema), "assigned")
    # one row per centroid
    totals = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    facts = [(c, totals.get(c, 0), sum(totals.values()), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest())
             for c, own in enumerate(final.tolist())]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
