"""Centroid clustering against a plain search over all centroids."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from spanalign.llm import centroids as C


def _plain(rows, count, rounds, dimension):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) and abs(x) < 1e5 for x in v)]
    if all(i is None for i, _ in kept):
        return []  # no first centroids
    points = np.array([p for _, p in kept], np.int64)
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), p) for i, p in kept if i is not None)[:count]
    centers = np.array([p for _, p in starts], np.int64)

    def assign():
        squares = ((points[:, None, :] - centers[None]) ** 2).sum(-1)
        return squares.argmin(1), squares.min(1)

    for _ in range(rounds):
        cluster, _ = assign()
        for c in range(len(centers)):
            own = points[cluster == c]
            if len(own):
                centers[c] = own.sum(0) // len(own)
    cluster, distance = assign()
    return sorted((i if i is not None else -1, int(c), int(d), int(distance[cluster == c].sum()), int(distance.sum()),
                   hashlib.sha256(",".join(map(str, centers[c].tolist())).encode()).hexdigest()) for (i, _), c, d in zip(kept, cluster, distance))


def _rows(result):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in result.collect())


def test_equals_the_plain_search(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(9, 6))
    rows = [(i, [float(x) for x in middles[i % 9] + 0.2 * rng.normal(size=6)]) for i in range(600)]
    rows += [(1000 + i, rows[4][1]) for i in range(300)] + [rows[8]] * 3  # copies and repeated rows
    odd = [(None, rows[0][1]), (2000, None), (2001, []), (2002, rows[0][1] + [1.0]), (2003, [float("nan")] * 6), (2004, [None] * 6),
           (2005, [float("-inf")] + [0.0] * 5), (2006, [1e300] + [0.0] * 5), (2007, [0.0] * 6), (2008, [1.0] * 5)]
    schema = "vec_id long, embedding array<double>"
    for own, count, rounds in ((rows + odd, 12, 4), (rows[:3], 12, 2), (odd[:1], 5, 1)):
        df = spark.createDataFrame(own, schema).withColumn("cluster", F.lit("a")).withColumn("point", F.lit(1)).repartition(3)
        assert _rows(C.clustered(df, count, rounds, dimension=6)) == _plain(own, count, rounds, 6)
    assert C.clustered(spark.createDataFrame([], schema)).count() == 0


def test_walks_end_at_the_nearest_centroid():
    rng = random.Random(4)
    for _ in range(40):
        k, d = rng.choice([1, 2, 7, 40]), rng.choice([1, 2, 5])
        centers = np.array([[rng.randint(-6, 6) for _ in range(d)] for _ in range(k)], np.int64)
        points = np.array([[rng.randint(-9, 9) for _ in range(d)] for _ in range(200)], np.int64)
        squares = ((points[:, None, :] - centers[None]) ** 2).sum(-1)
        for start in {0, k - 1}:
            cluster, distance = C.Orchard(centers).nearest(points, start)
            assert cluster.tolist() == squares.argmin(1).tolist() and distance.tolist() == squares.min(1).tolist()


def test_large_components_stay_exact():
    rng = np.random.default_rng(5)
    centers = rng.integers(-C.LARGEST, C.LARGEST, (20, 64))
    points = rng.integers(-C.LARGEST, C.LARGEST, (50, 64))
    cluster, distance = C.Orchard(centers).nearest(points)
    exact = [[sum((a - b) ** 2 for a, b in zip(p, c)) for c in centers.tolist()] for p in points.tolist()]
    assert distance.tolist() == [min(e) for e in exact] and cluster.tolist() == [e.index(min(e)) for e in exact]
