"""Cross-polytope search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanalign.llm import nearest_vectors as V


def _exact(rows, every, k):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, x in rows:
        if q % every == 0:
            near = sorted({(float(np.sqrt(((x - v) ** 2).sum())), i) for i, v in rows if i != q})[:k]
            out[q] = near
    return out


@pytest.mark.parametrize("n,d", [(40, 5), (700, 16)])
def test_small_tables(spark, n, d):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in rng.normal(size=d)]) for i in range(n)]
    rows += [(n + k, rows[10][1]) for k in range(25)]  # ties
    odd = [(None, rows[0][1]), (n + 100, None), (n + 101, []), (n + 102, [0.0] * d), (n + 103, [float("nan")] * d), (n + 104, [float("inf")] * d),
           (n + 105, [None] * d), (n + 106, rows[0][1] + [1.0]), (20, rows[20][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("class", F.lit(1)).withColumn("score", F.lit(2)).repartition(3)
    found = V.nearest(df, every=10, neighbours=6).collect()
    want = _exact(rows, 10, 6)
    hits = 0
    for q, near in want.items():
        own = sorted((r.rank, r.score, r.vec_id) for r in found if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1)) and [(s, v) for _, s, v in own] == sorted((s, v) for _, s, v in own)
        hits += len({v for _, _, v in own} & {i for _, i in near})
    assert hits >= 0.9 * 6 * len(want) and {r.query_id for r in found} == set(want)
    ties = [r.vec_id for r in sorted((r for r in found if r.query_id == 10), key=lambda r: r.rank)]
    assert ties == [n + k for k in range(6)]


def test_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    found = V.nearest(df).collect()
    want = _exact(rows, 100, 10)
    own = {(r.query_id, r.vec_id) for r in found}
    assert sum((q, i) in own for q, near in want.items() for _, i in near) >= 0.9 * 10 * len(want)


def test_probes_are_added_until_neighbours_are_found():
    """Vectors without any structure, just below the size at which buckets get another part."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def known(ids):
        apart = -x[ids] @ x.T
        apart[np.arange(len(ids)), ids] = 9
        near = np.argpartition(apart, 10, axis=1)[:, :10]
        return x[ids].astype(float), np.repeat(np.arange(len(ids)), 10), x[near.ravel()].astype(float)

    hashing = V.CrossPolytope(64, 2, V.TABLES)
    first, others = 9, known(np.arange(1000, 1100))
    assert V.found_share(hashing, *others, first) < 0.9
    assert V.found_share(hashing, *others, V.enough_probes(hashing, *known(np.arange(100)), first)) >= 0.93


def test_first_probes_are_measured(spark, monkeypatch):
    monkeypatch.setattr(V, "PROBED", 1e-9)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=32)]) for i in range(1500)]
    found = {(r.query_id, r.vec_id) for r in V.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, tables=6).collect()}
    want = _exact(rows, 20, 10)
    assert sum((q, i) in found for q, near in want.items() for _, i in near) >= 0.93 * 10 * len(want)


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert V.nearest(spark.createDataFrame([], schema)).count() == 0
    assert V.nearest(spark.createDataFrame([(100, [1.0, 2.0])], schema)).count() == 0
    found = V.nearest(spark.createDataFrame([(100, [1.0, 2.0]), (3, [1.0, 2.0]), (5, [1.0, 2.5])], schema)).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in found] == [(1, 3, 0.0), (2, 5, 0.5)]


def test_probes_start_with_the_own_bucket():
    own = V.CrossPolytope(12, 2, 5)
    x = np.random.default_rng(1).normal(size=(30, 12))
    assert (own.probes(x, 20)[:, :, 0] == own.buckets(x)).all()


def test_sketches_leave_few_pairs_to_compare(spark):
    """Vectors without any structure: pairs that go on to the exact comparison grow about as the queries do."""
    rng, queries, pairs = np.random.default_rng(7), 60, []
    hashing = V.CrossPolytope(64, 2, 4)
    for n in (4_000, 20_000):
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        apart = -x[:queries] @ x.T
        apart[np.arange(queries), np.arange(queries)] = 9
        near, of = np.argpartition(apart, 10, axis=1)[:, :10].ravel(), np.repeat(np.arange(queries), 10)
        least = np.sort(hashing.products(x[:queries], of, x[near]))[int(0.005 * len(near))]
        everyone = np.tile(np.arange(n), queries)
        pairs.append(int((hashing.products(x[:queries], np.repeat(np.arange(queries), n), x[everyone]) >= least).sum()))
    assert pairs[1] < 0.02 * queries * 20_000 and pairs[1] < 2.4 * pairs[0]

    words = [f"{side}{k}" for side in "cq" for k in range(V.BITS)]
    rows = spark.createDataFrame([tuple(int(w) for w in np.r_[a, b]) for a, b in zip(hashing.sketches(x[:50]), hashing.sketches(x[50:100]))], words)
    found = rows.select(V.sketch_product([F.col(c) for c in words[:V.BITS]], [F.col(c) for c in words[V.BITS:]]).alias("p")).collect()
    assert [r.p for r in found] == hashing.products(x[:50], np.arange(50), x[50:100]).tolist()


def test_pairs_are_made_in_the_first_table_they_meet():
    """Of a group of near copies, pairs are made a few times, not in each table, and none is lost."""
    rng, hashing, count = np.random.default_rng(8), V.CrossPolytope(64, 2, V.TABLES), 5
    x = rng.normal(size=64) + 0.05 * rng.normal(size=(200, 64))
    x = np.concatenate([x, x[:50] + 0.6 * rng.normal(size=(50, 64))])
    buckets, probes = hashing.buckets(x), hashing.probes(x[:20], count)
    had, asked = V._earlier(buckets, "b", -1), V._earlier(probes[:, :, 0], "b", -2, count)
    meets = (probes[:, None] == buckets[None, :, :, None]).any(axis=3)  # query, vector, table
    made = meets.copy()
    for name in had:
        made &= had[name].reshape(1, *buckets.shape) != asked[name].reshape(*probes.shape)[:, None, :, 0]
    assert (made.any(axis=2) == meets.any(axis=2)).all() and meets.any(axis=2).sum() > 4_000
    assert made[:, :200].sum() < 0.1 * meets[:, :200].sum()
    assert all(len(v) == 2 * 1 for v in V._earlier(buckets[:2, :1], "b", -1).values())
