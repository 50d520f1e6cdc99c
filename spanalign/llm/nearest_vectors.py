"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by fast Hadamard pseudo-rotations (three rounds of random signs and a Walsh-Hadamard
transform) and assigned to the nearest signed axis.  A table joins ``parts`` such hashes to one bucket; a
query looks in its own bucket and in those that are next nearest (multiprobe), in each of ``TABLES`` tables.
The candidates of all tables are compared exactly on the original vectors.

With n rows, ``parts`` grows with log n, so buckets stay small, and a query looks at first in as many buckets
of a table as hold ``PROBED * n ** (1 / 3)`` rows on average.  How many it takes depends on the data, so the
exact neighbours of ``SAMPLE`` queries are found by comparing them with all rows (a scan), and probes are
added until the hashes find the share ``RECALL`` of them, up to all buckets of a table, which is an exact
search.  Probes are no cap on candidates: all rows of a probed bucket are compared.

Most rows of a probed bucket are not near.  So a sketch travels with the bucket, ``SKETCH`` rotated coordinates of
``BITS`` bits each, and a row and a query that meet are compared first by the dot product of their sketches.  Pairs go on
to the exact comparison down to the dot product that the share ``SEEN`` of the sample's known neighbours reaches, and
always with equal sketches; ``RECALL`` is measured behind this test, and an exact search has no such test.

Near copies share the bucket of most tables.  So the buckets of the ``EARLIER`` tables before travel along too, and a pair
that shared the query's own bucket in one of them was made there and is not made again: each pair is still made in
the first table where it meets.

Shape on a cluster: the index is a scan that gives a row per vector and table; it meets the probes of the
stated query set in an equi-join on the bucket.  Equal vectors are hashed and compared once; of equal
vectors only the ``neighbours + 1`` smallest ids can be in a result, so a vector that a third of all rows
share neither fills a bucket nor is lost.  Top rows are cut before the shuffle (rank filter).

Edge cases: vectors that are null, empty, zero or hold null or non-finite parts take no part, nor do rows
with a null id or of another length than most; rows that share the query's id are its own; with fewer
candidates than neighbours all that were found are returned; ties go to the smaller id; empty tables give an
empty result.  Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanalign.session import written

TABLES, ROUNDS = 48, 3
PROBED = 1.5
#: Queries with known neighbours, the share of those to be found, and the step by which probes are added.
SAMPLE, RECALL, WIDER = 200, 0.95, 1.25
#: Coordinates and bits of a sketch, the width of a level (coordinates of variance 1), and the share of known neighbours it keeps.
SKETCH, BITS, LEVEL, SEEN = 64, 3, 0.586, 0.995
#: Tables before its own whose buckets go with a bucket.
EARLIER = 2
NEIGHBOURS, EVERY = 10, 100
_SEED = 20240921


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform along the last axis, not scaled."""
    n, h = x.shape[-1], 1
    while h < n:
        pairs = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x


class CrossPolytope:
    """The hash functions of all tables for vectors of one length."""

    def __init__(self, dimension: int, parts: int, tables: int = TABLES) -> None:
        self.width = 1 << max(1, (dimension - 1).bit_length())
        self.dimension, self.parts, self.tables = dimension, parts, tables
        signs = np.random.Generator(np.random.PCG64(_SEED)).integers(0, 2, (ROUNDS, tables * parts, self.width))
        self.signs = (2 * signs - 1).astype(np.float32)
        wide = max(dimension, SKETCH)
        turn = np.linalg.qr(np.random.Generator(np.random.PCG64(_SEED)).normal(size=(wide, SKETCH)))[0]
        self.turn = turn[:dimension] * math.sqrt(wide) / LEVEL

    def levels(self, vectors: np.ndarray) -> np.ndarray:
        """The sketch as numbers from 0 to 2 ** BITS - 1: (vector, coordinate)."""
        turned = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ self.turn
        return np.clip(np.floor(turned) + (1 << BITS - 1), 0, (1 << BITS) - 1).astype(np.uint8)

    def sketches(self, vectors: np.ndarray) -> np.ndarray:
        """The sketch as one word for each bit of its numbers, lowest first: (vector, bit)."""
        levels = self.levels(vectors)
        return np.concatenate([np.packbits(levels >> k & 1, axis=1).view(np.int64) for k in range(BITS)], axis=1)

    def products(self, queries: np.ndarray, of: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Dot product of the sketches of ``queries[of]`` and ``near``, as `sketch_product` has it."""
        a, b = (2 * self.levels(x).astype(np.int64) - (1 << BITS) + 1 for x in (queries, near))
        return (a[of] * b).sum(axis=1)

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        """Unit vectors after each pseudo-rotation: (vector, table, part, axis)."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        x = np.zeros((len(unit), 1, self.width), np.float32)
        x[:, 0, :self.dimension] = unit
        for signs in self.signs:
            x = _hadamard(x * signs) / np.float32(math.sqrt(self.width))
        return x.reshape(len(unit), self.tables, self.parts, self.width)

    def _keys(self, codes: np.ndarray) -> np.ndarray:
        """One number for the table and the axes of all parts (last dimension)."""
        key = np.arange(self.tables, dtype=np.int64).reshape(1, self.tables, *[1] * (codes.ndim - 3))
        for part in range(self.parts):
            key = key * (2 * self.width) + codes[..., part]
        return key

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """The bucket in each table: (vector, table)."""
        x = self.turned(vectors)
        axis = np.abs(x).argmax(axis=-1)
        negative = np.take_along_axis(x, axis[..., None], -1)[..., 0] < 0
        return self._keys(2 * axis + negative)

    def probes(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest buckets in each table: (vector, table, probe)."""
        x = self.turned(vectors)
        top = np.abs(x).max(axis=-1, keepdims=True)
        cost = np.stack([(top - x) ** 2, (top + x) ** 2], axis=-1).reshape(*x.shape[:-1], 2 * self.width)
        order = np.argsort(cost, axis=-1, kind="stable")[..., :min(count, 2 * self.width)]
        cost = np.take_along_axis(cost, order, -1)
        total, codes = cost[:, :, 0], order[:, :, 0, :, None]
        for part in range(1, self.parts):
            # the cheapest sums so far with every choice of the next part
            # (both are sorted: of the a-th sum with the b-th choice, a * b others are no dearer)
            a, b = (np.concatenate(x) for x in zip(*((np.full(m, k), np.arange(m)) for k in range(total.shape[-1])
                                                     for m in [min(count // (k + 1), cost.shape[-1])])))
            both = total[..., a] + cost[:, :, part][..., b]
            best = np.argsort(both, axis=-1, kind="stable")[..., :count]
            total = np.take_along_axis(both, best, -1)
            earlier = np.take_along_axis(codes, a[best][..., None], 2)
            codes = np.concatenate([earlier, np.take_along_axis(order[:, :, part], b[best], -1)[..., None]], axis=-1)
        return self._keys(codes)


def _earlier(own: np.ndarray, name: str, none: int, repeat: int = 1) -> dict[str, np.ndarray]:
    """The buckets of the tables before that of each row of ``own`` (vector, table), ``none`` where there is none."""
    out = {}
    for k in range(1, EARLIER + 1):
        before = np.full_like(own, none)
        before[:, k:] = own[:, :max(own.shape[1] - k, 0)]
        out[f"{name}{k}"] = np.repeat(before.ravel(), repeat)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def valid_vectors(vectors: DataFrame, vector_id: str, vector: str) -> DataFrame:
    """``id, v`` of the rows that take part (double parts)."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vector_id).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite).where(F.exists("v", lambda x: x != 0))


def known_neighbours(classes: DataFrame, queries: DataFrame, neighbours: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``SAMPLE`` of the queries, and the vectors nearest to them by comparison with all classes, without the
    query's own: the index of the query, the vector."""
    drawn = [r.v for r in queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    sample = np.array(drawn, float)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rows = np.full((len(sample), 0), 0.0), np.zeros((len(sample), 0, sample.shape[1]))
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                v = _matrix(batch.column(0).slice(low, 256))
                apart = (v ** 2).sum(axis=1) - 2 * sample @ v.T  # less the query's own square
                best, rows = np.concatenate([best, apart], axis=1), np.concatenate([rows, np.broadcast_to(v, (len(sample), *v.shape))], axis=1)
                near = np.argsort(best, axis=1, kind="stable")[:, :neighbours + 1]
                best, rows = np.take_along_axis(best, near, 1), np.take_along_axis(rows, near[..., None], 1)
        if best.size:
            yield pa.record_batch({"k": np.repeat(np.arange(len(sample)), best.shape[1]), "apart": best.ravel(),
                                   "v": pa.array(list(rows.reshape(-1, sample.shape[1])), pa.list_(pa.float64()))})

    if not drawn:
        return sample, np.zeros(0, np.int64), sample
    near = Window.partitionBy("k").orderBy("apart")
    found = classes.select("v").mapInArrow(compare, "k long, apart double, v array<double>")
    rows = found.withColumn("r", F.row_number().over(near)).where(F.col("r") <= neighbours + 1).select("k", "v").collect()
    rows = [r for r in rows if r.v != drawn[r.k]]
    return sample, np.array([r.k for r in rows], np.int64), np.array([r.v for r in rows], float).reshape(len(rows), -1)


def found_share(hashing: CrossPolytope, queries: np.ndarray, of: np.ndarray, near: np.ndarray, count: int) -> float:
    """Share of the neighbours ``near`` of ``queries[of]`` that are in a bucket of ``count`` probes a table."""
    found, order = 0, np.argsort(of, kind="stable")
    step = max(1, 512 // count)
    for low in range(0, len(queries), step):
        probes = hashing.probes(queries[low:low + step], count)
        for k in range(len(probes)):
            own = near[order[slice(*np.searchsorted(of[order], [low + k, low + k + 1]))]]
            if len(own):
                found += int((probes[k] == hashing.buckets(own)[..., None]).any(axis=(1, 2)).sum())
    return found / len(near)


def sketch_product(left: list[Column], right: list[Column]) -> Column:
    """Dot product of two sketches, their numbers as odd ones around 0."""
    ones = lambda *words: F.bit_count(reduce(Column.bitwiseAND, words))
    top = (1 << BITS) - 1
    product = sum((ones(a, b) * (4 << i + j) for i, a in enumerate(left) for j, b in enumerate(right)), F.lit(SKETCH * top * top))
    return sum((ones(w) * (-2 * top << i) for words in (left, right) for i, w in enumerate(words)), product)


def enough_probes(hashing: CrossPolytope, queries: np.ndarray, of: np.ndarray, near: np.ndarray, count: int,
                  share: float = RECALL) -> int:
    """``count`` or the larger number of probes a table that finds this share of the neighbours."""
    buckets = (2 * hashing.width) ** hashing.parts
    while len(near) and count < buckets and found_share(hashing, queries, of, near, count) < share:
        count = min(math.ceil(WIDER * count), buckets)
    return count


def nearest(vectors: DataFrame, vector_id: str = "vec_id", vector: str = "embedding", every: int = EVERY,
            neighbours: int = NEIGHBOURS, tables: int = TABLES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows found of each row whose id ``every`` divides."""
    rows = valid_vectors(vectors, vector_id, vector)
    sizes = sorted(((n, -d) for d, n in rows.groupBy(F.size("v")).count().collect()), reverse=True)
    dimension = -sizes[0][1] if sizes else 1
    rows = rows.where(F.size("v") == dimension)
    # equal vectors are one class, named by its smallest id
    of_class = Window.partitionBy("v").orderBy("id")
    members = written(rows.withColumn("place", F.row_number().over(of_class)).where(F.col("place") <= neighbours + 1)
                      .withColumn("class", F.first("id").over(of_class)), "vectors")
    classes = members.where("place = 1").select("class", "v")
    queries = rows.where(F.col("id") % every == 0)

    n = max(classes.count(), 1)
    width = 1 << max(1, (dimension - 1).bit_length())
    parts = max(1, round(math.log(n) / math.log(2 * width)))
    hashing = CrossPolytope(dimension, parts, tables)
    buckets = (2 * width) ** parts
    count = min(math.ceil(PROBED * n ** (1 / 3) * buckets / n), buckets)
    least = None
    if count < buckets:
        sample, of, near = known_neighbours(classes, queries, neighbours)
        if len(near):
            products = hashing.products(sample, of, near)
            least = int(np.sort(products)[len(near) - math.ceil(SEEN * len(near))])
            seen = products >= least
            count = enough_probes(hashing, sample, of[seen], near[seen], count, RECALL / seen.mean())
    step = max(1, min(64, 2048 // count))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                v = _matrix(part.column(1))
                found, words = hashing.buckets(v), hashing.sketches(v)
                yield pa.record_batch({"bucket": found.ravel(), "class": np.repeat(part.column(0).to_numpy(), tables),
                                       **{f"c{k}": np.repeat(words[:, k], tables) for k in range(BITS)}, **_earlier(found, "had", -1)})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                v = _matrix(part.column(1))
                found, words = hashing.probes(v, count), hashing.sketches(v)
                own, each = found[:, :, 0], found.shape[2]
                yield pa.record_batch({"bucket": found.ravel(), "query_id": np.repeat(part.column(0).to_numpy(), tables * each),
                                       **{f"q{k}": np.repeat(words[:, k], tables * each) for k in range(BITS)}, **_earlier(own, "asked", -2, each)})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.sqrt(((_matrix(batch.column(2)) - _matrix(batch.column(3))) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query_id", "class", "score"])

    words = lambda name, numbers: "".join(f", {name}{k} long" for k in numbers)
    tables_before = range(1, EARLIER + 1)
    probes = queries.mapInArrow(probe, "bucket long, query_id long" + words("q", range(BITS)) + words("asked", tables_before))
    met = classes.mapInArrow(index, "bucket long, class long" + words("c", range(BITS)) + words("had", tables_before)).join(probes, "bucket")
    met = met.where(reduce(Column.__and__, (F.col(f"had{k}") != F.col(f"asked{k}") for k in tables_before)))
    if least is not None and count < buckets:
        own, asked = ([F.col(f"{name}{k}") for k in range(BITS)] for name in "cq")
        equal = reduce(Column.__and__, (a == b for a, b in zip(own, asked)))
        met = met.where((sketch_product(own, asked) >= least) | equal)
    candidates = met.select("query_id", "class").distinct()
    pairs = candidates.join(classes, "class").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    scores = pairs.select("query_id", "class", "v", "q").mapInArrow(compare, "query_id long, class long, score double")
    # a class may hold the query itself, so one class more than neighbours is kept
    near = Window.partitionBy("query_id").orderBy("score", "class")
    scores = scores.withColumn("r", F.row_number().over(near)).where(F.col("r") <= neighbours + 1).drop("r")
    found = scores.join(members.select("class", F.col("id").alias("vec_id")), "class").where("vec_id <> query_id").distinct()
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= neighbours)
            .select("query_id", "rank", "vec_id", "score"))
