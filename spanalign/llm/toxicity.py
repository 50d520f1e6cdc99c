"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of lower-cased byte n-grams of ``GRAMS`` (white space counts as a blank) in hashed
buckets.  ``r = log((1 + toxic documents with it) / toxic documents) - log(the same for clean ones)`` scales
each feature; a logistic regression with a quadratic penalty is then fitted to the scaled features.  Of all
buckets only the ``FEATURES`` with the largest log-likelihood statistic enter, so scoring a text costs a
table look-up per byte.

Shape on a cluster: the classifier is fitted on at most ``TRAIN_ROWS`` labelled rows, taken by the hash of
their id, whatever the size of the corpus (fixed bound; it makes the list of their ids fit for broadcasting).
Bucket counts are added up by Spark, the fit is one task over the bounded sample, the weights
(``FEATURES`` rows) pass the driver, and scoring is one scan without a shuffle.

Edge cases: a null or empty text has no features and gets the score of the bias alone; unlabelled rows, null
ids and null labels are never learned from but null ids are scored; a label given several times counts once
(toxic if any says so); with no labels, or of one kind only, every score is the smoothed share of toxic
labels; repeated rows stay repeated; empty tables give an empty result.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from spanalign.llm import kernels as K
from spanalign.session import written

GRAMS, BITS = (4, 5, 6), 20
TRAIN_ROWS, FEATURES = 20_000, 2048
FOLDS, MIN_DOCUMENTS = 5, 3
PENALTY, ROUNDS = 1e-4, 400
CUT = 0.5

_FOLD = K.LOWER.copy()
_FOLD[K.SPACE] = 32


def _buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size of n-gram: the bucket of every position of the slice, and the end of each text's n-grams."""
    folded = _FOLD[data].astype(np.uint64)
    for n in GRAMS:
        count = max(len(folded) - n + 1, 0)
        total = np.full(count, n, np.uint64)
        for k in range(n):
            total = total * np.uint64(257) + folded[k:k + count]
        yield K.bucket(total * np.uint64(0x9E3779B97F4A7C15), BITS), np.clip(np.maximum(offsets[1:] - n + 1, offsets[:-1]), 0, count)


def _present(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs, of chosen buckets only if a mask is given."""
    keys = []
    for buckets, ends in _buckets(data, offsets):
        at = np.arange(len(buckets)) if chosen is None else np.flatnonzero(chosen[buckets])
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at < ends[text]
        keys.append(text[inside] << BITS | buckets[at[inside]])
    keys = np.unique(np.concatenate(keys))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class Model:
    bias: float
    buckets: np.ndarray
    weights: np.ndarray


def _bucket_counts(rows: DataFrame) -> DataFrame:
    """Documents of either kind that have each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for first, data, offsets in K.slices(batch.column(0)):
                text, bucket = _present(data, offsets)
                for kind in (0, 1):
                    found[kind] += np.bincount(bucket[toxic[first + text] == kind], minlength=1 << BITS)
        seen = np.flatnonzero(found.any(axis=0))
        yield pa.record_batch({"bucket": seen, "clean": found[0][seen], "toxic": found[1][seen]})

    parts = rows.select("text", "toxic").mapInArrow(count, "bucket long, clean long, toxic long")
    return parts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _chosen(counts: DataFrame, clean: int, toxic: int) -> DataFrame:
    """The buckets with the largest log-likelihood statistic, with their log-count ratio ``r``."""
    n = float(clean + toxic)
    have = F.col("clean") + F.col("toxic")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    statistic = (part(F.col("toxic"), have * toxic / n) + part(F.col("clean"), have * clean / n)
                 + part(toxic - F.col("toxic"), (n - have) * toxic / n) + part(clean - F.col("clean"), (n - have) * clean / n))
    r = F.log((F.col("toxic") + 1.0) / (toxic + 1.0)) - F.log((F.col("clean") + 1.0) / (clean + 1.0))
    return (counts.where(have >= MIN_DOCUMENTS).where(have < n).select("bucket", r.alias("r"), statistic.alias("s"))
            .orderBy(F.desc("s"), "bucket").limit(FEATURES).select("bucket", "r"))


def _fit(rows: list[np.ndarray], toxic: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Weights of the features (already times ``r``), the bias last: accelerated gradient descent."""
    sizes = np.array([len(x) for x in rows])
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    value = r[flat]
    # a bound of the curvature: largest eigenvalue of X'X/4n by power iteration, the bias included
    v = np.ones(len(r) + 1)
    for _ in range(20):
        z = np.bincount(row, value * v[flat], len(rows)) + v[-1]
        v = np.append(np.bincount(flat, value * z[row], len(r)), z.sum()) / len(rows)
        bound = np.linalg.norm(v)
        v /= bound
    step = 1 / (0.3 * bound + PENALTY)
    w, ahead, t = np.zeros(len(r) + 1), np.zeros(len(r) + 1), 1.0
    for _ in range(ROUNDS):
        z = np.bincount(row, value * ahead[flat], len(rows)) + ahead[-1]
        miss = 1 / (1 + np.exp(-z)) - toxic
        slope = np.append(np.bincount(flat, value * miss[row], len(r)), miss.sum()) / len(rows)
        slope[:-1] += PENALTY * ahead[:-1]
        new = ahead - step * slope
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        if (slope * (new - w)).sum() > 0:  # restart when the momentum points uphill
            ahead, t_new = new, 1.0
        w, t = new, t_new
    return np.append(w[:-1] * r, w[-1])


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fold."""
    known = (labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    own = documents.select(F.col("doc_id").cast("long"), "text")
    sample = written(own.join(F.broadcast(known), "doc_id").select("text", "toxic"), "labelled")
    kinds = {k: n for k, n in sample.groupBy("toxic").count().collect()}
    clean, toxic = kinds.get(0, 0), kinds.get(1, 0)
    none = np.zeros(0)
    if not clean or not toxic:
        return Model(float(np.log((toxic + 1) / (clean + 1))), none.astype(np.int64), none)
    ranked = np.array(sorted((b, r) for b, r in _chosen(_bucket_counts(sample), clean, toxic).collect()))
    if not len(ranked):
        return Model(float(np.log((toxic + 1) / (clean + 1))), none.astype(np.int64), none)
    buckets, r = ranked[:, 0].astype(np.int64), ranked[:, 1]
    mask = np.zeros(1 << BITS, bool)
    mask[buckets] = True

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in K.slices(batch.column(0)):
                text, bucket = _present(data, offsets, mask)
                ends = np.searchsorted(text, np.arange(len(offsets)))
                feature = np.searchsorted(buckets, bucket).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, len(offsets) - 1), lists], ["toxic", "features"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, toxics = [], []
        for batch in batches:
            toxics.append(batch.column(0).to_numpy(zero_copy_only=False))
            column = batch.column(1)
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
            lists += [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        if lists:
            yield pa.record_batch({"weight": _fit(lists, np.concatenate(toxics), r)})

    # one task over the bounded sample
    designed = sample.mapInArrow(design, "toxic int, features array<int>")
    weights = np.array([x.weight for x in designed.coalesce(1).mapInArrow(fit, "weight double").collect()])
    return Model(float(weights[-1]), buckets, weights[:-1])


def score(documents: DataFrame, model: Model, result: str = "toxic_score") -> DataFrame:
    """All columns of ``documents`` and a double ``result`` from 0 to 1 for every row.

    A column of that name in the input is replaced.
    """
    documents = documents.drop(result)
    weight, mask = np.zeros(1 << BITS), np.zeros(1 << BITS, bool)
    weight[model.buckets], mask[model.buckets] = model.weights, True
    place, bias = documents.columns.index("text"), model.bias

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.full(batch.num_rows, bias)
            for first, data, offsets in K.slices(batch.column(place)):
                text, bucket = _present(data, offsets, mask)
                found[first:first + len(offsets) - 1] += np.bincount(text, weight[bucket], len(offsets) - 1)
            odds = 1 / (1 + np.exp(-np.clip(found, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds)], [*batch.schema.names, result])

    return documents.mapInArrow(each, T.StructType([*documents.schema.fields, T.StructField(result, T.DoubleType())]))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = train(documents, labels)
    found = score(documents.select(F.col("doc_id").cast("long"), "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"),
                        (F.col("toxic_score") >= CUT).cast("int").alias("predicted"))


def clean_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not call toxic, with their own columns, values untouched."""
    found = score(documents, train(documents, labels), "__toxic_score")
    return found.where(F.col("__toxic_score") < CUT).select(*documents.columns)
