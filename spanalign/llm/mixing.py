"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are counted by cell of source, language and topic.  Raking multiplies a factor per source, per
language and per topic until the weighted token shares of every margin are the targets.  A document is then
sampled with the probability ``min(1, c * weight of its cell)``; ``c`` makes the expected tokens of the sample
the wanted fraction of all tokens.  Draws are a hash of the id and a seed, so a run can be repeated.

Shape on a cluster: one scan counts cells (added up before the shuffle), a second one decides; no text is
shuffled.  Every source and language is a category of its own.  The driver rakes the cells that have tokens, as
numbers: its memory grows with the distinct cells, not with documents.  The scan gets the weights as a
broadcast if each margin has at most ``CATEGORIES`` values, otherwise by a join that shuffles the documents.

Edge cases: a null source or language is the category ``(none)``; a null or empty text has no tokens, its
topic is -1, and it is sampled with the weight of its cell (1 if the cell has no tokens at all); targets are
scaled to the categories that have tokens; categories without a target get weight 0; rows with one id are
drawn alike, rows without an id by a hash of their text, source and language; empty tables give an empty result.
Further columns pass through; names that begin with two underscores are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from spanalign.llm import kernels as K

TOPICS, TOPIC_WORD_BYTES = 8, 6
#: With more categories in a margin the weights are not broadcast.
CATEGORIES = 128
ROUNDS, TOLERANCE = 500, 1e-10
MARGINS = ("source", "lang", "topic")
RESULTS = ("topic", "n_tokens", "weight", "probability", "sampled")


def with_tokens(documents: DataFrame) -> DataFrame:
    """Adds ``__n_tokens`` (words) and ``__topic``: the part of the hashed vocabulary that holds most of the
    text's longer words (ties to the smaller number)."""
    place = documents.columns.index("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = K.Powers()
        for batch in batches:
            topics, tokens = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for _, data, offsets in K.slices(batch.column(place)):
                starts, ends, hashes, first = K.words(data, offsets, kept)
                n = len(offsets) - 1
                text = np.searchsorted(first, np.arange(len(starts)), "right") - 1
                longer = ends - starts >= TOPIC_WORD_BYTES
                part = (hashes >> np.uint64(32)).astype(np.int64) % TOPICS
                votes = np.bincount(text[longer] * TOPICS + part[longer], minlength=n * TOPICS).reshape(n, TOPICS)
                topics.append(np.where(votes.any(axis=1), votes.argmax(axis=1), -1).astype(np.int32))
                tokens.append(first[1:] - first[:-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(topics)), pa.array(np.concatenate(tokens))],
                                             [*batch.schema.names, "__topic", "__n_tokens"])

    return documents.mapInArrow(count, T.StructType([*documents.schema.fields, T.StructField("__topic", T.IntegerType()), T.StructField("__n_tokens", T.LongType())]))


def _category(margin: str) -> Column:
    return F.coalesce(F.col(margin).cast("string"), F.lit("(none)"))


def tempered(power: float):
    """Targets proportional to a power of the tokens there are: 1 leaves the shares, 0 makes them equal."""
    return lambda tokens: {k: v ** power for k, v in tokens.items() if v > 0}


def level_topics(tokens: dict) -> dict:
    """Equal shares for all topics; texts without one keep the share they have."""
    real = [v for k, v in tokens.items() if k != "-1" and v > 0]
    return {k: v if k == "-1" else sum(real) / len(real) for k, v in tokens.items() if v > 0}


DEFAULT_TARGETS = {"source": tempered(0.5), "lang": tempered(0.7), "topic": level_topics}


def rake(tokens: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Weights of cells whose weighted tokens have the target shares; ``places`` has the category of each cell
    in each margin."""
    factors = [np.ones(len(t)) for t in targets]

    def weights() -> np.ndarray:
        out = np.ones(len(tokens))
        for f, at in zip(factors, places):
            out *= f[at]
        return out

    for _ in range(ROUNDS):
        worst = 0.0
        for k, target in enumerate(targets):
            now = np.bincount(places[k], tokens * weights(), len(target))
            total = now.sum()
            if not total:
                return np.ones(len(tokens))
            step = np.divide(target * total, now, out=np.zeros(len(now)), where=now > 0)
            worst = max(worst, np.abs(now / total - target).max())
            factors[k] *= step
        if worst < TOLERANCE:
            break
    return weights()


def scale(tokens: np.ndarray, weights: np.ndarray, fraction: float) -> float:
    """The factor with which capped weights sample the wanted fraction of tokens, as far as they can."""
    wanted, low, high = fraction * tokens.sum(), 0.0, 1.0
    positive = weights[(weights > 0) & (tokens > 0)]
    if not len(positive):
        return fraction
    while (tokens * np.minimum(1, high * weights)).sum() < wanted and high * positive.min() < 1:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if (tokens * np.minimum(1, middle * weights)).sum() < wanted else (low, middle)
    return high


def _weighed(documents: DataFrame, fraction: float, targets: dict | None, seed: int) -> DataFrame:
    """``documents`` with the results under names that begin with ``__``."""
    spark, targets = documents.sparkSession, DEFAULT_TARGETS | (targets or {})
    rows = with_tokens(documents)
    margins = {m: f"__of_{m}" for m in MARGINS}
    # a topic that the documents have counts, otherwise that of their words
    rows = rows.select("*", *(_category(m if m in documents.columns else "__topic").alias(name) for m, name in margins.items()))
    cells = rows.groupBy(*margins.values()).agg(F.sum("__n_tokens").alias("tokens"))
    # only cells that have tokens count; others weigh 1
    cells = cells.where("tokens > 0").toArrow().sort_by([(name, "ascending") for name in margins.values()])
    tokens = cells.column("tokens").to_numpy().astype(float)
    places, shares = [], []
    for m, name in margins.items():
        coded = cells.column(name).combine_chunks().dictionary_encode()
        names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        own = dict(zip(names, np.bincount(at, tokens, len(names))))
        wanted = targets[m](own) if callable(targets[m]) else {str(c): s for c, s in targets[m].items()}
        share = np.array([wanted.get(c, 0.0) for c in names], float)
        places.append(at)
        shares.append(share / share.sum() if share.sum() else share)
    weights = rake(tokens, places, shares)
    c = scale(tokens, weights, fraction)
    table = spark.createDataFrame(cells.drop_columns(["tokens"]).append_column("__weight", pa.array(weights, pa.float64())))
    if max(map(len, shares)) <= CATEGORIES:
        table = F.broadcast(table)
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text", *margins.values())).otherwise(F.col("doc_id").cast("long"))
    out = rows.join(table, list(margins.values()), "left")
    out = out.withColumn("__draw", F.shiftrightunsigned(F.xxhash64(own, F.lit(seed)), 11) / F.lit(float(1 << 53)))
    out = out.withColumn("__weight", F.coalesce("__weight", F.lit(1.0))).withColumn("__probability", F.least(F.lit(1.0), F.lit(c) * F.col("__weight")))
    return out.withColumn("__sampled", F.col("__draw") < F.col("__probability"))


def mixed(documents: DataFrame, fraction: float, targets: dict | None = None, seed: int = 1) -> DataFrame:
    """``documents`` with ``topic, n_tokens, weight, probability, sampled``.

    ``targets`` maps a margin to ``{category: share}`` or to a function from tokens per category to that.
    Input columns named like the results are replaced, but a ``topic`` stays and is the margin.
    """
    found = _weighed(documents, fraction, targets, seed)
    topic = "topic" if "topic" in documents.columns else "__topic"
    return found.select(*(c for c in documents.columns if c not in RESULTS), F.col(topic).alias("topic"), *(F.col(f"__{r}").alias(r) for r in RESULTS[1:]))


def sample(documents: DataFrame, fraction: float, targets: dict | None = None, seed: int = 1) -> DataFrame:
    """The sampled documents with their own columns, values untouched."""
    return _weighed(documents, fraction, targets, seed).where("__sampled").select(*documents.columns)
