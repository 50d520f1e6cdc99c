"""Quality rules: base rules and a hashed n-gram log-likelihood ratio against a trusted target.

Two multinomials over hashed character n-grams are counted over whole texts: one over all documents (raw)
and one over the documents that the labels trust (target).  A document's score is the mean, over its
n-grams, of ``log p_target - log p_raw``; dividing by the number of n-grams makes long and short texts
comparable.  Every document is decided by the same cut, no draw is involved.

Shape on a cluster: a scan joined with the labels counts both tables (one row per bucket and task, added up
by bucket), a second scan scores.  Only the bucket table (``2**bits`` rows) and a histogram of scores of
labelled rows (``BINS`` rows) pass the driver; both have a fixed size.

Edge cases: a null or empty text has no words and no n-grams, its score is 0 and it fails the base rules;
rows with a null ``doc_id`` are scored like any other but can't be labelled; repeated ids stay repeated,
each row judged by itself; without trusted rows every ratio is 0 and only the base rules decide; empty
tables give an empty result.  Further columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanalign.llm import kernels as K

GRAM, BITS = 4, 16
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Scores of labelled rows are put into bins of this width to find the cut.
BIN_WIDTH, BINS = 0.01, 2001
#: A trusted document that would be rejected counts as much as this many junk documents kept.
TRUSTED_COST = 4.0

RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _grams(data: np.ndarray, gram: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte (the last ``gram - 1`` of a slice are no n-grams)."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(gram):
        total = total * np.uint64(257) + data[k:k + n]
    return ((total * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _gram_ranges(offsets: np.ndarray, gram: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(offsets[:-1], n), np.minimum(np.maximum(offsets[1:] - gram + 1, offsets[:-1]), n)


def gram_counts(documents: DataFrame, trusted: DataFrame, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """``bucket, raw, target``: n-gram counts over all documents and over those in ``trusted`` (``doc_id``)."""
    marked = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("marked", F.lit(1))
    # labels grow with the corpus: one plan at every size, no broadcast for small inputs only
    rows = documents.select("doc_id", "text").join(marked.hint("merge"), "doc_id", "left").select("text", "marked")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            of_target = np.asarray(batch.column(1).is_valid())
            for first, data, offsets in K.slices(batch.column(0)):
                keys = _grams(data, gram, bits)
                low, high = _gram_ranges(offsets, gram, len(keys))
                inside = np.zeros(len(keys) + 1, np.int64)
                np.add.at(inside, low, 1)
                np.add.at(inside, high, -1)
                whole = np.cumsum(inside[:-1]) > 0
                raw += np.bincount(keys[whole], minlength=1 << bits)
                inside[:] = 0
                chosen = of_target[first:first + len(low)]
                np.add.at(inside, low[chosen], 1)
                np.add.at(inside, high[chosen], -1)
                target += np.bincount(keys[np.cumsum(inside[:-1]) > 0], minlength=1 << bits)
        seen = np.flatnonzero(raw)
        yield pa.record_batch({"bucket": seen, "raw": raw[seen], "target": target[seen]})

    parts = rows.mapInArrow(count, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, bits: int = BITS, smoothing: float = 1.0) -> np.ndarray:
    """Log-likelihood ratio of each bucket; the table has ``2**bits`` entries whatever the input."""
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    for bucket, r, t in counts.collect():
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(1 << bits)
    share = lambda x: (x + smoothing) / (x.sum() + smoothing * len(x))
    return np.log(share(target)) - np.log(share(raw))


def score_documents(documents: DataFrame, ratios: np.ndarray, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """The base figures and the length-normalised score of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = K.Powers()
        continuing = (np.arange(256) & 0xC0) == 0x80
        in_words = ~K.SPACE & ~continuing
        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            for _, data, offsets in K.slices(batch.column(1)):
                starts, ends, hashes, first = K.words(data, offsets, kept, lower=False)
                keys = _grams(data, gram, bits)
                low, high = _gram_ranges(offsets, gram, len(keys))
                sums = np.zeros(len(keys) + 1)
                np.cumsum(ratios[keys], out=sums[1:])
                parts.append([
                    first[1:] - first[:-1], _per_text(in_words[data], offsets), _per_text(symbol[data], offsets),
                    _duplicate_lines(data, offsets, starts, kept), _repeated_words(hashes, first),
                    (sums[high] - sums[low]) / np.maximum(high - low, 1),
                ])
            columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5 + [np.zeros(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in columns)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, RULES)


def _text_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, starts, "right") - 1


def _duplicate_lines(data, offsets, word_starts, kept) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    breaks = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    begins = begins[begins < len(data)]
    stops = np.concatenate([begins[1:], [len(data)]])[:len(begins)]
    stops = stops - (data[stops - 1] == 10) if len(stops) else stops
    with_word = np.searchsorted(word_starts, stops) > np.searchsorted(word_starts, begins)
    begins, stops = begins[with_word], stops[with_word]
    text = _text_of(begins, offsets)
    keys = K.mix(K.range_hashes(K._BYTE[data], begins, stops, kept) + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    later = np.ones(len(keys), bool)
    later[np.unique(keys, return_index=True)[1]] = False
    return np.bincount(text[later], minlength=len(offsets) - 1)


def _repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words inside windows of eight words that occur at least twice in their text."""
    found = K.windows(hashes, REPEAT_WINDOW)
    text = _text_of(np.arange(len(found)), first)
    whole = np.arange(len(found)) + REPEAT_WINDOW <= first[text + 1]
    at = np.flatnonzero(whole)
    keys = K.mix(found[at] + text[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    twice = np.zeros(len(keys), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(hashes) + 1, np.int64)
    cover[at[order[twice]]] += 1
    cover[at[order[twice]] + REPEAT_WINDOW] -= 1
    sums = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(np.cumsum(cover[:-1]) > 0, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def with_base(rules: DataFrame) -> DataFrame:
    """Adds ``base_failed``: too few words, or too many of them inside repeated windows."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rules.withColumn("base_failed", failed)


def cut(rules: DataFrame, labels: DataFrame) -> float:
    """The score below which documents are rejected: least weighted error on the labelled documents that
    pass the base rules; without any of either kind nothing is rejected."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    place = F.least(F.greatest(F.round(F.col("score") / BIN_WIDTH) + (BINS - 1) // 2, F.lit(0)), F.lit(BINS - 1))
    rows = (rules.where("not base_failed").join(known, "doc_id").groupBy(place.cast("int").alias("bin"))
            .agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.count("*").alias("n")).collect())
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for b, g, n in rows:
        good[b], bad[b] = g, n - g
    if not good.sum() or not bad.sum():
        return float("-inf")
    # error if all bins below k are rejected
    lost = np.concatenate([[0], np.cumsum(good)]) * TRUSTED_COST
    error = lost + bad.sum() - np.concatenate([[0], np.cumsum(bad)])
    best = np.flatnonzero(error == error.min())
    k = best[len(best) // 2]  # the middle of a gap between both kinds
    return float("-inf") if k == 0 else (k - (BINS - 1) // 2 - 0.5) * BIN_WIDTH


def quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its base figures, score and verdict (``base_failed``, ``kept``).

    ``labels`` has ``doc_id, quality``; rows of quality 1 are the trusted target.
    """
    ratios = log_ratios(gram_counts(documents, labels.where("quality = 1")))
    rules = with_base(score_documents(documents, ratios))
    least = cut(rules, labels)
    return rules.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))
