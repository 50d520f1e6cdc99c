"""Substring dedup: sliding spans of sentences.

A sentence ends after a word that ends in ``. ! ?``, at a line break, or with the text.  Sentences of more than
``LONG`` words are cut after every word whose hash is divisible by ``CUT``, so long or unpunctuated text has
units too, and a passage has the same ones wherever it stands, but for its first and last.  From every unit the
shortest run of at least ``SENTENCES`` units and ``WORDS`` words is hashed (lower-cased words, any white space).
Of equal runs the first by ``(doc_id, place)`` stays; every unit covered by another one is removed with the white
space behind it.  Runs are judged on the input, not on what is left.

Shape on a cluster: a scan hashes the runs; of equal runs in one block of a task only the first goes to the
global comparison, the others are known to be later ones, so a run that a third of all documents share comes
once per block.  One shuffle by hash finds later runs in a sorted stream (no group is held), a second one
brings the places to the texts.

Edge cases: null and empty texts have no sentences and stay as they are; a null ``doc_id`` takes no part and
stays; texts shorter than a run are never touched; repeated rows (same id and text) count as one
document, so one does not remove the other; empty tables give an empty result.  Further columns pass through
unchanged, whatever their names; names that begin with two underscores are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from spanalign.llm import kernels as K

SENTENCES, WORDS = 2, 12
LONG, CUT = 12, 6
#: Runs compared within a task before the rest is sent on.
BLOCK = 1 << 20
_VERSION_BITS = 24
_END = np.zeros(256, bool)
_END[[0x21, 0x2E, 0x3F]] = True


def units(data: np.ndarray, offsets: np.ndarray, kept: K.Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and hashes of words, the index of each unit's first word (with the end), and of each text's
    first unit (with the end)."""
    starts, ends, hashes, first = K.words(data, offsets, kept)
    if not len(starts):
        return starts, hashes, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=breaks[1:])
    last = _END[data[ends - 1]]
    last[:-1] |= breaks[starts[1:]] > breaks[ends[:-1]]
    last[first[1:][first[1:] > 0] - 1] = True
    sentences = np.diff(np.concatenate([[0], np.flatnonzero(last) + 1]))
    last |= np.repeat(sentences > LONG, sentences) & (K.mix(hashes) % np.uint64(CUT) == 0)
    bounds = np.concatenate([[0], np.flatnonzero(last) + 1])
    return starts, hashes, bounds, np.searchsorted(bounds, first)


def run_ends(bounds: np.ndarray, sentences: int = SENTENCES, words: int = WORDS) -> np.ndarray:
    """The unit behind the run that begins with each unit; it may lie beyond the text."""
    return np.maximum(np.searchsorted(bounds, bounds[:-1] + words), np.arange(len(bounds) - 1) + sentences)


def _runs(data, offsets, kept, sentences, words):
    """For each run: text, place of its first unit there, and hash."""
    _, hashes, bounds, first = units(data, offsets, kept)
    ends = run_ends(bounds, sentences, words)
    at = np.arange(len(ends))
    text = np.searchsorted(first, at, "right") - 1
    whole = ends <= first[text + 1]
    at, text, ends = at[whole], text[whole], ends[whole]
    return text, at - first[text], K.range_hashes(hashes, bounds[at], bounds[ends], kept)


def later_runs(documents: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``doc_id, version, place`` of every run that is not the first of its kind.

    ``version`` tells apart rows that share an id.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    rows = rows.select("doc_id", "text", version().alias("version"))
    schema = "hash long, doc_id long, place long, later boolean"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, size = K.Powers(), [], 0

        def block() -> pa.RecordBatch:
            hashes, ids, places = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((places, ids, hashes))
            hashes, ids, places = hashes[order], ids[order], places[order]
            later = np.zeros(len(order), bool)
            later[1:] = hashes[1:] == hashes[:-1]
            same = np.zeros(len(order), bool)
            same[1:] = later[1:] & (ids[1:] == ids[:-1]) & (places[1:] == places[:-1])
            # known places are spread by a hash of their own
            spread = np.where(later, K.mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + places.astype(np.uint64)), hashes)
            return pa.record_batch({"hash": K.signed(spread[~same]), "doc_id": ids[~same], "place": places[~same], "later": later[~same]})

        for batch in batches:
            ids, versions = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for first, data, offsets in K.slices(batch.column(1)):
                text, place, hashes = _runs(data, offsets, kept, sentences, words)
                held.append((hashes, ids[first + text], place << _VERSION_BITS | versions[first + text]))
                size += len(hashes)
            if size > BLOCK:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None  # hash, id and place of the first run of the last kind
        for batch in batches:
            hashes, ids, places = (batch.column(k).to_numpy() for k in range(3))
            later = batch.column(3).to_numpy(zero_copy_only=False)
            runs = np.flatnonzero(~later)
            if len(runs):
                h = hashes[runs]
                begins = np.ones(len(h), bool)
                begins[1:] = h[1:] != h[:-1]
                going_on = first is not None and h[0] == first[0]
                begins[0] = not going_on
                at = np.cumsum(begins) - 1  # -1: the kind that goes on
                firsts = runs[begins]
                first_id, first_place = ids[firsts][at] if len(firsts) else np.zeros(len(h), np.int64), places[firsts][at] if len(firsts) else np.zeros(len(h), np.int64)
                if going_on:
                    first_id, first_place = np.where(at < 0, first[1], first_id), np.where(at < 0, first[2], first_place)
                later = later.copy()
                later[runs] = (ids[runs] != first_id) | (places[runs] != first_place)
                first = (h[-1], first_id[-1], first_place[-1])
            found = places[later]
            yield pa.record_batch({"doc_id": ids[later], "version": found & ((1 << _VERSION_BITS) - 1), "place": (found >> _VERSION_BITS).astype(np.int32)})

    runs = rows.mapInArrow(scan, schema).repartition("hash").sortWithinPartitions("hash", "doc_id", "place")
    return runs.mapInArrow(compare, "doc_id long, version long, place int")


def version():
    """Tells apart rows with one id and different texts."""
    return F.xxhash64("text").bitwiseAND(F.lit((1 << _VERSION_BITS) - 1))


def without_repeats(documents: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``documents`` with the texts that are left, ``__units`` (their number before) and ``__removed`` (places of the
    removed ones)."""
    spans = (later_runs(documents, sentences, words).groupBy(F.col("doc_id").alias("__id"), F.col("version").alias("__version"))
             .agg(F.collect_list("place").alias("__removed")))
    joined = documents.withColumn("__units", F.lit(0)).join(
        spans.hint("merge"), (documents["doc_id"].cast("long") == spans["__id"]) & (version() == spans["__version"]), "left").drop("__id", "__version")
    place, columns = documents.columns.index("text"), joined.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = K.Powers()
        for batch in batches:
            kept, counts, lists = [], [], []
            runs = batch.column(len(columns) - 1)
            run_bounds, run_places, touched = runs.offsets.to_numpy(), runs.values.to_numpy(), runs.is_valid().to_numpy(zero_copy_only=False)
            valid = batch.column(place).is_valid().to_numpy(zero_copy_only=False)
            for first, data, offsets in K.slices(batch.column(place)):
                starts, _, bounds, unit = units(data, offsets, powers)
                ends = run_ends(bounds, sentences, words)
                for k in range(len(offsets) - 1):
                    row, a, b = first + k, unit[k], unit[k + 1]
                    own, gone = data[offsets[k]:offsets[k + 1]], np.zeros(0, np.int64)
                    if touched[row]:
                        covered = np.zeros(b - a + 1, np.int64)
                        places = run_places[run_bounds[row]:run_bounds[row + 1]]
                        np.add.at(covered, places, 1)
                        np.add.at(covered, ends[a + places] - a, -1)
                        gone = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
                        begins = np.append(starts[bounds[a:b]], offsets[k + 1]) - offsets[k]
                        stays = np.ones(b - a, bool)
                        stays[gone] = False
                        size = np.diff(begins)
                        mask = np.concatenate([np.ones(begins[0], bool), np.repeat(stays, size)])
                        own = own[mask]
                    kept.append(own.tobytes().decode() if valid[row] else None)
                    counts.append(int(b - a))
                    lists.append(gone.astype(np.int32))
            arrays = list(batch.columns)
            arrays[place] = pa.array(kept, pa.string())
            arrays[columns.index("__units")], arrays[-1] = pa.array(counts, pa.int32()), pa.array(lists, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(arrays, columns)

    fields = [T.StructField(f.name, f.dataType) for f in joined.schema.fields]
    return joined.mapInArrow(rewrite, T.StructType(fields))


def substring_dedup(documents: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``documents`` with the texts that are left, ``n_sentences`` and ``removed`` (places of the removed ones).

    Columns of these two names in the input are replaced; ``without_repeats`` keeps all.
    """
    found = without_repeats(documents.drop("n_sentences", "removed"), sentences, words)
    return found.withColumnsRenamed({"__units": "n_sentences", "__removed": "removed"})
