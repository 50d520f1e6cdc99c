"""LM scoring: stupid-backoff scores from n-gram count tables of the whole corpus.

Words are lower-cased (``A-Z``).  The tables hold every n-gram of 1 to ``ORDER`` words (a caller may leave out
longer ones that occur fewer than ``least_count`` times).  A word scores ``count(n-gram) / count(context)`` for the longest
n-gram in the tables that ends with it, times ``BACKOFF`` per shortening; a single word scores its share of
all words.  A document's score is the sum of the logarithms.

The tables of longer n-grams are counted after those of shorter ones: with a least count an n-gram can only
occur often enough if both shorter n-grams in it do, and only such ones are sent.

Shape on a cluster: this is an aggregate and a join on the hash of n-grams, with the rows of a block of
documents packed.  Documents are dealt by a hash to blocks of about ``BLOCK_CHARS`` characters.  A block
sends its distinct n-grams with their counts to the partitions of the count tables, one row per order and
partition with the sorted hashes in a binary column; a partition adds them up and answers with the global
counts in the same order (mostly zeros, which compress to little); block and answers meet in a cogroup and
scores are summed per document.  The number of blocks and of partitions follows the input, so each task
holds about as much at every size.  Texts are shuffled once, compressed, n-grams once; a frequent n-gram comes once per
block.  Packing is what keeps the shuffle at the size of the hashes, where a row per n-gram would take four
times as much.

Edge cases: null and empty texts have no words, the score 0 and a null mean; texts shorter than the order use
the n-grams they have; repeated rows count and score as often as they stand there; null ids are scored; empty
tables give an empty result.  Further columns are ignored.  N-grams are compared by hashes of
``SPARE_BITS`` more bits than it takes to number all words of the corpus (64 bits at most), so a chance
equality is rarer than one in ``2 ** SPARE_BITS`` n-grams at every size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanalign.llm import kernels as K

ORDER, BACKOFF, LEAST_COUNT = 3, 0.4, 1
BLOCK_CHARS, PART_CHARS = 12 << 20, 16 << 20
SPARE_BITS, COUNT_BYTES = 28, 6
#: Texts travel compressed, as many bytes of them at a time as this.
HELD_BYTES = 32 << 20


def _packed(values: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bytes of numbers, bytes of equal weight together: compresses sorted hashes and
    small counts."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def _packed_steps(values: np.ndarray, width: int) -> bytes:
    """Ascending numbers as their steps: most steps need few bytes, and those of equal weight compress well."""
    raw = _packed(np.diff(values, prepend=np.uint64(0)), width)
    return len(raw).to_bytes(8, "little") + _codec().compress(raw, asbytes=True)


def _unpacked_steps(raw: bytes, width: int) -> np.ndarray:
    return np.cumsum(_unpacked(_codec().decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True), width), dtype=np.uint64)


def _packs(blocks_of_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``doc_id, text, block`` as one row per block of what a task holds at a time: ids, sizes, packed texts."""
    held, size, codec = [], 0, _codec()

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("block")
        block, ids = table.column("block").to_numpy(), table.column("doc_id").combine_chunks()
        data, offsets = K.texts(table.column("text").combine_chunks().cast(pa.large_string()))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]).tolist()
        rows = [{"block": int(block[a]), "doc_ids": ids[a:b].to_pylist(), "sizes": np.diff(offsets[a:b + 1]),
                 "packed": codec.compress(data[offsets[a]:offsets[b]].tobytes(), asbytes=True)} for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_pylist(rows, pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                                                           ("sizes", pa.list_(pa.int64())), ("packed", pa.binary())]))

    for batch in blocks_of_rows:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > HELD_BYTES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _ids(table: pa.Table) -> pa.Array:
    """Ids of a block's documents, in the order of ``_grams``."""
    return pa.chunked_array([c.flatten() for c in table.column("doc_ids").chunks], pa.int64())


def _grams(table: pa.Table, order: int, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes (``width`` bytes) of the n-grams of 1 to ``order`` words that start at each word of the block
    (windows that cross texts included), and the bounds of texts in words."""
    kept, codec, hashes, bounds, n = K.Powers(), _codec(), [], [np.zeros(1, np.int64)], 0
    for sizes, packed in zip(table.column("sizes"), table.column("packed")):
        offsets = np.concatenate([[0], np.cumsum(sizes.values.to_numpy())])
        data = codec.decompress(packed.as_py(), int(offsets[-1]), asbytes=True)
        texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        for _, data, offsets in K.slices(texts):
            own = K.words(data, offsets, kept)
            hashes.append(own[2])
            bounds.append(own[3][1:] + n)
            n += len(own[2])
    words = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    return [K.windows(words, k) >> np.uint64(64 - 8 * width) for k in range(1, order + 1)], np.concatenate(bounds)


def _inside(bounds: np.ndarray, n: int, k: int) -> np.ndarray:
    """Whether the k words from each word on are in one text."""
    text = np.searchsorted(bounds, np.arange(n), "right") - 1
    return np.arange(n) + k <= bounds[text + 1] if n else np.zeros(0, bool)


def corpus_size(documents: DataFrame) -> tuple[int, int]:
    """Words and characters of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = size = 0
        for batch in batches:
            for _, data, offsets in K.slices(batch.column(0)):
                words += len(K.word_bounds(data, offsets)[0])
                size += len(data)
        yield pa.record_batch({"words": [words], "size": [size]})

    row = documents.select("text").mapInArrow(count, "words long, size long").agg(F.sum("words").alias("words"), F.sum("size").alias("size")).first()
    return row.words or 0, row.size or 0


def _sizes(grams: list[np.ndarray], bounds: np.ndarray, answers: pa.Table | None, upto: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size of n-gram: the distinct hashes in question with their counts in the block, and the count in
    the tables of the n-gram that ends with each word (0 where it is not answered yet)."""
    if answers is not None:
        answers = answers.sort_by([("size", "ascending"), ("part", "ascending")])
        sizes, packs = answers.column("size").to_numpy(), answers.column("known")
    before = np.zeros(0)
    for k in range(1, upto + 1):
        own = grams[k - 1]
        at = np.flatnonzero(_inside(bounds, len(own), k))
        if k > 2:  # both shorter n-grams must be in the tables
            at = at[(before[at + k - 2] > 0) & (before[at + k - 1] > 0)]
        values, inverse, counts = np.unique(own[at], return_inverse=True, return_counts=True)
        before = np.zeros(len(grams[0]))
        if answers is not None and (sizes == k).any():
            known = np.concatenate([_unpacked(packs[int(i)].as_py(), COUNT_BYTES) for i in np.flatnonzero(sizes == k)])
            before[at + k - 1] = known.astype(float)[inverse]
        yield k, values, counts, before


def lm_scores(documents: DataFrame, order: int = ORDER, backoff: float = BACKOFF, least_count: int = LEAST_COUNT,
              block_chars: int = BLOCK_CHARS, part_chars: int = PART_CHARS) -> DataFrame:
    """``doc_id, n_words, score`` (sum of natural logarithms) and ``mean_score`` of every document."""
    total, size = corpus_size(documents)
    blocks, parts = max(1, -(-size // block_chars)), max(1, -(-size // part_chars))
    width = min(8, -(-(total.bit_length() + SPARE_BITS) // 8))
    edges = np.array([-(-(k << 8 * width) // parts) for k in range(1, parts)], np.uint64)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                            F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long").alias("block"))
    by_block = rows.mapInArrow(_packs, "block long, doc_ids array<long>, sizes array<long>, packed binary").groupBy("block")

    def sent(block: int, sized: list[tuple]) -> pa.Table:
        """A row per size and partition of the tables."""
        out: list[list] = [[], [], [], [], []]
        for k, values, counts, _ in sized:
            cuts = np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])
            for part in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[part], cuts[part + 1]
                for x, value in zip(out, (part, k, block, _packed_steps(values[a:b], width), _packed(counts[a:b], COUNT_BYTES))):
                    x.append(value)
        kinds = {"part": pa.int64(), "size": pa.int32(), "block": pa.int64(), "grams": pa.binary(), "counts": pa.binary()}
        return pa.table({name: pa.array(x, kind) for (name, kind), x in zip(kinds.items(), out)})

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        grams, bounds = _grams(table, min(order, 2), width)
        return sent(key[0].as_py(), list(_sizes(grams, bounds, None, len(grams))))

    def asking(longest: int):
        def ask_longer(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
            grams, bounds = _grams(table, longest, width)
            return sent(key[0].as_py(), list(_sizes(grams, bounds, answers, longest))[-1:])
        return ask_longer

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        grams = [_unpacked_steps(x.as_py(), width) for x in table.column("grams")]
        counts = np.concatenate([_unpacked(x.as_py(), COUNT_BYTES) for x in table.column("counts")])
        values, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        summed = np.bincount(inverse, counts, len(values))
        if key[1].as_py() > 1:
            summed[summed < least_count] = 0
        known = summed.astype(np.uint64)[inverse]
        cuts = np.cumsum([0, *map(len, grams)])
        return pa.table({"block": table.column("block"), "size": table.column("size"), "part": table.column("part"),
                         "known": pa.array([_packed(known[a:b], COUNT_BYTES) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})

    def score(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        grams, bounds = _grams(table, order, width)
        n = len(grams[0])
        # counts[k - 1][i]: of the k words that end with word i
        counts = [x[3] for x in _sizes(grams, bounds, answers, order)]
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        longest = np.minimum(np.arange(n) - bounds[text] + 1, order)
        logs, open_ = np.zeros(n), np.ones(n, bool)
        for k in range(order, 0, -1):
            hit = np.flatnonzero(open_ & (longest >= k) & (counts[k - 1] > 0))
            context = counts[k - 2][hit - 1] if k > 1 else np.ones(len(hit))
            logs[hit] = np.log(counts[k - 1][hit]) - np.log(context) + (longest[hit] - k) * math.log(backoff)
            open_[hit] = False
            alone = hit  # at last: words that score by their share of all words
        return pa.table({"doc_id": _ids(table), "n_words": np.diff(bounds), "logs": np.bincount(text, logs, len(bounds) - 1).astype(float),
                         "alone": np.bincount(text[alone], minlength=len(bounds) - 1)})

    packed, told = "part long, size int, block long, grams binary, counts binary", "block long, size int, part long, known binary"
    answers = by_block.applyInArrow(ask, packed).groupBy("part", "size").applyInArrow(answer, told)
    for longest in range(3, order + 1):
        longer = by_block.cogroup(answers.groupBy("block")).applyInArrow(asking(longest), packed)
        answers = answers.union(longer.groupBy("part", "size").applyInArrow(answer, told))
    found = by_block.cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, n_words long, logs double, alone long")
    total_log = math.log(total) if total else 0.0
    scores = found.select("doc_id", "n_words", (F.col("logs") - F.col("alone") * F.lit(total_log)).alias("score"))
    return scores.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))
