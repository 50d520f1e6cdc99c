"""Best-fit packing of tokenized documents into sequences of a fixed length.

A document is its token ids and one separator id.  Only documents longer than a sequence are cut, into
pieces of the full length; every other document stays in one piece.  Pieces are packed by bounded-space
online best-fit: a fixed number of bins is open, a bitset with one bit per amount of free space finds the
fullest bin that still takes the next piece in a few machine words, a full bin closes at once, and when one
bin too many is open the fullest closes.

Shape on a cluster: tokenizing is a scan; the pieces are dealt by a hash to streams of about
``STREAM_PIECES``, each packed by one task with ``OPEN_BINS`` bins of state.  A stream arrives in random runs
of about ``RUN_PIECES``, each from long to short: long pieces open bins and short ones fill them, and bins
stay open from run to run.  Bins that are not full at the end of their stream are packed once more as whole
items by the same rule, so the number of streams hardly costs sequences.  No step gathers documents.

Edge cases: a null or empty text is one piece that holds just the separator; rows with null or repeated ids
are packed as rows of their own; empty tables give an empty result.  Further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from spanalign.llm import kernels as K
from spanalign.session import written

LENGTH, SEPARATOR = 2048, 0
OPEN_BINS = 4096
#: Pieces of a stream and of a run sorted by length within it, about.
STREAM_PIECES, RUN_PIECES = 1 << 15, 1 << 13
#: Ids of distinct words kept by a task before it starts anew (memory only, results are the same).
CACHED_IDS = 1 << 22
ENCODED_AT_ONCE = 1024


class WordIds:
    """Ids of white-space separated words, each distinct word encoded once.

    For tokenizers that drop white space and case, never join across white space, and end a run of letters at
    a full stop or comma: a text's ids are then its words' ids.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.powers = Tokenizer.from_file(path), K.Powers()
        self.clear()

    def clear(self) -> None:
        # hashes of known words in order, and the place of each one's ids
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.bounds, self.used, self.filled = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0, 0

    def add(self, keys: np.ndarray, new: list[str]) -> None:
        """Encode new words, given with their hashes in order."""
        parts, sizes = [], []
        for low in range(0, len(new), ENCODED_AT_ONCE):
            # one text of many words takes less time than many texts; a token belongs to the word it begins in
            own = new[low:low + ENCODED_AT_ONCE]
            coded = self.tokenizer.encode(" ".join(own), add_special_tokens=False)
            begins = np.cumsum([0, *(len(word) + 1 for word in own[:-1])])
            at = np.fromiter((a for a, _ in coded.offsets), np.int64, len(coded.ids))
            sizes.append(np.bincount(np.searchsorted(begins, at, "right") - 1, minlength=len(own)))
            parts.append(np.array(coded.ids, np.uint32))
        flat, sizes, n = np.concatenate(parts), np.concatenate(sizes), len(new)
        self.ids = _room(self.ids, self.filled + len(flat))
        self.bounds = _room(self.bounds, self.used + n + 1)
        self.ids[self.filled:self.filled + len(flat)] = flat
        self.bounds[self.used + 1:self.used + 1 + n] = self.filled + np.cumsum(sizes)
        at = np.searchsorted(self.known, keys)
        self.known = np.insert(self.known, at, keys)
        self.place = np.insert(self.place, at, np.arange(self.used, self.used + n))
        self.used, self.filled = self.used + n, self.filled + len(flat)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets of each text's ids."""
        if self.filled > CACHED_IDS:
            self.clear()
        starts, ends, hashes = _units(data, offsets, self.powers)
        first = np.searchsorted(starts, offsets)
        keys, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, keys)
        missing = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != keys) if len(self.known) else np.arange(len(keys))
        if len(missing):
            raw = data.tobytes()
            self.add(keys[missing], [raw[starts[w]:ends[w]].decode("utf-8", "replace") for w in where[missing].tolist()])
        at = self.place[np.searchsorted(self.known, keys)][inverse]
        low, sizes = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        sums = np.zeros(len(at) + 1, np.int64)
        np.cumsum(sizes, out=sums[1:])
        return self.ids[np.repeat(low - sums[:-1], sizes) + np.arange(sums[-1])], sums[first]


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _units(data: np.ndarray, offsets: np.ndarray, powers: K.Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of words; a full stop or comma after a letter is a word of its own, and case
    counts only in words with a ``<``, which may be special tokens."""
    starts, ends = K.word_bounds(data, offsets)
    apart = (ends - starts > 1) & ((data[ends - 1] == 46) | (data[ends - 1] == 44)) & _LETTER[data[np.maximum(ends - 2, 0)]]
    cuts = ends[apart] - 1
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    hashes = K.hashed_ranges(data, starts, ends, powers)
    marks = data == 60
    if marks.any():
        sums = np.concatenate([[0], np.cumsum(marks)])
        own = sums[ends] > sums[starts]
        hashes[own] = K.hashed_ranges(data, starts[own], ends[own], powers, lower=False)
    return starts, ends, hashes


def _room(values: np.ndarray, n: int) -> np.ndarray:
    return values if n <= len(values) else np.concatenate([values, np.zeros(max(n, 2 * len(values)) - len(values), values.dtype)])


def pieces(documents: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: ``doc_id, piece, start, length, ids_crc32`` and, if wanted, ``ids``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(tokenizer)
        for batch in batches:
            for first, data, offsets in K.slices(batch.column(1), 1 << 20):
                ids, bounds = encoder.encode(data, offsets)
                at, piece, start, size, crc, lists = [], [], [], [], [], []
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    own = np.append(ids[a:b], np.uint32(SEPARATOR)).astype("<u4")
                    for n, low in enumerate(range(0, len(own), length)):
                        part = own[low:low + length]
                        at.append(first + k)
                        piece.append(n)
                        start.append(low)
                        size.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            lists.append(part.astype(np.int32))
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()),
                           *(pa.array(x, pa.int64()) for x in (start, size, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


class OpenBins:
    """Open bins keyed by free space: one bit of ``free`` says that some bin has exactly that much."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.free, self.bins, self.count, self.made = 0, {}, 0, 0
        self.closed: list[int] = []

    def _take(self, space: int) -> int:
        own = self.bins[space]
        found = own.pop()
        if not own:
            self.free ^= 1 << space
        self.count -= 1
        return found

    def put(self, size: int) -> tuple[int, int]:
        """Bin for an item and its offset there."""
        fitting = self.free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            found = self._take(space)
        else:
            space, found = self.capacity, self.made
            self.made += 1
        rest = space - size
        if rest:
            if self.free >> rest & 1:
                self.bins[rest].append(found)
            else:
                self.bins[rest] = [found]
                self.free |= 1 << rest
            self.count += 1
            if self.count > self.most:
                self._take((self.free & -self.free).bit_length() - 1)
        return found, self.capacity - space


def _stream(keys: list[str], streams: int) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit("stream")), F.lit(streams)).cast("long")


def _packed(items: DataFrame, size: str, keys: list[str], streams: int, capacity: int, open_bins: int) -> DataFrame:
    """Every item with its ``stream``, ``bin`` and offset ``at`` there."""
    runs = max(1, STREAM_PIECES // RUN_PIECES)
    dealt = (items.withColumn("stream", _stream(keys, streams)).repartition(streams, "stream")
             .sortWithinPartitions("stream", F.pmod(F.xxhash64(*keys, F.lit("run")), F.lit(runs)), F.desc(size), *keys))
    place = dealt.columns.index(size)
    of_stream = dealt.columns.index("stream")
    schema = T.StructType([*dealt.schema.fields, *(T.StructField(n, T.LongType()) for n in ("bin", "at"))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bins = None, None
        for batch in batches:
            found, at = [], []
            for stream, n in zip(batch.column(of_stream).to_pylist(), batch.column(place).to_pylist()):
                if stream != current:
                    current, bins = stream, OpenBins(capacity, open_bins)
                b, offset = bins.put(n)
                found.append(b)
                at.append(offset)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64()), pa.array(at, pa.int64())], [*batch.schema.names, "bin", "at"])

    return dealt.mapInArrow(pack, schema)


def pack(parts: DataFrame, capacity: int = LENGTH, open_bins: int = OPEN_BINS, stream_pieces: int = STREAM_PIECES) -> DataFrame:
    """``parts`` (``length`` and more) with ``sequence_id`` and ``offset``.

    Offsets of a sequence run from 0 without gaps.  Sequence ids are unique numbers without an order.
    """
    kept = parts.columns
    # rows are dealt by a number of their own, whatever they hold; it is fixed once it is written
    parts = written(parts.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    n = parts.count()
    streams = max(1, -(-n // stream_pieces))
    first = written(_packed(parts, "length", ["__row"], streams, capacity, open_bins), "packed")
    # bins of the first round are the items of the next ones
    items = first.groupBy("stream", "bin").agg(F.sum("length").alias("fill")).select(
        F.col("stream").alias("s0"), F.col("bin").alias("b0"), "fill", F.lit(0).cast("long").alias("base"),
        F.col("stream").alias("s"), F.col("bin").alias("b"))
    full = items.where(F.col("fill") == capacity).select("s0", "b0", "base", F.lit(0).alias("round"), "s", "b")
    items = written(items.where(F.col("fill") < capacity).select("s0", "b0", "fill"), "bins")
    left = max(1, -(-items.count() // stream_pieces))
    merged = _packed(items, "fill", ["s0", "b0"], left, capacity, open_bins).select(
        "s0", "b0", F.col("at").alias("base"), F.lit(1).alias("round"), F.col("stream").alias("s"), F.col("bin").alias("b"))
    where = full.unionByName(merged).withColumn(
        "sequence_id", F.shiftleft(F.col("round").cast("long"), 62) + F.shiftleft("s", 31) + F.col("b")).select(
        F.col("s0").alias("stream"), F.col("b0").alias("bin"), "base", "sequence_id")
    return first.join(where, ["stream", "bin"]).select(*kept, "sequence_id", (F.col("at") + F.col("base")).alias("offset"))
