"""NumPy helpers shared by the operators: whole texts of an Arrow batch as bytes, words and hashes.

Texts are read as UTF-8 bytes straight from the Arrow buffers and handled in slices of bounded size, so
a batch of long texts needs a few times its own size of memory and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Documents are handled together up to this many bytes; a longer document is a slice of its own.
SLICE_BYTES = 1 << 18

_RNG = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it can be divided by modulo 2**64
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[LOWER]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column and the offsets of each (a null text is empty)."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4))
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[starts[0]:starts[-1]], (starts - starts[0]).astype(np.int64)


def slices(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes as (index of the first, bytes, offsets)."""
    size = size or SLICE_BYTES
    every, starts = texts(column)
    first, n = 0, len(column)
    while first < n:
        last = int(np.searchsorted(starts, starts[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, every[starts[first]:starts[last]], starts[first:last + 1] - starts[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse to the powers 0..n-1, modulo 2**64."""
    up, down = np.full(max(n, 1), _BASE), np.full(max(n, 1), _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Powers:
    """The same, grown as needed and kept for one task."""

    def __init__(self) -> None:
        self.up, self.down = powers(1 << 16)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = powers(2 * n)
        return self.up[:n], self.down[:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: Powers) -> np.ndarray:
    """Hash of ``values[start:end]`` for each range; equal contents hash alike wherever they stand."""
    up, down = kept.upto(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    if not len(values):
        return mix(lengths)
    return mix((sums[ends] - sums[starts]) * down[np.minimum(starts, len(values) - 1)] + lengths)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``; a word never crosses texts."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(SPACE[data], out=inside[:-1])
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[offsets] = False
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside[1:]
    inner = offsets[offsets > 0] - 1
    after[inner] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def hashed_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: Powers, lower: bool = True) -> np.ndarray:
    """Hash of each of the ordered, separate ranges of bytes, ``A-Z`` lower-cased if wanted."""
    table = _BYTE_LOWER if lower else _BYTE
    hashes = np.empty(len(starts), np.uint64)
    # in pieces that end with a range, so that one long text stays small
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + 2 * SLICE_BYTES, "right")))
        low = starts[at]
        hashes[at:to] = range_hashes(table[data[low:ends[to - 1]]], starts[at:to] - low, ends[at:to] - low, kept)
        at = to
    return hashes


def words(data: np.ndarray, offsets: np.ndarray, kept: Powers, lower: bool = True):
    """Starts, ends and hashes of all words, and the index of the first word of each text (with the end)."""
    starts, ends = word_bounds(data, offsets)
    return starts, ends, hashed_ranges(data, starts, ends, kept, lower), np.searchsorted(starts, offsets)


_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` neighbours (order counts)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += values[k:k + n] * _PLACE[k]
    return mix(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, kept: Powers) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: windows of ``size`` lower-cased words, or all its
    words as one shingle if it has fewer, or nothing without words."""
    _, _, hashes, first = words(data, offsets, kept)
    every = windows(hashes, size)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            yield np.unique(every[a:b - size + 1])
        elif b > a:
            total = np.uint64(b - a) + (hashes[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64)
            yield mix(np.array([total], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def signed(hashes: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return hashes.view(np.int64)


def bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits of each hash."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)
