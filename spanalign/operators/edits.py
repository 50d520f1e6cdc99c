"""Tokens at most two edits apart, for many small groups of tokens at once.

All tokens of a group's one side meet all of the other in a matrix of marks: an edit changes few bits of a mark, so most
pairs go at once.  The edit distance of the others is filled for all pairs together, five diagonals at a time: first for
their beginnings, then for those that may still be close.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from spanalign.functions.similarity import EDIT_LIMIT, LONG_TOKEN
from spanalign.operators.cleanup import within_edits

#: Pairs of one matrix, and letters of a token in the two tables.
PAIRS, NARROW, WIDE = 1 << 20, 24, 256
_CODES = np.zeros(256, dtype=np.int64)
_CODES[ord("0"):ord("9") + 1] = np.arange(10)
_CODES[ord("a"):ord("z") + 1] = np.arange(10, 36)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def _marks(letters: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64 bits a token for its letters (each letter twice, each digit once), of which an edit changes two at most, and
    64 bits for its pairs of neighbours, of which it changes four at most."""
    codes = _CODES[letters]
    counts = np.bincount(owner * 36 + codes, minlength=36 * n).reshape(n, 36)
    single, pairs = np.zeros((n, 64), dtype=bool), np.zeros((n, 64), dtype=bool)
    single[:, :36], single[:, 36:62] = counts > 0, counts[:, 10:] > 1
    both = owner[1:] == owner[:-1]
    pairs[owner[1:][both], (codes[:-1] * 29 + codes[1:] * 11)[both] & 63] = True
    return _packed(single), _packed(pairs)


_FAR = EDIT_LIMIT + 1
_DIAGONALS = range(-EDIT_LIMIT, _FAR)


def _first_row(n: int) -> dict[int, np.ndarray]:
    return {d: np.full(n, d if d >= 0 else _FAR, dtype=np.uint8) for d in _DIAGONALS}


def _next_row(last: dict[int, np.ndarray], i: int, x: np.ndarray, y: np.ndarray) -> dict[int, np.ndarray]:
    """Row ``i`` of the tables of all pairs by diagonals, up to ``_FAR``; ``x`` and ``y`` hold a row for each letter."""
    row: dict[int, np.ndarray] = {}
    for d in _DIAGONALS:
        j = i + d
        if j <= 0:
            row[d] = np.full(x.shape[1], min(i, _FAR) if j == 0 else _FAR, dtype=np.uint8)
            continue
        best = last[d] + (x[i - 1] != y[j - 1]) if j <= len(y) else last[d] + np.uint8(1)
        if d < EDIT_LIMIT:
            best = np.minimum(best, last[d + 1] + np.uint8(1))
        if d > -EDIT_LIMIT:
            best = np.minimum(best, row[d - 1] + np.uint8(1))
        row[d] = np.minimum(best, np.uint8(_FAR))
    return row


def _close(grid: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows of ``grid``, of more than ``LONG_TOKEN`` letters, are at most ``EDIT_LIMIT`` edits apart."""
    begun, row = np.ascontiguousarray(grid[:, :LONG_TOKEN + _FAR]), _first_row(len(a))
    x, y = begun[a].T.copy(), begun[b].T.copy()
    for i in range(1, LONG_TOKEN + 2):
        row = _next_row(row, i, x, y)
    at = np.flatnonzero(np.minimum.reduce(list(row.values())) < _FAR)
    found, a, b = np.zeros(len(a), dtype=bool), a[at], b[at]
    x, y, ends, diagonal, row = grid[a].T.copy(), grid[b].T.copy(), size[a], size[b] - size[a], _first_row(len(at))
    for i in range(1, grid.shape[1] + 1):
        row = _next_row(row, i, x, y)
        ended = np.flatnonzero(ends == i)
        for d in _DIAGONALS if len(ended) else ():
            own = ended[diagonal[ended] == d]
            found[at[own[row[d][own] < _FAR]]] = True
        if i % 3 == 0:
            alive = np.flatnonzero((ends > i) & (np.minimum.reduce(list(row.values())) < _FAR))
            if not len(alive):
                break
            if 4 * len(alive) < 3 * len(at):
                at, x, y, ends, diagonal = at[alive], x[:, alive], y[:, alive], ends[alive], diagonal[alive]
                row = {d: r[alive] for d, r in row.items()}
    return found


def close_pairs(groups: Sequence[tuple[Sequence[str], Sequence[str]]]) -> Iterator[list[tuple[str, str]]]:
    """For each group (left, right) of distinct tokens of more than five letters the pairs that differ and are at most two edits apart."""
    groups = [(sorted(left, key=len), sorted(right, key=len)) for left, right in groups]
    tokens = [t for left, right in groups for side in (left, right) for t in side]
    size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    longest = int(size.max(initial=0))
    short = size.astype(np.int8 if longest < 128 else np.int32)
    letters = np.frombuffer("".join(tokens).encode("ascii"), dtype=np.uint8)
    owner = np.repeat(np.arange(len(tokens)), size)
    marks, second = _marks(letters, owner, len(tokens))
    place = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
    tables = []
    for low, high in ((0, NARROW), (NARROW - EDIT_LIMIT, min(longest, WIDE))):
        own = (size > low) & (size <= high)
        line, kept = np.cumsum(own) - 1, own[owner]
        grid = np.zeros((int(own.sum()), high), dtype=np.uint8)
        grid[line[owner[kept]], place[kept]] = letters[kept]
        tables.append((grid, short[own], line))
        if high >= longest:
            break

    met, begin = [[np.zeros(0, dtype=np.int64)] * 2], 0
    found: list[np.ndarray] = []

    def settle() -> None:
        a, b = (np.concatenate(side) for side in zip(*met))
        met[1:] = []
        letters = np.maximum(size[a], size[b])
        for (grid, sizes, line), chosen in zip(tables, (letters <= NARROW, (letters > NARROW) & (letters <= WIDE))):
            one, two = a[chosen], b[chosen]
            hit = _close(grid, sizes, line[one], line[two])
            found.append(np.stack([one[hit], two[hit]]))
        huge = [(i, j) for i, j in zip(*(side[letters > WIDE].tolist() for side in (a, b))) if within_edits(tokens[i], tokens[j], EDIT_LIMIT)]
        found.append(np.array(huge, dtype=np.int64).reshape(-1, 2).T)

    waiting = 0
    for left, right in groups:
        middle, end = begin + len(left), begin + len(left) + len(right)
        rows = max(1, PAIRS // max(1, len(right)))
        for low in range(begin, middle, rows):
            high = min(low + rows, middle)
            # sides are sorted by length, and an edit changes it by one at most
            first, last = np.searchsorted(size[middle:end], (size[low] - EDIT_LIMIT, size[high - 1] + _FAR)) + middle
            near = np.bitwise_count(marks[low:high, None] ^ marks[first:last]) <= 2 * EDIT_LIMIT
            near &= np.bitwise_count(second[low:high, None] ^ second[first:last]) <= 4 * EDIT_LIMIT
            near &= np.abs(short[low:high, None] - short[first:last]) <= EDIT_LIMIT
            i, j = np.divmod(np.flatnonzero(near).astype(np.int32), np.int32(max(1, last - first)))
            met.append([i + low, j + first])
            waiting += len(i)
            if waiting > PAIRS:
                settle()
                waiting = 0
        begin = end
    settle()
    a, b = np.concatenate(found, axis=1)
    order = np.argsort(a, kind="stable")
    ends = np.searchsorted(a[order], np.cumsum([len(left) + len(right) for left, right in groups]))
    pairs, begin = [(tokens[i], tokens[j]) for i, j in zip(a[order].tolist(), b[order].tolist())], 0
    for end in ends.tolist():
        yield [(one, two) for one, two in pairs[begin:end] if one != two]
        begin = end
