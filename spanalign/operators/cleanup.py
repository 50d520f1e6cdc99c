"""Does a cleaned transcript keep the words of the raw one?"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from spanalign import fixed
from spanalign.fixed import CHANGED, EMPTY, PRESERVED, TOO_LONG, UNTRUSTED, VERIFIED
from spanalign.functions import text as tx

GROUP = 4
#: Positions kept as a set.
FEW = 16


def within_edits(a: str, b: str, limit: int) -> bool:
    """True when at most ``limit`` single-character edits turn ``a`` into ``b``."""
    if abs(len(a) - len(b)) > limit:
        return False
    # one row of the table, only the cells up to ``limit`` off the diagonal
    row = {j: j for j in range(min(limit, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        last, row = row, {}
        for j in range(max(0, i - limit), min(len(b), i + limit) + 1):
            ways = [last[j] + 1] if j in last else []
            ways += [row[j - 1] + 1] if j - 1 in row else []
            ways += [last[j - 1] + (x != b[j - 1])] if j and j - 1 in last else []
            row[j] = min(ways)
        if min(row.values()) > limit:
            return False
    return row[len(b)] <= limit


def _joined(tokens: Sequence[str], number: dict[str, int]) -> list[np.ndarray]:
    """Numbers of the joined texts of one to ``GROUP`` tokens from each place on (-1 beyond the end)."""
    found = []
    for size in range(1, GROUP + 1):
        own = [number.setdefault("".join(tokens[k:k + size]), len(number)) for k in range(len(tokens) - size + 1)]
        found.append(np.array(own + [-1] * (len(tokens) - len(own)), dtype=np.int64))
    return found


def is_conservative(raw: Sequence[str], cleaned: Sequence[str], allowed: frozenset[str]) -> bool:
    """Can both token lists be cut into matching groups of one to four tokens?

    Groups match when their joined text is equal, when the cleaned side is a vocabulary term at most
    two edits away, or when two single tokens (raw one of four bytes or more) differ by one edit.

    For every raw position the reachable cleaned positions are a band of flags, from the lowest to the
    highest one (a set while they are few); all cleaned groups of a size are compared with a raw group at
    once, by the numbers of their joined texts.  At most five bands are open, so memory follows the widest.
    """
    n, m = len(raw), len(cleaned)
    number: dict[str, int] = {}
    of_raw, of_cleaned = _joined(raw, number), _joined(cleaned, number)
    texts = list(number)
    # pairs of texts compared before
    compared: dict[tuple[int, int, int], bool] = {}

    def alike(a: int, b: int, limit: int) -> bool:
        key = (a, b, limit)
        if key not in compared:
            compared[key] = within_edits(texts[a], texts[b], limit)
        return compared[key]

    def spelled(a: int, b: int, term: bool, single: bool) -> bool:
        return (term and alike(a, b, 2)) or (single and alike(a, b, 1))

    def wide(at: np.ndarray, di: int, before: int, single: bool) -> np.ndarray:
        """Positions reached from many at once."""
        reached = []
        for dj in range(1, GROUP + 1):
            after = of_cleaned[dj - 1][at]
            hit = after == before
            rest = np.flatnonzero(~hit & (after >= 0))
            near = [b for b in set(after[rest].tolist()) if spelled(before, b, b in term_numbers, single and dj == 1)]
            hit[rest] = np.isin(after[rest], near)
            reached.append(at[hit] + dj)
        return np.concatenate(reached)

    def narrow(at: list[int], di: int, before: int, single: bool) -> list[int]:
        """The same from a few positions."""
        return [j + dj for j in at for dj in range(1, min(GROUP, m - j) + 1)
                if (after := lists[dj - 1][j]) == before or spelled(before, after, after in term_numbers, single and dj == 1)]

    term_numbers, lists = {number[t] for t in allowed if t in number}, [own.tolist() for own in of_cleaned]
    # raw position -> the positions reached there: a set while they are few, else a band of flags and its begin
    open_at: dict[int, set[int] | tuple[int, np.ndarray]] = {0: {0}}
    for i in range(n):
        here = open_at.pop(i, None)
        if here is None:
            continue
        few = isinstance(here, set)
        at = sorted(here) if few else here[0] + np.flatnonzero(here[1])
        for di in range(1, min(GROUP, n - i) + 1):
            single = di == 1 and len(raw[i].encode()) >= 4
            before = int(of_raw[di - 1][i])
            reached = narrow([j for j in at if j < m], di, before, single) if few else wide(at[at < m], di, before, single)
            if len(reached):
                open_at[i + di] = _merged(open_at.get(i + di), reached)
    end = open_at.get(n, set())
    return m in end if isinstance(end, set) else 0 <= m - end[0] < len(end[1]) and bool(end[1][m - end[0]])


def _merged(old: set[int] | tuple[int, np.ndarray] | None, new: Sequence[int]):
    """Positions reached before and now."""
    if not isinstance(old, tuple):
        found = (old or set()).union(new if isinstance(new, list) else new.tolist())
        if len(found) <= FEW:
            return found
        old, new = (min(found), np.zeros(0, dtype=bool)), np.fromiter(found, dtype=np.int64)
    new = np.asarray(new, dtype=np.int64)
    low, high = min(old[0], int(new.min())), max(old[0] + len(old[1]), int(new.max()) + 1)
    flags = np.zeros(high - low, dtype=bool)
    flags[old[0] - low:old[0] - low + len(old[1])] = old[1]
    flags[new - low] = True
    return low, flags


def validate_cleanup(
    pairs: DataFrame,
    vocabulary: Sequence[str] = fixed.CLEANUP_VOCABULARY,
    max_tokens: int | None = None,
) -> DataFrame:
    """Verdict and reason per row of ``pairs`` (session_id, raw, cleaned).

    Tokens, the empty and the over-long case, and the common case of equal tokens are decided in the
    JVM; only rows whose tokens differ reach the Python check, each row on its own.  A token bound
    holds only if one is given.
    """
    raw, cleaned = tx.tokens_unicode(F.col("raw")), tx.tokens_unicode(F.col("cleaned"))
    tokens = pairs.select("session_id", raw.alias("r"), cleaned.alias("c"))
    decided = (
        F.when((F.size("r") == 0) | (F.size("c") == 0), EMPTY)
        .when(F.lit(False) if max_tokens is None else F.greatest(F.size("r"), F.size("c")) > max_tokens, TOO_LONG)
        .when(F.col("r") == F.col("c"), PRESERVED)
    )
    allowed = frozenset(
        "".join(ch for ch in term.lower() if ch.isalnum()) for term in vocabulary
    )

    @F.pandas_udf("boolean")
    def conservative(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rs, cs in parts:
            yield pd.Series([is_conservative(list(r), list(c), allowed) for r, c in zip(rs, cs)],
                            dtype=bool)

    marked = tokens.withColumn("decided", decided)
    settled = marked.where("decided is not null").select("session_id", F.col("decided").alias("reason"))
    checked = marked.where("decided is null").select(
        "session_id", F.when(conservative("r", "c"), PRESERVED).otherwise(CHANGED).alias("reason")
    )
    return settled.unionByName(checked).select(
        "session_id",
        F.when(F.col("reason") == PRESERVED, VERIFIED).otherwise(UNTRUSTED).alias("status"),
        "reason",
    )
