"""Edit-aware token counts: after an edit only the touched region of a document is encoded again.

A document's pre-tokens are kept with their lengths and token counts in leaves of about ``LEAF`` pre-tokens;
a segment tree over the leaves holds sums of both.  An edit finds its leaf from the root, matches the
pre-token pattern anew from a few pre-tokens before the edit (the boundary context) until a boundary behind
the edit is one of the old ones, encodes the new pre-tokens of that stretch only, and updates the sums on the
paths of the leaves it changed.

Shape on a cluster: a document and its edits are one row, so counting is a scan without a shuffle; a task
keeps the counts of distinct pre-tokens it has seen (bounded, only for speed).

Edge cases: a null or empty text has no tokens and can be edited like an empty one; null or missing edits
change nothing; places beyond the text are moved to its end, negative ones to its start, null ones count as
0, a null insertion inserts nothing; edits apply one after the other, each to the result of those before;
repeated rows and null ids are counted like any other; empty tables give an empty result.  Other columns pass
through, those named like the results are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

LEAF, CONTEXT = 64, 3
CACHED = 200_000
RESULTS = ("n_tokens", "n_pretokens", "n_edits", "n_tokens_after", "n_reencoded")


class Counter:
    """Pre-tokens of a text and their token counts under a vocabulary of ranked byte strings."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.known = regex.compile(pattern), {}

    def counts(self, pretokens: list[str]) -> list[int]:
        known = self.known
        missing = {p for p in pretokens if p not in known}
        if missing:
            if len(known) > CACHED:
                known.clear()
                missing = set(pretokens)
            for p in missing:
                known[p] = len(self.encoding.encode_ordinary(p))
        return [known[p] for p in pretokens]


class TokenTree:
    """Lengths and token counts of a document's pre-tokens under a segment tree."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.text, self.counter, self.encoded = text, counter, 0
        found = counter.pattern.findall(text)
        self._build([len(p) for p in found], counter.counts(found))

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        self.leaves = [(lengths[a:a + LEAF], counts[a:a + LEAF]) for a in range(0, len(lengths), LEAF)] or [([], [])]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        sums = np.zeros((2 * self.size, 2), np.int64)
        if lengths:
            begins = np.arange(0, len(lengths), LEAF)
            sums[self.size:self.size + len(begins)] = np.add.reduceat(np.array([lengths, counts], np.int64), begins, axis=1).T
        low = self.size
        while low > 1:
            sums[low // 2:low] = sums[low:2 * low].reshape(-1, 2, 2).sum(axis=1)
            low //= 2
        self.sums = sums

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def pretokens(self) -> int:
        return sum(len(lengths) for lengths, _ in self.leaves)

    def _leaf(self, place: int) -> tuple[int, int]:
        """Leaf with the character at ``place`` (or the last leaf) and the leaf's start."""
        node, start = 1, 0
        while node < self.size:
            left = int(self.sums[2 * node, 0])
            if place < start + left:
                node = 2 * node
            else:
                node, start = 2 * node + 1, start + left
        leaf = node - self.size
        while leaf >= len(self.leaves) or (leaf and not self.leaves[leaf][0]):  # behind the end
            leaf -= 1
            start -= int(self.sums[self.size + leaf, 0]) if leaf < len(self.leaves) else 0
        return leaf, start

    def _set(self, leaf: int, lengths: list[int], counts: list[int]) -> None:
        self.leaves[leaf] = (lengths, counts)
        node = self.size + leaf
        self.sums[node] = sum(lengths), sum(counts)
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def _boundary_before(self, place: int) -> tuple[int, int, int]:
        """Leaf, index there and start of the pre-token ``CONTEXT`` before the one with ``place``."""
        leaf, at = self._leaf(place)
        index = 0
        lengths = self.leaves[leaf][0]
        while index < len(lengths) and at + lengths[index] <= place:
            at += lengths[index]
            index += 1
        for _ in range(CONTEXT):
            while index == 0 and leaf > 0:
                leaf -= 1
                index = len(self.leaves[leaf][0])
            if index == 0:
                break
            index -= 1
            at -= self.leaves[leaf][0][index]
        return leaf, index, at

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``at`` on by ``inserted``."""
        at = min(max(at, 0), len(self.text))
        end = min(at + max(removed, 0), len(self.text))
        if at == end and not inserted:
            return
        grown = len(inserted) - (end - at)
        self.text = self.text[:at] + inserted + self.text[end:]
        leaf, index, start = self._boundary_before(max(at - 1, 0))
        # old boundaries behind the edit, walked in step with the new ones
        last, place, old = leaf, index, start
        new: list[str] = []
        where = start
        matches = self.counter.pattern.finditer(self.text, start)

        def forward() -> bool:
            nonlocal last, place, old
            while place >= len(self.leaves[last][0]):
                if last + 1 >= len(self.leaves):
                    return False
                last, place = last + 1, 0
            old += self.leaves[last][0][place]
            place += 1
            return True

        while True:
            while old < end or old + grown < where:
                if not forward():
                    break
            if old >= end and old + grown == where:
                break
            match = next(matches, None)
            if match is None:  # the text ends: nothing of the old is left
                while forward():
                    pass
                break
            new.append(match.group())
            where = match.end()
        self.encoded += len(new)
        head_lengths, head_counts = self.leaves[leaf]
        tail_lengths, tail_counts = self.leaves[last]
        lengths = [*head_lengths[:index], *map(len, new), *tail_lengths[place:]]
        counts = [*head_counts[:index], *self.counter.counts(new), *tail_counts[place:]]
        for k in range(leaf + 1, last + 1):
            self._set(k, [], [])
        self._set(leaf, lengths, counts)
        if len(lengths) > 16 * LEAF:  # a leaf has outgrown its share: spread the leaves again, nothing is encoded
            self._build([x for own, _ in self.leaves for x in own], [x for _, own in self.leaves for x in own])


def edited_counts(documents: DataFrame, ranks_path: str, pattern: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """``documents`` with ``n_tokens, n_pretokens, n_edits, n_tokens_after, n_reencoded``.

    ``edits`` is an array of ``struct(at, removed, inserted)`` in characters.  ``n_reencoded`` counts the
    pre-tokens encoded for the edits.
    """
    documents = documents.drop(*RESULTS)
    names = documents.columns
    of_text, of_edits = names.index(text), names.index(edits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks_path, pattern)
        for batch in batches:
            rows = []
            for raw, own in zip(batch.column(of_text), batch.column(of_edits)):
                tree, own = TokenTree(raw.as_py() or "", counter), own.as_py() or []
                before, size = tree.tokens, tree.pretokens
                for e in own:
                    if e is not None:
                        tree.edit(e["at"] or 0, e["removed"] or 0, e["inserted"] or "")
                rows.append((before, size, len(own), tree.tokens, tree.encoded))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 5))], [*names, *RESULTS])

    return documents.mapInArrow(count, T.StructType([*documents.schema.fields, *(T.StructField(c, T.LongType()) for c in RESULTS)]))


def drafted_edits(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Three edits per document at places that follow from its id: an insertion, a deletion, a replacement by
    words of its own start."""
    size = F.coalesce(F.char_length(text), F.lit(0))

    def edit(k: int, removed: int, inserted):
        at = F.pmod(F.xxhash64(doc_id, F.lit(k)), (size + 1).cast("long")).cast("int")
        return F.struct(at.alias("at"), F.lit(removed).alias("removed"), inserted.alias("inserted"))

    return F.array(edit(1, 0, F.lit(" with an insertion, ")), edit(2, 40, F.lit("")), edit(3, 7, F.coalesce(F.substring(text, 1, 25), F.lit(""))))
