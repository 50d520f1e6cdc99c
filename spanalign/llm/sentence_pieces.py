"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The symbols of a text are its characters.  An agenda holds the adjacent pairs of symbols whose joined string is
a piece; the pair with the highest score, the leftmost of equal ones, is joined, its two new neighbours enter
the agenda, until the agenda is empty.  Characters without a piece become byte pieces.

A text is cut where no piece of the vocabulary has the two characters next to each other across the cut (before
a run of spaces), so no pair can join across and each distinct stretch is encoded once per task.  The agendas
of all new stretches of an Arrow batch advance together in NumPy, one pair of each at a time; long stretches
have a heap of their own.  Each new stretch is also encoded, and each text's ids are also decoded, by the
sentencepiece library in the same batch; ``agrees`` says whether the results are equal.

Shape on a cluster: a scan; nothing is shuffled.  Texts are worked on in parts of about ``PART`` characters
that end at a cut, so memory follows the part (a run of characters without any cut is one part) and the
table of known stretches, which starts anew beyond ``KNOWN`` characters.

Edge cases: a null text is empty and gives begin and end ids only; every row is encoded by itself, so null ids,
repeated rows and ties need no rule; empty tables give an empty result.  Other columns pass through unchanged;
columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

#: Characters handled at once, characters of stretches remembered by a task, symbols of a stretch joined in step.
PART, KNOWN, IN_STEP = 1 << 20, 1 << 25, 32
#: The visible character that stands for a space in pieces.
SPACE = "▁"
RESULTS = ("n_tokens", "ids_sha256", "decoded_sha256", "agrees")
#: Rank of a pair that makes no piece, and the symbol behind the last one.
_NONE, _BEHIND = np.iinfo(np.int32).max, -(1 << 30)
_PROBE = "  aÅﬁ  ①\t\n b "


class Vocabulary:
    """Pieces, scores and joins of a model file.

    Only models with one piece per joined string, without normalisation rules, with a space put before the
    text and with byte pieces are taken; others raise ``ValueError``.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        if lib.normalize(_PROBE) != SPACE + _PROBE.replace(" ", SPACE) or any(lib.is_unused(i) for i in range(size)):
            raise ValueError("only vocabularies without normalisation rules and unused pieces")
        plain = [i for i in range(size) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        plain_ids = set(plain)
        bytes_of = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(size) if lib.is_byte(i)}
        if len(bytes_of) != 256:
            raise ValueError("only vocabularies with byte pieces")
        self.bos, self.eos, self.bytes_of = lib.bos_id(), lib.eos_id(), bytes_of
        pieces = {lib.id_to_piece(i): i for i in plain}
        # symbols are pieces and the characters they are made of; single characters may lack a piece
        self.symbol = dict(pieces)
        for c in sorted({c for p in pieces for c in p} - pieces.keys()):
            self.symbol[c] = size + len(self.symbol)
        self.size, self.span = size, max(self.symbol.values()) + 1
        self.char_of = {i: c for c, i in self.symbol.items() if i >= size}
        # equal scores share a rank, so that the leftmost of them is joined first
        scores = sorted({lib.get_score(i) for i in plain}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        joins = {}
        self.adjacent = set()
        for piece, i in pieces.items():
            self.adjacent.update(zip(piece, piece[1:]))
            for k in range(1, len(piece)):
                a, b = self.symbol.get(piece[:k]), self.symbol.get(piece[k:])
                if a is not None and b is not None:
                    joins[a * self.span + b] = (rank_of[lib.get_score(i)], i)
        self.joins = joins
        self.keys = np.array(sorted(joins), np.int64)
        self.ranks = np.array([joins[k][0] for k in self.keys.tolist()], np.int32)
        self.joined = np.array([joins[k][1] for k in self.keys.tolist()], np.int32)
        if any(b == SPACE and a != SPACE for a, b in self.adjacent):
            raise ValueError("only vocabularies whose pieces do not go on behind a space")
        self.surface = [b""] * size
        for p, i in pieces.items():
            self.surface[i] = p.replace(SPACE, " ").encode()
        for value, i in bytes_of.items():
            self.surface[i] = bytes([value])
        for i in range(size):
            if lib.is_unknown(i):
                self.surface[i] = lib.decode([i]).encode()
        self.byte_ids, self.control = set(bytes_of.values()), {i for i in range(size) if lib.is_control(i)}
        self.begins = [p[:1] == b" " and i in plain_ids for i, p in enumerate(self.surface)]

    def _char_ids(self, c: str) -> list[int]:
        return [self.bytes_of[b] for b in c.encode()]

    def _ids(self, symbols: list[int], chars: list[str]) -> list[int]:
        out = []
        for s, c in zip(symbols, chars):
            out += [s] if 0 <= s < self.size else self._char_ids(c)
        return out

    def by_heap(self, stretch: str) -> list[int]:
        """Ids of one stretch, its agenda a heap."""
        n = len(stretch)
        symbols = [self.symbol.get(c, -1) for c in stretch]
        before, behind = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []

        def offer(a: int, b: int) -> None:
            x, y = symbols[a], symbols[b]
            found = self.joins.get(x * self.span + y) if x >= 0 and y >= 0 else None
            if found:
                heapq.heappush(agenda, (found[0], a, b, x, y, found[1]))

        for k in range(n - 1):
            offer(k, k + 1)
        gone = [False] * n
        while agenda:
            _, a, b, x, y, piece = heapq.heappop(agenda)
            if gone[a] or gone[b] or symbols[a] != x or symbols[b] != y or behind[a] != b:
                continue  # one of the two was joined with another symbol
            symbols[a], gone[b] = piece, True
            behind[a] = behind[b]
            if behind[b] >= 0:
                before[behind[b]] = a
                offer(a, behind[a])
            if before[a] >= 0:
                offer(before[a], a)
        left = [k for k in range(n) if not gone[k]]
        return self._ids([symbols[k] for k in left], [stretch[k] for k in left])

    def _places(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair among the joins, and whether it is there."""
        key = left.astype(np.int64) * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, (self.keys[at] == key) & (left >= 0) & (right >= 0)

    def _offers(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; pairs that make no piece have the rank ``_NONE``."""
        at, hit = self._places(left, right)
        return np.where(hit, self.ranks[at], _NONE)

    def in_step(self, stretches: list[str]) -> list[bytes]:
        """Ids (as little-endian 32-bit integers) of stretches of at most ``IN_STEP`` characters."""
        sizes = np.array([len(s) for s in stretches])
        codes = np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)
        distinct, inverse = np.unique(codes, return_inverse=True)
        of_code = np.array([self.symbol.get(chr(c), -1 - c) for c in distinct.tolist()], np.int32)[inverse]
        starts = np.cumsum(sizes) - sizes
        out: list[bytes] = [b""] * len(stretches)
        bounds = [0, 4, 6, 8, 10, 13, 18, 24, IN_STEP]
        for low, high in zip(bounds[:-1], bounds[1:]):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            if not len(rows):
                continue
            columns = np.arange(high)
            inside = columns < sizes[rows, None]
            symbols = np.where(inside, of_code[np.minimum(starts[rows, None] + columns, len(codes) - 1)], _BEHIND)
            count = sizes[rows].copy()
            ranks = self._offers(symbols[:, :-1], symbols[:, 1:])
            active = np.arange(len(rows))
            while len(active):
                own = ranks[active]
                at = own.argmin(axis=1)
                going = own[np.arange(len(active)), at] < _NONE
                active, at = active[going], at[going]
                if not len(active):
                    break
                k = np.arange(len(active))
                own_symbols, own = symbols[active], own[going]
                joined = self.joined[self._places(own_symbols[k, at], own_symbols[k, at + 1])[0]]
                # the right symbol goes, everything behind it moves up
                behind = columns[:-1] > at[:, None]
                moved = np.full_like(own_symbols, _BEHIND)
                moved[:, :-1] = np.where(behind, own_symbols[:, 1:], own_symbols[:, :-1])
                moved[k, at] = joined
                symbols[active] = moved
                count[active] -= 1
                new = np.full_like(own, _NONE)
                new[:, :-1] = np.where(behind[:, :-1], own[:, 1:], own[:, :-1])
                new[k, at] = self._offers(joined, moved[k, at + 1])
                left = np.flatnonzero(at > 0)
                new[left, at[left] - 1] = self._offers(moved[left, at[left] - 1], joined[left])
                ranks[active] = new
            known = ((symbols >= 0) & (symbols < self.size)).sum(axis=1) == count
            flat = symbols[columns < count[:, None]].astype("<u4").tobytes()
            ends = (np.cumsum(count) * 4).tolist()
            begin = 0
            for row, end in zip(rows.tolist(), ends):
                out[row] = flat[begin:end]
                begin = end
            for k in np.flatnonzero(~known).tolist():
                out[rows[k]] = np.array(self._expanded(symbols[k, :count[k]].tolist()), "<u4").tobytes()
        return out

    def _expanded(self, symbols: list[int]) -> list[int]:
        out = []
        for s in symbols:
            out += [s] if 0 <= s < self.size else self._char_ids(self.char_of[s] if s >= 0 else chr(-1 - s))
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control pieces vanish, the first space of the text goes, byte pieces are read as UTF-8."""
        parts = [self.surface[i] for i in ids]
        first = next((k for k, part in enumerate(parts) if part), None)
        if first is not None and self.begins[ids[first]]:
            parts[first] = parts[first][1:]
        try:
            if self.control.isdisjoint(ids):
                return b"".join(parts).decode()
        except UnicodeDecodeError:
            pass
        # runs of byte pieces are read by themselves, also when a control piece stands between them
        runs = itertools.groupby(zip(ids, parts), lambda x: x[0] if x[0] not in self.byte_ids else -1)
        return "".join(b"".join(p for _, p in run).decode(errors="surrogateescape").translate(_BROKEN) for _, run in runs)


#: Bytes that are no UTF-8 become replacement characters, one each.
_BROKEN = {0xDC00 + b: 0xFFFD for b in range(128, 256)}
_STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_CUT = re.compile(f"[^{SPACE}]{SPACE}")


def parts(text: str) -> Iterator[str]:
    """The text with visible spaces, the one put before it too, in parts that no piece crosses."""
    text, low = SPACE + text.replace(" ", SPACE), 0
    while len(text) - low > PART:
        found = _CUT.search(text, low + PART)
        if not found:
            break
        yield text[low:found.start() + 1]
        low = found.start() + 1
    yield text[low:] if low else text


class Encoder:
    """Ids of texts with a table of the stretches met before."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.known: dict[str, bytes] = {}
        self.held, self.differing = 0, set()

    def learn(self, stretches: set[str]) -> None:
        """Encode new stretches and compare them with the library."""
        v, new = self.vocabulary, list(stretches)
        short = [s for s in new if len(s) <= IN_STEP]
        ids = dict(zip(short, v.in_step(short))) if short else {}
        for s in new:
            if len(s) > IN_STEP:
                ids[s] = np.array(self._long(s), "<u4").tobytes()
        theirs = v.library.encode([s[1:].replace(SPACE, " ") for s in new], num_threads=1)
        if np.array([i for one in theirs for i in one], "<u4").tobytes() != b"".join(ids[s] for s in new):
            # the library puts no space before an empty text
            self.differing.update(s for s, one in zip(new, theirs) if s != SPACE and np.array(one, "<u4").tobytes() != ids[s])
        self.known.update(ids)
        self.held += sum(map(len, new))

    def _long(self, stretch: str) -> list[int]:
        """A long stretch is cut at every two characters that no piece has next to each other."""
        adjacent, out, low = self.vocabulary.adjacent, [], 0
        for k, pair in enumerate(zip(stretch, stretch[1:]), 1):
            if pair not in adjacent:
                out += self.vocabulary.by_heap(stretch[low:k])
                low = k
        return out + self.vocabulary.by_heap(stretch[low:])

    def encode(self, parts: list[str]) -> list[tuple[bytes, bool]]:
        """Ids of each part, and whether the library agrees on its stretches."""
        if self.held > KNOWN:
            self.known, self.held = {}, 0
        stretches = [_STRETCH.findall(part) for part in parts]
        new = set().union(*stretches).difference(self.known)
        if new:
            self.learn(new)
        known = self.known.__getitem__
        return [(b"".join(map(known, own)), not self.differing or self.differing.isdisjoint(own)) for own in stretches]


class _Digests:
    """Digests of one text's ids and of the text decoded from them, part by part."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.n, self.agrees, self.parts = vocabulary, 2, True, 0
        self.ids, self.decoded = hashlib.sha256(np.array([vocabulary.bos], "<u4").tobytes()), hashlib.sha256()

    def add(self, ids: bytes, same: bool) -> None:
        self.ids.update(ids)
        numbers = np.frombuffer(ids, "<u4").tolist()
        back = self.vocabulary.decode(numbers)
        self.agrees &= same and self.vocabulary.library.decode(numbers) == back
        self.n += len(numbers)
        if self.parts:
            self.decoded.update(b" ")  # every part begins with a space, which only a text's first one loses
        self.decoded.update(back.encode())
        self.parts += 1

    def row(self) -> tuple[int, str, str, bool]:
        self.ids.update(np.array([self.vocabulary.eos], "<u4").tobytes())
        return self.n, self.ids.hexdigest(), self.decoded.hexdigest(), self.agrees


def digests(encoder: Encoder, texts: list[str]) -> list[tuple[int, str, str, bool]]:
    """``RESULTS`` of each text."""
    found = [_Digests(encoder.vocabulary) for _ in texts]
    owners, held, size = [], [], 0

    def flush() -> None:
        for owner, result in zip(owners, encoder.encode(held)):
            owner.add(*result)
        owners.clear()
        held.clear()

    for own, text in zip(found, texts):
        for part in parts(text) if text else ():
            owners.append(own)
            held.append(part)
            size += len(part)
            if size > PART:
                flush()
                size = 0
    flush()
    return [own.row() for own in found]


def encoded(documents: DataFrame, model: str) -> DataFrame:
    """``documents`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``agrees`` of each text.

    ``n_tokens`` and the ids have a begin and an end id.
    """
    rows = documents.drop(*RESULTS)
    place = rows.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            results = digests(encoder, [t or "" for t in batch.column(place).to_pylist()])
            arrays = [pa.array([r[k] for r in results], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *RESULTS])

    types = (T.LongType(), T.StringType(), T.StringType(), T.BooleanType())
    return rows.mapInArrow(scan, T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in zip(RESULTS, types))]))
