"""Suffix-array dedup: bytes covered by a long string that also starts earlier are removed.

Texts are UTF-8 bytes.  A string of ``LENGTH`` bytes is repeated if the same bytes start earlier, in a
document with a smaller id or before it in its own; every byte that a repeated string covers goes.  Strings
are judged on the input and never cross documents.

Suffixes are dealt to tasks so that equal strings meet.  The least hash of the ``SEED``-byte grams in a string
is its anchor; equal strings have equal anchors at equal places.  Neighbouring strings with one anchor form a
context.  Anchors that occur once are done.  Equal contexts count as one (the first stays, all strings of the
others are repeated).  The different contexts of an anchor go to one task, which builds the suffix array of
many of them together by two-stage sorting: only suffixes smaller than their successors are sorted directly,
the rest is induced by scanning the buckets in order.  Adjacent common prefixes of at least ``LENGTH`` bytes
then give the runs of equal strings, of which the first stays.

Shape on a cluster: a scan gives a row per anchor (about 3 per 100 bytes); of equal contexts in a block of a
task only the first is compared globally, so a passage that a third of all documents share comes once per
block.  One shuffle by anchor finds repeated contexts in a sorted stream.  Texts are fetched only for
documents with something to compare or to remove (a bit table of fixed size skips the others).  An anchor
with more than ``GROUP`` different contexts is split; what is first in its part is then compared once more
across parts by hash.  No step holds all of an anchor's contexts.

Edge cases: null and empty texts, and texts shorter than a string, stay whole; a null ``doc_id`` takes no part
and stays whole; rows with equal id and text count as one document and are cut alike; empty tables give an
empty result.  Further columns pass through.  A cut may split a character; ``kept`` is therefore bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from spanalign.llm import kernels as K
from spanalign.llm.bits import bit_table, place
from spanalign.session import written

LENGTH, SEED = 100, 24
#: Anchors compared within a task before the rest is sent on; contexts of an anchor in one task; bytes of one suffix array.
BLOCK, GROUP, ARRAY_BYTES = 1 << 19, 4096, 1 << 20


# --- anchors -----------------------------------------------------------------------------------------------

def anchors(data: np.ndarray, offsets: np.ndarray, kept: K.Powers, length: int = LENGTH, seed: int = SEED):
    """Contexts of a slice: first and last start of its strings, hash of the anchor, hash of the context."""
    n, wide = len(data) - length + 1, length - seed + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = kept.upto(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(K._BYTE[data] * up, out=sums[1:])
    grams = len(data) - seed + 1
    hashes = K.mix((sums[seed:] - sums[:-seed]) * down[:grams] + np.uint64(seed))
    # the least gram of each string: hash in the upper half, place in the lower, so the first of equal ones wins
    least = hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(grams, dtype=np.uint64)
    span = 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[wide - span:wide - span + n])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(n), "right") - 1
    whole = np.arange(n) + length <= offsets[text + 1]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(whole)
    begins = starts[new[starts] | ~whole[np.maximum(starts - 1, 0)] | (starts == 0)]
    ends = np.ones(n, bool)
    ends[:-1] = new[1:] | ~whole[1:]
    lasts = starts[ends[starts]]
    context = K.mix((sums[lasts + length] - sums[begins]) * down[begins] + (lasts - begins + length).astype(np.uint64))
    return begins, lasts, hashes[at[begins]], context


def version() -> Column:
    """Tells apart rows with one id and different texts."""
    return F.xxhash64("text").bitwiseAND(F.lit(0xFFFF))


def _pack(start: np.ndarray, versions: np.ndarray, more: np.ndarray) -> np.ndarray:
    return start << 24 | versions << 8 | more


def repeated_contexts(documents: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Rows ``repeated, anchor, doc_id, at``: contexts that equal an earlier one, and the first ones of
    anchors that have several contexts.  ``at`` holds start, version and number of further strings."""
    rows = documents.select("doc_id", "text", version().alias("version"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, size = K.Powers(), [], 0

        def block() -> pa.RecordBatch:
            anchor, context, ids, at = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((at, ids, context, anchor))
            anchor, context, ids, at = anchor[order], context[order], ids[order], at[order]
            later, same = np.zeros(len(order), bool), np.zeros(len(order), bool)
            later[1:] = (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1])
            same[1:] = later[1:] & (ids[1:] == ids[:-1]) & (at[1:] == at[:-1])
            # what is known to be repeated is spread by a hash of its own
            spread = np.where(later, K.mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)), anchor)
            return pa.record_batch({"anchor": K.signed(spread[~same]), "context": K.signed(context[~same]), "doc_id": ids[~same], "at": at[~same], "later": later[~same]})

        for batch in batches:
            ids, versions = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for first, data, offsets in K.slices(batch.column(1)):
                begins, lasts, anchor, context = anchors(data, offsets, kept, length, seed)
                text = np.searchsorted(offsets, begins, "right") - 1
                held.append((anchor, context, ids[first + text], _pack(begins - offsets[text], versions[first + text], lasts - begins)))
                size += len(begins)
            if size > BLOCK:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last row compared: anchor, context, first id, first at
        alone = np.zeros((3, 0), np.int64)  # the first context of an anchor, while there is no other
        for batch in batches:
            anchor, context, ids, at = (batch.column(k).to_numpy() for k in range(4))
            later = batch.column(4).to_numpy(zero_copy_only=False)
            rows = np.stack([anchor, context, ids, at])
            done, rows = rows[:, later], rows[:, ~later]
            out = [(True, done)]
            if rows.shape[1]:
                if last is not None:
                    rows = np.concatenate([np.array(last)[:, None], rows], axis=1)
                a, c = rows[0], rows[1]
                new_anchor, new_context = np.ones(len(a), bool), np.ones(len(a), bool)
                new_anchor[1:] = a[1:] != a[:-1]
                new_context[1:] = new_anchor[1:] | (c[1:] != c[:-1])
                first = np.flatnonzero(new_context)[np.cumsum(new_context) - 1]
                copies = ~new_context & ((rows[2] != rows[2, first]) | (rows[3] != rows[3, first]))
                out.append((True, rows[:, copies]))
                # first contexts: those of anchors with several; the carried row has been passed on or is alone
                heads = np.flatnonzero(new_context)
                group = np.cumsum(new_anchor)[heads] - 1
                count = np.bincount(group)
                passed = last is not None and not alone.shape[1]
                several = count > 1
                if passed:
                    several[0] = True
                chosen = several[group]
                if passed:
                    chosen[0] = False
                out.append((False, rows[:, heads[chosen]]))
                ends_alone = not several[-1]
                last = (a[-1], c[-1], rows[2, first[-1]], rows[3, first[-1]])
                alone = np.zeros((3, 1 if ends_alone else 0), np.int64)
            for repeated, x in out:
                if x.shape[1]:
                    yield pa.record_batch({"repeated": np.full(x.shape[1], repeated), "anchor": x[0], "doc_id": x[2], "at": x[3]})

    dealt = rows.mapInArrow(scan, "anchor long, context long, doc_id long, at long, later boolean")
    dealt = dealt.repartition("anchor").sortWithinPartitions("anchor", "context", "doc_id", "at")
    return dealt.mapInArrow(compare, "repeated boolean, anchor long, doc_id long, at long")


# --- suffix arrays -----------------------------------------------------------------------------------------

def _words(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one number that sorts alike."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k:k + len(text)]
    return out


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes in the order of their first ``depth`` bytes, by two-stage sorting.

    ``wanted`` flags suffixes; ``text`` ends with a byte that is smaller than all before it.
    """
    n = len(text)
    turns = np.flatnonzero(text[:-1] != text[1:])
    next_turn = turns[np.minimum(np.searchsorted(turns, np.arange(n)), max(len(turns) - 1, 0))] if len(turns) else np.zeros(n, np.int64)
    smaller = np.zeros(n, bool)  # than its successor
    if n > 1 and len(turns):
        smaller = text[next_turn] < text[np.minimum(next_turn + 1, n - 1)]
    smaller[-1] = True
    # the rest needs its successors up to the first that is sorted directly
    stops = np.flatnonzero(smaller)
    until = stops[np.searchsorted(stops, np.arange(n))]
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(wanted)
    np.add.at(cover, at, 1)
    np.add.at(cover, until[at] + 1, -1)
    needed = np.cumsum(cover[:-1]) > 0

    direct = _direct_order(_words(text), np.flatnonzero(needed & smaller), depth)
    induced = needed & ~smaller
    heads = text[direct]
    buckets: dict[int, list[np.ndarray]] = {}
    order: list[np.ndarray] = []
    for c in np.flatnonzero(np.bincount(text[needed], minlength=256)).tolist():
        own = buckets.pop(c, [])
        # suffixes of this bucket that are larger than their successors come first; runs of c induce more
        k = 0
        while k < len(own):
            before = own[k] - 1
            before = before[(before >= 0)]
            before = before[induced[before] & (text[before] == c)]
            if len(before):
                own.append(before)
            k += 1
        own.append(direct[np.searchsorted(heads, c):np.searchsorted(heads, c, "right")])
        bucket = np.concatenate(own)
        order.append(bucket)
        before = bucket - 1
        before = before[before >= 0]
        before = before[induced[before] & (text[before] > c)]
        to = text[before]
        by = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[by])) + 1
        for part in np.split(before[by], cuts):
            if len(part):
                buckets.setdefault(int(text[part[0]]), []).append(part)
    found = np.concatenate(order) if order else np.zeros(0, np.int64)
    return found[wanted[found]]


def _direct_order(words: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first bytes, eight at a time; only ties are sorted further."""
    order = suffixes[np.argsort(words[suffixes], kind="stable")]
    tied, group = _ties(words[order])
    open_at, group = np.flatnonzero(tied), group[tied]
    for low in range(8, depth, 8):
        if not len(open_at):
            break
        own = order[open_at]
        key = words[np.minimum(own + low, len(words) - 1)]
        by = np.lexsort((key, group))
        order[open_at] = own[by]
        key, group = key[by], group[by]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new)
        several = np.bincount(group)[group] > 1
        open_at, group = open_at[several], group[several]
    return order


def _ties(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(new)
    return (np.bincount(group)[group] > 1 if len(keys) else np.zeros(0, bool)), group


def common_prefixes(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to ``depth``."""
    found, alive = np.zeros(len(a), np.int64), np.arange(len(a))
    for low in range(0, depth, 8):
        x = words[a[alive] + low] ^ words[b[alive] + low]
        equal = np.zeros(len(x), np.int64)
        open_ = np.ones(len(x), bool)
        for k in range(8):
            open_ &= (x >> np.uint64(56 - 8 * k)) & np.uint64(255) == 0
            equal += open_
        found[alive] += equal
        alive = alive[open_]
    return np.minimum(found, depth)


def repeated_strings(contexts: list[bytes], rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings of the contexts that come again: (context, start) of all but the first of each kind, and of
    all first ones.  ``rank`` orders the contexts; of one context, smaller starts come first."""
    sizes = np.array([len(c) for c in contexts])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    # bytes are raised by one in the order, so the end of a context is smaller than all of them; 0xFF never occurs in UTF-8
    text = np.zeros(begins[-1] + 1, np.uint8)
    text[:-1] = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8) + 1
    text[begins[1:] - 1] = 0
    wanted = np.zeros(len(text), bool)
    windows = sizes - length + 1
    starts = np.repeat(begins[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    wanted[starts] = True
    of = np.repeat(np.arange(len(contexts)), windows)
    owner = np.zeros(len(text), np.int64)
    owner[starts] = of
    order = suffix_order(text, wanted, length)
    words = _words(text)
    same = np.zeros(len(order), bool)
    same[1:] = common_prefixes(words, order[:-1], order[1:], length) >= length
    group = np.cumsum(~same)
    context = owner[order]
    start = order - begins[context]
    by = np.lexsort((start, rank[context], group))
    first = np.ones(len(by), bool)
    first[1:] = group[by][1:] != group[by][:-1]
    later = by[~first]
    return context[later], start[later], context[by[first]], start[by[first]]


def compared(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts (``anchor, part, several, doc_id, at, bytes``) of equal ``anchor`` and ``part`` compared:
    ``hash, doc_id, at`` of repeated strings (hash null; ``at`` holds the number of strings that follow each
    other) and, for anchors in several parts, of first strings."""
    ordered = contexts.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "doc_id", "at")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], [], []]

        def out(n: int) -> pa.RecordBatch:
            anchor, part, several, ids, at, raw = (x[:n] for x in held)
            for x in held:
                del x[:n]
            ids, at = np.array(ids, np.int64), np.array(at, np.int64)
            rank = np.empty(n, np.int64)
            rank[np.lexsort((at, ids))] = np.arange(n)
            context, start, first_context, first_start = repeated_strings(raw, rank, length)
            by = np.lexsort((start, context))
            context, start = context[by], start[by]
            new = np.ones(len(by), bool)
            new[1:] = (context[1:] != context[:-1]) | (start[1:] != start[:-1] + 1)
            begin = np.flatnonzero(new)
            run = np.diff(np.append(begin, len(by))) - 1
            context, start = context[begin], start[begin]
            places = (at[context] >> 8) + (start << 16)
            hashes = pa.nulls(len(context), pa.int64())
            many = np.array(several)[first_context]
            hash_of = pa.array([int.from_bytes(hashlib.blake2b(raw[c][s:s + length], digest_size=8).digest(), "little", signed=True)
                                for c, s in zip(first_context[many].tolist(), first_start[many].tolist())], pa.int64())
            return pa.record_batch({
                "hash": pa.concat_arrays([hashes, hash_of]),
                "doc_id": np.concatenate([ids[context], ids[first_context[many]]]),
                "at": np.concatenate([places << 8 | run, ((at[first_context[many]] >> 8) + (first_start[many] << 16)) << 8])})

        size = 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for row in zip(*columns):
                if size > ARRAY_BYTES and (row[0], row[1]) != (held[0][-1], held[1][-1]):
                    yield out(len(held[0]))
                    size = 0
                for x, value in zip(held, row):
                    x.append(value)
                size += len(row[5])
        if held[0]:
            yield out(len(held[0]))

    return ordered.mapInArrow(sort, "hash long, doc_id long, at long")


# --- the operator ------------------------------------------------------------------------------------------

def _fetched(documents: DataFrame, lists: DataFrame) -> DataFrame:
    """Texts of the documents in ``lists`` (``__id, __version`` and more)."""
    table = bit_table(lists, "__id", "__version")
    rows = documents.select("doc_id", "text", version().alias("version")).withColumn("place", place("doc_id", "version"))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(table[batch.column(3).to_numpy()])).select([0, 1, 2])

    found = rows.mapInArrow(known, "doc_id long, text string, version long")
    return found.join(lists.hint("merge"), (F.col("doc_id") == F.col("__id")) & (F.col("version") == F.col("__version")))


def removed_ranges(documents: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``__id, __version, ranges``: starts (upper bits) and further strings (lowest byte) to remove."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    found = written(repeated_contexts(documents, length, seed), "contexts")
    heads = found.where("not repeated")
    crowded = heads.groupBy("anchor").count().where(F.col("count") > GROUP).select("anchor", F.ceil(F.col("count") / GROUP).cast("long").alias("parts"))
    heads = heads.join(crowded, "anchor", "left").select(
        "anchor", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id", "at"), "parts")).otherwise(F.lit(0)).cast("long").alias("part"),
        F.col("parts").isNotNull().alias("several"), "doc_id", "at")
    lists = written(heads.groupBy(F.col("doc_id").alias("__id"), F.shiftright("at", 8).bitwiseAND(F.lit(0xFFFF)).alias("__version"))
                    .agg(F.collect_list(F.struct("anchor", "part", "several", "at")).alias("own")), "heads")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw, own = batch.column(1)[k].as_buffer().to_pybytes(), batch.column(2).slice(k, 1).flatten()
                anchor, part, several, at = (own.field(n) for n in range(4))
                starts, more = at.to_numpy() >> 24, at.to_numpy() & 0xFF
                pieces = [raw[s:s + m + length] for s, m in zip(starts.tolist(), more.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [anchor, part, several, pa.repeat(batch.column(0)[k], len(own)), at, pa.array(pieces, pa.binary())],
                    ["anchor", "part", "several", "doc_id", "at", "bytes"])

    # rows that are the same document are cut once
    once = _fetched(documents, lists).dropDuplicates(["doc_id", "version"])
    contexts = once.select("doc_id", "text", "own").mapInArrow(
        cut, "anchor long, part long, several boolean, doc_id long, at long, bytes binary")
    strings = written(compared(contexts, length), "strings")
    firsts = strings.where("hash is not null")
    least = firsts.groupBy("hash").agg(F.min(F.struct("doc_id", "at")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    across = firsts.join(least, "hash").where(F.struct("doc_id", "at") != F.col("least")).select("doc_id", "at")
    every = found.where("repeated").select("doc_id", "at").union(strings.where("hash is null").select("doc_id", "at")).union(across)
    return every.groupBy(F.col("doc_id").alias("__id"), F.shiftright("at", 8).bitwiseAND(F.lit(0xFFFF)).alias("__version")).agg(F.collect_list("at").alias("ranges"))


def suffix_dedup(documents: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``documents`` with ``n_bytes, n_removed, n_spans`` (maximal removed runs) and ``kept`` (the bytes left).

    Columns of these names in the input are replaced.
    """
    documents = documents.drop("n_bytes", "n_removed", "n_spans", "kept")
    ranges = written(removed_ranges(documents, length, seed), "ranges")
    table = bit_table(ranges, "__id", "__version")
    keyed = documents.select("*", F.col("doc_id").cast("long").alias("__id"), version().alias("__version"))
    keyed = keyed.withColumn("__bit", place("__id", "__version"))
    n, names = len(documents.columns), documents.columns
    text_at = names.index("text")

    def split(chosen: bool):
        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = table[batch.column(n + 2).to_numpy()]
                yield batch.filter(pa.array(hit == chosen)).select(list(range(n + 2)))
        return keyed.mapInArrow(known, T.StructType(keyed.schema.fields[:n + 2]))

    touched = split(True).join(ranges.withColumnRenamed("ranges", "__ranges").withColumnRenamed("__id", "__of_id").withColumnRenamed("__version", "__of_version").hint("merge"),
                               (F.col("__id") == F.col("__of_id")) & (F.col("__version") == F.col("__of_version")), "left").drop("__of_id", "__of_version")
    whole = split(False).withColumn("__ranges", F.lit(None).cast("array<long>"))
    both = touched.unionByName(whole).drop("__id", "__version")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, spans, kept = [], [], [], []
            lists = batch.column(n)
            bounds, values, valid = lists.offsets.to_numpy(), lists.values.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            data, offsets = K.texts(batch.column(text_at))
            for k in range(batch.num_rows):
                own = data[offsets[k]:offsets[k + 1]]
                total.append(len(own))
                if not valid[k]:
                    gone.append(0)
                    spans.append(0)
                    kept.append(own.tobytes())
                    continue
                at = values[bounds[k]:bounds[k + 1]]
                cover = np.zeros(len(own) + 1, np.int64)
                np.add.at(cover, at >> 24, 1)
                np.add.at(cover, (at >> 24) + (at & 0xFF) + length, -1)
                removed = np.cumsum(cover[:-1]) > 0
                gone.append(int(removed.sum()))
                spans.append(int(removed[0]) + int((removed[1:] & ~removed[:-1]).sum()))
                kept.append(own[~removed].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(x, pa.int64()) for x in (total, gone, spans)), pa.array(kept, pa.binary())],
                                             [*names, "n_bytes", "n_removed", "n_spans", "kept"])

    schema = T.StructType([*documents.schema.fields, *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    return both.mapInArrow(rewrite, schema)
