"""N-gram Jaccard join: all links between documents whose shingle sets are alike, and their groups.

The document by n-gram incidence matrix ``A`` is multiplied with its transpose block by block: a task holds
a block of n-grams (columns) with the documents of each, as ordered pairs ``(n-gram, document)``.  The
columns of every document are taken in one global order, the known frequent n-grams last.  Two sets of
sizes m and n with ``J >= t`` share at least ``b = ceil(t (m + n) / (1 + t))`` n-grams, so

* they meet in the first ``n - ceil(t n) + 1`` columns of either: only this block of ``A`` is multiplied;
* a pair met at places i and j can still reach ``1 + min(m - i, n - j)`` (places from 1 count those used
  up): it is discarded if that, or the smaller size, is below ``b``.

The overlap of a remaining pair is accumulated over the block, the pair is discarded if the columns beyond
cannot make up for what is missing, and else accumulated over all columns and compared exactly.

Groups need no list of all pairs.  Sets that are equal are one node.  In every column the document that comes
first (fewest rare n-grams before it, so the most central one) is compared with the others; pairs that this
links are one component, and only pairs of different components that meet in a column are compared after
that.  Every pair that could be linked is thus either compared or already in one component, so the components
are exact, while a column with thousands of near copies gives thousands of pairs, not millions.

Shape on a cluster: texts are scanned for set digests and frequent n-grams, for the columns, and once for the
sets of the documents that remain in each round of comparisons (found with a bit table of ``FILTER_BITS``,
which is a fixed size; false hits fall out in the join).  The one large shuffle carries a quarter of the
n-grams.  ``FREQUENT`` n-grams are broadcast at most, a fixed number.  Which n-grams count as frequent only
changes the order of columns, never the result.

Edge cases: a text without words has an empty set and is linked with nothing; with fewer words than a shingle
the whole sequence is its one shingle; rows with a null ``doc_id`` get a null component and link nothing;
repeated rows have equal sets and so one component; empty tables give an empty result.  Other columns are
ignored.  Sets and n-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanalign.llm import kernels as K
from spanalign.llm.graph import connected_components
from spanalign.session import written

WORDS, PERCENT = 5, 75
FREQUENT = 1 << 19
#: Shingles whose repetitions are counted together before they are added up by Spark.
BLOCK = 1 << 22
FILTER_BITS = 22


def _digest(shingles: np.ndarray) -> int:
    """Digest of a set, as a signed long; 0 is the empty set."""
    return int((K.mix(shingles + np.uint64(7)).sum(dtype=np.uint64) + np.uint64(len(shingles))).view(np.int64)) if len(shingles) else 0


def _sets(batch: pa.RecordBatch, words: int, kept: K.Powers) -> Iterator[np.ndarray]:
    for _, data, offsets in K.slices(batch.column(batch.schema.get_field_index("text"))):
        yield from K.shingle_sets(data, offsets, words, kept)


def _facts(documents: DataFrame, words: int) -> DataFrame:
    """Rows ``(0, doc_id, digest, size)`` of all documents and ``(1, n-gram, count, null)`` of n-grams that
    distinct sets of one block share."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, seen, held, size = K.Powers(), set(), [], 0

        def repeated() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            values, counts = values[counts > 1], counts[counts > 1]
            n = len(values)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(K.signed(values)), pa.array(counts), pa.nulls(n, pa.int64())], ["kind", "a", "b", "c"])

        for batch in batches:
            digests, sizes = [], []
            for s in _sets(batch, words, kept):
                digests.append(_digest(s))
                sizes.append(len(s))
                if digests[-1] not in seen:
                    seen.add(digests[-1])
                    held.append(s)
                    size += len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int32)), batch.column(0), pa.array(digests, pa.int64()), pa.array(sizes, pa.int64())], ["kind", "a", "b", "c"])
            if size > BLOCK:
                yield repeated()
                held, size = [], 0
        if held:
            yield repeated()

    return documents.mapInArrow(scan, "kind int, a long, b long, c long")


def _frequent(facts: DataFrame) -> np.ndarray:
    """At most ``FREQUENT`` n-grams, the most frequent last."""
    counts = facts.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n"))
    step = F.floor(4 * F.log2("n"))
    chosen, total = F.lit(False), 0
    for s, n in sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True):
        if total + n > FREQUENT:
            # a part of those that are equally frequent, by the upper bits of their hashes
            part = int((FREQUENT - total) / n * (1 << 16))
            chosen = chosen | ((step == s) & (F.shiftrightunsigned("a", 48) < part))
            break
        total, chosen = total + n, step >= s

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            yield pa.record_batch({"rows": pa.array([both.tobytes()], pa.binary())})

    parts = counts.where(chosen).select("a", "n").mapInArrow(packed, "rows binary").collect()
    grams, n = np.concatenate([np.zeros((2, 0), np.int64), *(np.frombuffer(r.rows, np.int64).reshape(2, -1) for r in parts)], axis=1)
    return grams[np.lexsort((grams, n))][-FREQUENT:].view(np.uint64)


def _columns(documents: DataFrame, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """The block of the matrix that is multiplied: ``gram, node, size, place``."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, seen = K.Powers(), set()
        by_value = np.argsort(frequent)
        sorted_frequent = frequent[by_value]
        maybe = np.zeros(1 << 22, bool)
        maybe[K.bucket(frequent, 22)] = True
        for batch in batches:
            grams, nodes, sizes, places = [], [], [], []
            for s in _sets(batch, words, kept):
                node, n = _digest(s), len(s)
                if not n or node in seen:
                    continue
                seen.add(node)
                look = np.flatnonzero(maybe[K.bucket(s, 22)])
                if len(look):
                    at = np.minimum(np.searchsorted(sorted_frequent, s[look]), len(frequent) - 1)
                    hit = sorted_frequent[at] == s[look]
                    rank = by_value[at[hit]]
                    rare = np.ones(n, bool)
                    rare[look[hit]] = False
                    s = np.concatenate([s[rare], frequent[np.sort(rank)]])
                taken = s[:n + (-percent * n // 100) + 1]
                grams.append(taken)
                nodes.append(node)
                sizes.append(n)
                places.append(len(taken))
            if grams:
                counts = np.array(places)
                yield pa.record_batch({
                    "gram": K.signed(np.concatenate(grams)), "node": np.repeat(np.array(nodes, np.int64), counts),
                    "size": np.repeat(np.array(sizes, np.int64), counts),
                    "place": np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)})

    return documents.mapInArrow(emit, "gram long, node long, size long, place long")


def _shared(columns: DataFrame) -> DataFrame:
    """The rows of columns with two nodes or more, each beside the column's first row (the hub)."""
    ordered = columns.repartition("gram").sortWithinPartitions("gram", "place", F.desc("size"), "node")
    names = ["gram", "node", "size", "place"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)  # the first row of the last column, while it is alone
        hub, last = None, None  # of the last column, once it has been passed on
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(k).to_numpy() for k in range(4)])], axis=1)
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
            if last is not None:
                new[0] = (rows[0, 0], rows[1, 0]) != last
            if not rows.shape[1]:
                continue
            rows = rows[:, new]
            if not rows.shape[1]:
                continue
            begins = np.ones(rows.shape[1], bool)
            begins[1:] = rows[0, 1:] != rows[0, :-1]
            going_on = hub is not None and rows[0, 0] == hub[0]
            group = np.cumsum(begins) - 1
            first = np.flatnonzero(begins)
            hubs = rows[:, first]
            if going_on:
                hubs[:, 0] = hub
            several = np.bincount(group) > 1
            several[0] |= going_on
            chosen = several[group]
            if several[-1]:
                held, hub, last = rows[:, :0], hubs[:, -1], (rows[0, -1], rows[1, -1])
            else:
                held, hub, last = rows[:, -1:], None, None
            if chosen.any():
                of = hubs[:, group[chosen]]
                yield pa.record_batch(dict(zip([*names, "hub", "hub_size", "hub_place"], [*rows[:, chosen], *of[1:]])))

    return ordered.mapInArrow(emit, "gram long, node long, size long, place long, hub long, hub_size long, hub_place long")


def _need(m: Column, n: Column, percent: int) -> Column:
    """N-grams that sets of sizes m and n must share."""
    return F.floor((percent * (m + n) + (99 + percent)) / (100 + percent))


def _possible(m: Column, i: Column, n: Column, j: Column, percent: int) -> Column:
    """Whether sets of sizes m and n that meet at places i and j can share as many n-grams as a link needs."""
    need = _need(m, n, percent)
    return (F.least(m, n) >= need) & (F.least(m - i, n - j) >= need)


def _accumulated(shared: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose overlap in the multiplied block leaves a link possible.

    Beyond the block of one of the two, at most its remaining n-grams can be shared.
    """
    x = shared.select("gram", F.col("node").alias("a"), F.col("size").alias("m"))
    y = shared.select("gram", F.col("node").alias("b"), F.col("size").alias("n"))
    # pairs grow with the corpus: one plan at every size, no broadcast for small inputs only
    counted = pairs.hint("merge").join(x, "a").join(y.hint("merge"), ["gram", "b"]).groupBy("a", "b", "m", "n").agg(F.count("*").alias("both"))
    rest = F.ceil(percent * F.greatest("m", "n") / 100) - 1
    return counted.where(F.col("both") + rest >= _need(F.col("m"), F.col("n"), percent)).select("a", "b")


def _sets_of(documents: DataFrame, facts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``node, shingles`` of the given nodes, each from the first document that has the set."""
    first = facts.where("kind = 0").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("doc_id"))
    nodes = written(nodes.join(first, "node"), "nodes")
    key = F.xxhash64("doc_id")
    place = F.shiftrightunsigned(key, 64 - FILTER_BITS).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(doc_id), {64 - FILTER_BITS}) & 63 as int))")
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for at, bits in nodes.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit)).collect():
        table[at] = bits
    wanted = np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = K.Powers()
        for batch in batches:
            chosen = batch.filter(pa.array(wanted[batch.column(2).to_numpy()]))
            found = list(_sets(chosen, words, kept))
            yield pa.RecordBatch.from_arrays([chosen.column(0), pa.array(map(_digest, found), pa.int64()), pa.array(map(K.signed, found), pa.list_(pa.int64()))], ["doc_id", "node", "shingles"])

    every = documents.select("doc_id", "text", place.alias("place")).mapInArrow(emit, "doc_id long, node long, shingles array<long>")
    return written(every.join(nodes, ["node", "doc_id"]).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")


def _links(documents: DataFrame, facts: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the ``pairs`` (``a, b``) those that are alike enough.  Nodes in many pairs had better be ``b``."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets_of(documents, facts, nodes, words)
    a, b = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    overlap = F.size(F.array_intersect("of_a", "of_b"))
    counted = pairs.join(a, "a").join(b, "b").select("a", "b", overlap.alias("both"), (F.size("of_a") + F.size("of_b") - overlap).alias("either"))
    return counted.where(100 * F.col("both") >= percent * F.col("either")).select("a", "b")


def _across(shared: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components that meet in a column and may be alike.

    Of each column, the rows outside its largest component meet all rows: no pair within that component is
    looked at.
    """
    rows = shared.select("gram", "node", "size", "place").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = rows.groupBy("gram", "component").count()
    mixed = parts.groupBy("gram").agg(F.max(F.struct("count", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    rows = written(rows.join(mixed.select("gram", F.col("main.component").alias("main")), "gram"), "columns")
    x = rows.where("component <> main").select("gram", *(F.col(c).alias(f"x_{c}") for c in ("node", "component", "size", "place")))
    y = rows.select("gram", "main", *(F.col(c).alias(f"y_{c}") for c in ("node", "component", "size", "place")))
    met = x.join(y, "gram").where("x_component <> y_component and (y_component = main or x_node < y_node)").where(
        _possible(F.col("x_size"), F.col("x_place"), F.col("y_size"), F.col("y_place"), percent))
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def similar_groups(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: documents linked, directly or over others, by a
    Jaccard similarity of at least ``percent`` / 100 have the same component, named by its smallest id."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts = written(_facts(documents, words), "facts")
    known = documents.where("doc_id is not null")
    shared = written(_shared(_columns(known, _frequent(facts), words, percent)), "shared")

    near_hub = shared.where("node <> hub").where(_possible(F.col("size"), F.col("place"), F.col("hub_size"), F.col("hub_place"), percent))
    first = written(near_hub.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    likely = written(_accumulated(shared, first, percent), "pairs")
    links = written(_links(known, facts, likely, words, percent), "links")
    tried = first.union(first.select("b", "a"))
    second = written(_across(shared, connected_components(links), percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    likely = written(_accumulated(shared, second, percent), "pairs")
    components = connected_components(links.union(_links(known, facts, likely, words, percent)))

    rows = facts.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("node"), F.col("c").alias("n_shingles"))
    rows = rows.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = rows.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = rows.join(least, "component", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("least")))
    return named.select("doc_id", "n_shingles", own.alias("component_id"))


def one_of_each_group(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without those that have a smaller id in their group; of rows with one id, one stays."""
    own = documents.columns
    keep = similar_groups(documents, words, percent).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    known = documents.join(keep, documents["doc_id"] == keep["__kept"]).dropDuplicates(["__kept"]).select(*own)
    return known.unionByName(documents.where("doc_id is null"))
