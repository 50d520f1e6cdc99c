"""Cleaned text back onto timed segments.

Everything except the monotonic token match itself is joins, aggregates and windows; joins of token tables are
merge joins by hint, as their size does not show in that of the files they come from.  The match is
a dynamic program, a small kernel on one row per session; a session beyond the usual number of
cells is cut at anchors first and has a row per stretch, so recordings of any length are aligned in
bounded memory.  All of this is for sessions too large for one row; the others are aligned by
`operators.sessionwise`, with the same results.  `alignment_limits` reports sessions beyond the usual limits; none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanalign import fixed
from spanalign.fixed import LOW_FALLBACK, LOW_SIMILARITY, MARKER_UNSEEN, NO_SOURCE, TRAILING
from spanalign.functions import checks, sensitive, text as tx
from spanalign.functions.similarity import phrase_similarity
from spanalign.operators import anchors, sessionwise
from spanalign.operators.allocation import allocate
from spanalign.operators.fuzzy import dictionary_pairs, similar_tokens, symmetric_pairs
from spanalign.operators.prefix import row_block, running
from spanalign.operators.utterances import utterances
from spanalign.session import written

FINAL_SCHEMA = (
    "session_id", "id", "start_ms", "end_ms", "text", "confidence", "source_segment_ids", "mismatch",
)


# --- limits ---

def alignment_limits(segments: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Sizes per session and the limit a session breaks (NULL when it can be aligned)."""
    longest = F.array_max(F.transform(tx.extract_all(F.col("text"), tx.ASCII_TOKEN), F.length))
    spoken = segments.groupBy("session_id").agg(
        F.sum(tx.token_count(F.col("text"))).alias("realtime_tokens"),
        F.sum(F.octet_length("text")).alias("realtime_bytes"),
        F.max(longest).alias("realtime_longest"),
        F.count("*").alias("segments"),
    )
    text = F.col("cleaned_text")
    written = cleaned.select(
        "session_id",
        tx.token_count(text).alias("cleaned_tokens"),
        F.octet_length(text).cast("bigint").alias("cleaned_bytes"),
        F.array_max(F.transform(tx.extract_all(text, tx.ASCII_TOKEN), F.length)).alias("cleaned_longest"),
    )
    cells = (F.col("cleaned_tokens") + 1) * (F.col("realtime_tokens") + 1)
    side = fixed.MAX_ALIGNMENT_TOKENS_PER_SIDE
    size = fixed.MAX_ALIGNMENT_TEXT_BYTES_PER_SIDE
    broken = (
        F.when((F.col("cleaned_bytes") > size) | (F.col("realtime_bytes") > size), "text-bytes")
        .when(
            F.greatest("cleaned_longest", "realtime_longest") > fixed.MAX_ALIGNMENT_TOKEN_BYTES,
            "token-bytes",
        )
        .when((F.col("cleaned_tokens") > side) | (F.col("realtime_tokens") > side), "tokens")
        .when(cells > fixed.MAX_ALIGNMENT_CELLS, "cells")
        .when(F.col("segments") > fixed.TRANSCRIPT_MAX_ROWS, "segments")
    )
    return written.join(spoken, "session_id").select(
        "session_id", "cleaned_tokens", "realtime_tokens", cells.alias("cells"),
        broken.alias("limit_broken"),
    )


# --- token tables ---

def realtime_tokens(segments: DataFrame) -> DataFrame:
    """(session_id, segment_id, place, token): tokens of the segments, place within the segment."""
    return segments.select(
        "session_id", "segment_id",
        F.posexplode(tx.tokens_ascii(F.col("text"))).alias("place", "token"),
    )


def cleaned_tokens(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(
        "session_id", F.posexplode(tx.tokens_ascii(F.col("cleaned_text"))).alias("place", "token")
    )


# --- the kernel ---

def monotonic_match(left: np.ndarray, right: np.ndarray, alike: list[np.ndarray]) -> np.ndarray:
    """For each left token the right token of a longest monotonic match, or -1.

    Tokens are numbers; ``alike[x]`` holds the right tokens that match the left token ``x``.
    """
    place, masks = sessionwise.places(right.tolist()), {}
    for value in set(left.tolist()):
        masks[value] = 0
        for other in alike[value].tolist():
            masks[value] |= place.get(other, 0)
    return np.array(sessionwise.longest_match(left.tolist(), masks, len(right)), dtype=np.int64)


def _numbered(left: list[str], right: list[str], pairs: list[dict]):
    """Tokens as numbers, and the matching right tokens of each left one."""
    l_ids, l_at = np.unique(np.asarray(left, dtype=object), return_inverse=True)
    r_ids, r_at = np.unique(np.asarray(right, dtype=object), return_inverse=True)
    l_of, r_of = ({t: k for k, t in enumerate(ids)} for ids in (l_ids, r_ids))
    alike: list[list[int]] = [[] for _ in l_ids]
    for p in pairs:
        alike[l_of[p["left_token"]]].append(r_of[p["right_token"]])
    return l_at, r_at, [np.array(x, dtype=np.int64) for x in alike]


def _match_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            found = monotonic_match(*_numbered(list(row.cleaned), list(row.realtime), list(row.pairs)))
            hit = np.flatnonzero(found >= 0)
            yield pd.DataFrame({
                "session_id": np.repeat(row.session_id, len(hit)),
                "cleaned_idx": row.base + hit,
                "segment_idx": np.asarray(row.segment_of, dtype=np.int64)[found[hit]],
            })


def _whole(text: DataFrame, segs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both token lists of a session and its similar pairs in one row."""
    spoken = segs.groupBy("session_id").agg(
        F.array_sort(F.collect_list(
            F.struct("segment_id", tx.tokens_ascii(F.col("text")).alias("tokens"))
        )).alias("segs")
    ).select(
        "session_id",
        F.flatten(F.transform("segs", lambda s: s["tokens"])).alias("realtime"),
        F.flatten(F.transform(
            "segs", lambda s, i: F.transform(s["tokens"], lambda t: i)
        )).alias("segment_of"),
    )
    of_session = pairs.groupBy("session_id").agg(
        F.collect_list(F.struct("left_token", "right_token")).alias("pairs")
    )
    rows = text.select(
        "session_id", F.lit(0).cast("bigint").alias("base"),
        tx.tokens_ascii(F.col("cleaned_text")).alias("cleaned"),
    )
    return rows.join(spoken.hint("merge"), "session_id").join(of_session.hint("merge"), "session_id")


def _in_stretches(text: DataFrame, segs: DataFrame, pairs: DataFrame, spacing: int) -> DataFrame:
    """The same for each stretch between two anchors of a session."""
    left = text.select("session_id", tx.tokens_ascii(F.col("cleaned_text")).alias("tokens"))
    spoken = segs.select(
        "session_id", (F.col("segment_id") - 1).cast("bigint").alias("segment_of"),
        tx.tokens_ascii(F.col("text")).alias("tokens"),
    )
    spoken = written(running(
        spoken, ["session_id"], row_block("segment_of"), ["segment_of"], sums={"base": F.size("tokens")}
    ), "spoken")
    cut = written(anchors.cuts(left, spoken, spacing=spacing), "cuts")
    lefts = written(anchors.left_stretches(left, cut), "stretches")
    rights = written(anchors.right_stretches(spoken, cut, "segment_of"), "stretches")
    at = ["session_id", "stretch"]
    said = lefts.select(*at, F.explode(F.array_distinct("tokens")).alias("left_token"))
    heard = rights.select(*at, F.explode(F.array_distinct("tokens")).alias("right_token"))
    own = said.join(pairs.hint("merge"), ["session_id", "left_token"]).join(heard.hint("merge"), [*at, "right_token"], "left_semi")
    own = own.groupBy(*at).agg(F.collect_list(F.struct("left_token", "right_token")).alias("pairs"))
    rows = lefts.withColumnRenamed("tokens", "cleaned").join(rights.withColumnRenamed("tokens", "realtime").hint("merge"), at)
    return rows.join(own.hint("merge"), at).select("session_id", "base", "cleaned", "realtime", "segment_of", "pairs")


def token_alignment(
    segments: DataFrame, cleaned: DataFrame, fits: DataFrame, pairs: DataFrame | None = None,
    most_cells: int = fixed.MAX_ALIGNMENT_CELLS, spacing: int = anchors.SPACING,
) -> DataFrame:
    """(session_id, cleaned_idx, segment_idx) of all matched cleaned tokens.

    ``segment_idx`` is the 0-based position of the segment; ``fits`` holds the ids of the sessions
    to align, ``pairs`` their similar tokens if they are known.  A session whose two sides multiply to
    more than ``most_cells`` is cut at anchors (`operators.anchors`) and its stretches are matched as
    rows of their own; smaller ones are matched whole, so their match is a longest one.
    """
    segs = segments.join(fits, "session_id", "left_semi")
    text = cleaned.join(fits, "session_id", "left_semi")
    if pairs is None:
        pairs = similar_tokens(cleaned_tokens(text), realtime_tokens(segs))
    sides = segs.groupBy("session_id").agg(F.sum(tx.token_count(F.col("text"))).alias("m")).join(
        text.select("session_id", tx.token_count(F.col("cleaned_text")).cast("bigint").alias("n")), "session_id"
    )
    long = written(sides.where((F.col("n") + 1) * (F.col("m") + 1) > most_cells).select("session_id"), "long")
    schema = "session_id bigint, cleaned_idx bigint, segment_idx bigint"
    if long.isEmpty():
        return _whole(text, segs, pairs).mapInPandas(_match_batches, schema)
    whole, cut = ({
        "text": text.join(long, "session_id", how), "segs": segs.join(long, "session_id", how),
        "pairs": pairs.join(long, "session_id", how),
    } for how in ("left_anti", "left_semi"))
    rows = _whole(**whole).unionByName(_in_stretches(**cut, spacing=spacing))
    return rows.mapInPandas(_match_batches, schema)


# --- marker anchors ---

def spoken_labels(segments: DataFrame) -> DataFrame:
    """(session_id, segment_idx, label) for every marker label a segment carries or hints at.

    A label is always a token of its own, also in front of the word marker, so each text is cut into
    tokens once and the list of labels is intersected with them (see `text.label_seen` for one label).
    """
    said = segments.select(
        "session_id", (F.col("segment_id") - 1).alias("segment_idx"),
        F.explode(F.array(tx.tokens_ascii(F.col("text")))).alias("tokens"),
    )
    tokens = F.col("tokens")
    padded = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    aliases = F.array_compact(F.array(
        F.when(F.array_contains(tokens, "keyhole"), "kilo"), F.when(F.array_contains(tokens, "mic"), "mike"),
        F.when(padded.contains(" pop a "), "papa"),
    ))
    labels = F.array(*[F.lit(x) for x in fixed.MARKER_LABELS])
    return said.select(
        "session_id", "segment_idx", F.explode(F.array_union(F.array_intersect(labels, tokens), aliases)).alias("label"),
    )


def first_label_at_or_after(wanted: DataFrame, spoken: DataFrame) -> DataFrame:
    """Forward as-of search: first segment at or after ``from_idx`` that carries the label.

    Both sides are put on one line per (session, label) and a running value is carried backwards,
    so a label that is spoken very often causes no pair explosion.
    """
    queries = wanted.select(
        "session_id", "label", (-F.col("from_idx")).alias("back"), F.lit(1).alias("side"),
        "utterance_id", F.lit(None).cast("bigint").alias("found"),
    )
    marks = spoken.select(
        "session_id", "label", (-F.col("segment_idx")).alias("back"), F.lit(0).alias("side"),
        F.lit(None).cast("bigint").alias("utterance_id"), (-F.col("segment_idx")).alias("found"),
    )
    lined = running(
        queries.unionByName(marks), ["session_id", "label"], row_block("back"),
        ["back", "side"], maxes={"nearest": F.col("found")},
    )
    return lined.where("side = 1 and nearest is not null").select(
        "session_id", "utterance_id", (-F.col("nearest")).alias("marker_idx")
    )


# --- utterances on segments ---

def utterance_mismatch(
    confidence: Column, has_source: Column, label: Column, label_found: Column
) -> Column:
    unseen = label.isNotNull() & ~F.coalesce(label_found, F.lit(False))
    return (
        F.when(~has_source, NO_SOURCE).when(confidence < 0.3, LOW_SIMILARITY)
        .when(unseen & (confidence < 0.6), MARKER_UNSEEN)
    )


def proportional_edge(start: Column, end: Column, at: Column, total: Column) -> Column:
    """Point at the share ``at / total`` of a window, in whole milliseconds."""
    span = F.greatest(end - start, F.lit(0))
    return start + F.call_function("div", span * at, F.greatest(total, F.lit(1)))


def clamp_forward(rows: DataFrame, order: str) -> DataFrame:
    """Make (start_ms, end_ms) run forwards: no start before the end of any earlier row."""
    ordered = running(
        rows, ["session_id"], None, [order],
        maxes={"reached": F.greatest("start_ms", "end_ms")},
    )
    start = F.greatest("start_ms", F.coalesce("reached", F.lit(0)))
    return ordered.withColumns({
        "start_ms": start, "end_ms": F.greatest(F.col("end_ms"), start)
    }).drop("reached")


def _range_hits(spans: DataFrame, said: DataFrame, heard: DataFrame) -> DataFrame:
    """(session_id, utterance_id, hits): how many spoken tokens of each utterance's range resemble one of its own.

    ``said`` holds the spoken tokens that would count (``session_id, utterance_id, token``), ``heard`` the spoken
    ones (``session_id, segment_idx, token``).  Every token has one line of counts per segment with the edges of
    the ranges between; two running counts answer a range, however many segments it has.
    """
    counted = heard.groupBy("session_id", "token", "segment_idx").agg(F.count("*").alias("n"))
    edges = said.join(spans.select("session_id", "utterance_id", "first_idx", "last_idx").hint("merge"), ["session_id", "utterance_id"]).select(
        "session_id", "token", "utterance_id",
        F.explode(F.array(
            F.struct((F.col("first_idx") - 1).alias("segment_idx"), F.lit(-1).alias("sign")),
            F.struct(F.col("last_idx").alias("segment_idx"), F.lit(1).alias("sign")),
        )).alias("edge"),
    ).select("session_id", "token", "utterance_id", "edge.segment_idx", "edge.sign", F.lit(0).cast("bigint").alias("n"))
    line = edges.unionByName(counted, allowMissingColumns=True)
    # counts of a segment come before the edges behind it
    up_to = running(
        line, ["session_id", "token"], row_block("segment_idx"),
        ["segment_idx", F.col("sign").isNotNull(), "utterance_id", "sign"], sums={"before": F.col("n")},
    )
    return up_to.where("sign is not null").groupBy("session_id", "utterance_id").agg(
        F.sum(F.col("before") * F.col("sign")).alias("hits")
    )


def _labels_in_range(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """(session_id, utterance_id) of the utterances whose label is heard within their range."""
    tokens = segments.select(
        "session_id", (F.col("segment_id") - 1).alias("segment_idx"), tx.tokens_ascii(F.col("text")).alias("t"),
    ).where(F.size("t") > 0)
    # "pop" at the end of one segment and "a" at the start of the next one that has tokens
    lined = running(tokens, ["session_id"], row_block("segment_idx"), ["segment_idx"], lags={
        "last_token": F.element_at("t", -1), "last_segment": F.col("segment_idx"),
    })
    crossing = lined.where((F.col("last_token") == "pop") & (F.element_at("t", 1) == "a")).select(
        "session_id", "segment_idx", F.lit("pop a").alias("label")
    )
    wanted = spans.where("marker_label is not null").select(
        "session_id", (F.col("utterance_id") * 2).alias("utterance_id"), F.col("marker_label").alias("label"),
        F.col("first_idx").alias("from_idx"),
    )
    # a crossing counts only if both of its segments are in the range
    split = spans.where("marker_label = 'papa'").select(
        "session_id", (F.col("utterance_id") * 2 + 1).alias("utterance_id"), F.lit("pop a").alias("label"),
        (F.col("first_idx") + 1).alias("from_idx"),
    )
    found = first_label_at_or_after(wanted.unionByName(split), spoken_labels(segments).unionByName(crossing))
    found = found.withColumn("utterance_id", F.call_function("div", F.col("utterance_id"), F.lit(2).cast("bigint")))
    return found.join(spans.select("session_id", "utterance_id", "last_idx"), ["session_id", "utterance_id"]).where(
        F.col("marker_idx") <= F.col("last_idx")
    ).select("session_id", "utterance_id").distinct()


def _covered(spans: DataFrame, segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Phrase evidence of each utterance over all segments between its first and last source.

    ``pairs`` holds the similar pairs (``session_id, left_token, right_token``) from spoken to cleaned tokens.
    No utterance is spread over its segments: counts and edges of a range are looked up at its two ends.
    """
    spans = written(spans, "ranges")
    at = ["session_id", "utterance_id"]
    own = tx.tokens_ascii(F.col("text"))
    said = spans.select(*at, F.explode(F.array_distinct(own)).alias("right_token")).join(
        pairs.hint("merge"), ["session_id", "right_token"]
    ).select(*at, F.col("left_token").alias("token")).distinct()
    heard = realtime_tokens(segments).select("session_id", (F.col("segment_id") - 1).alias("segment_idx"), "token")
    counts = segments.select(
        "session_id", (F.col("segment_id") - 1).alias("segment_idx"), "start_ms", "end_ms",
        tx.token_count(F.col("text")).cast("bigint").alias("n"),
    )
    counts = written(running(
        counts, ["session_id"], row_block("segment_idx"), ["segment_idx"], sums={"before": F.col("n")}
    ), "counts")
    first = counts.select("session_id", F.col("segment_idx").alias("first_idx"), F.col("before").alias("from_token"),
                          F.col("start_ms").alias("source_start"))
    last = counts.select("session_id", F.col("segment_idx").alias("last_idx"), (F.col("before") + F.col("n")).alias("to_token"),
                         F.col("end_ms").alias("source_end"))
    labelled = _labels_in_range(spans, segments).withColumn("label_found", F.lit(True))
    rows = (
        spans.select(*at, "first_idx", "last_idx", F.size(own).alias("said_tokens"))
        .join(first, ["session_id", "first_idx"]).join(last, ["session_id", "last_idx"])
        .join(_range_hits(spans, said, heard), at, "left").join(labelled, at, "left")
        .withColumn("spoken_tokens", F.col("to_token") - F.col("from_token"))
    )
    phrase = (
        F.when((F.col("spoken_tokens") == 0) & (F.col("said_tokens") == 0), F.lit(1.0))
        .when((F.col("spoken_tokens") == 0) | (F.col("said_tokens") == 0), F.lit(0.0))
        .otherwise(F.coalesce("hits", F.lit(0)) / F.col("spoken_tokens"))
    )
    return rows.select(
        *at, F.coalesce("label_found", F.lit(False)).alias("label_found"), "source_start", "source_end",
        phrase.alias("phrase_confidence"),
    )


def align_utterances(
    spans: DataFrame, segments: DataFrame, cleaned: DataFrame, fits: DataFrame
) -> DataFrame:
    """Final segments of sessions with two utterances or more."""
    segs = segments.join(fits, "session_id", "left_semi")
    text = cleaned.join(fits, "session_id", "left_semi")
    alike = written(symmetric_pairs(cleaned_tokens(text), realtime_tokens(segs)), "alike")
    listed = dictionary_pairs(cleaned_tokens(text), realtime_tokens(segs))
    matched = token_alignment(segments, cleaned, fits, alike.unionByName(listed).distinct())
    # the dictionary is directed, so it is asked once more from the spoken side
    spoken_pairs = alike.select("session_id", F.col("right_token").alias("left_token"), F.col("left_token").alias("right_token")).unionByName(
        dictionary_pairs(realtime_tokens(segs), cleaned_tokens(text)))
    places = spans.where("token_end > token_start").select(
        "session_id", "utterance_id",
        F.explode(F.sequence(F.col("token_start"), F.col("token_end") - 1)).alias("cleaned_idx"),
    )
    sourced = places.join(matched.hint("merge"), ["session_id", "cleaned_idx"]).groupBy(
        "session_id", "utterance_id"
    ).agg(
        F.count("*").alias("matched"), F.min("segment_idx").alias("lo"), F.max("segment_idx").alias("hi")
    )
    based = written(spans.join(sourced, ["session_id", "utterance_id"], "left"), "sourced")
    wanted = based.where("marker_label is not null").select(
        "session_id", "utterance_id", F.col("marker_label").alias("label"),
        F.coalesce("lo", F.lit(0)).cast("bigint").alias("from_idx"),
    )
    anchored = written(based.join(
        first_label_at_or_after(wanted, spoken_labels(segs)), ["session_id", "utterance_id"], "left"
    ).withColumns({
        "first_idx": F.least("lo", "marker_idx"), "last_idx": F.greatest("hi", "marker_idx"),
    }), "anchored")
    evidence = _covered(anchored.where("first_idx is not null"), segs, spoken_pairs)
    whole = segs.groupBy("session_id").agg(
        F.min_by("start_ms", "segment_id").alias("session_start"),
        F.max_by("end_ms", "segment_id").alias("session_end"),
    )
    total = spans.groupBy("session_id").agg(F.max("token_end").alias("total_tokens"))
    joined = (
        anchored.join(evidence, ["session_id", "utterance_id"], "left")
        .join(whole, "session_id").join(total, "session_id")
    )
    has_source = F.col("first_idx").isNotNull()
    edge = [
        proportional_edge(F.col("session_start"), F.col("session_end"), F.col(c), F.col("total_tokens"))
        for c in ("token_start", "token_end")
    ]
    tokens = F.greatest(F.col("token_end") - F.col("token_start"), F.lit(1))
    confidence = F.greatest(
        F.coalesce("matched", F.lit(0)) / tokens, F.coalesce("phrase_confidence", F.lit(0.0))
    )
    placed = joined.withColumns({
        "start_ms": F.when(has_source, F.col("source_start")).otherwise(edge[0]),
        "end_ms": F.when(has_source, F.col("source_end")).otherwise(F.greatest(edge[1], edge[0])),
        "confidence": confidence,
    })
    clamped = clamp_forward(placed, "utterance_id")
    ids = F.when(
        has_source, F.sequence(F.col("first_idx") + 1, F.col("last_idx") + 1)
    ).otherwise(F.array().cast("array<bigint>"))
    return clamped.select(
        "session_id", F.col("utterance_id").alias("id"), "start_ms", "end_ms", "text", "confidence",
        ids.alias("source_segment_ids"),
        utterance_mismatch(
            F.col("confidence"), has_source, F.col("marker_label"), F.col("label_found")
        ).alias("mismatch"),
    )


# --- proportional fallback ---

def align_fallback(segments: DataFrame, cleaned: DataFrame, fits: DataFrame) -> DataFrame:
    """Final segments of sessions whose cleaned text is at most one utterance.

    The words are dealt block by block (`operators.allocation`); segments behind the last word get
    empty text.
    """
    t = F.col("text")
    segs = written(segments.join(fits, "session_id", "left_semi").select(
        "session_id", "segment_id", "start_ms", "end_ms", tx.tokens_ascii(t).alias("tokens"),
        tx.semantic_word_count(t).alias("words"),
    ), "segments")
    text = cleaned.join(segs, "session_id", "left_semi").select(
        "session_id", tx.split_words(F.col("cleaned_text")).alias("cleaned_words")
    )
    given, ends = allocate(segs, text)
    filled = segs.join(text.select("session_id"), "session_id", "left_semi").join(
        given, ["session_id", "segment_id"], "left"
    ).withColumn("text", F.coalesce("text", F.lit("")))
    confidence = phrase_similarity(F.col("tokens"), tx.tokens_ascii(F.col("text")))
    floor = F.when(F.greatest("words", F.lit(1)) <= 3, 0.25).otherwise(0.35)
    placed = filled.withColumn("confidence", confidence).select(
        "session_id", F.col("segment_id").alias("id"), "start_ms", "end_ms", "text", "confidence",
        F.array("segment_id").alias("source_segment_ids"),
        F.when(F.col("confidence") < floor, LOW_FALLBACK).alias("mismatch"),
    )
    edges = segs.groupBy("session_id").agg(F.count("*").alias("n_segments"), F.max("end_ms").alias("last_end"))
    rest = text.join(ends, "session_id").where(F.col("end") < F.size("cleaned_words")).join(edges, "session_id")
    trailing = rest.select(
        "session_id", (F.col("n_segments") + 1).alias("id"), F.col("last_end").alias("start_ms"),
        F.col("last_end").alias("end_ms"),
        F.array_join(F.slice("cleaned_words", (F.col("end") + 1).cast("int"), F.size("cleaned_words")), " ")
        .alias("text"),
        F.lit(0.0).alias("confidence"), F.array("n_segments").alias("source_segment_ids"),
        F.lit(TRAILING).alias("mismatch"),
    )
    return placed.unionByName(trailing)


def align_cleaned(segments: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Final segments of all sessions: by utterance, else proportionally.

    A session is a row of its own (`operators.sessionwise`); those too large for that are aligned by joins and windows.
    """
    beyond = written(sessionwise.beyond(segments, cleaned), "beyond")
    if beyond.isEmpty():
        return sessionwise.final_segments(segments, cleaned)
    parts = {how: [df.join(beyond, "session_id", how) for df in (segments, cleaned)] for how in ("left_anti", "left_semi")}
    return sessionwise.final_segments(*parts["left_anti"]).unionByName(align_in_parts(*parts["left_semi"]))


def align_in_parts(segments: DataFrame, cleaned: DataFrame) -> DataFrame:
    """`align_cleaned` by joins and windows, whatever the size of a session.

    The steps feed several branches each, so they are written to the shared folder once instead of
    being computed again per branch.
    """
    fits = cleaned.select("session_id").join(segments, "session_id", "left_semi")
    spans = written(utterances(cleaned.join(segments, "session_id", "left_semi")), "utterances")
    several = spans.groupBy("session_id").agg(F.count("*").alias("n")).where("n >= 2").select("session_id")
    by_utterance = align_utterances(
        spans.join(several, "session_id", "left_semi"), segments, cleaned, several
    )
    rest = fits.join(several, "session_id", "left_anti")
    return by_utterance.unionByName(align_fallback(segments, cleaned, rest))


def final_status(final: DataFrame) -> DataFrame:
    """Unresolved mismatches and the resulting status of each aligned session."""
    counted = final.groupBy("session_id").agg(
        F.count("*").alias("utterances"), F.count("mismatch").alias("mismatches")
    )
    return counted.withColumn(
        "status", F.when(F.col("mismatches") == 0, "aligned").otherwise("aligned-with-review-warnings")
    )


def final_timeline(final: DataFrame) -> DataFrame:
    """Shape of the final timeline rows: redacted text and the strategy label."""
    return final.select(
        "session_id", "id", "start_ms", "end_ms",
        sensitive.redact_text(F.col("text")).alias("text"),
        "confidence", "source_segment_ids", "mismatch",
        F.lit("aligned-final-cleaned").alias("source"),
        F.when(F.size("source_segment_ids") > 1, "monotonic-token-window")
        .otherwise("monotonic-token-single-window").alias("alignment_strategy"),
    )


def verified_receipts(
    receipts: DataFrame, artifacts: DataFrame, bound: list[str], required: dict[str, str]
) -> DataFrame:
    """Sessions whose receipt holds the required values and equals the artifact digests it names.

    ``receipts`` and ``artifacts`` hold ``session_id, fields MAP<STRING,STRING>``; ``bound`` lists
    the entries that must be equal on both sides, ``required`` the values the receipt must carry.
    """
    joined = receipts.select("session_id", F.col("fields").alias("r")).join(
        artifacts.select("session_id", F.col("fields").alias("a")), "session_id"
    )
    rules = {
        f"value:{k}": F.element_at("r", F.lit(k)) == v for k, v in required.items()
    } | {"binding": checks.fields_equal(F.col("r"), F.col("a"), bound)}
    return joined.withColumn("failures", checks.failing(rules)).select("session_id", "failures")
