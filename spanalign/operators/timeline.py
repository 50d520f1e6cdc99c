"""Segments against UI events: alignment, confidence, diagnostics, conflicts, notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanalign import fixed
from spanalign.functions import instants, sensitive, text as tx
from spanalign.operators.bands import band_pairs, nearest_points

CLOCKED_CEILING = "wall-clock timestamp-window alignment; monotonic drift proof still owed"
UNCLOCKED_CEILING = "no alignment without an audio start"


def with_anchor(segments: DataFrame, sessions: DataFrame) -> DataFrame:
    """Segments with the audio start of their session (NULL allowed) and their wall-clock middle.

    The join strategy is left to the optimizer: it broadcasts the session table only when its
    measured size allows it, and splits a session that holds a large share of the segments.
    """
    anchors = sessions.select("session_id", "audio_started_ms")
    return segments.join(anchors, "session_id", "left").withColumn(
        "mid_ms",
        instants.midpoint(F.col("audio_started_ms"), F.col("start_ms"), F.col("end_ms")),
    )


def align_events(
    segments: DataFrame,
    events: DataFrame,
    sessions: DataFrame,
    window_ms: int = fixed.ALIGNMENT_WINDOW_MS,
) -> DataFrame:
    """Flat alignment table: every (segment, event) pair within the window, with its confidence."""
    left = with_anchor(segments, sessions).select(
        "session_id", "segment_id", "start_ms", "end_ms", "mid_ms"
    )
    pairs = band_pairs(
        left, events.drop("ts_raw", "ts_status"), "mid_ms", "unix_ms", window_ms
    )
    return pairs.withColumn("confidence", instants.confidence_band(F.col("delta_ms")))


def _points(segments: DataFrame, events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Segment middles and event instants on one time line, merged per (session, instant)."""
    false = F.lit(False)
    middles = with_anchor(segments, sessions).where(F.col("mid_ms").isNotNull()).select(
        "session_id", F.col("mid_ms").alias("at_ms"),
        F.lit(True).alias("segment"), false.alias("event"), false.alias("cancel"),
        F.lit(1).alias("segments"), F.lit(0).alias("events"),
    )
    marks = events.where(F.col("unix_ms").isNotNull()).select(
        "session_id", F.col("unix_ms").alias("at_ms"),
        false.alias("segment"), F.lit(True).alias("event"),
        tx.has_cancel_label(F.col("ui_hint"), F.col("window")).alias("cancel"),
        F.lit(0).alias("segments"), F.lit(1).alias("events"),
    )
    return nearest_points(
        middles.unionByName(marks), "at_ms", ["segment", "event", "cancel"], ["segments", "events"]
    )


def segment_neighbours(segments: DataFrame, events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Segments with the distance to the nearest event and to the nearest cancel-like event.

    Distances are NULL without an audio start or without events; no pair is ever built.
    """
    nearest = _points(segments, events, sessions).where("segment").select(
        "session_id", F.col("at_ms").alias("mid_ms"), "near_event", "near_cancel"
    )
    return with_anchor(segments, sessions).join(nearest, ["session_id", "mid_ms"], "left")


def aligned_segments(
    segments: DataFrame,
    events: DataFrame,
    sessions: DataFrame,
    window_ms: int = fixed.ALIGNMENT_WINDOW_MS,
) -> DataFrame:
    """Segments with at least one event in the window, and their best confidence."""
    return (
        segment_neighbours(segments, events, sessions)
        .where(F.col("near_event") <= window_ms)
        .withColumn("best_confidence", instants.confidence_band(F.col("near_event")))
    )


def out_of_window_events(
    segments: DataFrame,
    events: DataFrame,
    sessions: DataFrame,
    window_ms: int = fixed.ALIGNMENT_WINDOW_MS,
) -> DataFrame:
    """Timed events of clocked sessions without any segment in the window."""
    far = (
        _points(segments, events, sessions)
        .where(F.col("event") & ~(F.coalesce(F.col("near_segment") <= window_ms, F.lit(False))))
        .select("session_id", F.col("at_ms").alias("unix_ms"))
    )
    clocked = sessions.where(F.col("audio_started_ms").isNotNull()).select("session_id")
    return events.join(far, ["session_id", "unix_ms"], "left_semi").join(
        clocked, "session_id", "left_semi"
    )


def nearby_events(pairs: DataFrame, limit: int = fixed.NEARBY_LIMIT) -> DataFrame:
    """The first ``limit`` nearby events of each segment in event order.

    The rank filter is applied before the shuffle as well, so a crowded segment stays cheap.
    """
    order = Window.partitionBy("session_id", "segment_id").orderBy("seq")
    return pairs.withColumn("nearby_rank", F.row_number().over(order)).where(
        F.col("nearby_rank") <= limit
    )


def _conflict_reason(
    window_ms: int, commit_words: Sequence[str] = fixed.COMMIT_WORDS
) -> Column:
    """Why the nearest events of an action segment do not support it (NULL if they do)."""
    unseen = ~F.coalesce(F.col("near_event") <= window_ms, F.lit(False))
    contradicted = tx.claims_commit(F.col("text"), commit_words) & (
        F.col("near_cancel") <= window_ms
    )
    return (
        F.when(F.col("audio_started_ms").isNull(), "missing-audio-anchor")
        .when(unseen, "no-nearby-event")
        .when(contradicted, "nearby-ui-label-mismatch")
    )


def conflict_warnings(
    segments: DataFrame,
    events: DataFrame,
    sessions: DataFrame,
    window_ms: int = fixed.ALIGNMENT_WINDOW_MS,
    action_words: Sequence[str] = fixed.ACTION_WORDS,
    commit_words: Sequence[str] = fixed.COMMIT_WORDS,
) -> DataFrame:
    """Action segments that no nearby event supports, or that a cancel-like event contradicts."""
    acting = segments.where(tx.mentions_action(F.col("text"), action_words))
    near = segment_neighbours(acting, events, sessions)
    return near.withColumn("reason", _conflict_reason(window_ms, commit_words)).where(F.col("reason").isNotNull()).select(
        "session_id", "segment_id", "start_ms", "end_ms", "text", "reason",
        F.lit("needs-ui-evidence").alias("severity"),
    )


def conflict_events(warnings: DataFrame, pairs: DataFrame) -> DataFrame:
    """The <= 4 events shown with each mismatch warning, text fields redacted."""
    mismatched = warnings.where(F.col("reason") == "nearby-ui-label-mismatch").select(
        "session_id", "segment_id"
    )
    shown = nearby_events(pairs.join(mismatched, ["session_id", "segment_id"], "left_semi"))
    return shown.select(
        "session_id", "segment_id", "nearby_rank", "event_id", "kind", "app",
        sensitive.redact_text(F.col("window")).alias("window"),
        sensitive.redact_text(F.col("ui_hint")).alias("ui_hint"),
    )


# --- diagnostics ---

def duplicate_segments(segments: DataFrame) -> DataFrame:
    """Segments whose normalized text appeared earlier in the session, with the earliest one.

    The earliest id comes from a partial aggregate on a text digest, so a sentence repeated very
    often does not end up in one window partition.
    """
    keyed = segments.withColumn("text_key", F.sha2(tx.normalized_text(F.col("text")), 256))
    first = keyed.groupBy("session_id", "text_key").agg(F.min("segment_id").alias("duplicate_of"))
    return (
        keyed.join(first, ["session_id", "text_key"])
        .where(F.col("segment_id") > F.col("duplicate_of"))
        .drop("text_key")
    )


def duplicate_counts(segments: DataFrame) -> DataFrame:
    """Duplicates per session without joining them back."""
    per_text = segments.groupBy(
        "session_id", F.sha2(tx.normalized_text(F.col("text")), 256).alias("text_key")
    ).agg((F.count("*") - 1).alias("extra"))
    return per_text.groupBy("session_id").agg(F.sum("extra").alias("duplicate_segments"))


def timestamp_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(
        F.count_if(F.col("ts_status") == "invalid").alias("malformed_timestamps"),
        F.count_if(F.col("ts_status") == "missing").alias("missing_timestamps"),
    )


def band_counts(
    segments: DataFrame,
    events: DataFrame,
    sessions: DataFrame,
    window_ms: int = fixed.ALIGNMENT_WINDOW_MS,
) -> DataFrame:
    """Per session: aligned segments by best confidence, and out-of-window events."""
    points = _points(segments, events, sessions)
    best = instants.confidence_band(F.col("near_event"))
    hit = F.col("near_event") <= window_ms

    def total(column: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(column))), F.lit(0))

    return points.groupBy("session_id").agg(
        total("segments", hit).alias("aligned_segments"),
        total("segments", hit & (best == "high")).alias("high_segments"),
        total("segments", hit & (best == "medium")).alias("medium_segments"),
        total("segments", hit & (best == "low")).alias("low_segments"),
        total(
            "events", ~F.coalesce(F.col("near_segment") <= window_ms, F.lit(False))
        ).alias("far_events"),
    )


def alignment_diagnostics(
    segments: DataFrame, events: DataFrame, sessions: DataFrame
) -> DataFrame:
    """One row of counters and labels per session of the session table."""
    bands = band_counts(segments, events, sessions).select("session_id", "far_events")
    clocked = F.col("audio_started_ms").isNotNull()
    skew = F.col("rec_started_ms") - F.col("audio_started_ms")
    joined = (
        sessions.select("session_id", "audio_started_ms", "rec_started_ms")
        .join(timestamp_counts(events), "session_id", "left")
        .join(bands, "session_id", "left")
        .join(duplicate_counts(segments), "session_id", "left")
    )
    zero = F.lit(0)
    return joined.select(
        "session_id",
        (~clocked).cast("bigint").alias("missing_audio_clock"),
        F.col("rec_started_ms").isNull().cast("bigint").alias("missing_recording_start"),
        F.coalesce("malformed_timestamps", zero).alias("malformed_timestamps"),
        F.coalesce("missing_timestamps", zero).alias("missing_timestamps"),
        F.when(clocked, F.coalesce("far_events", zero)).otherwise(zero)
        .alias("out_of_window_events"),
        skew.alias("start_delta_ms"),
        instants.clock_skew_status(skew).alias("clock_skew_status"),
        F.lit(fixed.CLOCK_SKEW_WARNING_MS).cast("bigint").alias("clock_skew_warning_ms"),
        F.coalesce("duplicate_segments", zero).alias("duplicate_segments"),
        F.when(clocked, CLOCKED_CEILING).otherwise(UNCLOCKED_CEILING).alias("claim_ceiling"),
    )


def session_counts(segments: DataFrame, events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Segments, events, aligned segments and conflict warnings per session (one time line for all)."""
    zero, window_ms = F.lit(0), fixed.ALIGNMENT_WINDOW_MS
    conflict = F.when(tx.mentions_action(F.col("text"), fixed.ACTION_WORDS), _conflict_reason(window_ms))
    spoken = segment_neighbours(segments, events, sessions).groupBy("session_id").agg(
        F.count("*").alias("segments"), F.count_if(F.col("near_event") <= window_ms).alias("aligned_segments"),
        F.count(conflict).alias("conflicts"),
    )
    return (
        sessions.select("session_id").join(spoken, "session_id", "left")
        .join(events.groupBy("session_id").agg(F.count("*").alias("events")), "session_id", "left")
        .select("session_id", *[
            F.coalesce(c, zero).alias(c)
            for c in ("segments", "events", "aligned_segments", "conflicts")
        ])
    )


# --- notes ---

def note_lines(segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Readable lines: one per segment, followed by its first nearby events."""
    spoken = segments.select(
        "session_id", "segment_id", F.lit(0).alias("line_no"),
        F.concat(
            F.lit("- ["), instants.format_offset(F.col("start_ms")), F.lit("-"),
            instants.format_offset(F.col("end_ms")), F.lit("] "),
            sensitive.render_untrusted("Transcript segment", F.col("text")),
        ).alias("line"),
    )
    seen = nearby_events(pairs).select(
        "session_id", "segment_id", F.col("nearby_rank").alias("line_no"),
        F.concat_ws(
            "; ",
            F.concat(F.lit("  - Nearby UI: "), sensitive.render_untrusted("Event kind", F.col("kind"))),
            sensitive.render_untrusted("Event app", F.coalesce("app", F.lit("unknown app"))),
            sensitive.render_untrusted("Event window", F.coalesce("window", F.lit("unknown window"))),
        ).alias("line"),
    )
    return spoken.unionByName(seen)


# --- nested document ---

def temporal_context(
    segments: DataFrame,
    events: DataFrame,
    sessions: DataFrame,
) -> DataFrame:
    """One nested document per session: anchors, segments, events, alignments, diagnostics, conflicts.

    A document is one row, whatever its size; the flat tables above hold the same rows for sessions
    that should not be gathered (see `segments.limit_flags`).
    """
    segs, evs = segments, events
    pairs = align_events(segs, evs, sessions)

    def packed(df: DataFrame, name: str, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
        entry = F.struct(*order, *[f for f in fields if f not in order])
        return df.groupBy("session_id").agg(F.array_sort(F.collect_list(entry)).alias(name))

    shown = segs.withColumn(
        "text", sensitive.render_untrusted("Transcript evidence", F.col("text"))
    )
    nearby = pairs.groupBy("session_id", "segment_id", "start_ms", "end_ms").agg(
        F.array_sort(F.collect_list(F.struct(
            "seq", "event_id", "kind", "delta_ms", "confidence", "app", "window", "ui_hint"
        ))).alias("nearby"),
        F.min(F.abs("delta_ms")).alias("closest"),
    ).withColumn("confidence", instants.confidence_band(F.col("closest")))
    warnings = conflict_warnings(segs, evs, sessions).withColumn(
        "text", sensitive.render_untrusted("Transcript evidence", F.col("text"))
    )
    diagnostics = alignment_diagnostics(segs, evs, sessions)
    return (
        sessions.select(
            "session_id",
            F.struct("audio_started_ms", "rec_started_ms").alias("anchors"),
        )
        .join(packed(shown, "segments", [
            "segment_id", "start_ms", "end_ms", "monotonic_offset_ms", "timing_source", "text"
        ], ["segment_id"]), "session_id", "left")
        .join(packed(evs, "events", [
            "seq", "event_id", "kind", "ts_raw", "unix_ms", "ts_status", "app", "window", "ui_hint"
        ], ["seq"]), "session_id", "left")
        .join(packed(nearby, "alignments", [
            "segment_id", "start_ms", "end_ms", "nearby", "confidence"
        ], ["segment_id"]), "session_id", "left")
        .join(packed(warnings, "warnings", [
            "segment_id", "start_ms", "end_ms", "text", "reason", "severity"
        ], ["segment_id"]), "session_id", "left")
        .join(diagnostics.select(
            "session_id",
            F.struct(*[c for c in diagnostics.columns if c != "session_id"]).alias("diagnostics"),
        ), "session_id", "left")
    )


def unwrap_evidence(df: DataFrame) -> DataFrame:
    """Accept a rendered text only when its boundary fields match; strip the label."""
    prefix = "Transcript evidence: [untrusted data] "
    b = F.col("boundary")
    trusted = (
        (b["classification"] == "untrusted-transcript-evidence")
        & (b["consumerPolicy"] == "evidence-only-never-instructions")
        & (b["instructionUse"] == "forbidden")
        & (b["uiProof"] == F.lit(False))
        & F.col("text").startswith(prefix)
    )
    return df.withColumn(
        "evidence", F.when(trusted, F.expr(f"substring(text, {len(prefix) + 1})"))
    )
