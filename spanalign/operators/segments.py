"""Transcript events to time-stamped segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanalign import fixed
from spanalign.functions import instants, text as tx
from spanalign.operators.prefix import row_block, running

SEGMENT_COLUMNS = (
    "session_id", "segment_id", "start_ms", "end_ms", "monotonic_offset_ms", "timing_source", "text",
)


def timed_events(events: DataFrame) -> DataFrame:
    """Events with their effective offset and the label of the clock it came from."""
    return events.withColumns({
        "offset_ms": instants.effective_offset(
            F.col("monotonic_offset_ms"), F.col("audio_offset_ms")
        ),
        "timing_source": instants.timing_source(F.col("monotonic_offset_ms")),
    })


def is_segment_row():
    """Completed rows with text; everything else never becomes a segment by itself."""
    return (F.col("kind") == "completed") & ~tx.is_blank(F.col("text"))


def completed_segments(events: DataFrame) -> DataFrame:
    """One segment per completed row, numbered in row order, spans never running backwards."""
    kept = timed_events(events).where(is_segment_row())
    ordered = running(
        kept,
        ["session_id"],
        row_block("seq"),
        ["seq"],
        sums={"earlier": F.lit(1)},
        maxes={"previous_end": F.col("offset_ms")},
    )
    start = F.coalesce(F.col("previous_end"), F.lit(0)).cast("bigint")
    return ordered.select(
        "session_id",
        (F.col("earlier") + 1).cast("bigint").alias("segment_id"),
        start.alias("start_ms"),
        F.greatest("offset_ms", start).alias("end_ms"),
        "monotonic_offset_ms",
        "timing_source",
        tx.squeeze(F.col("text")).alias("text"),
    )


def delta_only_sessions(events: DataFrame) -> DataFrame:
    """Sessions without any segment row, with the size of their delta text (pre-aggregated)."""
    return (
        events.groupBy("session_id")
        .agg(
            F.count_if(is_segment_row()).alias("segment_rows"),
            F.sum(F.when(F.col("kind") == "delta", F.octet_length("text"))).alias("delta_bytes"),
        )
        .where((F.col("segment_rows") == 0) & (F.col("delta_bytes") > 0))
        .select("session_id", "delta_bytes")
    )


def delta_fallback(events: DataFrame) -> DataFrame:
    """One segment from all deltas of a session that has no completed text.

    The joined text is one cell, whatever its length; :func:`oversize_delta_sessions` reports the
    sessions whose text is above the text limit.
    """
    eligible = delta_only_sessions(events)
    deltas = timed_events(events).where(F.col("kind") == "delta").join(
        eligible.select("session_id"), "session_id", "left_semi"
    )
    piece = F.when(F.col("text") != "", F.struct("seq", "text"))
    joined = deltas.groupBy("session_id").agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"),
        F.max_by(F.struct("offset_ms", "monotonic_offset_ms", "timing_source"), "seq").alias("last"),
    )
    text = tx.squeeze(F.array_join(F.transform("pieces", lambda p: p["text"]), ""))
    return joined.select(
        "session_id",
        F.lit(1).cast("bigint").alias("segment_id"),
        F.lit(0).cast("bigint").alias("start_ms"),
        F.col("last.offset_ms").alias("end_ms"),
        F.col("last.monotonic_offset_ms").alias("monotonic_offset_ms"),
        F.col("last.timing_source").alias("timing_source"),
        text.alias("text"),
    ).where(~tx.is_blank(F.col("text")))


def oversize_delta_sessions(
    events: DataFrame, max_bytes: int = fixed.TRANSCRIPT_TEXT_MAX_BYTES
) -> DataFrame:
    """Flag only: the sessions are assembled all the same."""
    return delta_only_sessions(events).where(F.col("delta_bytes") > max_bytes)


def assemble_segments(events: DataFrame) -> DataFrame:
    """All segments of all sessions: completed rows, else the delta fallback."""
    return completed_segments(events).unionByName(delta_fallback(events))


def select_authoritative(segments: DataFrame, final: DataFrame, verified: DataFrame) -> DataFrame:
    """Aligned segments for sessions whose receipts verify, raw segments for all others.

    ``final`` holds ``session_id, id, start_ms, end_ms, text``; ``verified`` the session ids.
    """
    sessions = verified.select("session_id").distinct()
    trusted = final.join(sessions, "session_id", "left_semi").select(
        "session_id",
        F.col("id").cast("bigint").alias("segment_id"),
        "start_ms",
        "end_ms",
        F.col("end_ms").alias("monotonic_offset_ms"),
        F.lit(fixed.ALIGNED_SOURCE).alias("timing_source"),
        "text",
    )
    raw = segments.join(
        final.join(sessions, "session_id", "left_semi").select("session_id").distinct(),
        "session_id",
        "left_anti",
    ).select(*SEGMENT_COLUMNS)
    return trusted.unionByName(raw)


def monotonic_policy(segments: DataFrame) -> DataFrame:
    """Per session: how many segments carry a process-local offset."""
    counted = segments.groupBy("session_id").agg(
        F.count("monotonic_offset_ms").alias("monotonic_segments")
    )
    return counted.withColumn(
        "monotonic_status",
        F.when(F.col("monotonic_segments") == 0, "not-captured").otherwise(
            "process-local-offsets-captured"
        ),
    )


def limit_flags(events: DataFrame, ui_events: DataFrame, segments: DataFrame) -> DataFrame:
    """Per-session size limits as flags instead of a failing job."""
    transcript = events.groupBy("session_id").agg(
        F.count("*").alias("transcript_rows"),
        F.count_if(F.octet_length("text") > fixed.TRANSCRIPT_TEXT_MAX_BYTES).alias("oversize_texts"),
        F.sum(F.octet_length("text")).alias("transcript_bytes"),
    )
    recorded = ui_events.groupBy("session_id").agg(F.count("*").alias("event_rows"))
    counted = segments.groupBy("session_id").agg(F.count("*").alias("segment_rows"))
    joined = (
        transcript.join(recorded, "session_id", "left")
        .join(counted, "session_id", "left")
        .na.fill(0, ["event_rows", "segment_rows"])
    )
    work = F.col("segment_rows") * F.col("event_rows")
    return joined.select(
        "session_id", "transcript_rows", "transcript_bytes", "event_rows", "segment_rows",
        work.alias("work_items"),
        (F.col("oversize_texts") > 0).cast("bigint").alias("oversize_text"),
        (
            (F.col("transcript_rows") > fixed.TRANSCRIPT_MAX_ROWS)
            | (F.col("transcript_bytes") > fixed.TRANSCRIPT_MAX_BYTES)
            | (F.col("event_rows") > fixed.EVENT_MAX_ROWS)
            | (work > fixed.MAX_ALIGNMENT_WORK_ITEMS)
        ).cast("bigint").alias("oversize_session"),
    )
