"""Sinks: nested context documents, final timelines, notes, evidence reports, packed session files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_temporal_context(context: DataFrame, path: str) -> None:
    """One JSON document per session (row), partitioned by nothing: sessions are spread evenly."""
    context.write.mode("errorifexists").json(path)


def write_final_timeline(timeline: DataFrame, path: str) -> None:
    """Final segments as JSONL, rows of a session in order within a file."""
    timeline.select(
        "session_id",
        F.col("id"), F.col("start_ms").alias("startMs"), F.col("end_ms").alias("endMs"), "text",
        "confidence", F.col("source_segment_ids").alias("sourceRealtimeSegmentIds"), "mismatch",
        "source", F.col("alignment_strategy").alias("alignmentStrategy"),
    ).repartitionByRange("session_id", "id").sortWithinPartitions("session_id", "id").write.mode(
        "errorifexists"
    ).option("ignoreNullFields", False).json(path)


def write_timestamped_notes(lines: DataFrame, path: str) -> None:
    """Note lines as text below ``session_id=...`` folders, in line order.

    Range partitioning on the full order keeps a session's lines in consecutive files even when one
    session is very large.
    """
    order = ["session_id", "segment_id", "line_no"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "session_id", F.col("line").alias("value")
    ).write.mode("errorifexists").partitionBy("session_id").text(path)


def write_evidence_report(report: DataFrame, path: str) -> None:
    report.write.mode("errorifexists").json(path)


# --- packed session files: many sessions in a file, so that files grow with the bytes, not with the sessions ---

def write_packed_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """``session_id, value`` as text, a line behind its session's name and a tab, in the order of the session.

    A session's lines are in one file or in consecutive ones, however many it has.  ``value`` holds no line break.
    """
    by = ["session_id", *order]
    placed = lines.repartitionByRange(*by).sortWithinPartitions(*by)
    name, value = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("session_id", "value"))
    placed.select(F.concat(name, F.lit("\t"), value).alias("value")).write.mode("errorifexists").text(path)


def write_packed_files(files: DataFrame, path: str) -> None:
    """``session_id, name, content``: small files of many sessions, a row each."""
    files.select(F.col("session_id").cast("string"), "name", F.col("content").cast("binary")).write.mode(
        "errorifexists").parquet(path)
