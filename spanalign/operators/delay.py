"""Capture latency: measure per session, compare a candidate with a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanalign.fixed import IMPROVED, INCOMPLETE, NOT_IMPROVED
from spanalign.functions import instants
from spanalign.operators.scoring import marker_recall

REQUIRED = ("mismatches", "utterances", "first_delta_ms", "first_completed_ms")
METRICS = (
    "first_audio_ms", "first_delta_ms", "first_completed_ms", "utterances", "mismatches", "recall",
)
_LOWEST = -(2**63)


def first_latencies(events: DataFrame) -> DataFrame:
    """First row of each kind in row order: its offset and the clock it came from."""
    latency = F.coalesce("monotonic_offset_ms", "audio_offset_ms")
    row = F.struct(
        latency.alias("ms"), instants.timing_source(F.col("monotonic_offset_ms")).alias("source")
    )

    def first(kind: str):
        return F.min_by(F.when(F.col("kind") == kind, row), F.when(F.col("kind") == kind, F.col("seq")))

    picked = events.groupBy("session_id").agg(
        first("delta").alias("d"), first("completed").alias("c")
    )
    return picked.select(
        "session_id",
        F.col("d.ms").alias("first_delta_ms"),
        F.coalesce("d.source", F.lit("missing")).alias("first_delta_source"),
        F.col("c.ms").alias("first_completed_ms"),
        F.coalesce("c.source", F.lit("missing")).alias("first_completed_source"),
    )


def evaluate_delay(
    sessions: DataFrame, transcript: DataFrame, final: DataFrame, ui_events: DataFrame
) -> DataFrame:
    """Latencies, alignment counts and marker recall of every session.

    ``final`` holds the final segments (``text``, ``mismatch``); a session without any has NULL
    counts and recall 0.
    """
    counted = final.groupBy("session_id").agg(
        F.count("*").alias("utterances"), F.count("mismatch").alias("mismatches")
    ).withColumn(
        "status", F.when(F.col("mismatches") == 0, "aligned").otherwise("aligned-with-review-warnings")
    )
    seen = ui_events.groupBy("session_id").agg(F.count("*").alias("event_count"))
    joined = (
        sessions.join(first_latencies(transcript), "session_id", "left")
        .join(counted, "session_id", "left")
        .join(marker_recall(final).select("session_id", F.col("found").alias("recall")),
              "session_id", "left")
        .join(seen, "session_id", "left")
    )
    missing = F.lit("missing")
    return joined.select(
        "session_id", "delay",
        (F.col("first_chunk_ms") - F.col("rec_started_ms")).alias("first_audio_ms"),
        (F.col("audio_started_ms") - F.col("rec_started_ms")).alias("audio_start_ms"),
        "first_delta_ms", F.coalesce("first_delta_source", missing).alias("first_delta_source"),
        "first_completed_ms",
        F.coalesce("first_completed_source", missing).alias("first_completed_source"),
        "status", "utterances", "mismatches",
        F.coalesce("recall", F.lit(0)).cast("bigint").alias("recall"), "event_count",
    )


def compare_delay(baseline: DataFrame, candidate: DataFrame, key: str = "pair_id") -> DataFrame:
    """Deltas (candidate minus baseline) and the decision for every pair.

    A missing first-audio metric counts as the smallest value, as an absent value sorts first; it is
    not among the required metrics.
    """
    b = baseline.select(key, *[F.col(c).alias(f"b_{c}") for c in METRICS])
    c = candidate.select(key, F.col("status").alias("c_status"), *[F.col(m).alias(f"c_{m}") for m in METRICS])
    joined = b.join(c, key)
    complete = F.lit(True)
    for metric in REQUIRED:
        complete = complete & F.col(f"b_{metric}").isNotNull() & F.col(f"c_{metric}").isNotNull()
    lowest = F.lit(_LOWEST).cast("bigint")
    quality = (
        (F.col("c_mismatches") <= F.col("b_mismatches"))
        & (F.col("c_utterances") >= F.col("b_utterances"))
        & F.coalesce(F.col("c_status") == "aligned", F.lit(False))
    )
    faster = (
        (F.col("c_first_delta_ms") < F.col("b_first_delta_ms"))
        | (F.col("c_first_completed_ms") < F.col("b_first_completed_ms"))
        | (F.coalesce("c_first_audio_ms", lowest) < F.coalesce("b_first_audio_ms", lowest))
    )
    better = F.coalesce(quality & faster, F.lit(False))
    pick = lambda incomplete, yes, no: F.when(~complete, incomplete).when(better, yes).otherwise(no)
    return joined.select(
        key,
        *[(F.col(f"c_{m}") - F.col(f"b_{m}")).alias(f"{m}_delta") for m in METRICS],
        pick("inconclusive", "candidate-lower-latency-needs-operator-review", "keep-current-default")
        .alias("status"),
        pick("keep-current-default", "operator-review-before-default-change", "keep-current-default")
        .alias("recommendation"),
        pick(INCOMPLETE, IMPROVED, NOT_IMPROVED).alias("reason"),
    )


def capture_stats(stream: DataFrame) -> DataFrame:
    """Totals per session of routed stream rows (also used as a streaming aggregate)."""
    kind = F.col("route")
    count = lambda k: F.count_if(kind == k).cast("bigint")
    return stream.groupBy("session_id").agg(
        count("audio").alias("audio_chunks"),
        F.coalesce(F.sum(F.when(kind == "audio", F.col("bytes"))), F.lit(0)).alias("audio_bytes"),
        F.count_if(kind != "audio").cast("bigint").alias("messages"),
        count("delta").alias("deltas"), count("completed").alias("completed"),
        count("error").alias("errors"),
    )




#: Events that close a capture, and those that tell what became of its last bytes, the latest first.
CLOSING = ("not-needed", "send-failed", "awaiting-acknowledgement")
OUTCOMES = ("unacknowledged", "acknowledged", "not-needed", "send-failed", "awaiting-acknowledgement")


def capture_totals(stats: DataFrame, commits: DataFrame) -> DataFrame:
    """`capture_stats` with the number of commits, the bytes pending at the end and the final status.

    ``commits``: events of `streaming.live.live_commits`.  A capture that has not closed is ``open`` and
    has all bytes pending that no commit sent.
    """
    event, size = F.col("event"), F.col("bytes")
    told = commits.groupBy("session_id").agg(
        F.count_if(event == "commit").alias("audio_commits"),
        F.sum(F.when(event == "commit", size)).alias("sent"),
        F.max(F.when(event.isin(*CLOSING), size)).alias("pending"),
        *[F.max(F.when(event == name, name)).alias(f"e_{i}") for i, name in enumerate(OUTCOMES)],
    )
    zero = F.lit(0).cast("bigint")
    return stats.join(told, "session_id", "left").select(
        *stats.columns, F.coalesce("audio_commits", zero).alias("audio_commits"),
        F.coalesce("pending", F.col("audio_bytes") - F.coalesce("sent", zero)).alias("pending_bytes"),
        F.coalesce(*[F.col(f"e_{i}") for i in range(len(OUTCOMES))], F.lit("open")).alias("final_commit"),
    )
