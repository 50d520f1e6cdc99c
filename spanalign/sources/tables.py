"""Session tables derived from the given Parquet tables.

The same derivations are written as SQL in ``spanalign.plans.sql`` for the cross-check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanalign.functions import instants, text as tx
from spanalign.operators.prefix import BLOCK_MS, row_block, running
from spanalign.operators.segments import assemble_segments
from spanalign.session import written

MS_PER_WORD = 400
DENSE_STEP_MS = 2_500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrated_text(conv: Column, turn: Column, text: Column) -> Column:
    """Conversation text with spoken markers and action phrases mixed in by position."""
    slot = turn % 8
    opening = (
        F.when(slot == 1, "Alpha marker. ").when(slot == 3, "Bravo marker. ")
        .when(slot == 5, "Kilo marker. ").otherwise("")
    )
    pick = (conv + turn) % 6
    closing = (
        F.when(pick == 1, " Then I clicked save.").when(pick == 2, " I opened the menu.")
        .when(pick == 3, " My password is correct horse battery.")
        .when(pick == 4, " Submit it, then press close.").otherwise("")
    )
    return F.when((conv + turn) % 13 == 7, "  ").otherwise(F.concat(opening, text, closing))


def transcript_rows(conversations: DataFrame) -> DataFrame:
    """Row-local part of the transcript table (also used on streams)."""
    conv, turn = F.col("conv_id"), F.col("turn")
    return conversations.select(
        conv.alias("session_id"),
        turn.cast("bigint").alias("seq"),
        F.when((F.col("role") == "system") | (conv % 10 == 0), "delta").otherwise("completed")
        .alias("kind"),
        narrated_text(conv, turn, F.col("text")).alias("text"),
    )


def transcript_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcript_rows(table(spark, sf_dir, "conversations"))
    words = tx.word_count(F.col("text"))
    timed = running(
        rows, ["session_id"], row_block("seq"), ["seq"], sums={"words_before": words}
    )
    offset = (MS_PER_WORD * (F.col("words_before") + words)).cast("bigint")
    return timed.select(
        "session_id", "seq", "kind",
        offset.alias("audio_offset_ms"),
        F.when(F.col("seq") % 3 != 0, offset - 120).alias("monotonic_offset_ms"),
        "text",
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    user = F.col("session_id")
    spans = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id")).agg(
        F.min(ms).alias("base_ms"), F.max(ms).alias("last_ms"), F.count("*").alias("n_events")
    )
    return spans.select(
        "session_id",
        "base_ms",
        F.when(user % 11 != 5, F.col("base_ms")).alias("audio_started_ms"),
        F.when(user % 4 != 0, F.col("base_ms") + 40).alias("first_chunk_ms"),
        F.when(user % 13 != 7, F.col("base_ms") - (user % 9) * 1000).alias("rec_started_ms"),
        F.when(
            user % 3 != 0, F.col("base_ms") + F.col("n_events") * DENSE_STEP_MS + 5000
        ).alias("rec_ended_ms"),
        F.when(user % 5 != 0, "stopped").otherwise("recording").alias("state"),
        F.when(user % 2 == 0, "high").otherwise("low").alias("delay"),
        F.when(user % 6 != 0, user % 7).alias("drain_completed"),
        F.when(user % 4 != 1, user % 3).alias("drain_observed"),
        F.when(user % 10 == 0, 1).otherwise(0).cast("bigint").alias("drain_errors"),
    )


def event_details() -> dict[str, Column]:
    """Row-local UI fields of one event row."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    titles = ["Cancel changes", "Main window", "Settings - General", "Close tab", "", None]
    return {
        "kind": F.col("event_type"),
        "app": F.concat(F.lit("app"), (k % 5).cast("string")),
        "window": F.element_at(
            F.array(*[F.lit(t) for t in titles]), (k % 6 + 1).cast("int")
        ),
        "ui_hint": F.when(F.col("event_type") == "click", "Save document")
        .when(F.col("event_type") == "error", "Delete row")
        .when(F.col("event_type") == "view", F.concat(F.lit("row "), k.cast("string"))),
    }


def ui_events(spark: SparkSession, sf_dir: str, anchors: DataFrame | None = None) -> DataFrame:
    """UI events on a dense clock: one every 2.5 s from the first event of the session.

    ``anchors`` is the session table, when it is at hand already.
    """
    raw = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"),
        *[c.alias(n) for n, c in event_details().items()],
    )
    numbered = running(
        raw, ["session_id"], F.floor(F.col("at_us") / (BLOCK_MS * 1000)).cast("bigint"),
        ["at_us", "event_id"], sums={"earlier": F.lit(1)},
    ).withColumn("seq", (F.col("earlier") + 1).cast("bigint"))
    base = (anchors or sessions(spark, sf_dir)).select("session_id", "base_ms")
    ms = F.col("base_ms") + (F.col("seq") - 1) * DENSE_STEP_MS + F.col("event_id") % 1000
    raw_ts = (
        F.when(F.col("event_id") % 17 == 0, F.lit(None).cast("string"))
        .when(F.col("event_id") % 19 == 0, "bad-date")
        .otherwise(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    )
    return (
        numbered.join(base, "session_id")
        .withColumn("ts_raw", raw_ts)
        .select(
            "session_id", "seq", "event_id", "kind", "ts_raw",
            instants.parse_utc_ms(F.col("ts_raw")).alias("unix_ms"),
            instants.timestamp_status(F.col("ts_raw")).alias("ts_status"),
            "app", "window", "ui_hint",
        )
    )


# --- tables that feed several branches of one query: written once per query ---

def shared_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(transcript_events(spark, sf_dir), "transcript")


def shared_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(assemble_segments(shared_transcript(spark, sf_dir)), "segments")


def shared_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, ui events, sessions)."""
    anchors = written(sessions(spark, sf_dir), "sessions")
    return (
        shared_segments(spark, sf_dir),
        written(ui_events(spark, sf_dir, anchors), "ui-events"),
        anchors,
    )


def shared_capture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(transcript, segments, ui events, sessions) for queries that read the ui events once: these are not written."""
    anchors = written(sessions(spark, sf_dir), "sessions")
    heard = shared_transcript(spark, sf_dir)
    return heard, written(assemble_segments(heard), "segments"), ui_events(spark, sf_dir, anchors), anchors
