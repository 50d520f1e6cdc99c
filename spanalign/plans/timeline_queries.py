"""Registered queries: segments and their alignment with UI events."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanalign import fixed
from spanalign.functions import instants
from spanalign.operators import segments as sg, timeline as tl
from spanalign.plans import redaction_sql as rs
from spanalign.plans.sql import NON_WS, any_token, band, collapse, mmss, normalized, query
from spanalign.session import written
from spanalign.sources import tables as src


def effective_offset(spark, sf):
    return sg.timed_events(src.transcript_events(spark, sf)).select(
        "session_id", "seq", "offset_ms", "timing_source"
    )


def assemble_segments(spark, sf):
    return sg.assemble_segments(src.shared_transcript(spark, sf))


def completed_segments(spark, sf):
    return sg.completed_segments(src.shared_transcript(spark, sf)).select(
        "session_id", "segment_id", "start_ms", "end_ms"
    )


def delta_fallback(spark, sf):
    return sg.delta_fallback(src.shared_transcript(spark, sf))


def ui_event_fields(spark, sf):
    return src.ui_events(spark, sf)


def segment_anchors(spark, sf):
    segs, _, sess = src.shared_tables(spark, sf)
    return tl.with_anchor(segs, sess).select("session_id", "segment_id", "audio_started_ms", "mid_ms")


def align_events(spark, sf):
    return tl.align_events(*src.shared_tables(spark, sf)).select(
        "session_id", "segment_id", "seq", "event_id", "delta_ms", "confidence"
    )


def aligned_segments(spark, sf):
    return tl.aligned_segments(*src.shared_tables(spark, sf)).select(
        "session_id", "segment_id", "best_confidence", F.col("near_event").alias("closest_ms")
    )


def out_of_window_events(spark, sf):
    return tl.out_of_window_events(*src.shared_tables(spark, sf)).select("session_id", "seq", "unix_ms")


def nearby_events(spark, sf):
    return tl.nearby_events(tl.align_events(*src.shared_tables(spark, sf))).select(
        "session_id", "segment_id", F.col("nearby_rank").cast("bigint").alias("nearby_rank"),
        "event_id", "delta_ms",
    )


def nearby_lists(spark, sf):
    first = tl.nearby_events(tl.align_events(*src.shared_tables(spark, sf)))
    # at most four entries per segment
    listed = first.groupBy("session_id", "segment_id").agg(
        F.array_sort(F.collect_list(F.struct("nearby_rank", "event_id"))).alias("nearby")
    )
    return listed.select(
        "session_id", "segment_id",
        F.array_join(
            F.transform("nearby", lambda e: e["event_id"].cast("string")), ","
        ).alias("event_ids"),
    )


def conflict_warnings(spark, sf):
    return tl.conflict_warnings(*src.shared_tables(spark, sf)).select("session_id", "segment_id", "reason")


def conflict_event_lists(spark, sf):
    segs, evs, sess = src.shared_tables(spark, sf)
    warnings = written(tl.conflict_warnings(segs, evs, sess), "warnings")
    # only segments with such a warning meet their events
    shown = segs.join(warnings.where("reason = 'nearby-ui-label-mismatch'"), ["session_id", "segment_id"], "left_semi")
    return tl.conflict_events(warnings, tl.align_events(shown, evs, sess)).select(
        "session_id", "segment_id", F.col("nearby_rank").cast("bigint").alias("nearby_rank"),
        "event_id", "window", "ui_hint",
    )


def duplicate_segments(spark, sf):
    """Every second segment comes again later, with other white space."""
    segs = src.shared_segments(spark, sf)
    again = segs.where("segment_id % 2 = 0").withColumns({
        "segment_id": F.col("segment_id") + 100000, "text": F.concat(F.lit("  "), "text")})
    return tl.duplicate_segments(segs.unionByName(again)).select("session_id", "segment_id", "duplicate_of")


def duplicate_documents(spark, sf):
    """The same duplicate rule on documents: one source is a session, the id gives the order."""
    docs = src.table(spark, sf, "documents").select(
        F.col("source").alias("session_id"), F.col("doc_id").alias("segment_id"), "text"
    )
    return tl.duplicate_segments(docs).select("session_id", "segment_id", "duplicate_of")


def timestamp_counts(spark, sf):
    return tl.timestamp_counts(src.ui_events(spark, sf))


def clock_skew(spark, sf):
    skew = F.col("rec_started_ms") - F.col("audio_started_ms")
    return src.sessions(spark, sf).select(
        "session_id", skew.alias("skew_ms"), instants.clock_skew_status(skew).alias("status")
    )


def alignment_diagnostics(spark, sf):
    return tl.alignment_diagnostics(*src.shared_tables(spark, sf))


def session_counts(spark, sf):
    return tl.session_counts(*src.shared_tables(spark, sf))


def band_counts(spark, sf):
    return tl.band_counts(*src.shared_tables(spark, sf)).select(
        "session_id", "aligned_segments", "high_segments", "medium_segments", "low_segments"
    )


def monotonic_policy(spark, sf):
    segs = src.shared_segments(spark, sf)
    return sg.monotonic_policy(segs)


def limit_flags(spark, sf):
    segs, evs, _ = src.shared_tables(spark, sf)
    return sg.limit_flags(src.transcript_events(spark, sf), evs, segs)


def temporal_context(spark, sf):
    segs, evs, sess = src.shared_tables(spark, sf)
    context = tl.temporal_context(segs, evs, sess)
    return context.select(
        "session_id",
        F.coalesce(F.size("segments"), F.lit(0)).cast("bigint").alias("segments"),
        F.coalesce(F.size("events"), F.lit(0)).cast("bigint").alias("events"),
        F.coalesce(F.size("alignments"), F.lit(0)).cast("bigint").alias("alignments"),
        F.coalesce(F.size("warnings"), F.lit(0)).cast("bigint").alias("warnings"),
        F.coalesce(F.aggregate(
            F.transform("alignments", lambda a: F.size(a["nearby"]).cast("bigint")),
            F.lit(0).cast("bigint"), lambda acc, n: acc + n,
        ), F.lit(0)).alias("pairs"),
        F.col("diagnostics.out_of_window_events").alias("out_of_window_events"),
        *[F.md5(F.array_join(parts, ",")).alias(name) for name, parts in {
            "segment_digest": F.transform("segments", lambda s: F.concat_ws(":", s["segment_id"], s["start_ms"], s["end_ms"], s["timing_source"])),
            "event_digest": F.transform("events", lambda e: F.concat_ws(":", e["seq"], e["event_id"], e["kind"], e["ts_status"], e["unix_ms"])),
            "pair_digest": F.flatten(F.transform("alignments", lambda a: F.transform(a["nearby"], lambda n: F.concat_ws(
                ":", a["segment_id"], n["seq"], n["event_id"], n["delta_ms"], n["confidence"])))),
            "confidence_digest": F.transform("alignments", lambda a: F.concat_ws(":", a["segment_id"], a["confidence"])),
            "warning_digest": F.transform("warnings", lambda w: F.concat_ws(":", w["segment_id"], w["reason"])),
        }.items()],
    )


def note_lines(spark, sf):
    segs, evs, sess = src.shared_tables(spark, sf)
    return tl.note_lines(segs, tl.align_events(segs, evs, sess)).select(
        "session_id", "segment_id", F.col("line_no").cast("bigint").alias("line_no"), "line"
    )


QUERIES = {
    "note_lines": note_lines,
    "effective_offset": effective_offset,
    "assemble_segments": assemble_segments,
    "completed_segments": completed_segments,
    "delta_fallback": delta_fallback,
    "ui_event_fields": ui_event_fields,
    "segment_anchors": segment_anchors,
    "align_events": align_events,
    "aligned_segments": aligned_segments,
    "out_of_window_events": out_of_window_events,
    "nearby_events": nearby_events,
    "nearby_lists": nearby_lists,
    "conflict_warnings": conflict_warnings,
    "conflict_event_lists": conflict_event_lists,
    "duplicate_segments": duplicate_segments,
    "duplicate_documents": duplicate_documents,
    "timestamp_counts": timestamp_counts,
    "clock_skew": clock_skew,
    "alignment_diagnostics": alignment_diagnostics,
    "session_counts": session_counts,
    "band_counts": band_counts,
    "monotonic_policy": monotonic_policy,
    "limit_flags": limit_flags,
    "temporal_context": temporal_context,
}

_BEST = f"""SELECT session_id, segment_id, min(abs(delta_ms)) AS closest_ms,
  {band('min(abs(delta_ms))')} AS best_confidence FROM pairs GROUP BY session_id, segment_id"""
_RANKED = """SELECT *, row_number() OVER (
  PARTITION BY session_id, segment_id ORDER BY seq) AS nearby_rank FROM pairs"""
_FAR = """SELECT e.session_id, e.seq, e.unix_ms FROM ui_events e
  JOIN sessions s ON s.session_id = e.session_id AND s.audio_started_ms IS NOT NULL
  WHERE e.unix_ms IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pairs p
    WHERE p.session_id = e.session_id AND p.seq = e.seq)"""
_CONFLICTS = f"""SELECT * FROM (SELECT m.session_id, m.segment_id,
    CASE WHEN m.audio_started_ms IS NULL THEN 'missing-audio-anchor'
         WHEN count(p.seq) = 0 THEN 'no-nearby-event'
         WHEN {any_token('m.text', fixed.COMMIT_WORDS)}
              AND bool_or({any_token('p.ui_hint', fixed.CANCEL_WORDS)}
                          OR {any_token('p."window"', fixed.CANCEL_WORDS)})
         THEN 'nearby-ui-label-mismatch' END AS reason
  FROM middles m LEFT JOIN pairs p USING (session_id, segment_id)
  WHERE {any_token('m.text', fixed.ACTION_WORDS)}
  GROUP BY m.session_id, m.segment_id, m.audio_started_ms, m.text) WHERE reason IS NOT NULL"""
_DUPLICATES = f"""SELECT session_id, segment_id, duplicate_of FROM (
  SELECT session_id, segment_id, min(segment_id) OVER (
    PARTITION BY session_id, {normalized('text')}) AS duplicate_of FROM segments)
  WHERE segment_id > duplicate_of"""
_STATUS = """SELECT session_id, count(*) FILTER (ts_status = 'invalid') AS malformed_timestamps,
  count(*) FILTER (ts_status = 'missing') AS missing_timestamps FROM ui_events GROUP BY session_id"""
_SKEW = """CASE WHEN rec_started_ms - audio_started_ms IS NULL THEN 'missing-anchor'
  WHEN abs(rec_started_ms - audio_started_ms) <= 6000 THEN 'within-window'
  ELSE 'exceeds-window' END"""
_EXTRA = {"best": _BEST, "far": _FAR, "conflicts": _CONFLICTS, "dups": _DUPLICATES,
          "status": _STATUS}
_LIMITS = f"""SELECT t.session_id, transcript_rows, transcript_bytes, coalesce(event_rows, 0) AS event_rows,
  coalesce(segment_rows, 0) AS segment_rows,
  coalesce(event_rows, 0) * coalesce(segment_rows, 0) AS work_items,
  CAST(oversize_texts > 0 AS BIGINT) AS oversize_text,
  CAST(transcript_rows > {fixed.TRANSCRIPT_MAX_ROWS} OR transcript_bytes > {fixed.TRANSCRIPT_MAX_BYTES}
    OR coalesce(event_rows, 0) > {fixed.EVENT_MAX_ROWS}
    OR coalesce(event_rows, 0) * coalesce(segment_rows, 0) > {fixed.MAX_ALIGNMENT_WORK_ITEMS} AS BIGINT)
    AS oversize_session
FROM (SELECT session_id, count(*) AS transcript_rows,
        count(*) FILTER (strlen(text) > {fixed.TRANSCRIPT_TEXT_MAX_BYTES}) AS oversize_texts,
        CAST(sum(strlen(text)) AS BIGINT) AS transcript_bytes FROM te GROUP BY session_id) t
LEFT JOIN (SELECT session_id, count(*) AS event_rows FROM ui_events GROUP BY session_id) e USING (session_id)
LEFT JOIN (SELECT session_id, count(*) AS segment_rows FROM segments GROUP BY session_id) s USING (session_id)"""

_NOTE_TEXTS = """SELECT session_id * 100000 + segment_id AS k, session_id, segment_id,
  substring(text, 1, 4096) AS text FROM segments"""


def _shown(text: str) -> str:
    return rf"""regexp_replace({collapse(text)}, '([\\`*_{{}}\[\]<>#|!()+-])', '\\\1', 'g')"""


def _count(cte: str) -> str:
    return f"coalesce((SELECT count(*) FROM {cte} x WHERE x.session_id = s.session_id), 0)"


def _listed(cte: str, *columns: str) -> str:
    """Digest of a session's rows in the order of the first two columns."""
    return (f"(SELECT md5(string_agg(concat_ws(':', {', '.join(columns)}), ',' ORDER BY {columns[0]}, {columns[1]})) "
            f"FROM {cte} x WHERE x.session_id = s.session_id)")


SQL = {
    "note_lines": query(
        f"""SELECT n.session_id, n.segment_id, 0 AS line_no, '- [' || {mmss('start_ms')} || '-' || {mmss('end_ms')}
          || '] Transcript segment: [untrusted data] ' || {_shown('red.text')}
          || CASE WHEN length(s.text) > 4096 THEN '...' ELSE '' END AS line
        FROM notes n JOIN red USING (k) JOIN segments s ON s.session_id = n.session_id AND s.segment_id = n.segment_id
        UNION ALL SELECT session_id, segment_id, nearby_rank, '  - Nearby UI: Event kind: [untrusted data] '
          || {_shown('kind')} || '; Event app: [untrusted data] ' || {_shown("coalesce(app, 'unknown app')")}
          || '; Event window: [untrusted data] ' || {_shown("""coalesce("window", 'unknown window')""")}
        FROM ({_RANKED}) WHERE nearby_rank <= 4""", "pairs",
        extra={"notes": _NOTE_TEXTS, **rs.redacted_ctes("red", "notes")}),
    "effective_offset": query("SELECT session_id, seq, offset_ms, timing_source FROM timed", "timed"),
    "assemble_segments": query("SELECT * FROM segments", "segments"),
    "completed_segments": query(
        f"""SELECT session_id, segment_id, start_ms, end_ms FROM segments WHERE session_id IN (
        SELECT session_id FROM timed WHERE kind = 'completed' AND regexp_matches(text, '{NON_WS}'))""",
        "segments"),
    "delta_fallback": query(
        f"""SELECT * FROM segments WHERE session_id NOT IN (
        SELECT session_id FROM timed WHERE kind = 'completed' AND regexp_matches(text, '{NON_WS}'))""",
        "segments"),
    "ui_event_fields": query("SELECT * FROM ui_events", "ui_events"),
    "segment_anchors": query(
        "SELECT session_id, segment_id, audio_started_ms, mid_ms FROM middles", "middles"),
    "align_events": query(
        "SELECT session_id, segment_id, seq, event_id, delta_ms, confidence FROM pairs", "pairs"),
    "aligned_segments": query(_BEST, "pairs"),
    "out_of_window_events": query(_FAR, "pairs"),
    "nearby_events": query(
        f"SELECT session_id, segment_id, nearby_rank, event_id, delta_ms FROM ({_RANKED}) WHERE nearby_rank <= 4",
        "pairs"),
    "nearby_lists": query(
        f"""SELECT session_id, segment_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY seq) AS event_ids
        FROM ({_RANKED}) WHERE nearby_rank <= 4 GROUP BY session_id, segment_id""", "pairs"),
    "conflict_warnings": query(_CONFLICTS, "pairs"),
    "conflict_event_lists": query(
        f"""SELECT r.session_id, r.segment_id, r.nearby_rank, r.event_id, r."window", r.ui_hint
        FROM ({_RANKED}) r JOIN conflicts c USING (session_id, segment_id)
        WHERE c.reason = 'nearby-ui-label-mismatch' AND r.nearby_rank <= 4""",
        "pairs", extra={"conflicts": _CONFLICTS}),
    "duplicate_segments": query(_DUPLICATES.replace("FROM segments", "FROM said"), "segments", extra={
        "said": "SELECT session_id, segment_id, text FROM segments UNION ALL "
                "SELECT session_id, segment_id + 100000, '  ' || text FROM segments WHERE segment_id % 2 = 0"}),
    "duplicate_documents": f"""SELECT session_id, segment_id, duplicate_of FROM (
        SELECT source AS session_id, doc_id AS segment_id,
          min(doc_id) OVER (PARTITION BY source, {normalized('text')}) AS duplicate_of FROM documents)
        WHERE segment_id > duplicate_of""",
    "timestamp_counts": query(_STATUS, "ui_events"),
    "clock_skew": query(
        f"SELECT session_id, rec_started_ms - audio_started_ms AS skew_ms, {_SKEW} AS status FROM sessions",
        "sessions"),
    "alignment_diagnostics": query(
        f"""SELECT s.session_id,
        CAST(audio_started_ms IS NULL AS BIGINT) AS missing_audio_clock,
        CAST(rec_started_ms IS NULL AS BIGINT) AS missing_recording_start,
        coalesce(malformed_timestamps, 0) AS malformed_timestamps,
        coalesce(missing_timestamps, 0) AS missing_timestamps,
        {_count('far')} AS out_of_window_events,
        rec_started_ms - audio_started_ms AS start_delta_ms, {_SKEW} AS clock_skew_status,
        CAST(6000 AS BIGINT) AS clock_skew_warning_ms, {_count('dups')} AS duplicate_segments,
        CASE WHEN audio_started_ms IS NOT NULL THEN '{tl.CLOCKED_CEILING}'
             ELSE '{tl.UNCLOCKED_CEILING}' END AS claim_ceiling
        FROM sessions s LEFT JOIN status USING (session_id)""",
        "pairs", extra=_EXTRA),
    "session_counts": query(
        f"""SELECT s.session_id, {_count('segments')} AS segments, {_count('ui_events')} AS events,
        {_count('best')} AS aligned_segments, {_count('conflicts')} AS conflicts FROM sessions s""",
        "pairs", extra=_EXTRA),
    "band_counts": query(
        """SELECT p.session_id, count(b.segment_id) AS aligned_segments,
        count(b.segment_id) FILTER (best_confidence = 'high') AS high_segments,
        count(b.segment_id) FILTER (best_confidence = 'medium') AS medium_segments,
        count(b.segment_id) FILTER (best_confidence = 'low') AS low_segments
        FROM (SELECT session_id FROM middles WHERE mid_ms IS NOT NULL
              UNION SELECT session_id FROM ui_events WHERE unix_ms IS NOT NULL) p
        LEFT JOIN best b USING (session_id) GROUP BY p.session_id""",
        "pairs", extra={"best": _BEST}),
    "monotonic_policy": query(
        """SELECT session_id, count(monotonic_offset_ms) AS monotonic_segments,
        CASE WHEN count(monotonic_offset_ms) = 0 THEN 'not-captured'
             ELSE 'process-local-offsets-captured' END AS monotonic_status
        FROM segments GROUP BY session_id""", "segments"),
    "limit_flags": query(_LIMITS, "segments", "ui_events"),
    "temporal_context": query(
        f"""SELECT s.session_id, {_count('segments')} AS segments, {_count('ui_events')} AS events,
        {_count('best')} AS alignments, {_count('conflicts')} AS warnings, {_count('pairs')} AS pairs,
        {_count('far')} AS out_of_window_events, {_listed('segments', 'segment_id', 'start_ms', 'end_ms', 'timing_source')} AS segment_digest,
        {_listed('ui_events', 'seq', 'event_id', 'kind', 'ts_status', 'unix_ms')} AS event_digest,
        {_listed('pairs', 'segment_id', 'seq', 'event_id', 'delta_ms', 'confidence')} AS pair_digest,
        {_listed('best', 'segment_id', 'best_confidence')} AS confidence_digest,
        {_listed('conflicts', 'segment_id', 'reason')} AS warning_digest
        FROM sessions s""", "pairs", extra=_EXTRA),
}
