"""Registered queries: streams run over all available rows of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanalign import fixed
from spanalign.operators import delay as dl, segments as sg, timeline as tl
from spanalign.plans.sql import CTES, query
from spanalign.session import scratch_path, written
from spanalign.sources import tables as src
from spanalign.streaming import live

MAX_MESSAGE, MAX_EVENTS, MAX_BYTES = 900, 60, 30_000  # small limits, so that they bind


def _message(route: str):
    """JSON message of one event row."""
    return F.expr(f"""to_json(CASE {route}
      WHEN 'view' THEN named_struct('type', '{live.DELTA_TYPE}', 'delta', props, 'transcript', cast(null as string))
      WHEN 'purchase' THEN named_struct('type', '{live.COMPLETED_TYPE}', 'delta', cast(null as string), 'transcript',
                                        CASE WHEN event_id % 3 = 0 THEN ' ' ELSE props END)
      WHEN 'error' THEN named_struct('type', 'error', 'delta', cast(null as string), 'transcript', cast(null as string))
      ELSE named_struct('type', 'other', 'delta', cast(null as string), 'transcript', cast(null as string)) END)""")


def _event_rows(df):
    """Event rows as capture rows: clicks are audio chunks, all others are messages."""
    rows = live.routed(df.withColumn("value", _message("event_type")))
    return rows.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "click", "audio").otherwise(F.col("route")).alias("route"),
        F.expr("event_id % 4000 + 1000").alias("bytes"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "text",
    )


def _event_stream(spark, sf):
    schema = src.table(spark, sf, "events").schema
    return _event_rows(live.stream_table(spark, sf, "events", schema))


def routed_events(spark, sf):
    return live.run_appended(
        _event_stream(spark, sf).select("session_id", "seq", "route", "text"), "routed")


def live_stats(spark, sf):
    return live.run_updated(live.live_stats(_event_stream(spark, sf)), "stats", ["session_id"])


def capture_stats(spark, sf):
    return live.capture_stats(_event_rows(src.table(spark, sf, "events")))


def first_chunk_clock(spark, sf):
    return live.run_updated(live.first_chunk_clock(_event_stream(spark, sf)), "clock", ["session_id"])


def within_capture(spark, sf):
    bounds = src.sessions(spark, sf).select(
        "session_id", (F.col("base_ms") + 86_400_000).alias("start_ms"),
        F.when(F.expr("session_id % 2 = 0"), F.col("base_ms") + 10 * 86_400_000).alias("stop_ms"))
    kept = live.within_capture(_event_stream(spark, sf), bounds, 20 * 86_400)
    return live.run_appended(kept.select("session_id", "seq"), "within")


def _turn_bytes(df):
    return df.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"),
                     F.octet_length("text").cast("bigint").alias("bytes"))


def quota_breaches(spark, sf):
    return live.quota_breaches(
        _turn_bytes(src.table(spark, sf, "conversations")), MAX_MESSAGE, MAX_EVENTS, 2_500)


def live_quota(spark, sf):
    schema = src.table(spark, sf, "conversations").schema
    stream = _turn_bytes(live.stream_table(spark, sf, "conversations", schema))
    found = live.run_appended(live.live_quota(stream, MAX_MESSAGE, MAX_EVENTS, 2_500, first_seq=0), "quota")
    return found.where("fault is null").select("session_id", "seq", "reason")


def event_quota(spark, sf):
    """Batch quota over user events, where the event count binds."""
    rows = _event_rows(src.table(spark, sf, "events")).select("session_id", "seq", "bytes")
    return live.quota_breaches(rows, 4_990, MAX_EVENTS, 200_000)


def _closed_transcript(spark, sf):
    """Transcript rows, closed by one stop row per session."""
    rows = src.transcript_events(spark, sf)
    stops = rows.groupBy("session_id").agg((F.max("seq") + 1).alias("seq")).select(
        "session_id", "seq", F.lit("stop").alias("kind"),
        F.lit(None).cast("bigint").alias("audio_offset_ms"),
        F.lit(None).cast("bigint").alias("monotonic_offset_ms"), F.lit("").alias("text"))
    return rows.unionByName(stops)


_SEGMENT = ("session_id", "segment_id", "start_ms", "end_ms", "monotonic_offset_ms", "timing_source", "text")


def live_segments(spark, sf):
    """Transcript rows as a stream that loses nothing."""
    rows = _closed_transcript(spark, sf)
    path = scratch_path(spark, "transcript")
    rows.write.parquet(path)
    stream = live.stream_folder(spark, path, rows.schema)
    return live.run_appended(live.live_segments(stream, first_seq=0), "live-segments").where(
        "fault is null").select(*_SEGMENT)


#: Streams of the queries below come in this many steps of time; rows may be late by the watermark.
STEPS = 6
WATERMARK = "10 minutes"


def _steps(spark, name, time, *tables):
    """Each table as a stream of files, one per step of time and read one per micro-batch.

    A last row of no session (all other columns NULL or -1), beyond all times, is the heartbeat that
    pushes the watermark over the rows before it.
    """
    held = [written(t, f"{name}-rows") for t in tables]
    times = held[0].select(time)
    for t in held[1:]:
        times = times.unionByName(t.select(time))
    cuts = sorted(set(times.where(f"{time} is not null").approxQuantile(time, [k / STEPS for k in range(1, STEPS)], 0.01)))
    last = times.agg(F.max(time)).first()[0] or 0
    streams = []
    for t in held:
        path = scratch_path(spark, name)
        for low, high in zip([None, *cuts], [*cuts, None]):
            inside = F.lit(True) if low is None else F.col(time) >= low
            if high is not None:
                inside = inside & (F.col(time) < high)
            t.where(inside).coalesce(1).write.mode("append").parquet(path)
        beat = t.limit(1).select(*[
            F.lit(last + 2 * live.IDLE_MS).alias(c) if c == time else F.lit(-1).cast("bigint").alias(c) if c == "session_id"
            else F.lit(None).cast(kind).alias(c) for c, kind in t.dtypes])
        beat.coalesce(1).write.mode("append").parquet(path)
        streams.append(live.stream_folder(spark, path, t.schema, files_per_trigger=1))
    return streams


def live_losses(spark, sf):
    """Segments of a transcript stream that loses some rows and repeats others, and what it lost.

    A row has the time of its number, one second each; lost and repeated rows follow from session and number.
    """
    rows = _closed_transcript(spark, sf).withColumn("at_ms", 1_700_000_000_000 + 1000 * F.col("seq"))
    fate = F.when(F.col("kind") != "stop", F.expr("(session_id * 31 + seq * 17) % 20"))
    copies = F.when(fate == 0, 0).when(fate == 1, 2).otherwise(1)
    come = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).where(copies > 0).drop("copy")
    stream, = _steps(spark, "lossy", "at_ms", come)
    found = live.run_appended(live.live_segments(stream, first_seq=0, time="at_ms", watermark=WATERMARK), "losses")
    return found.where("session_id >= 0").select(*_SEGMENT, "fault", "fault_from", "fault_to")


def _commit_rows(spark, sf):
    """User events as capture rows; the last event of a session is its stop."""
    rows = _event_rows(src.table(spark, sf, "events"))
    last = rows.groupBy("session_id").agg(F.max("at_ms").alias("at_ms"))
    stops = last.select("session_id", F.lit(1 << 40).alias("seq"), F.lit("stop").alias("route"),
                        F.lit(0).cast("bigint").alias("bytes"), F.col("at_ms"))
    cols = ["session_id", "seq", "route", "bytes", "at_ms"]
    return rows.select(*cols).unionByName(stops.select(*cols))


def live_commits(spark, sf):
    """Commit markers of the events as a stream in steps of time."""
    stream, = _steps(spark, "capture", "at_ms", _commit_rows(spark, sf))
    return live.run_appended(live.live_commits(stream, watermark=WATERMARK), "commits").where("session_id >= 0")


def capture_totals(spark, sf):
    """Totals of a capture with its commits and the bytes that were pending at its end."""
    return dl.capture_totals(live_stats(spark, sf), live_commits(spark, sf))


def live_alignment(spark, sf):
    segs = sg.assemble_segments(src.transcript_events(spark, sf))
    left = tl.with_anchor(segs, src.sessions(spark, sf)).select(
        "session_id", "segment_id", F.col("mid_ms").alias("unix_ms"))
    right = src.ui_events(spark, sf).select("session_id", "seq", "event_id", "unix_ms")
    middles, events = _steps(spark, "aligned", "unix_ms", left, right)
    return live.run_appended(live.live_alignment(
        middles.withColumnRenamed("unix_ms", "mid_ms").where("session_id >= 0"),
        events.where("session_id >= 0"), watermark=WATERMARK,
    ), "live-alignment")


QUERIES = {f.__name__: f for f in (
    routed_events, live_stats, capture_stats, first_chunk_clock, within_capture, quota_breaches,
    live_quota, event_quota, live_segments, live_losses, live_commits, capture_totals, live_alignment,
)}

_ROUTE = """CASE event_type WHEN 'click' THEN 'audio' WHEN 'view' THEN 'delta' WHEN 'error' THEN 'error'
  WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'other' ELSE 'completed' END ELSE 'other' END"""
_ROWS = {"r": f"""SELECT user_id AS session_id, event_id AS seq, {_ROUTE} AS route, event_id % 4000 + 1000 AS bytes,
  epoch_us(ts) // 1000 AS at_ms, props FROM events"""}
_STATS_BODY = """SELECT session_id, count(*) FILTER (route = 'audio') AS audio_chunks,
  coalesce(CAST(sum(bytes) FILTER (route = 'audio') AS BIGINT), 0) AS audio_bytes,
  count(*) FILTER (route <> 'audio') AS messages, count(*) FILTER (route = 'delta') AS deltas,
  count(*) FILTER (route = 'completed') AS completed, count(*) FILTER (route = 'error') AS errors
FROM r GROUP BY session_id"""
_STATS = query(_STATS_BODY, extra=_ROWS)


def _quota(source: str, message: int, events: int, total: int) -> str:
    return f"""SELECT session_id, min(seq) AS seq, arg_min(reason, seq) AS reason FROM (SELECT *, CASE
      WHEN bytes > {message} THEN 'message-bytes' WHEN n > {events} THEN 'event-count' WHEN t > {total} THEN 'total-bytes' END AS reason
    FROM (SELECT *, count(*) OVER w AS n, sum(bytes) OVER w AS t FROM {source}
          WINDOW w AS (PARTITION BY session_id ORDER BY seq))) WHERE reason IS NOT NULL GROUP BY session_id"""


_TURNS = _quota("(SELECT conv_id AS session_id, turn AS seq, strlen(text) AS bytes FROM conversations)",
                MAX_MESSAGE, MAX_EVENTS, 2_500)

_NEXT = """SELECT e.session_id, e.rn, e.at_ms,
    CASE WHEN waits_until IS NOT NULL AND (e.at_ms > waits_until OR e.route = 'error') THEN 'unacknowledged'
      WHEN waits_until IS NOT NULL AND e.route = 'completed' THEN 'acknowledged'
      WHEN waits_until IS NOT NULL OR closed THEN NULL
      WHEN e.route = 'audio' AND held + e.bytes >= {minimum} AND e.at_ms - coalesce(last, e.at_ms) >= {interval} THEN 'commit'
      WHEN e.route = 'stop' AND held < {minimum} THEN 'not-needed'
      WHEN e.route = 'stop' THEN 'awaiting-acknowledgement' END AS event,
    e.route, e.bytes AS size, held, last, waits_until, closed"""
_COMMITS = f"""SELECT * FROM (WITH RECURSIVE e AS (
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at_ms, seq) AS rn FROM (
      SELECT session_id, seq, route, bytes, at_ms FROM r
      UNION ALL SELECT session_id, 1099511627776, 'stop', 0, max(at_ms) FROM r GROUP BY session_id)),
  walk AS (
    SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS held, CAST(NULL AS BIGINT) AS last,
      CAST(NULL AS BIGINT) AS waits_until, false AS closed, CAST(NULL AS BIGINT) AS told_at, CAST(NULL AS VARCHAR) AS event,
      CAST(0 AS BIGINT) AS bytes FROM e
    UNION ALL SELECT session_id, rn,
      CASE WHEN event IN ('commit', 'acknowledged') THEN 0 WHEN waits_until IS NULL AND NOT closed AND route = 'audio' THEN held + size ELSE held END,
      CASE WHEN event = 'commit' THEN at_ms WHEN waits_until IS NOT NULL OR closed THEN last ELSE coalesce(last, at_ms) END,
      CASE WHEN event = 'awaiting-acknowledgement' THEN at_ms + {fixed.DRAIN_TIMEOUT_MS}
        WHEN event IN ('unacknowledged', 'acknowledged') THEN NULL ELSE waits_until END,
      closed OR (waits_until IS NULL AND route = 'stop'),
      CASE WHEN event = 'unacknowledged' THEN least(at_ms, waits_until) ELSE at_ms END, event,
      CASE WHEN event = 'commit' THEN held + size ELSE held END
    FROM ({_NEXT.format(minimum=fixed.MINIMUM_COMMIT_BYTES, interval=fixed.COMMIT_INTERVAL_MS)}
      FROM walk w JOIN e ON e.session_id = w.session_id AND e.rn = w.rn + 1))
  SELECT session_id, told_at AS at_ms, event, CAST(bytes AS BIGINT) AS bytes FROM walk WHERE event IS NOT NULL
  UNION ALL SELECT session_id, waits_until, 'unacknowledged', CAST(held AS BIGINT) FROM walk
  WHERE waits_until IS NOT NULL AND rn = (SELECT max(rn) FROM e WHERE e.session_id = walk.session_id))"""

_FATE = "(session_id * 31 + seq * 17) % 20"
_LOSSES = {"kept": f"SELECT * FROM timed WHERE {_FATE} <> 0", "lossy": CTES["segments"][1].replace("FROM timed", "FROM kept"),
           # numbers that came, the stop among them; a stretch of lost ones lies between two of them
           "came": """SELECT session_id, seq FROM kept UNION ALL SELECT session_id, max(seq) + 1 FROM timed GROUP BY session_id"""}

SQL = {
    "live_losses": query(
        f"""SELECT *, NULL AS fault, CAST(NULL AS BIGINT) AS fault_from, CAST(NULL AS BIGINT) AS fault_to FROM lossy
        UNION ALL SELECT session_id, NULL, NULL, NULL, NULL, NULL, NULL, 'repeated-or-late', seq, seq FROM kept WHERE {_FATE} = 1
        UNION ALL SELECT session_id, NULL, NULL, NULL, NULL, NULL, NULL, 'missing', before + 1, seq - 1
        FROM (SELECT *, coalesce(lag(seq) OVER (PARTITION BY session_id ORDER BY seq), -1) AS before FROM came) WHERE seq > before + 1""",
        "timed", extra=_LOSSES),
    "capture_totals": query(
        """SELECT st.*, coalesce(audio_commits, 0) AS audio_commits, coalesce(pending, audio_bytes - coalesce(sent, 0)) AS pending_bytes,
          coalesce(final_commit, 'open') AS final_commit
        FROM stats st LEFT JOIN (SELECT session_id, count(*) FILTER (event = 'commit') AS audio_commits,
            CAST(sum(bytes) FILTER (event = 'commit') AS BIGINT) AS sent,
            arg_max(bytes, at_ms) FILTER (event IN ('not-needed', 'awaiting-acknowledgement')) AS pending,
            coalesce(max(event) FILTER (event IN ('acknowledged', 'unacknowledged')), max(event) FILTER (event = 'not-needed')) AS final_commit
          FROM commits GROUP BY session_id) USING (session_id)""", extra={**_ROWS, "stats": _STATS_BODY, "commits": _COMMITS}),
    "live_commits": query("SELECT * FROM commits", extra={**_ROWS, "commits": _COMMITS}),
    "routed_events": query(
        "SELECT session_id, seq, route, CASE WHEN route IN ('delta', 'completed') THEN props END AS text FROM r", extra=_ROWS),
    "live_stats": _STATS,
    "capture_stats": _STATS,
    "first_chunk_clock": query(
        "SELECT session_id, min(at_ms) AS first_chunk_ms FROM r WHERE route = 'audio' GROUP BY session_id", extra=_ROWS),
    "within_capture": query(
        """SELECT r.session_id, r.seq FROM r JOIN sessions s USING (session_id) WHERE at_ms >= base_ms + 86400000
        AND (r.session_id % 2 = 1 OR at_ms <= base_ms + 864000000) AND at_ms - base_ms - 86400000 <= 1728000000""",
        "sessions", extra=_ROWS),
    "quota_breaches": _TURNS,
    "live_quota": _TURNS,
    "event_quota": query(_quota("r", 4_990, MAX_EVENTS, 200_000), extra=_ROWS),
    "live_segments": query("SELECT * FROM segments", "segments"),
    "live_alignment": query(
        "SELECT session_id, segment_id, seq, event_id, delta_ms, confidence FROM pairs", "pairs"),
}
