"""Live capture streams: routing, segments, commits, quotas, clocks, alignment, statistics.

Results do not depend on how rows fall into micro-batches.  Where rows carry gapless numbers (lines of a
log), a session's early rows wait in list state until all before them have come; where they carry only
times, they wait until the watermark has passed and are then taken in order of time.  Rows behind the
watermark are dropped by Spark and counted in the query progress as ``numRowsDroppedByWatermark``.
Besides waiting rows, keyed state is counters and the text of deltas before the first segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanalign import fixed
from spanalign.functions import instants, text as tx
from spanalign.operators.delay import capture_stats
from spanalign.operators.prefix import running
from spanalign.session import scratch_path

DELTA_TYPE = "conversation.item.input_audio_transcription.delta"
COMPLETED_TYPE = "conversation.item.input_audio_transcription.completed"

SEGMENT_SCHEMA = (
    "session_id bigint, segment_id bigint, start_ms bigint, end_ms bigint, "
    "monotonic_offset_ms bigint, timing_source string, text string, "
    "fault string, fault_from bigint, fault_to bigint"
)
BREACH_SCHEMA = "session_id bigint, seq bigint, reason string, fault string, fault_from bigint, fault_to bigint"
COMMIT_SCHEMA = "session_id bigint, at_ms bigint, event string, bytes bigint"


# --- routing ---

def routed(messages: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``route`` and ``text`` to raw JSON messages; works on batch and streaming tables.

    A completed message without text, and anything of another type, is ``other``.
    """
    kind = F.get_json_object(value, "$.type")
    delta, done = F.get_json_object(value, "$.delta"), F.get_json_object(value, "$.transcript")
    route = (
        F.when(kind == "error", "error")
        .when((kind == DELTA_TYPE) & delta.isNotNull(), "delta")
        .when((kind == COMPLETED_TYPE) & ~tx.is_blank(done), "completed")
        .otherwise("other")
    )
    return messages.withColumn("route", route).withColumn(
        "text",
        F.when(F.col("route") == "delta", delta).when(F.col("route") == "completed", done),
    )


def first_chunk_clock(stream: DataFrame) -> DataFrame:
    """Instant of the first audio row per session (a running minimum, so order does not matter)."""
    return stream.where(F.col("route") == "audio").groupBy("session_id").agg(
        F.min("at_ms").alias("first_chunk_ms")
    )


def live_stats(stream: DataFrame) -> DataFrame:
    return capture_stats(stream)


def within_capture(
    stream: DataFrame, sentinels: DataFrame, max_seconds: int | None = None
) -> DataFrame:
    """Rows between the start and stop sentinel of their session and within the duration cap.

    ``sentinels``: session_id, start_ms, stop_ms (NULL while running); a static or bounded table
    joined to the stream.
    """
    joined = stream.join(sentinels, "session_id")
    kept = joined.where(
        (F.col("at_ms") >= F.col("start_ms"))
        & (F.col("stop_ms").isNull() | (F.col("at_ms") <= F.col("stop_ms")))
    )
    if max_seconds is not None:
        kept = kept.where(F.col("at_ms") - F.col("start_ms") <= max_seconds * 1000)
    return kept.drop("start_ms", "stop_ms")


# --- quota ---

def quota_reason(
    size: Column, events: Column, total: Column, max_message: int, max_events: int, max_bytes: int
) -> Column:
    return (
        F.when(size > max_message, "message-bytes").when(events > max_events, "event-count")
        .when(total > max_bytes, "total-bytes")
    )


def quota_breaches(
    rows: DataFrame,
    max_message: int = fixed.STREAM_MAX_MESSAGE_BYTES,
    max_events: int = fixed.STREAM_MAX_EVENTS,
    max_bytes: int = fixed.STREAM_MAX_BYTES,
) -> DataFrame:
    """First row per session that breaks a message, event or byte limit (batch)."""
    summed = running(
        rows.select("session_id", "seq", "bytes"), ["session_id"], None, ["seq"],
        sums={"events": F.lit(1), "total": F.col("bytes")},
    )
    reason = quota_reason(
        F.col("bytes"), F.col("events") + 1, F.col("total") + F.col("bytes"),
        max_message, max_events, max_bytes,
    )
    broken = summed.withColumn("reason", reason).where("reason is not null")
    return broken.groupBy("session_id").agg(
        F.min("seq").alias("seq"), F.min_by("reason", "seq").alias("reason")
    )


#: How long an idle session is kept.
IDLE_MS = 24 * 60 * 60 * 1000
#: Sessions are dealt to this many keys of state.
BUCKETS = 1024


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(cell: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(cell)).read_all()


_PLACE = pa.schema([("session_id", pa.int64()), ("next_seq", pa.int64()), ("waiting", pa.int64()), ("seen", pa.int64()),
                    ("wakes", pa.int64()), ("closed", pa.bool_()), ("known", pa.bool_())])


class InSequence(StatefulProcessor):
    """Takes a session's rows by ``seq``; rows that come early wait in map state, one entry each.

    A waiting row has a deadline: its own time where the stream has event times (the watermark has then
    passed all that belongs before it), else the processing time of its arrival plus ``patience_ms``.
    With neither it waits without an end, as there is no clock to go by.  When a deadline passes, the missing numbers are told as a ``missing`` row and the session goes on
    behind them.  A number that came already or was given up is told as ``repeated-or-late``, a row
    without number as ``unnumbered``; neither is used.  A closed session keeps one flag and uses no more
    rows.  A session that has been idle for ``idle_ms`` leaves nothing; the next row would begin it anew.

    The key is a bucket of sessions, as calls to the state store cost far more than rows.  The places of
    its sessions are one cell; what a session keeps besides is read and written when it takes a row.
    """

    #: Schema of a waiting row besides its number and its deadline, of the output, and of what a session keeps.
    ROW = ""
    OUT = ""
    KEPT = ""
    #: What a session keeps before its first row.
    NEW: tuple = ()

    def __init__(self, first_seq: int, patience_ms: int | None, idle_ms: int, event_time: bool):
        if idle_ms < (patience_ms or 0):
            raise ValueError("an idle session must be kept for as long as missing rows are waited for")
        self.first_seq, self.patience_ms, self.idle_ms, self.event_time = first_seq, patience_ms, idle_ms, event_time
        self.timers = event_time or patience_ms is not None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [c.split()[0] for c in self.ROW.split(", ")]
        self.columns = [c.split() for c in self.OUT.split(", ")]
        self.early = handle.getMapState("early", "session_id bigint, seq bigint", f"{self.ROW}, due bigint")
        self.kept = handle.getMapState("kept", "session_id bigint", self.KEPT)
        # the places of all sessions of the bucket, and the earliest deadline among them
        self.bucket = handle.getValueState("bucket", "places binary, alarm bigint")

    # a subclass says what a row does, and what it keeps besides
    def load(self, kept: tuple) -> None:
        """Values of the session from what was kept."""

    def save(self) -> tuple:
        """What is kept of the session."""

    def step(self, session, row: dict) -> Iterator[tuple]:
        """Output rows (without fault columns) of one row in its turn; ``self.closed`` ends the session."""
        raise NotImplementedError

    def open_bucket(self) -> None:
        cell, self.alarm = self.bucket.get() if self.bucket.exists() else (None, None)
        places = _unpacked(cell) if cell is not None else _PLACE.empty_table()
        self.places = {row[0]: row[1:] for row in zip(*(c.to_pylist() for c in places.columns))}
        self.out: list[tuple] = []
        self.left: set = set()  # sessions whose waiting rows are of no use any more

    def close_bucket(self, alarms: list[int]) -> Iterator[pd.DataFrame]:
        """Keeps the places, sets the earliest alarm; the output."""
        if self.left:
            for number in [number for number in self.early.keys() if number[0] in self.left]:
                self.early.removeKey(tuple(number))
        if alarms and (self.alarm is None or min(alarms) < self.alarm):
            self.alarm = min(alarms)
            self.handle.registerTimer(self.alarm)
        if self.places:
            rows = zip(*((session, *place) for session, place in self.places.items()))
            columns = [pa.array(c, field.type) for c, field in zip(rows, _PLACE)]
            self.bucket.update((_packed(pa.Table.from_arrays(columns, schema=_PLACE)), self.alarm))
        elif self.bucket.exists():
            self.bucket.clear()
        if self.out:
            frame = pd.DataFrame(self.out, columns=[name for name, _ in self.columns])
            yield frame.astype({name: "Int64" for name, kind in self.columns if kind == "bigint"})

    def begin(self, session) -> None:
        place = self.places.get(session, (self.first_seq, 0, None, None, False, False))
        self.at, self.waiting, self.seen, self.wakes, self.closed, self.known = place
        self.loaded = False

    def tell(self, session, fault: str, first: int | None, last: int | None) -> None:
        self.out.append((session, *[None] * (len(self.columns) - 4), fault, first, last))

    def go_on(self, session, new: dict[int, tuple]) -> None:
        """Takes rows from the next number on, out of ``new`` or state, up to the first gap."""
        while not self.closed:
            if self.at in new:
                row = new.pop(self.at)
            elif self.waiting and self.early.containsKey((session, self.at)):
                row = self.early.getValue((session, self.at))
                self.early.removeKey((session, self.at))
                self.waiting -= 1
            else:
                return
            if not self.loaded:
                self.load(self.kept.getValue((session,)) if self.known else self.NEW)
                self.loaded = True
            for told in self.step(session, {"seq": self.at, **dict(zip(self.names, row))}):
                self.out.append((*told, None, None, None))
            self.at += 1

    def end(self, session) -> None:
        """Keeps the session."""
        if self.closed:
            self.forget(session)
            self.waiting = 0
        elif self.loaded:
            self.kept.updateValue((session,), self.save())
            self.known = True
        self.places[session] = (self.at, self.waiting, self.seen, self.wakes, self.closed, self.known)

    def forget(self, session) -> None:
        """Leaves nothing of the session but its place."""
        if self.waiting:
            self.left.add(session)
        if self.known:
            self.kept.removeKey((session,))
            self.known = False

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.open_bucket()
        now = timerValues.getCurrentProcessingTimeInMs() if self.timers and not self.event_time else 0
        come: dict[int, list[tuple]] = {}
        for batch in rows:
            times = batch["at_ms"] if self.event_time else [now] * len(batch)
            cells = batch[["session_id", "seq", *self.names]].itertuples(index=False, name=None)
            for time, (session, seq, *row) in zip(times, cells):
                come.setdefault(_plain(session), []).append((int(time), _plain(seq), row))
        alarms = []
        for session, cells in come.items():
            self.begin(session)
            new, due = {}, {}
            for time, seq, row in cells:
                self.seen = time if self.seen is None else max(self.seen, time)
                if self.closed:
                    continue
                if seq is None:
                    self.tell(session, "unnumbered", None, None)
                elif seq < self.at or seq in new or (self.waiting and self.early.containsKey((session, seq))):
                    self.tell(session, "repeated-or-late", seq, seq)
                else:
                    new[seq], due[seq] = tuple(_plain(v) for v in row), time if self.event_time else now + (self.patience_ms or 0)
            self.go_on(session, new)
            if new and not self.closed:
                for seq, row in new.items():
                    self.early.updateValue((session, seq), (*row, due[seq]))
                self.waiting += len(new)
                if self.timers:
                    alarms.append(min(due[seq] for seq in new))
            if self.timers and self.wakes is None:
                self.wakes = self.seen + self.idle_ms
                alarms.append(self.wakes)
            self.end(session)
        yield from self.close_bucket(alarms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        self.open_bucket()
        if self.alarm is None or self.alarm > reached:  # an earlier alarm of this micro-batch has done the work
            return
        held: dict[int, list[tuple]] = {}
        if any(place[1] for place in self.places.values()):
            for (session, seq), row in self.early.iterator():
                held.setdefault(session, []).append((seq, row[-1]))
        alarms = []
        for session, place in list(self.places.items()):
            rows = sorted(held.get(session, ()))
            if place[3] > reached and all(due > reached for _, due in rows):
                alarms += [place[3], *(due for _, due in rows)]
                continue
            self.begin(session)
            for seq, due in rows:
                if due <= reached and seq >= self.at and not self.closed:
                    if seq > self.at:
                        self.tell(session, "missing", self.at, seq - 1)
                    self.at = seq
                    self.go_on(session, {})
            if not self.closed:
                alarms += [due for seq, due in rows if seq >= self.at]
            if self.wakes <= reached:
                self.wakes = self.seen + self.idle_ms
                if self.wakes <= reached:  # all deadlines have passed as well
                    self.forget(session)
                    del self.places[session]
                    continue
            alarms.append(self.wakes)
            self.end(session)
        self.alarm = None
        yield from self.close_bucket(alarms)

    def close(self) -> None:
        pass


def in_sequence(
    stream: DataFrame, columns: list[str | Column], processor, time: str | None, watermark: str, buckets: int = BUCKETS
) -> DataFrame:
    """Rows of a session through ``processor``; ``time`` names the event time in ms, if there is one.

    A row without event time counts as one of the earliest: it may come at any time.  Deadlines in
    processing time are for streams that run on; a run over what is there would not end with them.
    """
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(buckets)).alias("bucket")
    if time is None:
        return stream.select(bucket, "session_id", "seq", *columns).groupBy("bucket").transformWithStateInPandas(
            processor, processor.OUT, "Append", "ProcessingTime" if processor.timers else "None")
    at = F.coalesce(F.col(time), F.lit(0)).cast("bigint")
    timed = stream.withColumn("at", F.timestamp_millis(time)).withWatermark("at", watermark)
    return timed.select(bucket, "session_id", "seq", at.alias("at_ms"), "at", *columns).groupBy(
        "bucket").transformWithStateInPandas(processor, processor.OUT, "Append", "EventTime")


def _plain(value):
    """A pandas cell as a text or whole number for state (columns with NULLs come as floats), NULL as None."""
    if value is None or isinstance(value, str):
        return value
    return None if pd.isna(value) else int(value)


class QuotaProcessor(InSequence):
    """Running counters per session; one row when the first limit breaks, nothing after it."""

    ROW, OUT = "bytes bigint", BREACH_SCHEMA
    KEPT, NEW = "events bigint, total bigint", (0, 0)

    def __init__(self, limits: tuple[int, int, int], *settings):
        super().__init__(*settings)
        self.limits = limits

    def load(self, kept: tuple) -> None:
        self.events, self.total = kept

    def save(self) -> tuple:
        return self.events, self.total

    def step(self, session, row: dict) -> Iterator[tuple]:
        max_message, max_events, max_bytes = self.limits
        size = row["bytes"] or 0
        self.events, self.total = self.events + 1, self.total + size
        reason = (
            "message-bytes" if size > max_message
            else "event-count" if self.events > max_events
            else "total-bytes" if self.total > max_bytes else None
        )
        if reason:
            self.closed = True
            yield session, row["seq"], reason


def live_quota(
    stream: DataFrame,
    max_message: int = fixed.STREAM_MAX_MESSAGE_BYTES,
    max_events: int = fixed.STREAM_MAX_EVENTS,
    max_bytes: int = fixed.STREAM_MAX_BYTES,
    first_seq: int = 1,
    time: str | None = None,
    watermark: str = "10 minutes",
    patience_ms: int | None = None,
    idle_ms: int = IDLE_MS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Streaming twin of `quota_breaches`; ``seq`` numbers a session's rows from ``first_seq`` on.

    Rows with ``fault`` tell numbers that are missing, repeated or NULL (`InSequence`).  A row without
    size counts with zero bytes.
    """
    processor = QuotaProcessor((max_message, max_events, max_bytes), first_seq, patience_ms, idle_ms, time is not None)
    return in_sequence(stream, ["bytes"], processor, time, watermark, buckets)


# --- segments ---

class SegmentProcessor(InSequence):
    """Segments as completed rows arrive; a ``stop`` row emits the delta fallback if there is none."""

    ROW = "kind string, monotonic_offset_ms bigint, offset_ms bigint, timing_source string, text string"
    OUT = SEGMENT_SCHEMA

    KEPT = "segments bigint, reached bigint, deltas string, last_offset bigint, last_monotonic bigint"
    NEW = (0, 0, "", 0, None)

    def load(self, kept: tuple) -> None:
        self.count, self.reached, deltas, self.last, self.last_mono = kept
        self.pieces = [deltas]

    def save(self) -> tuple:
        return self.count, self.reached, "".join(self.pieces), self.last, self.last_mono

    def step(self, session, row: dict) -> Iterator[tuple]:
        mono, offset = row["monotonic_offset_ms"], row["offset_ms"]
        if row["kind"] == "completed" and row["text"]:
            end = max(offset, self.reached)
            self.count += 1
            yield session, self.count, self.reached, end, mono, row["timing_source"], row["text"]
            self.reached, self.pieces = end, []
        elif row["kind"] == "delta" and self.count == 0:
            self.pieces.append(row["text"])  # they only matter until the first segment
            self.last, self.last_mono = offset, mono
        elif row["kind"] == "stop":
            self.closed = True
            deltas = "".join(self.pieces).strip()
            if self.count == 0 and deltas:
                source = fixed.WALL_CLOCK_SOURCE if self.last_mono is None else fixed.MONOTONIC_SOURCE
                yield session, 1, 0, self.last, self.last_mono, source, deltas


def live_segments(
    stream: DataFrame,
    first_seq: int = 1,
    time: str | None = None,
    watermark: str = "10 minutes",
    patience_ms: int | None = None,
    idle_ms: int = IDLE_MS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Streaming twin of segment assembly.

    ``stream``: session_id, seq (from ``first_seq`` on), kind (``completed``, ``delta``, ``stop``),
    audio_offset_ms, monotonic_offset_ms, text, and ``time`` where rows have an event time.  Texts are
    trimmed before the state.  Rows with ``fault`` tell numbers that are missing, repeated or NULL
    (`InSequence`); a ``stop`` row closes its session.
    """
    completed = F.col("kind") == "completed"
    columns = [
        F.col("kind"), F.col("monotonic_offset_ms"),
        instants.effective_offset(F.col("monotonic_offset_ms"), F.col("audio_offset_ms")).alias("offset_ms"),
        instants.timing_source(F.col("monotonic_offset_ms")).alias("timing_source"),
        F.when(completed & tx.is_blank(F.col("text")), "").when(completed, tx.squeeze(F.col("text")))
        .otherwise(F.coalesce("text", F.lit(""))).alias("text"),
    ]
    processor = SegmentProcessor(first_seq, patience_ms, idle_ms, time is not None)
    return in_sequence(stream, columns, processor, time, watermark, buckets)


# --- commits and the closing acknowledgement ---

#: Columns of a row that waits for the watermark, and of an open session.
_WAITING = pa.schema([("session_id", pa.int64()), ("at_ms", pa.int64()), ("seq", pa.int64()), ("route", pa.string()), ("bytes", pa.int64())])
_OPEN = pa.schema([("session_id", pa.int64()), ("buffered", pa.int64()), ("last_commit", pa.int64()), ("waiting_until", pa.int64()),
                   ("closed", pa.bool_()), ("ends", pa.int64())])


class CommitProcessor(StatefulProcessor):
    """Commit markers by size and age, and what became of the last pending bytes.

    Input rows: ``audio`` (bytes), ``completed``, ``error``, ``stop``, ``send-error``.  After a stop
    with enough pending bytes the session waits for a completed row until the event-time timer ends.
    Rows wait in list state until the watermark has passed them and are taken in order of time.  The
    state of a closed session goes ``idle_ms`` after its last row.

    The key is a bucket of sessions.  Calls to the state store cost far more than rows, so a micro-batch
    adds its rows of a bucket as one cell, and the open sessions of a bucket are one cell.
    """

    def __init__(self, minimum: int, interval_ms: int, timeout_ms: int, idle_ms: int = IDLE_MS):
        self.settings, self.idle_ms = (minimum, interval_ms, timeout_ms), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sessions binary")
        self.early = handle.getListState("early", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pa.concat_tables(
            pa.Table.from_pandas(batch[_WAITING.names], schema=_WAITING, preserve_index=False) for batch in rows)
        self.early.appendValue((_packed(new),))
        self.handle.registerTimer(pc.min(new["at_ms"]).as_py())
        return iter(())

    def walked(self, session: int, known: tuple, rows: list[tuple], reached: int, out: list[tuple]) -> tuple:
        """State of a session after its rows up to ``reached``; their events go to ``out``."""
        minimum, interval, timeout = self.settings
        buffered, last, until, closed, ends = known
        if rows:
            ends = rows[-1][0] + self.idle_ms
        for at, route, size in rows:
            if until is not None:
                if at > until or route == "error":
                    out.append((session, min(at, until), "unacknowledged", buffered))
                    until = None
                elif route == "completed":
                    out.append((session, at, "acknowledged", buffered))
                    until, buffered = None, 0
                continue
            if closed:
                continue
            last = at if last is None else last
            if route == "audio":
                buffered += size
                if buffered >= minimum and at - last >= interval:
                    out.append((session, at, "commit", buffered))
                    buffered, last = 0, at
            elif route in ("stop", "send-error"):
                closed = True
                if buffered < minimum:
                    out.append((session, at, "not-needed", buffered))
                elif route == "send-error":
                    out.append((session, at, "send-failed", buffered))
                else:
                    out.append((session, at, "awaiting-acknowledgement", buffered))
                    until = at + timeout
        if until is not None and until <= reached:
            out.append((session, until, "unacknowledged", buffered))
            until = None
        return buffered, last, until, closed, ends

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs()
        waiting = pa.concat_tables([
            _WAITING.empty_table(), *(_unpacked(cell) for cell, in (self.early.get() if self.early.exists() else ()))])
        passed = pc.less_equal(waiting["at_ms"], reached)
        ready, rest = waiting.filter(passed), waiting.filter(pc.invert(passed))
        if len(rest) and len(ready):
            self.early.put([(_packed(rest),)])
        elif len(ready):
            self.early.clear()
        rows: dict[int, list[tuple]] = {}
        ready = ready.sort_by([(c, "ascending") for c in _WAITING.names]).to_pydict()
        for session, at, route, size in zip(*(ready[c] for c in ("session_id", "at_ms", "route", "bytes"))):
            rows.setdefault(session, []).append((at, route, size))
        held = _unpacked(self.open.get()[0]) if self.open.exists() else _OPEN.empty_table()
        known = {row[0]: row[1:] for row in zip(*(c.to_pylist() for c in held.columns))}
        more = set(rest["session_id"].unique().to_pylist())
        out, kept, wakes = [], [], [pc.min(rest["at_ms"]).as_py()] if len(rest) else []
        for session in known | rows:
            now = self.walked(
                session, known.get(session, (0, None, None, False, None)), rows.get(session, []), reached, out)
            _, _, until, closed, ends = now
            if until is not None:
                wakes.append(until)
            elif closed and session not in more:
                if ends is None or ends <= reached:
                    continue
                wakes.append(ends)
            kept.append((session, *now))
        if kept:
            columns = [pa.array(c, kind.type) for c, kind in zip(zip(*kept), _OPEN)]
            self.open.update((_packed(pa.Table.from_arrays(columns, schema=_OPEN)),))
        elif self.open.exists():
            self.open.clear()
        if wakes:
            self.handle.registerTimer(min(wakes))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "at_ms", "event", "bytes"])

    def close(self) -> None:
        pass


def live_commits(
    stream: DataFrame,
    minimum: int = fixed.MINIMUM_COMMIT_BYTES,
    interval_ms: int = fixed.COMMIT_INTERVAL_MS,
    timeout_ms: int = fixed.DRAIN_TIMEOUT_MS,
    watermark: str = "10 seconds",
    buckets: int = BUCKETS,
) -> DataFrame:
    """``stream``: session_id, seq, route, at_ms, bytes.

    ``watermark`` is how far rows may come out of order; events are told once it has passed them.
    ``buckets`` of sessions keep their state together; a task holds the waiting rows of one bucket.
    """
    timed = stream.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", watermark)
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(buckets)).alias("bucket")
    return timed.select(bucket, *_WAITING.names, "at").groupBy("bucket").transformWithStateInPandas(
        CommitProcessor(minimum, interval_ms, timeout_ms), COMMIT_SCHEMA, "Append", "EventTime"
    )


# --- live alignment ---

def live_alignment(
    segments: DataFrame,
    events: DataFrame,
    window_ms: int = fixed.ALIGNMENT_WINDOW_MS,
    watermark: str = "10 minutes",
) -> DataFrame:
    """Stream-stream interval join of segment middles and UI events of a session.

    ``segments``: session_id, segment_id, mid_ms; ``events``: session_id, seq, event_id, unix_ms.
    """
    left = segments.where("mid_ms is not null").withColumn(
        "mid_at", F.timestamp_millis("mid_ms")
    ).withWatermark("mid_at", watermark)
    right = events.where("unix_ms is not null").select(
        F.col("session_id").alias("event_session"), "seq", "event_id", "unix_ms",
        F.timestamp_millis("unix_ms").alias("event_at"),
    ).withWatermark("event_at", watermark)
    span = f"interval {window_ms} milliseconds"
    joined = left.join(right, F.expr(
        f"session_id = event_session AND event_at BETWEEN mid_at - {span} AND mid_at + {span}"
    ))
    delta = F.col("unix_ms") - F.col("mid_ms")
    return joined.select(
        "session_id", "segment_id", "seq", "event_id", delta.alias("delta_ms"),
        instants.confidence_band(delta).alias("confidence"),
    )


# --- running a stream over what is there ---

MAX_BYTES_PER_TRIGGER = 512 * 1024 * 1024


def stream_folder(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Stream over the Parquet files of a folder.

    A micro-batch takes a bounded amount of input (or of files), so the rows of one session that meet
    in one task are bounded as well, whatever share of the stream the session has.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", MAX_BYTES_PER_TRIGGER)
    return reader.parquet(folder)


def stream_table(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """Stream over one Parquet table of a folder, a file or a folder of part files."""
    # a pattern that only the table matches: a stream takes a plain path for a folder, which a single file is not
    return stream_folder(spark, f"{folder}/{name}.parque[t]", schema)


def run_appended(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input and return the appended rows as a table."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    stream.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", scratch_path(spark, f"{name}-checkpoint")
    ).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_updated(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Process all available input of an update-mode aggregate; the last value per key counts.

    Every micro-batch overwrites its own folder, so a retried batch is written once.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, name)

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    stream.writeStream.outputMode("update").foreachBatch(save).option(
        "checkpointLocation", scratch_path(spark, f"{name}-checkpoint")
    ).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", out).parquet(f"{out}/epoch=*")
    values = [c for c in stream.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("v"))
    return latest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])
