import random

from pyspark.sql import functions as F

from spanalign.operators import segments as sg
from spanalign.streaming import live

CAP = "session_id bigint, seq bigint, route string, at_ms bigint, bytes bigint"
TR = ("session_id bigint, seq bigint, kind string, audio_offset_ms bigint, "
      "monotonic_offset_ms bigint, text string")


def stream_of(spark, tmp_path, name, schema, *batches):
    """Files written one after the other, read one per micro-batch."""
    folder = str(tmp_path / name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_commits_and_acknowledgement(spark, tmp_path):
    a, far = "audio", 100_000
    one = [(1, 1, a, 0, 4799), (1, 2, a, 6000, 1), (1, 3, a, 6500, 5000), (1, 4, "stop", 7000, 0),
           (2, 1, a, 0, 4000), (2, 2, "stop", 100, 0),
           (3, 1, a, 0, 9000), (3, 2, "send-error", 10, 0),
           (4, 1, a, 0, 9000), (4, 2, "stop", 10, 0),
           (5, 1, a, 0, 9000), (5, 2, "stop", 10, 0), (5, 3, "error", 20, 0)]
    two = [(1, 5, "completed", 8000, 0), (9, 1, a, far, 1)]
    three = [(9, 2, a, far + 1, 1)]
    base = 1_000_000  # instants at the epoch itself would be behind the first watermark
    batches = [[(s, n, r, ms + base, b) for s, n, r, ms, b in rows] for rows in (one, two, three)]
    out = live.run_appended(live.live_commits(
        stream_of(spark, tmp_path, "cap", CAP, *batches), watermark="1 second"), "commits-test")
    got = {}
    for r in out.orderBy("session_id", "at_ms").collect():
        got.setdefault(r.session_id, []).append((r.at_ms - base, r.event, r.bytes))
    assert got[1] == [(6000, "commit", 4800), (7000, "awaiting-acknowledgement", 5000), (8000, "acknowledged", 5000)]
    assert got[2] == [(100, "not-needed", 4000)]
    assert got[3] == [(10, "send-failed", 9000)]
    assert got[4] == [(10, "awaiting-acknowledgement", 9000), (5010, "unacknowledged", 9000)]
    assert got[5] == [(10, "awaiting-acknowledgement", 9000), (20, "unacknowledged", 9000)]


def test_segments_over_several_batches_equal_batch(spark, tmp_path):
    one = [(1, 1, "completed", 40, None, " a "), (1, 2, "delta", 50, None, "x"), (2, 1, "delta", 10, None, "He"),
           (3, 1, "delta", 5, None, "y" * 70_000)]
    two = [(1, 3, "completed", 30, 20, "b"), (2, 2, "delta", 20, 19, "llo "), (1, 4, "completed", 90, None, " ")]
    stops = [(s, n, "stop", None, None, "") for s, n in ((1, 5), (2, 3), (3, 2))]
    out = live.run_appended(live.live_segments(stream_of(spark, tmp_path, "tr", TR, one, two, stops)), "segments-test")
    want = sg.assemble_segments(spark.createDataFrame(one + two, TR))
    key = lambda df: sorted(tuple(r) for r in df.select(
        "session_id", "segment_id", "start_ms", "end_ms", "text", "timing_source").collect())
    assert key(out) == key(want) and len(key(out)) == 4


def shuffled(rows, seed=4):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return [rows[k::5] for k in range(5)]


def test_segments_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(s, n, rng.choice(["completed", "delta", "delta"] if s % 2 else ["delta"]), 10 * n, rng.choice([None, 10 * n - 1]), rng.choice([f" t{n} ", " ", f"u{n}"]))
            for s in range(6) for n in range(1, 12)]
    stops = [(s, 12, "stop", None, None, "") for s in range(6)]
    key = lambda df: sorted(tuple(r) for r in df.collect())
    want = key(sg.assemble_segments(spark.createDataFrame(rows, TR)).select("session_id", "segment_id", "start_ms", "end_ms", "text"))
    for name, batches in (("one", [rows + stops]), ("many", shuffled(rows + stops))):
        out = live.run_appended(live.live_segments(stream_of(spark, tmp_path, name, TR, *batches)), "any")
        assert key(out.select("session_id", "segment_id", "start_ms", "end_ms", "text")) == want


def test_commits_and_pairs_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(s, n, rng.choice(["audio", "audio", "completed", "error"]), 1_000_000 + 700 * n, rng.randint(500, 4000)) for s in range(5) for n in range(1, 40)]
    rows += [(s, 40, "stop", 1_000_000 + 28_000, 0) for s in range(5)]
    beat = (-1, 1, "heartbeat", 10**9, 0)
    found = []
    for name, batches in (("c1", [[*rows, beat]]), ("c5", [*shuffled(rows), [beat]])):
        stream = stream_of(spark, tmp_path, name, CAP, *batches)
        out = live.run_appended(live.live_commits(stream, watermark="1 hour"), "commits-any")
        found.append(sorted(tuple(r) for r in out.collect()))
    assert found[0] == found[1] and {r[2] for r in found[0]} > {"commit"}
    left = [(1, k, 1_000_000 + 9000 * k) for k in range(20)]
    right = [(1, k, k, 1_000_000 + 2500 * k) for k in range(70)]
    pairs = []
    for name, one, two in (("p1", [left], [right]), ("p5", shuffled(left), shuffled(right))):
        ls = stream_of(spark, tmp_path, name + "l", "session_id bigint, segment_id bigint, mid_ms bigint", *one)
        rs = stream_of(spark, tmp_path, name + "r", "session_id bigint, seq bigint, event_id bigint, unix_ms bigint", *two)
        pairs.append(sorted(tuple(r) for r in live.run_appended(live.live_alignment(ls, rs, watermark="1 hour"), "pairs-any").collect()))
    assert pairs[0] == pairs[1] and len(pairs[0]) > 50


def test_quota_over_batches_equals_batch(spark, tmp_path):
    schema = "session_id bigint, seq bigint, bytes bigint"
    one = [(1, 1, 5), (1, 2, 5), (2, 1, 50), (3, 1, 1)]
    two = [(1, 3, 5), (1, 4, 1), (2, 2, 90), (3, 2, 1)]
    three = [(3, 3, 1), (3, 4, 1), (3, 5, 1)]
    out = live.run_appended(live.live_quota(stream_of(spark, tmp_path, "q", schema, one, two, three), 60, 4, 12), "quota-test")
    want = live.quota_breaches(spark.createDataFrame(one + two + three, schema), 60, 4, 12)
    rows = lambda df: sorted((r.session_id, r.seq, r.reason) for r in df.collect())
    assert rows(out) == rows(want) == [(1, 3, "total-bytes"), (2, 1, "total-bytes"), (3, 5, "event-count")]


def test_capture_window_and_first_chunk(spark, tmp_path):
    rows = [(1, i, "audio", ms, 1) for i, ms in enumerate([5, 10, 20, 70_000, 90_000])]
    bounds = spark.createDataFrame([(1, 10, 80_000)], "session_id bigint, start_ms bigint, stop_ms bigint")
    df = spark.createDataFrame(rows, CAP)
    assert [r.at_ms for r in live.within_capture(df, bounds).orderBy("at_ms").collect()] == [10, 20, 70_000]
    assert live.within_capture(df, bounds, 60).count() == 2
    clock = live.run_updated(live.first_chunk_clock(
        stream_of(spark, tmp_path, "fc", CAP, rows[2:], rows[:2])), "clock-test", ["session_id"])
    assert [(r.session_id, r.first_chunk_ms) for r in clock.collect()] == [(1, 5)]


def test_live_alignment(spark, tmp_path):
    left = stream_of(spark, tmp_path, "l", "session_id bigint, segment_id bigint, mid_ms bigint", [(1, 1, 10_000), (1, 2, None)])
    right = stream_of(spark, tmp_path, "r", "session_id bigint, seq bigint, event_id bigint, unix_ms bigint",
                      [(1, 1, 1, 4000), (1, 2, 2, 3999)], [(1, 3, 3, 16_000), (2, 1, 1, 10_000), (1, 4, 4, None)])
    out = live.run_appended(live.live_alignment(left, right), "align-test")
    assert sorted((r.seq, r.delta_ms, r.confidence) for r in out.collect()) == [(1, -6000, "low"), (3, 6000, "low")]


TIMED = TR + ", at_ms bigint"
BASE = 10**12


def ran(spark, tmp_path, name, schema, build, *parts):
    """The output of ``build`` over files read one per micro-batch, stopped after each part and taken up again
    from the checkpoint; rows dropped behind the watermark; state rows left."""
    folder, out, dropped, left = str(tmp_path / name), str(tmp_path / f"{name}-out"), 0, 0
    for batches in parts:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-check")).trigger(
            availableNow=True).start(out)
        query.awaitTermination()
        operators = [op for progress in query.recentProgress for op in progress["stateOperators"]]
        dropped += sum(op["numRowsDroppedByWatermark"] for op in operators)
        left = operators[-1]["numRowsTotal"]
    return spark.read.schema(stream.schema).parquet(out).where("session_id >= 0"), dropped, left


def spoken(s, n, at, text="t", kind="completed"):
    return (s, n, kind, 10 * (n or 0), None, f"{text}{n}" if kind != "stop" else "", BASE + at)


def test_lost_late_and_repeated_rows_over_a_restart(spark, tmp_path):
    beat = [(-1, 1, "delta", None, None, None, BASE + 3 * live.IDLE_MS)]
    first = [[spoken(1, 1, 0), spoken(1, 2, 1_000), spoken(2, 1, 0, "d", "delta")],
             [spoken(1, 4, 60_000), spoken(1, 4, 60_500), spoken(2, 3, 60_000, "d", "delta")], [spoken(1, 5, 61_000)]]
    second = [[spoken(1, 3, 2_000), spoken(1, None, 61_500)], [spoken(1, 6, 62_000, kind="stop"), spoken(2, 4, 62_000, kind="stop")], beat]
    build = lambda stream: live.live_segments(stream, time="at_ms", watermark="10 seconds")
    out, dropped, left = ran(spark, tmp_path, "late", TIMED, build, first, second)
    kept = [r[:6] for batch in first for r in batch if r[6] != BASE + 60_500]
    want = sg.assemble_segments(spark.createDataFrame(kept, TR))
    columns = ["session_id", "segment_id", "start_ms", "end_ms", "text", "timing_source"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert rows(out.where("fault is null")) == rows(want) and len(rows(want)) == 5
    faults = sorted(out.where("fault is not null").select("session_id", "fault", "fault_from", "fault_to").collect(), key=str)
    assert [tuple(r) for r in faults] == [(1, "missing", 3, 3), (1, "repeated-or-late", 4, 4), (1, "unnumbered", None, None), (2, "missing", 2, 2)]
    assert dropped == 1
    assert left == ran(spark, tmp_path, "beat", TIMED, build, [beat])[2]  # closed sessions leave no state


def test_gaps_without_end_and_breaches_close(spark, tmp_path):
    schema = "session_id bigint, seq bigint, bytes bigint, at_ms bigint"
    rows = [(1, 1, 5, BASE), (1, 3, 5, BASE + 2), (1, 9, 90, BASE + 9), (1, 10, 1, BASE + 10), (2, 2, None, BASE + 1)]
    beat = [(-1, 1, 0, BASE + 3 * live.IDLE_MS)]
    for name, batches in (("q1", [rows, beat]), ("q2", [[r] for r in reversed(rows)] + [beat])):
        out, dropped, left = ran(spark, tmp_path, name, schema, lambda s: live.live_quota(s, 60, 9, 99, time="at_ms", watermark="1 minute"), batches)
        got = sorted((tuple(r) for r in out.select("session_id", "seq", "reason", "fault", "fault_from", "fault_to").collect()), key=str)
        assert got == sorted([(1, 9, "message-bytes", None, None, None), (1, None, None, "missing", 2, 2),
                              (1, None, None, "missing", 4, 8), (2, None, None, "missing", 1, 1)], key=str) and dropped == 0


def test_late_commits_are_counted_and_the_rest_equals_one_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(s, n, rng.choice(["audio", "audio", "completed", "error"]), BASE + 7_000 * n, rng.randint(500, 4000)) for s in range(3) for n in range(1, 25)]
    rows += [(s, 25, "stop", BASE + 7_000 * 25, 0) for s in range(3)]
    beat = [(-1, 1, "heartbeat", BASE + 3 * live.IDLE_MS, 0)]
    late = [r for r in rows if r[1] == 4]
    steps = [[r for r in rows if r not in late and (r[1] - 1) // 6 == k] for k in range(5)]
    build = lambda stream: live.live_commits(stream, watermark="20 seconds")
    out, dropped, _ = ran(spark, tmp_path, "cl", CAP, build, steps[:2], [late, *steps[2:], beat])
    one, none, _ = ran(spark, tmp_path, "co", CAP, build, [[r for r in rows if r not in late], beat])
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(out) == key(one) and len(key(one)) > 6 and (dropped, none) == (3, 0)


def test_a_table_may_be_one_file_or_a_folder_of_parts(spark, tmp_path):
    rows = spark.range(20).selectExpr("id as conv_id", "id as turn")
    rows.repartition(3).write.parquet(str(tmp_path / "parts" / "conversations.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "made"))
    part, = (tmp_path / "made").glob("*.parquet")
    (tmp_path / "file").mkdir()
    (tmp_path / "file" / "conversations.parquet").write_bytes(part.read_bytes())
    rows.where("conv_id < 3").write.parquet(str(tmp_path / "parts" / "other.parquet"))
    for folder in ("parts", "file"):
        stream = live.stream_table(spark, str(tmp_path / folder), "conversations", rows.schema)
        assert sorted(r.turn for r in live.run_appended(stream, f"table-{folder}").collect()) == list(range(20))


def test_commits_of_many_sessions_share_state(spark, tmp_path):
    """Keys of the state grow with the buckets, not with the sessions (a session had several of its own)."""
    first, last = 1_000_000, 10**10
    one = [(s, n, "audio", first + 4000 * n, 3000) for s in range(60) for n in range(3)]
    two = [(s, 9, "stop", first + 20_000, 0) for s in range(60)]
    stream = stream_of(spark, tmp_path, "many-sessions", CAP, one, two, [(-1, 1, "heartbeat", last, 0)])
    asked = live.live_commits(stream, watermark="1 hour", buckets=3).writeStream.format("memory").queryName(
        "shared_commits").outputMode("append").trigger(availableNow=True).start()
    asked.awaitTermination()
    keys = [op["numRowsTotal"] for p in asked.recentProgress for op in p["stateOperators"]]
    assert 0 < max(keys) < 60
    got = sorted(tuple(r) for r in spark.table("shared_commits").collect())
    assert got == sorted(row for s in range(60) for row in (
        (s, first + 8000, "commit", 9000), (s, first + 20_000, "not-needed", 0)))


def test_losses_of_many_sessions_share_state(spark, tmp_path):
    """Clocks and places are kept per bucket; a session has one entry, or its waiting row."""
    beat = [(-1, 1, "delta", None, None, None, BASE + 3 * live.IDLE_MS)]
    batches = [[spoken(s, 1, 0) for s in range(60)], [spoken(s, 3 if s % 5 == 0 else 2, 60_000) for s in range(60)],
               [spoken(s, 4 if s % 5 == 0 else 3, 120_000, kind="stop") for s in range(60)], beat]
    stream = stream_of(spark, tmp_path, "many-lossy", TIMED, *batches)
    asked = live.live_segments(stream, time="at_ms", watermark="10 seconds", buckets=3).writeStream.format("memory").queryName(
        "shared_losses").outputMode("append").trigger(availableNow=True).start()
    asked.awaitTermination()
    keys = [op["numRowsTotal"] for p in asked.recentProgress for op in p["stateOperators"]]
    assert 60 < max(keys) < 2 * 60
    got = spark.table("shared_losses").where("session_id >= 0")
    assert got.where("fault is null").count() == 120
    assert sorted(tuple(r) for r in got.where("fault is not null").select("session_id", "fault", "fault_from", "fault_to").collect()) == [
        (s, "missing", 2, 2) for s in range(0, 60, 5)]
