from pyspark.sql import functions as F

from spanalign.operators import segments as sg, timeline as tl

EV = ("session_id bigint, seq bigint, kind string, audio_offset_ms bigint, "
      "monotonic_offset_ms bigint, text string")
UI = ("session_id bigint, seq bigint, event_id bigint, kind string, ts_raw string, unix_ms bigint, "
      "ts_status string, app string, window string, ui_hint string")
SEG = ("session_id bigint, segment_id bigint, start_ms bigint, end_ms bigint, "
       "monotonic_offset_ms bigint, timing_source string, text string")
SES = "session_id bigint, audio_started_ms bigint, rec_started_ms bigint"


def ui(seq, ms, window=None, hint=None, status="valid", session=1):
    return (session, seq, seq, "click", None, ms, status, "App", window, hint)


def seg(i, start, end, text, session=1):
    return (session, i, start, end, None, "audio-wall-clock-offset", text)


def test_segment_assembly(spark):
    rows = [
        (1, 1, "delta", 100, None, "Hello "), (1, 2, "delta", 250, 240, "world"),
        (2, 1, "delta", 50, None, "x"), (2, 2, "completed", 40, None, " first "),
        (2, 3, "completed", 90, None, "next"), (2, 4, "completed", 60, None, "back"),
        (2, 5, "completed", 95, None, "  "),
        (3, 1, "delta", 5, None, "  "), (4, 1, "delta", 5, None, "y" * 70_000),
    ]
    events = spark.createDataFrame(rows, EV)
    got = sg.assemble_segments(events).orderBy("session_id", "segment_id").collect()
    assert [(r.session_id, r.segment_id, r.start_ms, r.end_ms, r.text) for r in got] == [
        (1, 1, 0, 240, "Hello world"), (2, 1, 0, 40, "first"), (2, 2, 40, 90, "next"),
        (2, 3, 90, 90, "back"), (4, 1, 0, 5, "y" * 70_000)]
    assert got[0].timing_source == "process-local-monotonic-offset"
    assert [r.session_id for r in sg.oversize_delta_sessions(events).collect()] == [4]


def tables(spark, segs, events, anchor=0, rec=None):
    return (spark.createDataFrame(segs, SEG), spark.createDataFrame(events, UI),
            spark.createDataFrame([(1, anchor, rec)], SES))


def test_bands_and_confidence(spark):
    parts = tables(spark, [seg(1, 0, 1000, "t")], [ui(1, 500), ui(2, 2700), ui(3, 5900), ui(4, 8000)])
    got = tl.align_events(*parts).orderBy("seq").collect()
    assert [(r.delta_ms, r.confidence) for r in got] == [(0, "high"), (2200, "medium"), (5400, "low")]
    best = tl.aligned_segments(*parts).collect()
    assert [(r.near_event, r.best_confidence) for r in best] == [(0, "high")]
    assert [r.seq for r in tl.out_of_window_events(*parts).collect()] == [4]


def test_window_edge_is_inclusive(spark):
    parts = tables(spark, [seg(1, 0, 0, "t")], [ui(1, 6000), ui(2, 6001), ui(3, -6000)])
    assert sorted(r.seq for r in tl.align_events(*parts).collect()) == [1, 3]


def test_no_anchor(spark):
    parts = tables(spark, [seg(1, 0, 1000, "I clicked save")], [ui(1, 500)], anchor=None)
    assert tl.align_events(*parts).count() == 0
    assert [r.reason for r in tl.conflict_warnings(*parts).collect()] == ["missing-audio-anchor"]
    d = tl.alignment_diagnostics(*parts).first()
    assert (d.missing_audio_clock, d.out_of_window_events, d.clock_skew_status) == (1, 0, "missing-anchor")


def test_conflicts(spark):
    segs = [seg(1, 0, 0, "I pressed submit"), seg(2, 60_000, 60_000, "then typed it"), seg(3, 0, 0, "plain words"),
            seg(4, 0, 0, "opened it")]
    parts = tables(spark, segs, [ui(1, 100, "Cancel changes")])
    got = {r.segment_id: r.reason for r in tl.conflict_warnings(*parts).collect()}
    assert got == {1: "nearby-ui-label-mismatch", 2: "no-nearby-event"}
    shown = tl.conflict_events(tl.conflict_warnings(*parts), tl.align_events(*parts)).collect()
    assert [(r.segment_id, r.nearby_rank, r.window) for r in shown] == [(1, 1, "Cancel changes")]


def test_diagnostics(spark):
    segs = [seg(1, 0, 1000, "Same  text"), seg(2, 1000, 2000, "same text"), seg(3, 2000, 3000, "other")]
    events = [ui(1, 60_000, status="invalid"), ui(2, None, status="missing"), ui(3, 90_000)]
    d = tl.alignment_diagnostics(*tables(spark, segs, events, 0, 30_000)).first()
    assert (d.clock_skew_status, d.missing_timestamps, d.malformed_timestamps) == ("exceeds-window", 1, 1)
    assert (d.out_of_window_events, d.duplicate_segments, d.start_delta_ms) == (2, 1, 30_000)


def test_nested_context_and_notes(spark):
    segs, events, sess = tables(
        spark, [seg(1, 0, 1000, "I clicked save"), seg(2, 60_000, 61_000, "far")],
        [ui(i, 100 * i, "Main", "Delete row") for i in range(1, 7)])
    row = tl.temporal_context(segs, events, sess).first()
    assert len(row.segments) == 2 and len(row.events) == 6 and len(row.alignments[0].nearby) == 6
    assert row.warnings[0].reason == "nearby-ui-label-mismatch"
    lines = tl.note_lines(segs, tl.align_events(segs, events, sess)).orderBy("segment_id", "line_no").collect()
    assert [r.line_no for r in lines] == [0, 1, 2, 3, 4, 0]
    assert lines[0].line == "- [00:00-00:01] Transcript segment: [untrusted data] I clicked save"


def test_evidence_unwrap(spark):
    b = "struct<classification:string,consumerPolicy:string,instructionUse:string,uiProof:boolean>"
    good = ("untrusted-transcript-evidence", "evidence-only-never-instructions", "forbidden", False)
    p = "Transcript evidence: [untrusted data] "
    df = spark.createDataFrame([(p + "hi", good), (p + "hi", (*good[:3], True)), ("hi", good), (p, None)],
                               f"text string, boundary {b}")
    assert [r.evidence for r in tl.unwrap_evidence(df).collect()] == ["hi", None, None, None]


def test_monotonic_policy(spark):
    df = spark.createDataFrame([(1, 1, 0, 1, 5, "m", "a"), (1, 2, 0, 1, None, "w", "b"), (2, 1, 0, 1, None, "w", "c")], SEG)
    got = {r.session_id: (r.monotonic_segments, r.monotonic_status) for r in sg.monotonic_policy(df).collect()}
    assert got == {1: (1, "process-local-offsets-captured"), 2: (0, "not-captured")}
