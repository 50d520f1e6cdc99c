import hashlib
import json

import pytest

from spanalign.operators import inventory as inv, segments as sg
from spanalign.sources import readers as rd, writers as wr


def put(root, session, name, text):
    folder = root / session
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def line(**fields):
    return json.dumps(fields) + "\n"


def test_transcript_rows_strict_and_lenient(spark, tmp_path):
    ok = line(kind="delta", audioOffsetMs=100, text="Hello ") + line(
        kind="delta", audioOffsetMs=250, monotonicOffsetMs=240, text="world", extra=1)
    put(tmp_path, "s1", "transcript.timeline.jsonl", ok)
    put(tmp_path, "s2", "transcript.timeline.jsonl", "")
    rows = rd.read_transcript_events(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.session_id, r.seq, r.monotonic_offset_ms, r.text) for r in rows] == [
        ("s1", 1, None, "Hello "), ("s1", 2, 240, "world")]
    segment = sg.assemble_segments(rd.read_transcript_events(spark, str(tmp_path))).first()
    assert (segment.text, segment.end_ms) == ("Hello world", 240)

    put(tmp_path, "s3", "transcript.timeline.jsonl", ok.split("\n")[0] + "\nnot json")
    with pytest.raises(Exception, match="malformed JSONL at row 2 of session s3"):
        rd.read_transcript_events(spark, str(tmp_path)).collect()
    good, bad = rd.read_transcript_events_lenient(spark, str(tmp_path))
    assert good.count() == 3
    assert [(r.session_id, r.seq, r.value) for r in bad.collect()] == [("s3", 2, "not json")]


def test_missing_input_is_empty(spark, tmp_path):
    assert rd.read_transcript_events(spark, str(tmp_path / "none")).count() == 0
    assert rd.read_session_documents(spark, str(tmp_path / "none"), "clock.json", "a int").count() == 0


def test_ui_events(spark, tmp_path):
    rows = line(id=1, kind="click", timestamp="2031-05-17T06:07:08.912345Z", app={"name": "App"},
                window={"title": "see /home/me/x.md"}, selection={"selectedText": "mail a@b.co"})
    rows += line(timestamp="bad-date", window={"title": ""}, selection={"target": {"value": "v" * 260}})
    rows += line(ax={"mode": "AXButton"})
    put(tmp_path, "s1", "events.jsonl", rows)
    a, b, c = rd.read_ui_events(spark, str(tmp_path)).orderBy("seq").collect()
    assert (a.event_id, a.unix_ms, a.ts_status) == (1, 1936764428912, "valid")
    assert (a.window, a.ui_hint) == ("see \\[REDACTED\\_PATH\\]", "mail \\[REDACTED\\_EMAIL\\]")
    assert (b.kind, b.ts_raw, b.ts_status, b.window) == ("unknown", None, "invalid", None)
    assert b.ui_hint == "v" * 240 + "..."
    assert (c.ts_status, c.ui_hint) == ("missing", "AXButton")
    put(tmp_path, "s2", "events.jsonl", line(kind="x") + "\n" + line(kind="y"))
    with pytest.raises(Exception, match="row 2 of session s2"):
        rd.read_ui_events(spark, str(tmp_path)).collect()
    good, bad = rd.read_ui_events_lenient(spark, str(tmp_path))
    assert (good.count(), [r.seq for r in bad.collect()]) == (5, [2])


def test_documents_bytes_and_chunks(spark, tmp_path):
    put(tmp_path, "s1", "clock.json", '{"audioStartedAtUnixMs": 5}')
    put(tmp_path, "s2", "clock.json", "{broken")
    docs = rd.read_session_documents(spark, str(tmp_path), "clock.json", "audioStartedAtUnixMs bigint")
    got = {r.session_id: r.document and r.document.audioStartedAtUnixMs for r in docs.collect()}
    assert got == {"s1": 5, "s2": None}
    put(tmp_path, "s1", "raw.bin", b"a\nb\xff")
    stats = inv.file_stats(rd.read_artifact_bytes(spark, str(tmp_path / "*" / "raw.bin"))).first()
    assert (stats.session_id, stats.bytes, stats.line_count) == ("s1", 4, 2)
    assert stats.fingerprint == "sha256:" + hashlib.sha256(b"a\nb\xff").hexdigest()
    assert rd.read_artifact_bytes(spark, str(tmp_path / "*" / "raw.bin"), 3).first().oversize
    put(tmp_path, "s1", "audio-chunks.jsonl", line(byteStart=0, byteEnd=4, sampleStart=0, sampleEnd=2, monotonicOffsetMs=7))
    chunk = rd.read_audio_chunks(spark, str(tmp_path)).first()
    assert (chunk.idx, chunk.byte_end, chunk.sample_end, chunk.monotonic_offset_ms) == (1, 4, 2, 7)


def test_metric_report(spark):
    doc = {"data": [{"totals": {"lines": {"percent": 96.5}}, "files": [
        {"filename": "a", "summary": {"lines": {"percent": 100.0}}},
        {"filename": "b", "summary": {"lines": {"percent": 90.0}}}, {"filename": "c", "summary": {}}]}]}
    from spanalign.operators.ledger import below_full
    flat = rd.flatten_metric_report(spark.createDataFrame([(1, json.dumps(doc))], "report_id int, document string"))
    assert [(r.path, r.percent, r.total_percent) for r in below_full(flat).collect()] == [("b", 90.0, 96.5)]


def test_sinks(spark, tmp_path):
    lines = spark.createDataFrame([("s1", 2, 0, "c"), ("s1", 1, 1, "b"), ("s1", 1, 0, "a"), ("s2", 1, 0, "x")],
                                  "session_id string, segment_id int, line_no int, line string")
    wr.write_timestamped_notes(lines, str(tmp_path / "notes"))
    parts = sorted((tmp_path / "notes" / "session_id=s1").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "a\nb\nc\n"
    final = spark.createDataFrame(
        [("s1", 1, 0, 5, "t", 0.5, [1, 2], None, "src", "monotonic-token-window")],
        "session_id string, id int, start_ms int, end_ms int, text string, confidence double, "
        "source_segment_ids array<int>, mismatch string, source string, alignment_strategy string")
    wr.write_final_timeline(final, str(tmp_path / "final"))
    row = json.loads("".join(p.read_text() for p in (tmp_path / "final").glob("part-*")))
    assert row["startMs"] == 0 and row["sourceRealtimeSegmentIds"] == [1, 2] and row["mismatch"] is None
    wr.write_temporal_context(final, str(tmp_path / "context"))
    wr.write_evidence_report(final, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def test_capture_stream_routes(spark, tmp_path):
    from spanalign.streaming import live
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"type": live.DELTA_TYPE, "delta": "checking"}, {"type": live.COMPLETED_TYPE, "transcript": " "},
            {"type": live.COMPLETED_TYPE, "transcript": "done"}, {"type": "error"}, {"type": "x"}]
    put(folder, "s1", "m.jsonl", "".join(line(**r) for r in rows))
    out = live.run_appended(live.routed(rd.read_capture_stream(spark, str(folder))), "capture-test")
    got = sorted((r.route, r.text or "") for r in out.where("session_id = 's1'").collect())
    assert got == [("completed", "done"), ("delta", "checking"), ("error", ""), ("other", ""), ("other", "")]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    texts = {f"s{k}": [f"line {n} " + "x" * (n % 7) for n in range(60 + 5 * k)] for k in range(3)}
    for name, lines in texts.items():
        put(tmp_path, name, "events.txt", "\n".join(lines) + ("\n" if name == "s1" else ""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("134217728", "100"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            found = rd.read_lines(spark, str(tmp_path / "*" / "events.txt")).collect()
            assert sorted((r.session_id, r.seq, r.value) for r in found) == sorted(
                (name, n, line) for name, lines in texts.items() for n, line in enumerate(lines, 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_grow_with_bytes_not_with_sessions(spark, tmp_path, monkeypatch):
    from spanalign.plans import source_queries as sq
    spark.range(600).selectExpr("id AS o_orderkey", "id % 300 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(300).selectExpr("id AS event_id", "id AS user_id", "timestamp '2024-01-01' AS ts", "'click' AS event_type",
                                "'{}' AS props").write.parquet(str(tmp_path / "events.parquet"))
    for query in (sq.read_chunks, sq.read_documents, sq.read_artifacts, sq.read_capture, sq.read_events):
        made = tmp_path / query.__name__
        monkeypatch.setattr(sq, "scratch_path", lambda _, name: str(made / name))
        rows = query(spark, str(tmp_path)).count()
        assert rows == {"read_chunks": 600}.get(query.__name__, 300)
        assert len(list(made.rglob("part-*"))) < 50


def test_packed_lines_keep_session_and_place(spark, tmp_path):
    rows = [(f"s{k}", n, line(kind="delta", text=f"{n}\twith a tab")[:-1]) for k in range(3) for n in range(40 + k)] + [(None, 0, "{}")]
    frame = spark.createDataFrame(rows, "session_id string, at int, value string")
    want = sorted((s or "", n + 1, v) for s, n, v in rows)
    settings = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1",
                "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "5"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        wr.write_packed_lines(frame, str(tmp_path / "packed"), ["at"])
        assert len(list((tmp_path / "packed").glob("part-*"))) > 2
        found = rd.read_packed_lines(spark, str(tmp_path / "packed")).collect()
        assert sorted((r.session_id or "", r.seq, r.value) for r in found) == want
        assert [r.session_id for r in found if r.value == "{}"] == [None]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    wr.write_packed_lines(spark.createDataFrame([("s1", 1, "{}"), ("s1", 2, "{broken")], "session_id string, at int, value string"), str(tmp_path / "bad"), ["at"])
    with pytest.raises(Exception, match="malformed JSONL at row 2 of session s1"):
        rd.read_transcript_events(spark, str(tmp_path / "bad"), packed=True).collect()
    assert rd.read_packed_lines(spark, str(tmp_path / "none")).count() == 0


def test_packed_files_read_like_files(spark, tmp_path):
    rows = [("s1", "clock.json", b'{"audioStartedAtUnixMs":\n 5}'), ("s2", "clock.json", b"{broken"), ("s1", "raw.bin", b"a\nb\xff")]
    for session, name, text in rows:
        put(tmp_path, session, name, text)
    packed = str(tmp_path / "packed" / "files")
    wr.write_packed_files(spark.createDataFrame([(s, n, bytearray(c)) for s, n, c in rows], "session_id string, name string, content binary"), packed)
    for name in ("clock.json", "none.json"):
        docs = [rd.read_session_documents(spark, str(root), name, "audioStartedAtUnixMs bigint", packed=p).collect()
                for root, p in ((tmp_path, False), (packed, True))]
        assert sorted(map(repr, docs[0])) == sorted(map(repr, docs[1]))
    stats = [sorted((r.session_id, r.name, r.length, r.oversize, r.line_count, r.fingerprint) for r in inv.file_stats(files).collect())
             for files in (rd.read_artifact_bytes(spark, str(tmp_path / "s*" / "*"), 4),
                           rd.read_artifact_bytes(spark, packed, 4, packed=True))]
    assert stats[0] == stats[1] and len(stats[0]) == 3
