import random
import time

import pytest
from pyspark.sql import functions as F

from spanalign import fixed
from spanalign.operators import cleanup as cu, delay as dl, scoring as sc, voice as vc


def test_cleanup_hand_cases(spark):
    cases = {
        ("Hello, world!", "hello world"): cu.PRESERVED,
        ("chat gpt rocks", "ChatGPT rocks"): cu.PRESERVED,
        ("clode code works", "Claude Code works"): cu.PRESERVED,
        ("the wether today", "the weather today"): cu.PRESERVED,
        ("a cat", "a bat"): cu.CHANGED,
        ("one two three", "one three"): cu.CHANGED,
        ("one two", "two one"): cu.CHANGED,
        ("nine four two", "942"): cu.CHANGED,
        ("", "x"): cu.EMPTY, ("x", "..."): cu.EMPTY,
        ("Été déjà", "été DÉJÀ"): cu.PRESERVED,
    }
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "session_id bigint, raw string, cleaned string")
    got = {r.session_id: r.reason for r in cu.validate_cleanup(df).collect()}
    assert got == {i: want for i, want in enumerate(cases.values())}
    assert cu.validate_cleanup(df, max_tokens=1).where("session_id = 0").first().reason == cu.TOO_LONG


def test_cleanup_equals_full_search():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    def search(raw, cleaned, allowed):
        seen, todo = set(), [(0, 0)]
        while todo:
            i, j = todo.pop()
            if (i, j) in seen:
                continue
            seen.add((i, j))
            for di in range(1, 5):
                for dj in range(1, 5):
                    if i + di <= len(raw) and j + dj <= len(cleaned):
                        a, b = "".join(raw[i:i + di]), "".join(cleaned[j:j + dj])
                        if a == b or (b in allowed and edits(a, b) <= 2) or (
                                di == dj == 1 and len(a) >= 4 and edits(a, b) <= 1):
                            todo.append((i + di, j + dj))
        return (len(raw), len(cleaned)) in seen

    rng = random.Random(9)
    words, allowed = ["chat", "gpt", "chatgpt", "cha", "tgpt", "wether", "weather", "a", "b"], frozenset(["chatgpt"])
    for _ in range(400):
        raw = rng.choices(words, k=rng.randint(1, 6))
        cleaned = [w if rng.random() > 0.3 else rng.choice(words) for w in raw]
        assert cu.is_conservative(raw, cleaned, allowed) == search(raw, cleaned, allowed)
    for _ in range(300):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 6))) for _ in "xy")
        for limit in (0, 1, 2):
            assert cu.within_edits(a, b, limit) == (edits(a, b) <= limit)


def test_long_cleanup_is_checked_in_seconds():
    rng = random.Random(4)
    raw = [f"word{rng.randrange(30_000)}" for _ in range(100_000)]
    cleaned = [w + "s" if k % 997 == 3 else w for k, w in enumerate(raw)]
    cleaned[50_000:50_002] = ["".join(cleaned[50_000:50_002])]
    began = time.perf_counter()
    assert cu.is_conservative(raw, cleaned, frozenset())
    assert not cu.is_conservative(raw, [*cleaned[:70_000], "something", *cleaned[70_000:]], frozenset())
    assert cu.is_conservative(["a"] * 2000, ["a"] * 1500 + ["aa"] * 250, frozenset())
    assert time.perf_counter() - began < 60


def test_density_and_recall(spark):
    df = spark.createDataFrame([(9, 5, 0), (30, 1, 10), (29, 3, 10), (30, 2, 10), (49, 2, 3), (50, 2, 3)],
                               "w bigint, s bigint, e bigint")
    got = [r[0] for r in df.select(sc.density_status(F.col("w"), F.col("s"), F.col("e"))).collect()]
    assert got == [fixed.SPARSE] * 3 + [fixed.NEEDS_DISTILLATION] * 2 + [fixed.SUFFICIENT]
    segs = spark.createDataFrame([(1, "Alphabet DELTAs"), (1, "golf"), (2, "none")], "session_id bigint, text string")
    assert {r.session_id: (r.found, r.missing) for r in sc.marker_recall(segs).collect()} == {1: (3, 14), 2: (0, 17)}


def test_start_sync(spark):
    ses = ("session_id bigint, audio_started_ms bigint, first_chunk_ms bigint, rec_started_ms bigint, rec_ended_ms bigint, "
           "state string, drain_completed bigint, drain_observed bigint")
    rows = [(1, 1000, 3000, 0, None, "stopped", None, 2), (2, 1000, 6000, 0, None, "stopped", 1, None),
            (3, 1000, None, 0, 10, "stopped", 1, 1), (4, 1000, None, 0, None, "recording", 1, 1),
            (5, None, None, 0, None, "stopped", 1, 1), (6, 5000, None, 0, None, "stopped", 0, None),
            (7, 5000, None, 0, None, "stopped", 1, None)]
    events = [(i, 1, "click", 5) for i in (1, 2, 4, 5, 6)] + [(3, 1, "click", 11)]
    got = sc.start_sync_check(spark.createDataFrame(rows, ses), spark.createDataFrame(
        events, "session_id bigint, seq bigint, kind string, unix_ms bigint")).collect()
    assert {r.session_id: r.status for r in got} == {
        1: "timestamp-proximity-verified", 2: "blocked", 3: "invalid-input", 4: "blocked",
        5: "invalid-input", 6: "blocked", 7: "blocked"}
    one = next(r for r in got if r.session_id == 1)
    assert (one.start_delta_ms, one.audio_source, one.drained_segments) == (3000, "first-audio-chunk", 2)


READY = {
    "session_id": 1, "state": "stopped", "same_operation": True, "parent_verified": True, "run_id": "r",
    "metadata_provided": True, "metadata_usable": True, "events_provided": True, "events_usable": True,
    "audio_clock_present": True, "segments": 2, "events": 3, "drain_present": True, "drained_segments": 1,
    "drain_errors": 0, "alignment_status": "aligned", "mismatches": 0,
    "inspection_status": "requires-real-packet-review", "leak_status": "expected-local-references-only",
    "share_without_review": False,
}


def test_readiness_positive_state_is_reachable(spark):
    none = spark.createDataFrame([], "session_id bigint, name string")
    df = spark.createDataFrame([READY])
    open_ = sc.readiness_receipt(df, none, standing=(sc.OPERATOR_REVIEW,)).first()
    assert (open_.status, open_.blockers) == ("requires-operator-review", [sc.OPERATOR_REVIEW])
    default = sc.readiness_receipt(df, none).first()
    assert (default.status, default.blockers) == ("blocked", [sc.ATTESTATION_MISSING, sc.OPERATOR_REVIEW])
    gap = spark.createDataFrame([(1, "manifest")], "session_id bigint, name string")
    assert sc.readiness_receipt(df, gap, standing=(sc.OPERATOR_REVIEW,)).first().status == "blocked"


def test_reviews(spark):
    base = {"session_id": 1, "context_exists": True, "packet_exists": True, "evidence_exists": True, "plan_exists": True,
            "plan_valid": True, "plan_speaks": False, "inspection_exists": True, "receipt_exists": True, "conflicts": 0,
            "leaks": 0, "raw_sensitive": 0, "out_of_window_events": 0, "density_status": fixed.SUFFICIENT,
            "quality_complete": True, "proofs_valid": True}
    good = sc.review_scorecard(spark.createDataFrame([base])).first()
    assert good.status == "requires-operator-review" and len(good.actions) == 1
    assert good.blockers == list(sc.COHESION_OWED)
    bad = sc.review_scorecard(spark.createDataFrame([{**base, "leaks": 2, "conflicts": 1}])).first()
    assert bad.status == "blocked" and len(bad.actions) == 2
    gone = sc.review_scorecard(spark.createDataFrame([{**base, "context_exists": False}])).first()
    assert gone.status == "blocked-missing-temporal-context"


def test_delay(spark):
    ev = spark.createDataFrame(
        [(1, 1, "delta", 90, 70, "a"), (1, 2, "completed", 200, None, "b"), (1, 3, "delta", 1, 1, "c"), (2, 1, "other", 1, 1, "x")],
        "session_id bigint, seq bigint, kind string, audio_offset_ms bigint, monotonic_offset_ms bigint, text string")
    rows = {r.session_id: r for r in dl.first_latencies(ev).collect()}
    assert (rows[1].first_delta_ms, rows[1].first_delta_source) == (70, fixed.MONOTONIC_SOURCE)
    assert (rows[1].first_completed_ms, rows[1].first_completed_source) == (200, fixed.WALL_CLOCK_SOURCE)
    assert (rows[2].first_delta_ms, rows[2].first_delta_source) == (None, "missing")

    schema = ("pair_id bigint, status string, first_audio_ms bigint, first_delta_ms bigint, first_completed_ms bigint, "
              "utterances bigint, mismatches bigint, recall bigint")
    base = [(i, "aligned", 10, 100, 200, 5, 0, 3) for i in (1, 2, 3, 4, 5)]
    cand = [(1, "aligned", 10, 90, 200, 5, 0, 3), (2, "aligned", 10, 90, 200, 4, 0, 3), (3, "aligned", 10, None, 200, 5, 0, 3),
            (4, "aligned", None, 100, 200, 5, 0, 3), (5, "aligned-with-review-warnings", 1, 1, 1, 9, 0, 3)]
    got = {r.pair_id: r for r in dl.compare_delay(spark.createDataFrame(base, schema), spark.createDataFrame(cand, schema)).collect()}
    assert {k: r.status for k, r in got.items()} == {
        1: "candidate-lower-latency-needs-operator-review", 2: "keep-current-default", 3: "inconclusive",
        4: "candidate-lower-latency-needs-operator-review", 5: "keep-current-default"}
    assert (got[1].first_delta_ms_delta, got[4].first_audio_ms_delta) == (-10, None)


def test_voice(spark):
    segs = spark.createDataFrame([(1, 1, 0, 1000), (1, 2, 5, 5), (1, 3, 9, 8)], "session_id bigint, segment_id bigint, start_ms bigint, end_ms bigint")
    cues = vc.voice_cues(vc.voice_bindings(segs, "calm", "slow", "high")).orderBy("segment_id").collect()
    assert [(c.planned_ms, c.status) for c in cues] == [(1250, "dry-run-not-spoken"), (1, "dry-run-not-spoken"), (None, "invalid-binding")]
    assert (cues[0].tone, cues[0].pace_multiplier, cues[0].emphasis_gain) == ("steady and low-variance", 0.8, 1.2)
    with pytest.raises(ValueError):
        vc.voice_bindings(segs, pace="odd")
