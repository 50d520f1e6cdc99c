"""Registered queries: cleaned-text alignment, session scores, latency, voice."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanalign import fixed
from spanalign.fixed import MESSAGES
from spanalign.functions import checks, similarity, text as tx
from spanalign.operators import (
    alignment as al, cleanup as cu, delay as dl, inventory as inv, scoring as sc, segments as sg,
    timeline as tl, voice as vc,
)
from spanalign.operators.fuzzy import similar_tokens
from spanalign.operators.utterances import utterances
from spanalign.plans.record_queries import (
    _FINDINGS, _LEAK, _inventory, approved_paths, artifacts, failed as _failed,
)
from spanalign.plans.sql import NON_WS, query, squeeze, tokens, words
from spanalign.plans.timeline_queries import _BEST, _CONFLICTS, _FAR
from spanalign.session import written
from spanalign.sources import tables as src


# --- cleaned text ---

def cleaned_text(segments):
    """Every seventh word of each segment dropped; segments joined in order to one text per session."""
    kept = F.filter(tx.split_words(F.col("text")), lambda w, i: i % 7 != 6)
    rows = segments.select(
        "session_id", F.struct("segment_id", F.array_join(kept, " ").alias("t")).alias("part")
    )
    return rows.groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["t"]), " ")
        .alias("cleaned_text")
    )


def align_cleaned(spark, sf):
    segs = src.shared_segments(spark, sf)
    cleaned = written(cleaned_text(segs), "cleaned")
    final = al.align_cleaned(segs, cleaned)
    return al.final_timeline(final).select(
        "session_id", "id", "start_ms", "end_ms", "text", F.round("confidence", 6).alias("confidence"),
        F.array_join(F.transform("source_segment_ids", lambda i: i.cast("string")), ",").alias("sources"),
        "mismatch", "alignment_strategy",
    )


def align_fallback(spark, sf):
    """Proportional allocation of the cleaned words of each session over all its segments."""
    segs = src.shared_segments(spark, sf)
    cleaned = written(cleaned_text(segs), "cleaned")
    return al.align_fallback(segs, cleaned, cleaned.select("session_id")).select(
        "session_id", "id", "start_ms", "end_ms", "text", F.round("confidence", 6).alias("confidence"),
        "mismatch",
    )


def final_status(spark, sf):
    return al.final_status(_final_like(src.shared_segments(spark, sf)))


def alignment_limits(spark, sf):
    segs = src.shared_segments(spark, sf)
    return al.alignment_limits(segs, cleaned_text(segs))


def utterance_spans(spark, sf):
    segs = src.shared_segments(spark, sf)
    return utterances(cleaned_text(segs)).select(
        "session_id", "utterance_id", "marker_label", F.md5("text").alias("digest"),
        "token_start", "token_end",
    )


def document_utterances(spark, sf):
    docs = src.table(spark, sf, "documents").select(
        F.col("doc_id").alias("session_id"), F.col("text").alias("cleaned_text"))
    return utterances(docs).groupBy("session_id").agg(
        F.count("*").alias("utterances"), F.max("token_end").alias("tokens"))


def similar_token_pairs(spark, sf):
    segs = src.shared_segments(spark, sf)
    cleaned = cleaned_text(segs)
    return similar_tokens(al.cleaned_tokens(cleaned), al.realtime_tokens(segs))


def phrase_similarity(spark, sf):
    """Each turn against the turn two places later (joined on the row number)."""
    rows = src.transcript_rows(src.table(spark, sf, "conversations")).select(
        "session_id", "seq", tx.tokens_ascii(F.col("text")).alias("ts"))
    later = rows.select("session_id", (F.col("seq") - 2).alias("seq"), F.col("ts").alias("us"))
    return rows.join(later, ["session_id", "seq"]).select(
        "session_id", "seq", F.round(similarity.phrase_similarity(F.col("ts"), F.col("us")), 6).alias("similarity"))


def clamp_forward(spark, sf):
    """Spans of orders (customer by customer) made to run forwards."""
    orders = src.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("id"),
        F.expr("(o_orderkey * 37) % 1000 + o_orderkey div 50").alias("start_ms"),
        F.expr("(o_orderkey * 91) % 1000 + o_orderkey div 50").alias("end_ms"),
    )
    return al.clamp_forward(orders, "id")


def label_search(spark, sf):
    """First segment at or after each segment's position that carries a spoken label."""
    segs = src.shared_segments(spark, sf)
    spoken = al.spoken_labels(segs)
    labels = F.explode(F.array(*[F.lit(x) for x in ("alpha", "bravo", "kilo")])).alias("label")
    wanted = segs.select(
        "session_id", F.col("segment_id").alias("utterance_id"),
        (F.col("segment_id") - 1).alias("from_idx"), labels)
    ids = wanted.withColumn("utterance_id", F.concat_ws(":", "utterance_id", "label"))
    numbered = ids.withColumn("utterance_id", F.xxhash64("utterance_id"))
    found = al.first_label_at_or_after(numbered, spoken)
    return numbered.join(found, ["session_id", "utterance_id"]).select(
        "session_id", (F.col("from_idx") + 1).alias("segment_id"), "label",
        (F.col("marker_idx") + 1).alias("found_segment_id"))


def validate_cleanup(spark, sf):
    """Turns against altered copies: punctuation, one letter, one word dropped, words swapped."""
    rows = src.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("session_id"), F.col("text").alias("raw"))
    ws = tx.split_words(F.col("raw"))
    v = F.col("session_id") % 5
    cleaned = (
        F.when(v == 0, F.concat(F.upper("raw"), F.lit("!")))
        .when(v == 1, F.array_join(F.transform(ws, lambda w, i: F.when(
            (F.char_length(w) > 6) & (i % 9 == 0), F.concat(F.substring(w, 1, 2), F.call_function("substring", w, F.lit(4)))
        ).otherwise(w)), " "))
        .when(v == 2, F.array_join(F.slice(ws, 2, F.size(ws)), " "))
        .when(v == 3, F.array_join(F.reverse(ws), " ")).otherwise(F.lit("..."))
    )
    return cu.validate_cleanup(rows.withColumn("cleaned", cleaned))


def select_authoritative(spark, sf):
    """Sessions whose receipts verify use a marked copy of their segments."""
    segs = src.shared_segments(spark, sf)
    sess = src.sessions(spark, sf)
    digest = checks.sha256(F.col("session_id").cast("string"))
    receipts = sess.select("session_id", F.create_map(
        F.lit("status"), F.expr("CASE WHEN session_id % 4 = 1 THEN 'stale' ELSE 'completed' END"),
        F.lit("timeline"), digest,
        F.lit("cleanup"), F.when(F.expr("session_id % 6 = 2"), F.lit(None).cast("string")).otherwise(digest),
    ).alias("fields"))
    held = sess.select("session_id", F.create_map(
        F.lit("timeline"), F.when(F.expr("session_id % 7 = 3"), F.lit("other")).otherwise(digest),
        F.lit("cleanup"), digest,
    ).alias("fields"))
    verified = al.verified_receipts(
        receipts, held, ["timeline", "cleanup"], {"status": "completed"}
    ).where(F.size("failures") == 0)
    final = segs.select("session_id", F.col("segment_id").alias("id"), "start_ms", "end_ms",
                        F.concat(F.lit("final "), "text").alias("text"))
    return sg.select_authoritative(segs, final, verified).select(
        "session_id", "segment_id", "timing_source", "monotonic_offset_ms", F.md5("text").alias("digest"))


# --- scores ---

def narration_quality(spark, sf):
    segs, evs, sess = src.shared_tables(spark, sf)
    return sc.narration_quality(segs, evs, sess)


def marker_recall(spark, sf):
    return sc.marker_recall(src.shared_segments(spark, sf))


def start_sync_check(spark, sf):
    rows = sc.start_sync_check(src.sessions(spark, sf), _sound_events(spark, sf))
    return rows.select(*[
        F.col(c).cast("bigint").alias(c) if t == "boolean" else F.col(c) for c, t in rows.dtypes])


def _sound_events(spark, sf):
    """Missing times of three quarters of the sessions become the recording start (others fail the check)."""
    started = src.sessions(spark, sf).select("session_id", "rec_started_ms")
    at = F.when(F.expr("session_id % 4 = 3"), F.col("unix_ms")).otherwise(F.coalesce("unix_ms", "rec_started_ms"))
    return src.ui_events(spark, sf).join(started, "session_id").withColumn("unix_ms", at).drop("rec_started_ms")


_FLAGS = {
    "packet_exists": "session_id % 7 <> 0", "notes_exists": "session_id % 5 <> 1",
    "thought_exists": "session_id % 6 <> 2", "temporal_exists": "session_id % 8 <> 3",
    "context_exists": "session_id % 9 <> 8", "evidence_exists": "session_id % 11 <> 4",
    "contract_exists": "session_id % 10 <> 5", "metadata_provided": "session_id % 3 <> 0",
    "metadata_usable": "session_id % 4 <> 0", "events_provided": "session_id % 5 <> 0",
    "events_usable": "session_id % 6 <> 0", "plan_exists": "session_id % 4 <> 2",
    "plan_valid": "session_id % 6 <> 5", "plan_speaks": "session_id % 12 = 7",
    "inspection_exists": "session_id % 9 <> 1", "receipt_exists": "session_id % 10 <> 2",
    "proofs_valid": "session_id % 13 <> 3", "same_operation": "session_id % 5 <> 4",
    "parent_verified": "session_id % 7 <> 5",
    "drain_present": "session_id % 8 <> 1", "share_without_review": "session_id % 14 = 0",
    "blocking_leaks": "session_id % 2", "leaks": "session_id % 4 - 1", "raw_sensitive": "session_id % 3 - 1",
    "mismatches": "CASE WHEN session_id % 8 <> 0 THEN session_id % 3 END",
    "run_id": "CASE WHEN session_id % 6 <> 1 THEN concat('run-', cast(session_id as {v})) ELSE ' ' END",
    "alignment_status": "CASE WHEN session_id % 4 <> 0 THEN 'aligned' ELSE 'aligned-with-review-warnings' END",
    "inspection_status": "CASE session_id % 4 WHEN 0 THEN 'requires-operator-review' WHEN 1 THEN 'requires-real-packet-review' WHEN 2 THEN 'requires-real-packet-review' END",
    "leak_status": "CASE session_id % 3 WHEN 0 THEN 'blocked' WHEN 1 THEN 'expected-local-references-only' ELSE 'no-obvious-sensitive-patterns-detected' END",
    "batch_status": "CASE WHEN session_id % 5 <> 3 THEN 'completed' END",
    "batch_reason": "CASE WHEN session_id % 2 = 0 THEN 'ok' END",
    "cleanup_status": "CASE WHEN session_id % 6 <> 3 THEN 'completed' ELSE 'disabled' END",
    "cleanup_reason": "CASE WHEN session_id % 3 = 0 THEN 'ok' END",
    "final_status": "'completed'", "final_reason": "'ok'",
    "packet_text": "CASE WHEN session_id % 7 <> 0 THEN concat('Goal: ', CASE WHEN session_id % 2 = 0 THEN '## Capture Artifacts ' ELSE '' END, CASE WHEN session_id % 3 = 0 THEN '## Evidence Boundary ' ELSE '## Timestamped Transcript ' END, '## Temporal Alignment Summary') END",
}


def _flagged(spark, sf):
    """What the reviews look at: counts, density, clocks and drain of the session's own rows; only what
    the tables have no word of (files that exist, receipts) follows from the id."""
    segs, evs, sess = src.shared_tables(spark, sf)
    counts = tl.session_counts(segs, evs, sess)
    density = sc.narration_quality(segs, evs, sess).select("session_id", "density_status")
    far = tl.alignment_diagnostics(segs, evs, sess).select("session_id", "out_of_window_events")
    facts = sess.select(
        "session_id", "state", F.col("audio_started_ms").isNotNull().alias("audio_clock_present"),
        F.coalesce("drain_completed", F.lit(0)).alias("drained_segments"), "drain_errors")
    for part in (counts, density, far):
        facts = facts.join(part, "session_id")
    return written(facts.select("*", *[F.expr(e.format(v="string")).alias(n) for n, e in _FLAGS.items()]), "facts")


def usefulness_review(spark, sf):
    rows = sc.usefulness_review(_flagged(spark, sf))
    return rows.select(*[
        F.col(c).cast("bigint").alias(c) if t == "boolean" else
        F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes])


def inspection_blockers(spark, sf):
    return sc.inspection_blockers(_flagged(spark, sf)).select(
        "session_id", "status", F.array_join("blockers", "|").alias("blockers"))


def inspection_without_notes(spark, sf):
    return sc.inspection_blockers(_flagged(spark, sf), standing=()).select(
        "session_id", "status", F.array_join("blockers", "|").alias("blockers"))


def readiness_receipt(spark, sf):
    missing = inv.missing_digests(_inventory(spark, sf), src.sessions(spark, sf))
    return sc.readiness_receipt(_flagged(spark, sf), missing).select(
        "session_id", "status", F.array_join("failed_checks", ",").alias("failed_checks"),
        F.array_join("blockers", "|").alias("blockers"))


def review_scorecard(spark, sf):
    flagged = _flagged(spark, sf)
    chain = sc.quality_chain("batch", "cleanup", "final")
    return sc.review_scorecard(flagged.withColumns(chain)).join(
        flagged.withColumns(chain).select("session_id", "chain_label"), "session_id"
    ).select("session_id", "status", "chain_label", F.array_join("actions", "|").alias("actions"),
             F.array_join("blockers", "|").alias("blockers"))


# --- the same reviews over what the scans of the session's artifacts found ---

def _found(spark, sf):
    """Facts of the sessions with the leaks and raw categories of their artifacts in place of flags."""
    full = written(artifacts(spark, sf), "artifacts")
    marks = inv.scan_budget(full.select("session_id", "seq", "bytes"))
    scanned = written(inv.classified(
        full.join(marks.select("session_id", "seq", "scanned"), ["session_id", "seq"])), "scanned")
    leaks = inv.leak_status(inv.leak_findings(scanned, approved_paths(spark, sf)), full)
    raw = inv.raw_sensitivity(scanned).where("sensitive").groupBy("session_id").agg(F.count("*").alias("raw_found"))
    facts = _flagged(spark, sf).drop("leak_status", "leaks", "blocking_leaks", "raw_sensitive")
    none = F.lit(0).cast("bigint")
    return written(
        facts.join(leaks, "session_id", "left").join(raw, "session_id", "left").select(
            *facts.columns, F.coalesce("status", F.lit("no-obvious-sensitive-patterns-detected")).alias("leak_status"),
            F.coalesce("findings", none).alias("leaks"), F.coalesce("blocking", none).alias("blocking_leaks"),
            F.coalesce("raw_found", none).alias("raw_sensitive")), "found")


def readiness_of_findings(spark, sf):
    missing = inv.missing_digests(_inventory(spark, sf), src.sessions(spark, sf))
    return sc.readiness_receipt(_found(spark, sf), missing).select(
        "session_id", "status", F.array_join("failed_checks", ",").alias("failed_checks"),
        F.array_join("blockers", "|").alias("blockers"))


def scorecard_of_findings(spark, sf):
    found = _found(spark, sf).withColumns(sc.quality_chain("batch", "cleanup", "final"))
    card, inspected = sc.review_scorecard(found), sc.inspection_blockers(found, standing=())
    return card.join(inspected.select(
        "session_id", F.array_join("blockers", "|").alias("inspection")), "session_id").select(
        "session_id", "status", F.array_join("actions", "|").alias("actions"),
        F.array_join("blockers", "|").alias("blockers"), "inspection")


def evidence_boundary(spark, sf):
    segs, evs, sess = src.shared_tables(spark, sf)
    counts = tl.session_counts(segs, evs, sess)
    flags = {n: F.expr(e) for n, e in {
        "provided": "doc_id % 3 <> 0", "exists": "doc_id % 4 <> 0"}.items()}
    size = F.when(F.col("doc_id") % 5 != 0, F.octet_length("text")).otherwise(0)
    artifacts = src.table(spark, sf, "documents").select(
        F.expr("doc_id % 100").alias("session_id"),
        *[c.alias(n) for n, c in inv.external_artifact(flags["provided"], flags["exists"], size).items()])
    rows = sc.evidence_boundary(counts, sess, artifacts)
    return rows.withColumn("audio_clock_present", F.col("audio_clock_present").cast("bigint"))


def session_summary(spark, sf):
    segs, evs, sess = src.shared_tables(spark, sf)
    return sc.session_summary(
        tl.session_counts(segs, evs, sess), sc.narration_quality(segs, evs, sess), vc.voice_bindings(segs)
    )


# --- latency ---

def _final_like(segments):
    """Segments seen as final ones, with an open mismatch here and there."""
    return segments.withColumn(
        "mismatch", F.when(F.expr("(session_id + segment_id) % 7 = 0"), "low-token-similarity"))


def first_latencies(spark, sf):
    return dl.first_latencies(src.transcript_events(spark, sf))


def _evaluated(spark, sf):
    segs, evs, sess = src.shared_tables(spark, sf)
    return dl.evaluate_delay(sess, src.transcript_events(spark, sf), _final_like(segs), evs)


def evaluate_delay(spark, sf):
    return _evaluated(spark, sf)


def compare_delay(spark, sf):
    """Even sessions are baselines, the odd session after each is its candidate."""
    rows = written(_evaluated(spark, sf), "evaluations")
    pair = F.expr("session_id div 2").alias("pair_id")
    return dl.compare_delay(
        rows.where("session_id % 2 = 0").select(pair, "*"),
        rows.where("session_id % 2 = 1").select(pair, "*"),
    )


def _aligned(spark, sf, segments):
    """Final segments of the alignment itself."""
    return written(al.align_cleaned(segments, written(cleaned_text(segments), "cleaned")), "final")


def delay_of_aligned(spark, sf):
    """Latencies and alignment counts from the final segments that the alignment of the session made."""
    heard, segs, evs, sess = src.shared_capture(spark, sf)
    return dl.evaluate_delay(sess, heard, _aligned(spark, sf, segs), evs)


# --- voice ---

def voice_bindings(spark, sf):
    return vc.voice_bindings(src.shared_segments(spark, sf), "calm", "slow", "high")


_VOICE = {
    "style": "CASE segment_id % 5 WHEN 0 THEN 'calm' WHEN 1 THEN 'focused' WHEN 2 THEN 'energetic' WHEN 3 THEN 'neutral' ELSE 'odd' END",
    "pace": "CASE segment_id % 3 WHEN 0 THEN 'slow' WHEN 1 THEN 'fast' ELSE 'normal' END",
    "emphasis": "CASE session_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'balanced' END",
    "end_ms": "CASE WHEN (session_id + segment_id) % 11 = 0 THEN start_ms - 1 ELSE end_ms END",
}


def voice_cues(spark, sf):
    rows = src.shared_segments(spark, sf).select(
        "session_id", "segment_id", "start_ms", *[F.expr(e).alias(n) for n, e in _VOICE.items()])
    valid = vc.is_valid_voice(F.col("style"), F.col("pace"), F.col("emphasis"))
    return vc.voice_cues(rows).join(
        rows.select("session_id", "segment_id", valid.cast("bigint").alias("valid_voice")),
        ["session_id", "segment_id"])


QUERIES = {f.__name__: f for f in (
    align_cleaned, align_fallback, final_status, alignment_limits, utterance_spans,
    document_utterances, similar_token_pairs, phrase_similarity, clamp_forward, label_search,
    validate_cleanup, select_authoritative, narration_quality, marker_recall, start_sync_check,
    usefulness_review, inspection_blockers, inspection_without_notes, readiness_receipt,
    review_scorecard, readiness_of_findings, scorecard_of_findings, delay_of_aligned, evidence_boundary, session_summary, first_latencies, evaluate_delay,
    compare_delay, voice_bindings, voice_cues,
)}


def reasons(rules) -> str:
    parts = ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m in rules)
    return f"coalesce(array_to_string(list_filter([{parts}], lambda z: z IS NOT NULL), '|'), '')"


_CLEANED = {"cleaned": f"""SELECT session_id, string_agg(t, ' ' ORDER BY segment_id) AS cleaned_text FROM (
  SELECT session_id, segment_id, array_to_string(list_filter(regexp_extract_all(text, '{NON_WS}+'),
    lambda w, i: (i - 1) % 7 <> 6), ' ') AS t FROM segments) GROUP BY session_id"""}
_PAIRS = "(" + ", ".join(f"('{a}', '{b}')" for a, b in fixed.CANONICAL_PAIRS) + ")"
_ALIKE = f"""(l = r OR (l, r) IN {_PAIRS} OR (length(l) > 5 AND length(r) > 5
  AND abs(length(l) - length(r)) <= 2 AND levenshtein(l, r) <= 2))"""
_LABELS = "|".join(fixed.MARKER_LABELS)
_SENT = r"(?s)\A[^.?!\n]*[.?!\n]|[.?!\n]*[^.?!\n]+[.?!\n]|.+"


def _utterances(source: str) -> dict[str, str]:
    """Utterances of ``source(session_id, cleaned_text)``: markers, sentences or 20-word spans."""
    cut = rf"(?i)(\A|[^A-Za-z0-9])((?:{_LABELS}) marker)([^A-Za-z0-9]|\z)"
    cut2 = rf"(?i)([^A-Za-z0-9\x01])((?:{_LABELS}) marker)([^A-Za-z0-9]|\z)"
    start = rf"(?i)\A({_LABELS}) marker([^A-Za-z0-9]|\z)"
    return {
        "u_cut": rf"""SELECT session_id, cleaned_text, regexp_replace(regexp_replace(cleaned_text, '{cut}',
            '\1' || chr(1) || '\2\3', 'g'), '{cut2}', '\1' || chr(1) || '\2\3', 'g') AS c FROM {source}""",
        "u_kind": rf"""SELECT *, len(regexp_extract_all(c, '\x01')) AS n_markers,
            list_filter(list_transform(regexp_extract_all(cleaned_text, '{_SENT}'), lambda s: {squeeze('s')}),
              lambda s: s <> '') AS sents, regexp_extract_all(cleaned_text, '{NON_WS}+') AS ws FROM u_cut""",
        "u_pieces": f"""SELECT session_id, n_markers >= 2 AS by_marker, CASE WHEN n_markers >= 2
            THEN list_transform(string_split(c, chr(1)), lambda s: {squeeze('s')})
            WHEN len(sents) >= 2 THEN sents
            ELSE list_transform(range(0, len(ws), 20), lambda a: array_to_string(ws[a + 1:a + 20], ' ')) END AS ps FROM u_kind""",
        "u_rows": f"""SELECT session_id, by_marker, p, i, CAST(len(regexp_extract_all(p, '[A-Za-z0-9]+')) AS BIGINT) AS n
            FROM (SELECT session_id, by_marker, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM u_pieces)""",
        "utt": rf"""SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY i) AS utterance_id,
            CASE WHEN m <> '' THEN lower(m) END AS marker_label, p AS text, token_end - n AS token_start, token_end
          FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY session_id ORDER BY i) AS BIGINT) AS token_end,
              regexp_extract(p, '(?i)(?:\A|[^A-Za-z0-9])({_LABELS}) marker(?:[^A-Za-z0-9]|\z)', 1) AS m FROM u_rows)
          WHERE p <> '' AND (NOT by_marker OR regexp_matches(p, '{start}'))""",
    }


_VERIFIED = "session_id % 4 <> 1 AND session_id % 6 <> 2 AND session_id % 7 <> 3"
_SPARSE = """CASE WHEN words < 10 OR (events >= 10 AND (segments < 2 OR words < 30)) THEN 'too-sparse-for-non-toy-replay'
  WHEN words < 50 THEN 'needs-operator-distillation' ELSE 'sufficient-for-operator-review' END"""
_QUALITY = f"""SELECT *, {_SPARSE} AS density_status,
  CASE {_SPARSE} WHEN 'too-sparse-for-non-toy-replay' THEN '{sc.DENSITY_WARNINGS[fixed.SPARSE]}'
    WHEN 'needs-operator-distillation' THEN '{sc.DENSITY_WARNINGS[fixed.NEEDS_DISTILLATION]}'
    ELSE '{sc.DENSITY_WARNINGS[fixed.SUFFICIENT]}' END AS density_warning
FROM (SELECT s.session_id, coalesce(words, 0) AS words, coalesce(chars, 0) AS chars,
    coalesce(segments, 0) AS segments, coalesce(events, 0) AS events FROM sessions s
  LEFT JOIN (SELECT session_id, {words('joined')} AS words, length(joined) AS chars, n AS segments FROM (
    SELECT session_id, string_agg(text, ' ' ORDER BY segment_id) AS joined, count(*) AS n FROM segments GROUP BY 1)) USING (session_id)
  LEFT JOIN (SELECT session_id, count(*) AS events FROM ui_events GROUP BY 1) USING (session_id))"""
_FIRST = """SELECT session_id,
  arg_min(coalesce(monotonic_offset_ms, audio_offset_ms), seq) FILTER (kind = 'delta') AS first_delta_ms,
  coalesce(arg_min(timing_source, seq) FILTER (kind = 'delta'), 'missing') AS first_delta_source,
  arg_min(coalesce(monotonic_offset_ms, audio_offset_ms), seq) FILTER (kind = 'completed') AS first_completed_ms,
  coalesce(arg_min(timing_source, seq) FILTER (kind = 'completed'), 'missing') AS first_completed_source
FROM timed GROUP BY session_id"""
_RECALL = " + ".join(
    f"CAST(contains(lower(string_agg(text, ' ')), '{w}') AS BIGINT)" for w in fixed.SCRIPTED_LABELS)
_EVALUATED = f"""SELECT s.session_id, delay, first_chunk_ms - rec_started_ms AS first_audio_ms,
  audio_started_ms - rec_started_ms AS audio_start_ms, first_delta_ms,
  coalesce(first_delta_source, 'missing') AS first_delta_source, first_completed_ms,
  coalesce(first_completed_source, 'missing') AS first_completed_source,
  CASE WHEN mismatches = 0 THEN 'aligned' WHEN mismatches > 0 THEN 'aligned-with-review-warnings' END AS status,
  utterances, mismatches, coalesce(recall, 0) AS recall, event_count
FROM sessions s LEFT JOIN first USING (session_id)
LEFT JOIN (SELECT session_id, count(*) AS utterances, count(*) FILTER ((session_id + segment_id) % 7 = 0) AS mismatches,
    {_RECALL} AS recall FROM segments GROUP BY session_id) g USING (session_id)
LEFT JOIN (SELECT session_id, count(*) AS event_count FROM ui_events GROUP BY 1) e USING (session_id)"""
_METRICS = dl.METRICS
_OK = " AND ".join(f"b.{m} IS NOT NULL AND c.{m} IS NOT NULL" for m in dl.REQUIRED)
_BETTER = """c.mismatches <= b.mismatches AND c.utterances >= b.utterances AND c.status = 'aligned' AND (
  c.first_delta_ms < b.first_delta_ms OR c.first_completed_ms < b.first_completed_ms
  OR (c.first_audio_ms IS NULL AND b.first_audio_ms IS NOT NULL) OR coalesce(c.first_audio_ms < b.first_audio_ms, false))"""
_PICK = "CASE WHEN NOT ({ok}) THEN '{0}' WHEN {better} THEN '{1}' ELSE '{2}' END"


def _count(cte: str) -> str:
    return f"coalesce((SELECT count(*) FROM {cte} x WHERE x.session_id = s.session_id), 0)"


_COUNTS = f"""SELECT s.session_id, {_count('segments')} AS segments, {_count('ui_events')} AS events,
  {_count('best')} AS aligned_segments, {_count('conflicts')} AS conflicts FROM sessions s"""
_COUNT_CTES = {"best": _BEST, "conflicts": _CONFLICTS, "counts": _COUNTS}
_F = {**_COUNT_CTES, "far": _FAR, "q": _QUALITY,
      "f": "SELECT s.session_id, s.state, s.audio_started_ms IS NOT NULL AS audio_clock_present, "
           "coalesce(s.drain_completed, 0) AS drained_segments, s.drain_errors, c.segments, c.events, c.aligned_segments, c.conflicts, "
           f"q.density_status, {_count('far')} AS out_of_window_events, "
           + ", ".join(f"{e.format(v='varchar').replace('session_id', 's.session_id')} AS {n}" for n, e in _FLAGS.items())
           + " FROM sessions s JOIN counts c USING (session_id) JOIN q USING (session_id)"}
_FOUND = {"findings": _FINDINGS,
          "raw": """SELECT a.session_id, count(*) AS n FROM art a JOIN cat USING (k) JOIN fold f ON f.session_id = a.session_id AND f.seq = a.seq
            WHERE scanned = 0 OR categories <> '' GROUP BY 1""",
          "fr": """SELECT f.* REPLACE (CASE WHEN l.blocking > 0 THEN 'blocked' WHEN l.findings > 0 THEN 'expected-local-references-only'
              ELSE 'no-obvious-sensitive-patterns-detected' END AS leak_status, coalesce(l.findings, 0) AS leaks,
            coalesce(l.blocking, 0) AS blocking_leaks, coalesce(raw.n, 0) AS raw_sensitive)
          FROM f LEFT JOIN (SELECT session_id, count(*) AS findings, count(*) FILTER (blocks_share = 1) AS blocking FROM findings GROUP BY 1) l
            ON l.session_id = f.session_id LEFT JOIN raw ON raw.session_id = f.session_id"""}
_SPARSE_F = "density_status = 'too-sparse-for-non-toy-replay'"
_DONE = "coalesce(batch_status = 'completed', false) AND cleanup_status = 'completed'"
_CARD = f"""CASE WHEN NOT context_exists THEN 'blocked-missing-temporal-context'
          WHEN leaks > 0 OR raw_sensitive > 0 OR NOT receipt_exists OR NOT plan_exists OR NOT plan_valid OR plan_speaks
            OR {_SPARSE_F} OR NOT ({_DONE}) OR NOT proofs_valid THEN 'blocked' ELSE 'requires-operator-review' END"""
_GATE = {
    "coordinated-start": "same_operation", "stopped": "state = 'stopped'", "segments": "segments > 0",
    "events": "events > 0", "audio-clock": "audio_clock_present", "drained": "drained_segments > 0",
    "drain-errors": "drain_errors = 0", "aligned": "alignment_status = 'aligned'",
    "mismatches": "mismatches = 0", "inspected": "inspection_status = 'requires-real-packet-review'",
    "share-boundary": "NOT share_without_review", "leak-scan": "leak_status <> 'blocked'",
}
_GATE_OK = " AND ".join(f"coalesce({c}, false)" for c in _GATE.values())
_INSPECT = [
    ("NOT packet_exists", MESSAGES["packet-missing"]),
    ("NOT temporal_exists", MESSAGES["temporal-missing"]),
    ("NOT evidence_exists", MESSAGES["evidence-missing"]),
    ("NOT contract_exists", MESSAGES["contract-missing"]),
    ("metadata_provided AND NOT metadata_usable", MESSAGES["metadata-unusable"]),
    ("events_provided AND NOT events_usable", MESSAGES["events-unusable"]),
    ("conflicts > 0", MESSAGES["conflicts-require-review"]),
    ("blocking_leaks > 0", MESSAGES["candidates-leak"]),
]
_READY = [
    ("state <> 'stopped'", MESSAGES["not-stopped"]),
    ("NOT same_operation", MESSAGES["not-coordinated"]),
    ("NOT parent_verified", MESSAGES["parent-unverified"]),
    ("trim(run_id) = ''", MESSAGES["run-id-missing"]),
    (f"NOT ({_GATE_OK})", MESSAGES["proof-invalid"]),
    ("true", sc.ATTESTATION_MISSING),
    ("NOT metadata_provided", MESSAGES["metadata-path-missing"]),
    ("metadata_provided AND NOT metadata_usable", MESSAGES["metadata-path-empty"]),
    ("NOT events_provided", MESSAGES["events-path-missing"]),
    ("events_provided AND NOT events_usable", MESSAGES["events-path-empty"]),
    ("NOT audio_clock_present", MESSAGES["clock-missing"]),
    ("segments = 0", MESSAGES["no-segments"]),
    ("NOT drain_present", MESSAGES["drain-missing"]),
    ("drain_present AND drained_segments = 0", MESSAGES["drain-empty"]),
    ("drain_present AND drain_errors > 0", MESSAGES["drain-errors"]),
    ("events = 0", MESSAGES["no-events"]),
    ("alignment_status <> 'aligned'", MESSAGES["not-aligned"]),
    ("coalesce(mismatches, 1) > 0", MESSAGES["mismatches"]),
    ("inspection_status IS NULL", MESSAGES["not-inspected"]),
    ("leak_status = 'blocked'", MESSAGES["leak-blocked"]),
    ("share_without_review", MESSAGES["privacy-open"]),
    ("true", sc.OPERATOR_REVIEW),
    ("gaps > 0", MESSAGES["digest-unbound"]),
]
_USEFUL = [
    ("packet_text IS NULL", MESSAGES["packet-missing"]),
    ("NOT notes_exists", MESSAGES["notes-missing"]),
    ("NOT thought_exists", MESSAGES["thought-missing"]),
    ("NOT temporal_exists", MESSAGES["temporal-missing"]),
    ("NOT evidence_exists", MESSAGES["evidence-missing"]),
    ("segments = 0", MESSAGES["packet-no-segments"]),
    (_SPARSE_F, MESSAGES["packet-sparse"]),
    ("aligned_segments = 0", MESSAGES["packet-no-aligned"]),
    ("conflicts > 0", MESSAGES["conflicts-need-review"]),
    ("true", sc.PACKET_REVIEW_OWED),
]
_ACTIONS = [
    ("NOT context_exists", "context"),
    ("NOT evidence_exists", "evidence-report"),
    ("NOT plan_exists", "dry-run-plan"),
    ("plan_speaks", "spoken-preview"),
    ("conflicts > 0", "conflicts"),
    ("out_of_window_events > 0", "out-of-window"),
    ("leaks > 0", "leaks"),
    ("raw_sensitive > 0", "raw-sensitive"),
    (_SPARSE_F, "sparse"),
    (f"NOT ({_DONE})", "quality-chain"),
    ("NOT receipt_exists", "receipt"),
]
_COHESION = [
    ("NOT context_exists", MESSAGES["context-missing"]),
    ("NOT packet_exists", MESSAGES["card-packet-missing"]),
    ("NOT evidence_exists", MESSAGES["card-evidence-missing"]),
    ("NOT plan_exists", MESSAGES["plan-missing"]),
    ("plan_exists AND NOT plan_valid", MESSAGES["plan-malformed"]),
    ("plan_speaks", MESSAGES["plan-speaks"]),
    ("NOT inspection_exists", MESSAGES["inspection-missing"]),
    ("NOT receipt_exists", MESSAGES["receipt-missing"]),
    ("conflicts > 0", MESSAGES["conflicts-need-review"]),
    ("leaks > 0", MESSAGES["leaks-need-review"]),
    ("raw_sensitive > 0", MESSAGES["raw-needs-review"]),
    (_SPARSE_F, MESSAGES["density-sparse"]),
    (f"NOT ({_DONE})", MESSAGES["quality-incomplete"]),
    ("NOT proofs_valid", MESSAGES["proofs-malformed"]),
    ("true", sc.COHESION_OWED[0]), ("true", sc.COHESION_OWED[1]),
]
_EVENTS = """SELECT session_id, count(*) AS events, arg_min(at_ms, seq) AS first_event_ms,
  arg_max(at_ms, seq) AS last_event_ms,
  count(*) FILTER (at_ms IS NULL OR at_ms < rec_started_ms OR at_ms > rec_ended_ms) AS bad
FROM (SELECT *, CASE WHEN session_id % 4 = 3 THEN unix_ms ELSE coalesce(unix_ms, rec_started_ms) END AS at_ms
  FROM ui_events e JOIN sessions s USING (session_id)) GROUP BY session_id"""
_NAMED = " + ".join(
    f"CAST((session_id + {i}) % 13 = 0 OR (session_id + {i}) % 17 = 1 OR (session_id + {i}) % 19 = 2 AS INT)"
    for i in range(len(inv.REQUIRED_DIGESTS)))

SQL = {
    "final_status": query(
        """SELECT session_id, count(*) AS utterances, count(*) FILTER ((session_id + segment_id) % 7 = 0) AS mismatches,
        CASE WHEN count(*) FILTER ((session_id + segment_id) % 7 = 0) = 0 THEN 'aligned'
             ELSE 'aligned-with-review-warnings' END AS status FROM segments GROUP BY session_id""", "segments"),
    "alignment_limits": query(
        f"""SELECT session_id, cleaned_tokens, realtime_tokens, (cleaned_tokens + 1) * (realtime_tokens + 1) AS cells,
          CASE WHEN greatest(l1, l2) > 256 THEN 'token-bytes' WHEN greatest(cleaned_tokens, realtime_tokens) > 10000 THEN 'tokens'
            WHEN (cleaned_tokens + 1) * (realtime_tokens + 1) > 4000000 THEN 'cells' END AS limit_broken
        FROM (SELECT session_id, CAST(len({tokens('cleaned_text')}) AS BIGINT) AS cleaned_tokens,
            list_max(list_transform({tokens('cleaned_text')}, lambda t: length(t))) AS l1 FROM cleaned)
        JOIN (SELECT session_id, CAST(sum(len({tokens('text')})) AS BIGINT) AS realtime_tokens,
            max(list_max(list_transform({tokens('text')}, lambda t: length(t)))) AS l2 FROM segments GROUP BY 1) USING (session_id)""",
        "segments", extra=_CLEANED),
    "utterance_spans": query(
        "SELECT session_id, utterance_id, marker_label, md5(text) AS digest, token_start, token_end FROM utt",
        "segments", extra={**_CLEANED, **_utterances("cleaned")}),
    "document_utterances": query(
        "SELECT session_id, count(*) AS utterances, max(token_end) AS tokens FROM utt GROUP BY session_id",
        extra={"cleaned": "SELECT doc_id AS session_id, text AS cleaned_text FROM documents", **_utterances("cleaned")}),
    "similar_token_pairs": query(
        f"""SELECT session_id, l AS left_token, r AS right_token FROM
        (SELECT DISTINCT session_id, unnest({tokens('cleaned_text')}) AS l FROM cleaned)
        JOIN (SELECT DISTINCT session_id, unnest({tokens('text')}) AS r FROM segments) USING (session_id)
        WHERE {_ALIKE}""", "segments", extra=_CLEANED),
    "phrase_similarity": query(
        f"""SELECT a.session_id, a.seq, round(CASE WHEN len(ts) = 0 AND len(us) = 0 THEN 1.0
            WHEN len(ts) = 0 OR len(us) = 0 THEN 0.0 ELSE coalesce(hits, 0) / len(ts) END, 6) AS similarity
        FROM t a JOIN (SELECT session_id, seq - 2 AS seq, ts AS us FROM t) b USING (session_id, seq)
        LEFT JOIN (SELECT session_id, seq, count(DISTINCT i) AS hits FROM
            (SELECT session_id, seq, unnest(ts) AS l, generate_subscripts(ts, 1) AS i FROM t)
            JOIN (SELECT DISTINCT session_id, seq - 2 AS seq, unnest(ts) AS r FROM t) USING (session_id, seq)
            WHERE {_ALIKE} GROUP BY session_id, seq) h ON h.session_id = a.session_id AND h.seq = a.seq""",
        "narrated", extra={"t": f"SELECT session_id, seq, {tokens('text')} AS ts FROM narrated"}),
    "clamp_forward": """SELECT session_id, id, greatest(s, coalesce(reached, 0)) AS start_ms,
          greatest(e, s, coalesce(reached, 0)) AS end_ms
        FROM (SELECT *, max(greatest(s, e)) OVER (PARTITION BY session_id ORDER BY id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
          FROM (SELECT o_custkey AS session_id, o_orderkey AS id, (o_orderkey * 37) % 1000 + o_orderkey // 50 AS s,
                  (o_orderkey * 91) % 1000 + o_orderkey // 50 AS e FROM orders))""",
    "label_search": query(
        f"""SELECT w.session_id, w.segment_id, label, min(g.segment_id) AS found_segment_id
        FROM (SELECT session_id, segment_id, unnest(['alpha', 'bravo', 'kilo']) AS label FROM segments) w
        JOIN segments g ON g.session_id = w.session_id AND g.segment_id >= w.segment_id
          AND (list_contains({tokens('g.text')}, label) OR (label = 'kilo' AND list_contains({tokens('g.text')}, 'keyhole')))
        GROUP BY ALL""", "segments"),
    "select_authoritative": query(
        f"""SELECT session_id, segment_id,
          CASE WHEN {_VERIFIED} THEN '{fixed.ALIGNED_SOURCE}' ELSE timing_source END AS timing_source,
          CASE WHEN {_VERIFIED} THEN end_ms ELSE monotonic_offset_ms END AS monotonic_offset_ms,
          md5(CASE WHEN {_VERIFIED} THEN 'final ' || text ELSE text END) AS digest FROM segments""", "segments"),
    "narration_quality": query(_QUALITY, "segments", "ui_events"),
    "marker_recall": query(
        f"SELECT session_id, {_RECALL} AS found, 17 - ({_RECALL}) AS missing FROM segments GROUP BY session_id",
        "segments"),
    "start_sync_check": query(
        """SELECT s.session_id, CASE WHEN first_chunk_ms IS NOT NULL THEN 'first-audio-chunk' ELSE 'capture-clock' END AS audio_source,
          d AS start_delta_ms, CAST(abs(d) <= 5000 AS BIGINT) AS within_delta, CAST(state = 'stopped' AS BIGINT) AS stopped,
          coalesce(events, 0) AS events, first_event_ms, last_event_ms, greatest(drain_completed, drain_observed) AS drained_segments,
          CASE WHEN audio_started_ms IS NULL OR rec_started_ms IS NULL OR coalesce(rec_ended_ms < rec_started_ms, false) OR bad > 0
            THEN 'invalid-input'
            WHEN state = 'stopped' AND events > 0 AND abs(d) <= 5000 AND coalesce(greatest(drain_completed, drain_observed), 0) > 0
            THEN 'timestamp-proximity-verified' ELSE 'blocked' END AS status
        FROM (SELECT *, coalesce(first_chunk_ms, audio_started_ms) - rec_started_ms AS d FROM sessions) s LEFT JOIN ev USING (session_id)""",
        "ui_events", extra={"ev": _EVENTS}),
    "usefulness_review": query(
        f"""SELECT session_id, {', '.join(f"CAST(contains(coalesce(packet_text, ''), '{t}') AS BIGINT) AS {n}" for n, t in sc.SECTIONS.items())},
        CAST(NOT contains(coalesce(packet_text, ''), '## Timestamped Transcript') AS BIGINT) AS raw_transcript_avoided,
        {reasons(_USEFUL)} AS blockers FROM f""", "pairs", extra=_F),
    "inspection_blockers": query(
        f"""SELECT session_id, 'requires-operator-review' AS status,
        {reasons(_INSPECT + [('true', n) for n in sc.STANDING_NOTES])} AS blockers FROM f""", "pairs", extra=_F),
    "inspection_without_notes": query(
        f"""SELECT *, CASE WHEN blockers = '' THEN 'requires-real-packet-review' ELSE 'requires-operator-review' END AS status
        FROM (SELECT session_id, {reasons(_INSPECT)} AS blockers FROM f)""", "pairs", extra=_F),
    "readiness_receipt": query(
        f"""SELECT session_id, 'blocked' AS status, {_failed(_GATE)} AS failed_checks, {reasons(_READY)} AS blockers
        FROM (SELECT *, {_NAMED} AS gaps FROM f)""", "pairs", extra=_F),
    "review_scorecard": query(
        f"""SELECT session_id, {_CARD} AS status,
          'batch=' || coalesce(batch_status, 'not-generated') || ' (' || coalesce(batch_reason, 'not-provided') || ') | cleanup='
            || cleanup_status || ' (' || coalesce(cleanup_reason, 'not-provided') || ') | final-receipt=completed (ok)' AS chain_label,
          CASE WHEN {reasons(_ACTIONS)} = '' THEN 'review' ELSE {reasons(_ACTIONS)} END AS actions,
          {reasons(_COHESION)} AS blockers FROM f""", "pairs", extra=_F),
    "readiness_of_findings": query(
        f"""SELECT session_id, 'blocked' AS status, {_failed(_GATE)} AS failed_checks, {reasons(_READY)} AS blockers
        FROM (SELECT *, {_NAMED} AS gaps FROM fr)""", "pairs", extra={**_F, **_LEAK, **_FOUND}),
    "scorecard_of_findings": query(
        f"""SELECT session_id, {_CARD} AS status, CASE WHEN {reasons(_ACTIONS)} = '' THEN 'review' ELSE {reasons(_ACTIONS)} END AS actions,
          {reasons(_COHESION)} AS blockers, {reasons(_INSPECT)} AS inspection FROM fr""", "pairs", extra={**_F, **_LEAK, **_FOUND}),
    "evidence_boundary": query(
        """SELECT c.*, CAST(s.audio_started_ms IS NOT NULL AS BIGINT) AS audio_clock_present,
          coalesce(provided_artifacts, 0) AS provided_artifacts, coalesce(exists_artifacts, 0) AS exists_artifacts,
          coalesce(non_empty_artifacts, 0) AS non_empty_artifacts, coalesce(usable_artifacts, 0) AS usable_artifacts
        FROM counts c JOIN sessions s USING (session_id) LEFT JOIN (SELECT doc_id % 100 AS session_id,
            count(*) FILTER (doc_id % 3 <> 0) AS provided_artifacts, count(*) FILTER (doc_id % 4 <> 0) AS exists_artifacts,
            count(*) FILTER (doc_id % 4 <> 0 AND doc_id % 5 <> 0 AND text <> '') AS non_empty_artifacts,
            count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 4 <> 0 AND doc_id % 5 <> 0 AND text <> '') AS usable_artifacts
          FROM documents GROUP BY 1) USING (session_id)""", "pairs", extra=_COUNT_CTES),
    "session_summary": query(
        """SELECT c.*, words, chars, density_status, density_warning, c.segments AS voice_bindings
        FROM counts c JOIN q USING (session_id)""", "pairs",
        extra={**_COUNT_CTES, "q": _QUALITY}),
    "first_latencies": query(_FIRST, "timed"),
    "evaluate_delay": query(_EVALUATED, "segments", "ui_events", extra={"first": _FIRST}),
    "compare_delay": query(
        f"""SELECT b.session_id // 2 AS pair_id, {', '.join(f'c.{m} - b.{m} AS {m}_delta' for m in _METRICS)},
        {_PICK.format('inconclusive', 'candidate-lower-latency-needs-operator-review', 'keep-current-default', ok=_OK, better=_BETTER)} AS status,
        {_PICK.format('keep-current-default', 'operator-review-before-default-change', 'keep-current-default', ok=_OK, better=_BETTER)} AS recommendation,
        {_PICK.format(dl.INCOMPLETE, dl.IMPROVED, dl.NOT_IMPROVED, ok=_OK, better=_BETTER)} AS reason
        FROM ev b JOIN ev c ON c.session_id = b.session_id + 1 WHERE b.session_id % 2 = 0""",
        "segments", "ui_events", extra={"first": _FIRST, "ev": _EVALUATED}),
    "voice_bindings": query(
        """SELECT session_id, segment_id, start_ms, end_ms, 'calm' AS style, 'slow' AS pace, 'high' AS emphasis,
        'planned-not-executed' AS replay_status FROM segments""", "segments"),
    "voice_cues": query(
        f"""SELECT session_id, segment_id, start_ms AS scheduled_at_ms,
          CASE WHEN e >= start_ms THEN CASE pace WHEN 'slow' THEN greatest(e - start_ms, 1) * 5 // 4
            WHEN 'fast' THEN greatest(e - start_ms, 1) * 3 // 4 ELSE greatest(e - start_ms, 1) END END AS planned_ms,
          CASE style WHEN 'calm' THEN 'steady and low-variance' WHEN 'focused' THEN 'concise and task-forward'
            WHEN 'energetic' THEN 'brighter and higher-variance' ELSE 'neutral and literal' END AS tone,
          CAST(CASE pace WHEN 'slow' THEN 0.8 WHEN 'fast' THEN 1.25 ELSE 1.0 END AS DOUBLE) AS pace_multiplier,
          CAST(CASE emphasis WHEN 'low' THEN 0.85 WHEN 'high' THEN 1.2 ELSE 1.0 END AS DOUBLE) AS emphasis_gain,
          CASE WHEN e >= start_ms THEN 'dry-run-not-spoken' ELSE 'invalid-binding' END AS status,
          CAST(style <> 'odd' AS BIGINT) AS valid_voice
        FROM (SELECT session_id, segment_id, start_ms, {_VOICE['end_ms']} AS e, {_VOICE['style']} AS style,
          {_VOICE['pace']} AS pace, {_VOICE['emphasis']} AS emphasis FROM segments)""", "segments"),
}
