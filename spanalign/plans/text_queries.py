"""Registered queries: text, time and classification functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanalign import fixed
from spanalign.functions import checks, instants, sensitive, similarity, text as tx
from spanalign.plans import redaction_sql as rs
from spanalign.plans.sql import (
    NON_WS, any_token, collapse, mmss, normalized, query, squeeze, tokens, utc_ms,
)
from spanalign.sources import tables as src

AS_OF_MS = 1_705_320_000_000  # 2024-01-15T12:00:00Z, the explicit as-of instant of the checks


def _docs(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", "text")


def _turns(spark, sf):
    return src.transcript_rows(src.table(spark, sf, "conversations"))


def tokens_ascii(spark, sf):
    toks = tx.tokens_ascii(F.col("text"))
    return _docs(spark, sf).select(
        "doc_id", F.size(toks).cast("bigint").alias("n"), F.md5(F.array_join(toks, " ")).alias("digest")
    )


def tokens_unicode(spark, sf):
    toks = tx.tokens_unicode(F.col("text"))
    return _docs(spark, sf).select(
        "doc_id", F.size(toks).cast("bigint").alias("n"), F.md5(F.array_join(toks, " ")).alias("digest")
    )


def split_words(spark, sf):
    parts = tx.split_words(F.col("text"))
    return _docs(spark, sf).select(
        "doc_id", F.size(parts).cast("bigint").alias("n"), F.md5(F.array_join(parts, " ")).alias("digest")
    )


def semantic_word_count(spark, sf):
    spelled = F.replace(F.col("text"), F.lit(" the "), F.lit(" chat-G P t "))
    return _docs(spark, sf).select(
        "doc_id", tx.token_count(spelled).alias("tokens"),
        tx.semantic_word_count(spelled).alias("words"),
    )


def sentence_spans(spark, sf):
    spans = tx.sentence_spans(F.col("text"))
    return _docs(spark, sf).select(
        "doc_id", F.size(spans).cast("bigint").alias("n"), F.md5(F.array_join(spans, "|")).alias("digest")
    )


def fixed_spans(spark, sf):
    spans = tx.fixed_spans(F.col("text"))
    return _docs(spark, sf).select(
        "doc_id", F.size(spans).cast("bigint").alias("n"), F.md5(F.array_join(spans, "|")).alias("digest")
    )


def marker_spans(spark, sf):
    """Markers in narrated text: labels in order and the pieces they start."""
    t = F.col("text")
    twice = F.concat_ws(" ", t, F.lit("and"), t)
    return _turns(spark, sf).select(
        "session_id", "seq",
        F.array_join(tx.marker_labels(twice), ",").alias("labels"),
        F.md5(F.array_join(tx.marker_pieces(twice), "|")).alias("pieces"),
    )


def label_seen(spark, sf):
    t = F.col("text")
    return _turns(spark, sf).select(
        "session_id", "seq",
        *[tx.label_seen(t, F.lit(w)).cast("bigint").alias(w) for w in ("alpha", "kilo", "la", "papa")],
    )


def normalized_text(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select(
        "doc_id", F.md5(tx.normalized_text(t)).alias("normal"), F.md5(tx.collapse(t)).alias("collapsed")
    )


def action_flags(spark, sf):
    t = F.col("text")
    return _turns(spark, sf).select(
        "session_id", "seq",
        tx.mentions_action(t).cast("bigint").alias("action"),
        tx.claims_commit(t).cast("bigint").alias("commit"),
        tx.has_cancel_label(t, F.lit(None).cast("string")).cast("bigint").alias("cancel"),
        tx.is_blank(t).cast("bigint").alias("blank"),
    )


def instant_variants(spark, sf):
    """Well-formed and malformed instants made from event times."""
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    base, whole = F.concat(ts, F.lit("Z")), F.concat(F.substring(ts, 1, 19), F.lit("Z"))
    e = F.col("event_id") % 10
    return src.table(spark, sf, "events").select(
        "event_id",
        F.when(e == 0, base).when(e == 1, whole)
        .when(e == 2, F.concat(F.substring(ts, 1, 21), F.lit("Z")))
        .when(e == 3, F.replace(base, F.lit("T"), F.lit(" ")))
        .when(e == 4, ts)
        .when(e == 5, F.concat(F.substring(ts, 1, 8), F.lit("31T25:00:00Z")))
        .when(e == 6, F.concat(F.lit("2024-02-"), F.substring(ts, 9, 11), F.lit("Z")))
        .when(e == 7, F.concat(F.substring(ts, 1, 19), F.lit(".Z")))
        .when(e == 8, F.concat(ts, F.lit("0001Z")))
        .alias("raw"),
    )


def parse_utc(spark, sf):
    raw = F.col("raw")
    return instant_variants(spark, sf).select(
        "event_id", instants.parse_utc_ms(raw).alias("ms"),
        instants.parse_utc_seconds(raw).alias("whole_seconds_ms"),
        instants.timestamp_status(raw).alias("status"),
    )


def freshness(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return src.table(spark, sf, "events").select(
        "event_id", instants.is_fresh(ms, F.lit(AS_OF_MS)).cast("bigint").alias("fresh")
    )


def format_offset(spark, sf):
    return src.transcript_events(spark, sf).select(
        "session_id", "seq", instants.format_offset(F.col("audio_offset_ms") * 10).alias("label")
    )


def ui_hint_cut(spark, sf):
    none = F.lit(None).cast("string")
    d = F.col("doc_id")
    hint = tx.ui_hint(
        F.when(d % 3 == 0, F.col("text")), F.when(d % 3 == 1, F.col("text")), none
    )
    return _docs(spark, sf).select("doc_id", F.md5(hint).alias("hint"))


def json_fields(spark, sf):
    props = F.col("props")
    return src.table(spark, sf, "events").select(
        "event_id", tx.json_long(props, "$.k").alias("k"), tx.json_long(props, "$.none").alias("absent")
    )


def edit_distances(spark, sf):
    """Bounded distance between neighbouring tokens of every turn."""
    toks = F.transform(
        tx.tokens_ascii(F.col("text")), lambda t, i: F.struct(i.alias("i"), t.alias("t"))
    )
    rows = _turns(spark, sf).select("session_id", "seq", toks.alias("ts"))
    ahead = F.slice("ts", 2, F.size("ts"))
    pairs = rows.select(
        "session_id", "seq",
        F.explode(F.zip_with("ts", ahead, lambda a, b: F.struct(
            a["i"].alias("i"), a["t"].alias("l"), b["t"].alias("r")))).alias("p"),
    ).where("p.r is not null").select("session_id", "seq", "p.*")
    l, r = F.col("l"), F.col("r")
    return pairs.select(
        "session_id", "seq", F.col("i").cast("bigint").alias("i"),
        similarity.bounded_edit_distance(l, r, 2).cast("bigint").alias("distance"),
        similarity.token_similar(l, r).cast("bigint").alias("similar"),
    )


def token_classes(spark, sf):
    """How many tokens of documents and pages fall into each class."""
    texts = src.table(spark, sf, "documents").select("text").unionByName(
        src.table(spark, sf, "pages").select(F.col("html").alias("text"))
    )
    # equal tokens are of one class: each is counted first and looked at once
    toks = texts.select(F.explode(tx.split_words(F.col("text"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("times"))
    t = F.col("tok")
    flags = {
        "secret": sensitive.is_secret_token(t) | sensitive.is_cloud_access_key(t),
        "email": sensitive.is_email(t),
        "path": sensitive.is_private_path(t),
        "jwt": sensitive.is_jwt(t),
        "opaque": sensitive.is_opaque(t),
        "assigned": t.rlike(sensitive.ASSIGNMENT),
        "bare_key": t.rlike(sensitive.BARE_KEY),
        "separator": sensitive.is_separator(t),
        "connector": sensitive.is_connector(t),
        "phrase_end": sensitive.ends_phrase(t),
    }
    letter = sensitive.token_class(t)
    letter = F.when(letter.isin("n", "e"), F.upper(letter)).otherwise(letter)
    return toks.groupBy(letter.alias("class")).agg(
        F.sum("times").alias("n"), *[F.sum(F.when(c, F.col("times")).otherwise(0)).alias(n) for n, c in flags.items()]
    )


def redact_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(sensitive.redact_text(F.col("text"))).alias("digest"))


def redact_narration(spark, sf):
    return _turns(spark, sf).select(
        "session_id", "seq", sensitive.redact_text(F.col("text")).alias("text")
    )


def redact_pages(spark, sf):
    return src.table(spark, sf, "pages").select(
        "page_id", F.md5(sensitive.redact_text(F.col("html"))).alias("digest")
    )


def redact_phones(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select(
        "doc_id", F.md5(sensitive.redact_phones(t)).alias("digest"),
        sensitive.has_phone(t).cast("bigint").alias("has_phone"),
    )


def sensitive_categories(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", F.array_join(sensitive.sensitive_categories(F.col("text")), ",").alias("categories")
    )


def page_categories(spark, sf):
    return src.table(spark, sf, "pages").select(
        "page_id", F.array_join(sensitive.sensitive_categories(F.col("html")), ",").alias("categories")
    )


def safe_field(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(sensitive.safe_field(F.col("text"))).alias("digest"))


def render_untrusted(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", F.md5(sensitive.render_untrusted("Goal", F.col("text"))).alias("digest")
    )


def digest_format(spark, sf):
    """Digest shape check on real and damaged digests of documents."""
    full = checks.sha256(F.col("text"))
    d = F.col("doc_id")
    value = (
        F.when(d % 5 == 0, full).when(d % 5 == 1, F.substring(full, 1, 70))
        .when(d % 5 == 2, F.upper(full)).when(d % 5 == 3, F.concat(full, F.lit("0")))
    )
    return _docs(spark, sf).select("doc_id", checks.is_digest(value).cast("bigint").alias("ok"))


def canonical_digests(spark, sf):
    """Row digest of documents without their text."""
    rows = src.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return rows.select("doc_id", checks.canonical_digest(rows.columns).alias("digest"))


QUERIES = {f.__name__: f for f in (
    tokens_ascii, tokens_unicode, split_words, semantic_word_count, sentence_spans, fixed_spans,
    marker_spans, label_seen, normalized_text, action_flags, parse_utc, freshness, format_offset,
    ui_hint_cut, json_fields, edit_distances, token_classes, redact_text, redact_narration,
    redact_pages, redact_phones, sensitive_categories, page_categories, safe_field,
    render_untrusted, digest_format, canonical_digests,
)}

_UNI = r"[\p{L}\p{N}]+"
_SENT = r"(?s)\A[^.?!\n]*[.?!\n]|[.?!\n]*[^.?!\n]+[.?!\n]|.+"
_LABELS = "|".join(fixed.MARKER_LABELS)
_CUT_AT = rf"(?i)(\A|[^A-Za-z0-9])((?:{_LABELS}) marker)([^A-Za-z0-9]|\z)"
_DOC = {"docs": "SELECT doc_id AS k, text FROM documents"}
_PAGE = {"docs": "SELECT page_id AS k, html AS text FROM pages"}
_TURN = {"docs": "SELECT session_id * 100000 + seq AS k, session_id, seq, text FROM narrated"}


def _listed(items: str, sep: str = " ") -> str:
    return (f"SELECT doc_id, CAST(len(x) AS BIGINT) AS n, md5(array_to_string(x, '{sep}')) AS digest "
            f"FROM (SELECT doc_id, {items} AS x FROM documents)")


def _escape(text: str, plus: bool) -> str:
    return (rf"regexp_replace({text}, '([\\`*_{{}}\[\]<>#|!()" + ("+" if plus else "")
            + r"-])', '\\\1', 'g')")


def _label(word: str) -> str:
    alias = {"kilo": " OR list_contains(ts, 'keyhole')",
             "papa": " OR ' ' || array_to_string(ts, ' ') || ' ' LIKE '% pop a %'"}.get(word, "")
    return f"CAST(list_contains(ts, '{word}'){alias} AS BIGINT) AS \"{word}\""


_TOKEN_FLAGS = {
    "secret": rs.secret("tok"), "email": rs.email("tok"), "path": rs.path("tok"), "jwt": rs.jwt("tok"),
    "opaque": rs.opaque("tok"), "assigned": rs.assigned("tok"), "bare_key": rs.bare_key("tok"),
    "separator": r"regexp_matches(tok, '\A[:=-]+\z')",
    "connector": r"regexp_matches(tok, '(?i)\A[^A-Za-z]*(is|was|equals)[^A-Za-z]*\z')",
    "phrase_end": rs.ending("tok"),
}
_PAIRS = "(" + ", ".join(f"('{a}', '{b}')" for a, b in fixed.CANONICAL_PAIRS) + ")"

SQL = {
    "tokens_ascii": _listed(tokens("text")),
    "tokens_unicode": _listed(f"list_transform(regexp_extract_all(text, '{_UNI}'), lambda t: lower(t))"),
    "split_words": _listed(f"regexp_extract_all(text, '{NON_WS}+')"),
    "semantic_word_count": f"""SELECT doc_id, CAST(len(ts) AS BIGINT) AS tokens,
        CAST(len(ts) - 3 * len(regexp_extract_all(
          ' ' || array_to_string(ts, '  ') || ' ', ' chat  g  p  t ')) AS BIGINT) AS words
        FROM (SELECT doc_id, {tokens("replace(text, ' the ', ' chat-G P t ')")} AS ts FROM documents)""",
    "sentence_spans": _listed(
        f"list_filter(list_transform(regexp_extract_all(text, '{_SENT}'), lambda s: {squeeze('s')}), "
        "lambda s: s <> '')", "|"),
    "fixed_spans": """SELECT d.doc_id, coalesce(n, 0) AS n, md5(coalesce(spans, '')) AS digest
        FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(span, '|' ORDER BY g) AS spans
          FROM (SELECT doc_id, (i - 1) // 20 AS g, string_agg(w, ' ' ORDER BY i) AS span
                FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
                  SELECT doc_id, regexp_extract_all(text, '""" + NON_WS + """+') AS ws FROM documents))
                GROUP BY doc_id, g) GROUP BY doc_id) USING (doc_id)""",
    "marker_spans": query(
        rf"""SELECT session_id, seq, coalesce(array_to_string(list_transform(regexp_extract_all(cut,
            '(?i)\x{{1}}({_LABELS}) marker', 1), lambda l: lower(l)), ','), '') AS labels,
          md5(array_to_string(list_filter(string_split(cut, chr(1)), lambda p, i: i > 1 OR p <> ''), '|')) AS pieces
        FROM (SELECT session_id, seq, regexp_replace(regexp_replace(text || ' and ' || text, '{_CUT_AT}',
            '\1' || chr(1) || '\2\3', 'g'), '{_CUT_AT.replace("[^A-Za-z0-9])((", "[^A-Za-z0-9" + chr(92) + "x{1}])((", 1)}',
            '\1' || chr(1) || '\2\3', 'g') AS cut FROM narrated)""", "narrated"),
    "label_seen": query(
        f"""SELECT session_id, seq, {', '.join(_label(w) for w in ('alpha', 'kilo', 'la', 'papa'))}
        FROM (SELECT session_id, seq, {tokens('text')} AS ts FROM narrated)""", "narrated"),
    "normalized_text": f"SELECT doc_id, md5({normalized('text')}) AS normal, md5({collapse('text')}) AS collapsed FROM documents",
    "action_flags": query(
        f"""SELECT session_id, seq, CAST({any_token('text', fixed.ACTION_WORDS)} AS BIGINT) AS action,
        CAST({any_token('text', fixed.COMMIT_WORDS)} AS BIGINT) AS "commit",
        CAST({any_token('text', fixed.CANCEL_WORDS)} AS BIGINT) AS cancel,
        CAST(NOT regexp_matches(text, '{NON_WS}') AS BIGINT) AS blank FROM narrated""", "narrated"),
    "parse_utc": f"""WITH v AS (SELECT event_id, CASE event_id % 10 WHEN 0 THEN t || 'Z' WHEN 1 THEN t[:19] || 'Z'
          WHEN 2 THEN t[:21] || 'Z' WHEN 3 THEN replace(t || 'Z', 'T', ' ') WHEN 4 THEN t
          WHEN 5 THEN t[:8] || '31T25:00:00Z' WHEN 6 THEN '2024-02-' || t[9:19] || 'Z'
          WHEN 7 THEN t[:19] || '.Z' WHEN 8 THEN t || '0001Z' END AS raw
        FROM (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS t FROM events))
        SELECT event_id, {utc_ms('raw')} AS ms,
          CASE WHEN length(raw) = 20 THEN {utc_ms('raw')} END AS whole_seconds_ms,
          CASE WHEN raw IS NULL THEN 'missing' WHEN ({utc_ms('raw')}) IS NULL THEN 'invalid' ELSE 'valid' END AS status
        FROM v""",
    "freshness": f"""SELECT event_id, CAST({AS_OF_MS} - epoch_us(ts) // 1000
        BETWEEN -300000 AND 86400000 AS BIGINT) AS fresh FROM events""",
    "format_offset": query(
        f"SELECT session_id, seq, {mmss('audio_offset_ms * 10')} AS label FROM te", "te"),
    "ui_hint_cut": """SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN md5(CASE WHEN length(text) > 240
        THEN substring(text, 1, 240) || '...' ELSE text END) END AS hint FROM documents""",
    "json_fields": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        CAST(json_extract_string(props, '$.none') AS BIGINT) AS absent FROM events""",
    "edit_distances": query(
        f"""SELECT session_id, seq, i - 1 AS i, CASE WHEN d > 2 THEN 3 ELSE d END AS distance,
          CAST(l = r OR (l, r) IN {_PAIRS} OR (length(l) > 5 AND length(r) > 5
            AND abs(length(l) - length(r)) <= 2 AND d <= 2) AS BIGINT) AS similar
        FROM (SELECT *, levenshtein(l, r) AS d FROM (SELECT session_id, seq, i, t AS l,
            lead(t) OVER (PARTITION BY session_id, seq ORDER BY i) AS r
          FROM (SELECT session_id, seq, unnest(ts) AS t, generate_subscripts(ts, 1) AS i
                FROM (SELECT session_id, seq, {tokens('text')} AS ts FROM narrated))) WHERE r IS NOT NULL)""",
        "narrated"),
    "token_classes": f"""SELECT {rs.token_class('tok')} AS class, count(*) AS n,
        {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in _TOKEN_FLAGS.items())}
        FROM (SELECT unnest(regexp_extract_all(text, '{NON_WS}+')) AS tok
              FROM (SELECT text FROM documents UNION ALL SELECT html FROM pages)) GROUP BY 1""",
    "redact_text": query("SELECT k AS doc_id, md5(text) AS digest FROM red",
                         extra={**_DOC, **rs.redacted_ctes("red", "docs")}),
    "redact_narration": query(
        "SELECT session_id, seq, red.text FROM docs JOIN red USING (k)", "narrated",
        extra={**_TURN, **rs.redacted_ctes("red", "docs")}),
    "redact_pages": query("SELECT k AS page_id, md5(text) AS digest FROM red",
                          extra={**_PAGE, **rs.redacted_ctes("red", "docs")}),
    "redact_phones": query(
        "SELECT k AS doc_id, md5(text) AS digest, CAST(has_phone AS BIGINT) AS has_phone FROM ph",
        extra={**_DOC, **rs.phone_ctes("ph", "docs")}),
    "sensitive_categories": query("SELECT k AS doc_id, categories FROM cat",
                                  extra={**_DOC, **rs.category_ctes("cat", "docs")}),
    "page_categories": query("SELECT k AS page_id, categories FROM cat",
                             extra={**_PAGE, **rs.category_ctes("cat", "docs")}),
    "safe_field": query(
        f"SELECT k AS doc_id, md5({_escape(collapse('text'), False)}) AS digest FROM red",
        extra={**_DOC, **rs.redacted_ctes("red", "docs")}),
    "render_untrusted": query(
        f"""SELECT k AS doc_id, md5('Goal: [untrusted data] ' || {_escape(collapse('red.text'), True)}
          || CASE WHEN length(d.text) > 4096 THEN '...' ELSE '' END) AS digest
        FROM red JOIN documents d ON d.doc_id = red.k""",
        extra={"docs": "SELECT doc_id AS k, substring(text, 1, 4096) AS text FROM documents",
               **rs.redacted_ctes("red", "docs")}),
    "digest_format": r"""SELECT doc_id, CAST(coalesce(regexp_matches(CASE doc_id % 5 WHEN 0 THEN f
          WHEN 1 THEN f[:70] WHEN 2 THEN upper(f) WHEN 3 THEN f || '0' END, '\Asha256:[0-9a-fA-F]{64}\z'),
          false) AS BIGINT) AS ok FROM (SELECT doc_id, 'sha256:' || sha256(text) AS f FROM documents)""",
    "canonical_digests": """SELECT doc_id, 'sha256:' || sha256('{"doc_id":' || doc_id || ',"lang":"' || lang
        || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS digest FROM documents""",
}
