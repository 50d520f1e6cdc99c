"""Registered queries: inventories, ledgers, claims, audio chunks.

Derived columns that are plain arithmetic are written once as SQL expressions that mean the same in
both engines; the operators themselves are written twice.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spanalign import fixed
from spanalign.functions import checks
from spanalign.operators import inventory as inv, ledger as lg, scoring as sc
from spanalign.operators.prefix import BLOCK_MS, running
from spanalign.plans import redaction_sql as rs
from spanalign.plans.sql import NON_WS, query
from spanalign.sources import tables as src

# limits of the two budget queries, small, so that they bind on documents of a few kB
BUDGET, PER_FILE = 20_000, 15_000

_TEXT = """concat(text, CASE WHEN doc_id % 5 = 1 THEN concat(' see (/home/user/s', cast({s} as {v}), '/notes.md)')
  WHEN doc_id % 5 = 2 THEN ' see "/home/user/other/notes.md".'
  WHEN doc_id % 5 = 3 THEN concat(' /home/user/s', cast({s} as {v}), '/../x') ELSE '' END)"""


def artifacts(spark, sf):
    """Eight documents make one session; some name private paths."""
    docs = src.table(spark, sf, "documents").select("doc_id", "text")
    text = F.expr(_TEXT.format(s="doc_id div 8", v="string"))
    return docs.select(
        F.expr("doc_id div 8").alias("session_id"), F.expr("doc_id % 8 + 1").alias("seq"),
        F.expr("concat('artifact-', cast(doc_id % 8 as string))").alias("name"),
        F.expr("concat('/home/user/s', cast(doc_id div 8 as string))").alias("session_dir"),
        text.alias("text"),
    ).withColumn("bytes", F.octet_length("text").cast("bigint"))


def approved_paths(spark, sf):
    return artifacts(spark, sf).where("session_id % 3 = 0").select("session_id").distinct().select(
        "session_id", F.lit("/home/user/other/notes.md").alias("path")
    )


def scan_budget(spark, sf):
    sized = artifacts(spark, sf).select("session_id", "seq", "bytes")
    return inv.scan_budget(sized, BUDGET, PER_FILE).select(
        "session_id", "seq", F.col("scanned").cast("bigint").alias("scanned")
    )


def scan_budget_by_source(spark, sf):
    """The same budget with one source as a session, so that groups grow with the table."""
    sized = src.table(spark, sf, "documents").select(
        F.col("source").alias("session_id"), F.col("doc_id").alias("seq"),
        F.octet_length("text").cast("bigint").alias("bytes"),
    )
    return inv.scan_budget(sized, BUDGET, PER_FILE, fold_rows=20).select(
        "session_id", "seq", F.col("scanned").cast("bigint").alias("scanned")
    )


def _findings(spark, sf):
    full = artifacts(spark, sf)
    marks = inv.scan_budget(full.select("session_id", "seq", "bytes"))
    scanned = full.join(marks.select("session_id", "seq", "scanned"), ["session_id", "seq"])
    return inv.leak_findings(scanned, approved_paths(spark, sf))


def leak_findings(spark, sf):
    return _findings(spark, sf).select(
        "session_id", "seq", F.array_join("categories", ",").alias("categories"), "disposition",
        F.col("blocks_share").cast("bigint").alias("blocks_share"),
    )


def leak_status(spark, sf):
    return inv.leak_status(_findings(spark, sf), artifacts(spark, sf))


def session_categories(spark, sf):
    return inv.session_categories(_findings(spark, sf)).select(
        "session_id", F.array_join("categories", ",").alias("categories")
    )


def raw_sensitivity(spark, sf):
    full = artifacts(spark, sf)
    marks = inv.scan_budget(full.select("session_id", "seq", "bytes"))
    scanned = full.join(marks.select("session_id", "seq", "scanned"), ["session_id", "seq"])
    return inv.raw_sensitivity(scanned).select(
        "session_id", "seq", "bytes", "line_count", "fingerprint",
        F.array_join("categories", ",").alias("categories"),
    )


def file_stats(spark, sf):
    pages = src.table(spark, sf, "pages").select(
        "page_id", F.encode("html", "UTF-8").alias("content")
    )
    return inv.file_stats(pages).select("page_id", "bytes", "line_count", "fingerprint")


def union_inventories(spark, sf):
    docs = src.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.octet_length("text").cast("bigint").alias("bytes"))
    pages = src.table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.octet_length("html").cast("bigint").alias("bytes"))
    return inv.union_inventories({"raw-local-private": docs, "generated-review-candidate": pages})


def _inventory(spark, sf):
    """Eleven expected artifacts per session, a few absent or malformed."""
    names = F.array(*[F.lit(n) for n in inv.REQUIRED_DIGESTS])
    rows = src.sessions(spark, sf).select("session_id", F.posexplode(names).alias("i", "name"))
    digest = checks.sha256(F.concat_ws("|", F.col("session_id").cast("string"), "name"))
    return rows.select(
        "session_id", "name", F.expr("(session_id + i) % 13 <> 0").alias("exists"),
        F.expr("(session_id + i) % 17 <> 1").alias("is_regular"),
        F.when(F.expr("(session_id + i) % 19 = 2"), F.substring(digest, 8, 64)).otherwise(digest)
        .alias("fingerprint"),
    )


def missing_digests(spark, sf):
    return inv.missing_digests(_inventory(spark, sf), src.sessions(spark, sf))


def snapshot_fingerprint(spark, sf):
    files = src.table(spark, sf, "documents").select(
        F.col("source").alias("session_id"), F.col("doc_id").cast("string").alias("path"),
        checks.sha256(F.col("text")).alias("fingerprint"),
    )
    return inv.snapshot_fingerprint(files)


#: Small, so that the trees of the query have several levels.
TREE_CELL = 4


def tree_fingerprint(spark, sf):
    files = src.table(spark, sf, "documents").select(
        F.col("source").alias("session_id"), F.col("doc_id").cast("string").alias("path"),
        checks.sha256(F.col("text")).alias("fingerprint"),
    )
    return inv.tree_fingerprint(files, TREE_CELL)


def event_digest(spark, sf):
    return sc.event_digest(src.table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms")))


def lint_jsonl(spark, sf):
    lines = src.table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"),
        F.expr("CASE WHEN event_id % 23 = 0 THEN substring(props, 1, 4) WHEN event_id % 29 = 0 THEN ' ' ELSE props END")
        .alias("value"),
    )
    return inv.lint_jsonl(lines)


def audio_chunk_spans(spark, sf):
    """Orders of a customer as consecutive chunks."""
    return inv.audio_chunk_spans(src.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("idx"),
        F.expr("o_orderkey % 4801 + 1").alias("bytes"),
        F.expr("o_orderkey * 250").alias("monotonic_offset_ms"),
    ))


def merge_chunk_texts(spark, sf):
    chunks = src.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), "text")
    return inv.merge_chunk_texts(chunks).select(
        "session_id", "chunks", F.md5("text").alias("digest"),
        F.col("oversize").cast("bigint").alias("oversize"),
    )


# --- ledgers ---

_ORDER_FIELDS = ("cents", "custkey", "orderkey", "status")


def _order_log(spark, sf):
    """Orders of a customer as a log in date order."""
    rows = src.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("session_id"), F.col("o_custkey").alias("custkey"),
        F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at_ms"),
    )
    numbered = running(
        rows, ["session_id"], F.floor(F.col("at_ms") / (BLOCK_MS * 24)).cast("bigint"),
        ["at_ms", "orderkey"], sums={"earlier": F.lit(1)},
    )
    return numbered.withColumn("seq", (F.col("earlier") + 1).cast("bigint"))


def hash_chain(spark, sf):
    """Chain check on order logs whose declared digests are damaged for some keys."""
    log = _order_log(spark, sf)
    own = checks.canonical_digest(_ORDER_FIELDS)
    declared = running(
        log.withColumn("declared", own), ["session_id"], F.expr("seq div 4096"), ["seq"],
        lags={"before": F.col("declared")},
    ).select(
        *log.columns,
        F.expr("CASE WHEN orderkey % 97 = 0 THEN upper(declared) ELSE declared END").alias("row_hash"),
        F.when(F.expr("orderkey % 89 = 1"), F.lit(None).cast("string"))
        .otherwise(F.coalesce("before", F.lit(fixed.EMPTY_DIGEST))).alias("previous_hash"),
    )
    return lg.hash_chain(declared, _ORDER_FIELDS, "previous_hash", "row_hash").select(
        "session_id", "seq", "actual_hash", "expected_previous", "violation"
    )


def continuation(spark, sf):
    log = _order_log(spark, sf)
    stated = running(
        log, ["session_id"], F.expr("seq div 4096"), ["seq"], lags={"prior": F.col("status")}
    ).withColumn("prior", F.expr("CASE WHEN orderkey % 31 = 3 THEN 'X' ELSE prior END"))
    return lg.continuation(stated, {"prior": "status"}).select(
        "session_id", "seq", "prior", F.size("breaks").cast("bigint").alias("breaks")
    )


_BEFORE = "CASE orderkey % 3 WHEN 0 THEN {a}('c1') WHEN 1 THEN {a}('c2', 'c1') ELSE {a}('c3') END"
_AFTER = "CASE orderkey % 4 WHEN 0 THEN {a}('c1', 'c2') WHEN 1 THEN {a}('c1', 'c2', 'c1') WHEN 2 THEN {a}('c3') ELSE {a}('c1') END"
_CHANGE = "CASE orderkey % 5 WHEN 0 THEN 'strengthens' WHEN 1 THEN 'clarifies' WHEN 2 THEN 'evidence_refresh' WHEN 3 THEN 'strengthens' ELSE 'weakens' END"


def transition_failures(spark, sf):
    orders = src.table(spark, sf, "orders").withColumn("orderkey", F.col("o_orderkey"))
    digest = lambda e: checks.sha256(F.expr(e))
    rows = orders.select(
        "orderkey", (F.col("orderkey") % 6).alias("seq"),
        F.expr(_BEFORE.format(a="array")).alias("before"), F.expr(_AFTER.format(a="array")).alias("after"),
        F.expr("CASE WHEN orderkey % 10 = 0 THEN array('c9') ELSE slice(array('c1'), 1, 0) END").alias("removed"),
        F.expr("slice(array('c1'), 1, 0)").alias("derived_removed"),
        F.expr("orderkey % 12 <> 5").alias("delta_matches"),
        F.expr("CASE WHEN orderkey % 14 = 0 THEN 'weakens' ELSE 'preserves_or_strengthens' END").alias("monotonicity"),
        F.expr(_CHANGE).alias("change_class"),
        digest("cast(orderkey % 7 as string)").alias("previous_contract_hash"),
        F.when(F.expr("orderkey % 8 = 0"), F.lit("sha256:00")).otherwise(
            digest("cast(orderkey % 9 as string)")).alias("new_contract_hash"),
        F.expr("orderkey % 16 = 0").alias("approval_required"),
        F.expr("CASE WHEN orderkey % 18 = 0 THEN 'pending' ELSE 'not_required' END").alias("approval_status"),
    )
    return lg.transition_failures(rows).select(
        "orderkey", F.array_join("failures", ",").alias("failures")
    )


_CLAIM = {
    "id": "cast(doc_id as {v})",
    "scope": "CASE WHEN doc_id % 50 = 3 THEN 'optional' ELSE 'required' END",
    "kind": "CASE doc_id % 8 WHEN 0 THEN 'feature_completion' WHEN 1 THEN 'integration' WHEN 2 THEN 'process_compliance' WHEN 3 THEN 'security' WHEN 4 THEN 'static_contract' WHEN 5 THEN 'ui_surface' WHEN 6 THEN 'other' END",
    "status": "CASE doc_id % 9 WHEN 0 THEN 'proven_static' WHEN 1 THEN 'contract_only' WHEN 2 THEN 'simulated_only' WHEN 3 THEN 'lane_owed' WHEN 4 THEN 'root_owed' WHEN 5 THEN 'externally_blocked' WHEN 6 THEN 'withheld_claim' WHEN 7 THEN 'unsupported' ELSE 'done' END",
    "surface": "CASE doc_id % 5 WHEN 0 THEN 'static' WHEN 1 THEN 'runtime_cli' WHEN 2 THEN 'ui_browser' WHEN 3 THEN 'observability' ELSE 'paper' END",
    "effect": "CASE doc_id % 4 WHEN 0 THEN 'satisfied' WHEN 1 THEN 'degraded' WHEN 2 THEN 'blocked' ELSE 'none' END",
    "evidence_count": "doc_id % 2",
    "backlog_row_id": "CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE concat('b', cast(doc_id as {v})) END",
}
_ALLOWED = "CASE WHEN doc_id % 7 = 0 THEN {a}('static', 'paper') ELSE {a}('static', 'runtime_cli') END"


def _claims(spark, sf):
    return src.table(spark, sf, "documents").select(
        "doc_id", *[F.expr(e.format(v="string")).alias(n) for n, e in _CLAIM.items()],
        F.expr(_ALLOWED.format(a="array")).alias("allowed_surfaces"),
    )


def _backlog(spark, sf):
    return src.table(spark, sf, "labels").select(
        F.expr("concat('b', cast(doc_id as string))").alias("id"),
        F.expr("CASE WHEN toxic = 1 THEN 'x' ELSE cast(doc_id as string) END").alias("claim_id"),
    )


def _evidence(spark, sf):
    digest = checks.sha256(F.col("text"))
    return src.table(spark, sf, "documents").select(
        F.expr("cast(doc_id as string)").alias("parent_id"),
        F.expr("concat('e', cast(doc_id as string))").alias("id"),
        F.expr("CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE cast(doc_id as string) END").alias("claim_id"),
        F.expr("CASE WHEN doc_id % 3 = 0 THEN 'runtime_execution' WHEN doc_id % 3 = 1 THEN 'static_check' ELSE 'hearsay' END").alias("kind"),
        F.expr(_CLAIM["surface"]).alias("surface"),
        F.expr("CASE WHEN doc_id % 10 = 0 THEN '  ' ELSE concat('src/', source) END").alias("path"),
        F.when(F.expr("doc_id % 13 = 0"), F.substring(digest, 1, 70)).otherwise(digest).alias("digest"),
    )


def claim_failures(spark, sf):
    return lg.claim_failures(_claims(spark, sf)).select(
        "id", F.array_join("failures", ",").alias("failures"))


def backlog_violations(spark, sf):
    return lg.backlog_violations(_claims(spark, sf), _backlog(spark, sf))


def evidence_violations(spark, sf):
    return lg.evidence_violations(_evidence(spark, sf), _claims(spark, sf)).select(
        "id", F.array_join("failures", ",").alias("failures"))


def ceiling_differences(spark, sf):
    declared = src.table(spark, sf, "labels").where("quality = 1").select(
        F.expr("cast(doc_id as string)").alias("id"))
    return lg.ceiling_differences(_claims(spark, sf), declared)


def claim_audit(spark, sf):
    """The whole claim set at once; every fiftieth claim and piece of evidence is given twice."""
    declared = src.table(spark, sf, "labels").where("quality = 1").select(
        F.expr("cast(doc_id as string)").alias("id"))
    twice = lambda df: df.unionByName(df.where(F.expr("try_cast(regexp_replace(id, 'e', '') as bigint) % 50 = 7")))
    return lg.claim_audit(twice(_claims(spark, sf).drop("doc_id")), _backlog(spark, sf), twice(_evidence(spark, sf)), declared)


_AMENDED = {
    "amendment_id": "concat('a', cast(orderkey as {v}))",
    "change_class": "CASE orderkey % 5 WHEN 0 THEN 'strengthens' WHEN 1 THEN 'clarifies' WHEN 2 THEN 'evidence_refresh' ELSE 'strengthens' END",
    "monotonicity": "CASE WHEN orderkey % 14 = 0 THEN 'weakens' ELSE 'preserves_or_strengthens' END",
    "delta_matches": "orderkey % 12 <> 5",
    "approval_required": "orderkey % 16 = 0",
    "approval_status": "CASE WHEN orderkey % 18 = 0 THEN 'pending' ELSE 'not_required' END",
    "created_at": "CASE WHEN orderkey % 37 <> 4 THEN cast(seq as {v}) END",
}
_HELD = "CASE ({s}) % 4 WHEN 0 THEN {a}('c1') WHEN 1 THEN {a}('c1', 'c2') WHEN 2 THEN {a}('c1', 'c2', 'c3') ELSE {a}('c1', 'c2', 'c3', 'c4') END"


def ledger_audit(spark, sf):
    """Order logs as amendment ledgers.

    The first row of a log links to the empty digest and the second to the first one's digest (damaged
    for some keys); later rows name a digest of their own, so both outcomes occur.
    """
    none = F.expr("slice(array('c1'), 1, 0)")
    step = lambda e: checks.sha256(F.concat(F.lit("k"), F.expr(e).cast("string")))
    rows = _order_log(spark, sf).select(
        "session_id", "seq", "orderkey", *[F.expr(e.format(v="string")).alias(n) for n, e in _AMENDED.items()],
        F.when(F.expr("seq = 1"), none).when(F.expr("orderkey % 31 = 3"), F.array(F.lit("x")))
        .otherwise(F.expr(_HELD.format(s="seq - 1", a="array"))).alias("before"),
        F.expr(_HELD.format(s="seq", a="array")).alias("after"),
        F.when(F.expr("orderkey % 10 = 0"), F.array(F.lit("c9"))).otherwise(none).alias("removed"),
        none.alias("derived_removed"),
        F.when(F.expr("seq = 1"), F.lit(fixed.EMPTY_DIGEST)).otherwise(step("seq - 1")).alias("previous_contract_hash"),
        F.when(F.expr("orderkey % 29 = 1"), F.lit("sha256:00")).otherwise(step("seq")).alias("new_contract_hash"),
    )
    fields = list(lg.AMENDMENT_FIELDS)
    first = rows.withColumn("previous_amendment_hash", F.when(F.expr("seq = 1"), F.lit(fixed.EMPTY_DIGEST)))
    before = running(first.withColumn("own", checks.canonical_digest(fields)), ["session_id"], F.expr("seq div 4096"), ["seq"],
                     lags={"linked": F.col("own")})
    linked = before.withColumn("previous_amendment_hash", F.when(F.expr("seq = 1"), F.lit(fixed.EMPTY_DIGEST)).when(
        F.expr("orderkey % 23 <> 0"), F.when(F.expr("seq = 2"), F.col("linked")).otherwise(step("orderkey"))))
    declared = linked.withColumn("amendment_hash", checks.canonical_digest(fields)).withColumn(
        "amendment_hash", F.when(F.expr("orderkey % 41 = 5"), F.upper("amendment_hash")).otherwise(F.col("amendment_hash")))
    return lg.ledger_audit(declared, ["c1", "c2", "c3", "c4", "c9"]).select(
        "session_id", "seq", F.coalesce("violation", F.lit("")).alias("violation"),
        *[F.array_join(c, ",").alias(c) for c in ("missing", "breaks", "failures")])


def duplicate_keys(spark, sf):
    docs = src.table(spark, sf, "documents").select(F.sha2("text", 256).alias("digest"))
    return lg.duplicate_keys(docs, "digest")


_REPORT = {
    "id": "p_partkey",
    "policy": "CASE p_partkey % 4 WHEN 0 THEN '100_percent_required' WHEN 1 THEN 'ratchet_floor' WHEN 2 THEN 'blocked_or_withheld' ELSE 'other' END",
    "ceiling": "CASE p_partkey % 6 WHEN 0 THEN 'supports_complete_claim' WHEN 1 THEN 'ratchet_floor_only' WHEN 4 THEN 'supports_complete_claim' ELSE 'withheld_or_blocked' END",
    "percent": "CASE WHEN p_partkey % 3 <> 1 THEN cast(100 as double) ELSE cast(p_size as double) END",
    "floor_percent": "CASE WHEN p_partkey % 20 <> 0 THEN cast(100 as double) END",
    "uncovered": "CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 0 END",
    "owner": "CASE WHEN p_partkey % 9 <> 0 THEN 'root' END",
    "reason": "p_name",
    "debt_id": "CASE WHEN p_partkey % 11 <> 0 THEN 'debt' END",
    "counted": "p_partkey % 15 = 0",
}


def floor_failures(spark, sf):
    rows = src.table(spark, sf, "part").select(*[F.expr(e).alias(n) for n, e in _REPORT.items()])
    rows = rows.withColumn("exclusions", F.array(F.struct(
        F.lit("gen").alias("path"), F.lit("generated").alias("kind"), F.col("reason").alias("rationale"),
        F.col("counted").alias("counts_as_covered"), F.lit(True).alias("reviewed"))))
    return lg.floor_failures(rows).select("id", F.array_join("failures", ",").alias("failures"))


QUERIES = {f.__name__: f for f in (
    scan_budget, scan_budget_by_source, leak_findings, leak_status, session_categories,
    raw_sensitivity, file_stats, union_inventories, missing_digests, snapshot_fingerprint, tree_fingerprint, event_digest, lint_jsonl,
    audio_chunk_spans, merge_chunk_texts, hash_chain, continuation, transition_failures,
    ledger_audit, claim_audit, claim_failures, backlog_violations, evidence_violations, ceiling_differences, duplicate_keys,
    floor_failures,
)}


def failed(rules: dict[str, str]) -> str:
    """SQL: comma-joined names of rules that are not true."""
    parts = ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in rules.items())
    return f"coalesce(array_to_string(list_filter([{parts}], lambda z: z IS NOT NULL), ','), '')"


def _in(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


_ART = {"art": f"""
  SELECT doc_id AS k, doc_id // 8 AS session_id, doc_id % 8 + 1 AS seq, text, CAST(strlen(text) AS BIGINT) AS bytes
  FROM (SELECT doc_id, {_TEXT.format(s='doc_id // 8', v='varchar')} AS text FROM documents)"""}


def _fold(source: str, total: int = BUDGET, per_file: int = PER_FILE) -> str:
    """Budget by recursion over the row number of each session."""
    return f"""
  SELECT * FROM (WITH RECURSIVE items AS (SELECT session_id, seq, bytes,
      row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM {source}),
    walk AS (SELECT session_id, seq, rn, CAST(bytes <= {per_file} AND bytes <= {total} AS BIGINT) AS scanned,
        {total} - CASE WHEN bytes <= {per_file} AND bytes <= {total} THEN bytes ELSE 0 END AS remaining
      FROM items WHERE rn = 1
      UNION ALL SELECT i.session_id, i.seq, i.rn, CAST(bytes <= {per_file} AND bytes <= remaining AS BIGINT),
        remaining - CASE WHEN bytes <= {per_file} AND bytes <= remaining THEN bytes ELSE 0 END
      FROM walk w JOIN items i ON i.session_id = w.session_id AND i.rn = w.rn + 1)
    SELECT session_id, seq, scanned FROM walk)"""


_PATHS = f"""SELECT k, list_filter(list_transform(regexp_extract_all(text, '{NON_WS}+'), lambda t:
    CASE WHEN {rs.path('t')} THEN regexp_replace(t, '\\A[!"#$%&''()*+,:;<=>?@\\[\\\\\\]^`{{|}}]+|[!"#$%&''()*+,:;<=>?@\\[\\\\\\]^`{{|}}]+\\z', '', 'g') END),
    lambda p: p IS NOT NULL) AS paths FROM art"""
_FINDINGS = """SELECT session_id, seq, cats AS categories,
  CASE WHEN scanned = 0 THEN 'artifact-inspection-budget-exceeded'
    WHEN blocks THEN 'unresolved-sensitive-content' WHEN path_found AND expected
    THEN 'expected-local-artifact-reference' ELSE 'expected-local-opaque-token-reference' END AS disposition,
  CAST(blocks AS BIGINT) AS blocks_share
FROM (SELECT *, path_found AND NOT expected OR len(list_filter(string_split(cats, ','),
        lambda c: c NOT IN ('opaque-token', 'private-path'))) > 0 AS blocks
  FROM (SELECT a.session_id, a.seq, scanned, list_contains(string_split(cats, ','), 'private-path') AS path_found, expected, cats
    FROM (SELECT a.*, scanned, CASE WHEN scanned = 0 THEN 'unsafe-artifact-content'
        WHEN len(paths) > 0 AND NOT list_contains(string_split(categories, ','), 'private-path')
        THEN CASE WHEN categories = '' THEN 'private-path' ELSE categories || ',private-path' END ELSE categories END AS cats,
      len(paths) > 0 AND len(list_filter(paths, lambda p: regexp_matches(p, '(\\A|/)\\.\\.(/|\\z)') OR NOT (
        p = '/home/user/s' || a.session_id OR starts_with(p, '/home/user/s' || a.session_id || '/')
        OR (a.session_id % 3 = 0 AND p = '/home/user/other/notes.md')))) = 0 AS expected
      FROM art a JOIN cat USING (k) JOIN paths USING (k) JOIN fold f ON f.session_id = a.session_id AND f.seq = a.seq) a
    WHERE cats <> ''))"""
_LEAK = {**_ART, **rs.category_ctes("cat", "art"), "paths": _PATHS,
         "fold": _fold("art", fixed.SCAN_MAX_BYTES_PER_SESSION, fixed.SCAN_MAX_BYTES_PER_FILE)}
_LOG = {"log": """SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY o_orderdate, orderkey) AS seq,
    'sha256:' || sha256('{"cents":' || cents || ',"custkey":' || session_id || ',"orderkey":' || orderkey
      || ',"status":"' || status || '"}') AS digest
  FROM (SELECT o_custkey AS session_id, o_orderkey AS orderkey, o_orderstatus AS status, o_orderdate,
          CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"""}
_CLAIMS = {"claims": "SELECT doc_id, " + ", ".join(f"{e.format(v='varchar')} AS {n}" for n, e in _CLAIM.items())
           + f", {_ALLOWED.format(a='list_value')} AS allowed_surfaces FROM documents"}
_DIG = r"coalesce(regexp_matches({0}, '\Asha256:[0-9a-fA-F]{{64}}\z'), false)"
_SAME = 'list_sort(list_distinct("before")) = list_sort(list_distinct("after"))'
_GROWS = f'len(list_filter("before", lambda b: NOT list_contains("after", b))) = 0 AND NOT ({_SAME})'

def _tree(leaves: str, cell: int, levels: int = 6) -> dict[str, str]:
    """Tree of digests over ``leaves(session_id, leaf)``, level by level; ``levels`` are enough for small tables."""
    depth = " + ".join(f"CAST(count(*) > {cell * 16**k} AS BIGINT)" for k in range(levels))
    parts = {"tl": f"SELECT session_id, leaf, count(*) AS n FROM ({leaves}) GROUP BY 1, 2",
             "ts": f"SELECT session_id, CAST(sum(n) AS BIGINT) AS files, {depth} AS depth FROM tl GROUP BY 1"}
    for k in range(levels, -1, -1):
        above = "" if k == levels else f""" UNION ALL SELECT session_id, digits[:{k}],
            sha256(string_agg(digits || ':' || digest, ',' ORDER BY digits)) FROM t{k + 1} GROUP BY 1, 2"""
        parts[f"t{k}"] = f"""SELECT session_id, leaf[:{k}] AS digits, sha256(string_agg(leaf || ':' || n, ',' ORDER BY leaf)) AS digest
            FROM tl JOIN ts USING (session_id) WHERE depth = {k} GROUP BY 1, 2{above}"""
    return parts


_ROOT = "SELECT session_id, files, depth, 'sha256:' || digest AS fingerprint FROM ts JOIN t0 USING (session_id)"

SQL = {
    "tree_fingerprint": query(_ROOT, extra=_tree(
        "SELECT source AS session_id, sha256(doc_id || chr(10) || 'sha256:' || sha256(text)) AS leaf FROM documents", TREE_CELL)),
    "event_digest": query(f"SELECT session_id, files AS events, depth, fingerprint AS digest FROM ({_ROOT})", extra=_tree(
        """SELECT user_id AS session_id, sha256(event_id || chr(10) || 'sha256:' || sha256('{"at_ms":' || epoch_us(ts) // 1000
            || ',"kind":"' || event_type || '","seq":' || event_id || '}')) AS leaf FROM events""", inv.TREE_CELL)),
    "scan_budget": query("SELECT session_id, seq, scanned FROM fold", extra={**_ART, "fold": _fold("art")}),
    "scan_budget_by_source": query("SELECT session_id, seq, scanned FROM fold", extra={
        "art": "SELECT source AS session_id, doc_id AS seq, CAST(strlen(text) AS BIGINT) AS bytes FROM documents",
        "fold": _fold("art")}),
    "leak_findings": query(_FINDINGS, extra=_LEAK),
    "leak_status": query(
        """SELECT a.session_id, count(f.seq) AS findings, count(f.seq) FILTER (blocks_share = 1) AS blocking,
        CASE WHEN count(f.seq) FILTER (blocks_share = 1) > 0 THEN 'blocked'
             WHEN count(f.seq) > 0 THEN 'expected-local-references-only'
             ELSE 'no-obvious-sensitive-patterns-detected' END AS status
        FROM art a LEFT JOIN findings f ON a.session_id = f.session_id AND a.seq = f.seq GROUP BY a.session_id""",
        extra={**_LEAK, "findings": _FINDINGS}),
    "session_categories": query(
        """SELECT session_id, string_agg(category, ',' ORDER BY place) AS categories FROM (
          SELECT session_id, category, min(seq * 1000 + pos) AS place FROM (
            SELECT session_id, seq, unnest(cs) AS category, generate_subscripts(cs, 1) AS pos
            FROM (SELECT session_id, seq, string_split(categories, ',') AS cs FROM findings))
          GROUP BY session_id, category) GROUP BY session_id""", extra={**_LEAK, "findings": _FINDINGS}),
    "raw_sensitivity": query(
        """SELECT a.session_id, a.seq, bytes, CAST(len(regexp_extract_all(text, '\\n'))
            + CASE WHEN text <> '' AND text[-1] <> chr(10) THEN 1 ELSE 0 END AS BIGINT) AS line_count,
          'sha256:' || sha256(text) AS fingerprint, CASE WHEN scanned = 0
            THEN 'artifact-inspection-budget-exceeded' ELSE categories END AS categories
        FROM art a JOIN cat USING (k) JOIN fold f ON f.session_id = a.session_id AND f.seq = a.seq""", extra=_LEAK),
    "file_stats": """SELECT page_id, CAST(strlen(html) AS BIGINT) AS bytes, CAST(len(regexp_extract_all(html, '\\n'))
            + CASE WHEN html <> '' AND html[-1] <> chr(10) THEN 1 ELSE 0 END AS BIGINT) AS line_count,
          'sha256:' || sha256(html) AS fingerprint FROM pages""",
    "union_inventories": """SELECT doc_id AS id, CAST(strlen(text) AS BIGINT) AS bytes, 'raw-local-private' AS policy FROM documents
        UNION ALL SELECT page_id, CAST(strlen(html) AS BIGINT), 'generated-review-candidate' FROM pages""",
    "missing_digests": query(
        f"""SELECT session_id, name FROM (SELECT session_id, unnest([{', '.join(repr(n) for n in inv.REQUIRED_DIGESTS)}]) AS name,
          unnest(range({len(inv.REQUIRED_DIGESTS)})) AS i FROM sessions)
        WHERE (session_id + i) % 13 = 0 OR (session_id + i) % 17 = 1 OR (session_id + i) % 19 = 2""", "sessions"),
    "snapshot_fingerprint": """SELECT session_id, CAST(sum(n) AS BIGINT) AS files,
          'sha256:' || sha256(string_agg(prefix || g, '' ORDER BY prefix)) AS snapshot
        FROM (SELECT session_id, leaf[:3] AS prefix, count(*) AS n, sha256(string_agg(leaf, '' ORDER BY leaf)) AS g
          FROM (SELECT source AS session_id, sha256(doc_id || chr(10) || 'sha256:' || sha256(text)) AS leaf FROM documents)
          GROUP BY 1, 2) GROUP BY session_id""",
    "lint_jsonl": """SELECT user_id AS session_id, event_id AS seq, 'malformed-json' AS reason FROM events
        WHERE event_id % 23 = 0 AND NOT json_valid(props[:4])""",
    "audio_chunk_spans": """SELECT session_id, idx, e - bytes AS byte_start, e AS byte_end, (e - bytes) // 2 AS sample_start,
          e // 2 AS sample_end, idx * 250 AS monotonic_offset_ms
        FROM (SELECT *, CAST(sum(bytes) OVER (PARTITION BY session_id ORDER BY idx) AS BIGINT) AS e
          FROM (SELECT o_custkey AS session_id, o_orderkey AS idx, o_orderkey % 4801 + 1 AS bytes FROM orders))""",
    "merge_chunk_texts": """SELECT session_id, chunks, md5(merged) AS digest, CAST(size > 4194304 AS BIGINT) AS oversize
        FROM (SELECT conv_id AS session_id, count(*) AS chunks, sum(strlen(text)) + count(*) AS size,
                string_agg(text, chr(10) ORDER BY turn) AS merged FROM conversations GROUP BY conv_id)""",
    "hash_chain": query(
        f"""SELECT session_id, seq, digest AS actual_hash,
          coalesce(lag(digest) OVER (PARTITION BY session_id ORDER BY seq), '{fixed.EMPTY_DIGEST}') AS expected_previous,
          CASE WHEN orderkey % 89 = 1 THEN 'previous-hash-mismatch'
          WHEN orderkey % 97 = 0 THEN 'row-hash-mismatch' END AS violation FROM log""", extra=_LOG),
    "continuation": query(
        """SELECT session_id, seq, prior, CAST(seq > 1 AND prior IS DISTINCT FROM before AS BIGINT) AS breaks
        FROM (SELECT *, CASE WHEN orderkey % 31 = 3 THEN 'X' ELSE before END AS prior
          FROM (SELECT *, lag(status) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM log))""",
        extra=_LOG),
    "transition_failures": f"""SELECT orderkey, {failed({
        "digest-format": "orderkey % 8 <> 0",
        "genesis": "orderkey % 6 <> 1",
        "delta-flag": "orderkey % 12 <> 5",
        "monotonicity": "orderkey % 14 <> 0",
        "duplicate-claims": "orderkey % 4 <> 1",
        "removed-claims": 'len(list_filter("before", lambda b: NOT list_contains("after", b))) = 0 AND orderkey % 10 <> 0',
        "change-class": f'''CASE change_class WHEN 'strengthens' THEN {_GROWS} AND nxt <> prev
            WHEN 'clarifies' THEN {_SAME} WHEN 'evidence_refresh' THEN {_SAME} AND nxt = prev ELSE false END''',
        "approval": "orderkey % 16 <> 0 AND orderkey % 18 <> 0",
        })} AS failures
        FROM (SELECT orderkey, {_BEFORE.format(a='list_value')} AS "before", {_AFTER.format(a='list_value')} AS "after", {_CHANGE} AS change_class,
          CAST(orderkey % 7 AS VARCHAR) AS prev, CASE WHEN orderkey % 8 = 0 THEN '-' ELSE CAST(orderkey % 9 AS VARCHAR) END AS nxt
          FROM (SELECT o_orderkey AS orderkey FROM orders))""",
    "claim_failures": query(f"""SELECT id, {failed({
        "scope": "scope = 'required'", "kind": _in("kind", fixed.CLAIM_KINDS),
        "surface": _in("surface", fixed.CLAIM_SURFACES), "effect": _in("effect", fixed.CLAIM_EFFECTS),
        "status": _in("status", (fixed.PROVEN_STATUS, *fixed.OPEN_STATUSES)),
        "allowed-surfaces": "doc_id % 7 <> 0",
        "evidence": "status <> 'proven_static' OR evidence_count > 0",
        "backlog": "status = 'proven_static' OR trim(backlog_row_id) <> ''",
        })} AS failures FROM claims""", extra=_CLAIMS),
    "backlog_violations": query(
        f"""SELECT c.id, c.backlog_row_id FROM claims c LEFT JOIN labels l ON c.backlog_row_id = 'b' || l.doc_id
          AND l.toxic = 0 AND c.doc_id = l.doc_id
        WHERE {_in('status', fixed.OPEN_STATUSES)} AND l.doc_id IS NULL""", extra=_CLAIMS),
    "evidence_violations": query(f"""SELECT * FROM (SELECT 'e' || id AS id, {failed({
        "claim": "doc_id % 11 <> 0",
        "surface": "list_contains(allowed_surfaces, surface)",
        "digest": "doc_id % 13 <> 0", "path": "doc_id % 10 <> 0", "kind": "doc_id % 3 <> 2",
        })} AS failures FROM claims) WHERE failures <> ''""", extra=_CLAIMS),
    "ceiling_differences": query(
        """SELECT coalesce(c.id, d.id) AS id, CASE WHEN d.id IS NULL THEN 'proven-not-declared' ELSE 'declared-not-proven' END AS difference
        FROM (SELECT id FROM claims WHERE status = 'proven_static') c
        FULL JOIN (SELECT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE quality = 1) d ON c.id = d.id
        WHERE c.id IS NULL OR d.id IS NULL""", extra=_CLAIMS),
    "duplicate_keys": "SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "floor_failures": f"""SELECT id, {failed({
        "policy": "policy <> 'other'",
        "percent": "percent IS NOT NULL AND floor_percent IS NOT NULL",
        "complete": "policy <> '100_percent_required' OR (percent = 100 AND ceiling = 'supports_complete_claim' AND uncovered = 0)",
        "ratchet": "policy <> 'ratchet_floor' OR (ceiling = 'ratchet_floor_only' AND owner IS NOT NULL AND reason IS NOT NULL AND debt_id IS NOT NULL)",
        "withheld": "policy <> 'blocked_or_withheld' OR (ceiling = 'withheld_or_blocked' AND owner IS NOT NULL AND reason IS NOT NULL AND debt_id IS NOT NULL)",
        "exclusions": "reason IS NOT NULL AND NOT counted",
        })} AS failures FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in _REPORT.items())} FROM part)""",
}


# --- audits as a whole ---

def _amendment_json(previous: str) -> str:
    """Canonical JSON of an amendment: fields by name, none that is NULL."""
    fields = {n: f"""'"{n}":"' || {n} || '"'""" for n in (*_AMENDED, "previous_contract_hash", "new_contract_hash")}
    fields |= {n: f"""'"{n}":' || {n}""" for n in ("delta_matches", "approval_required")}
    fields |= {n: f"""'"{n}":' || CAST(to_json("{n}") AS VARCHAR)""" for n in ("before", "after", "removed")}
    fields |= {"derived_removed": "'\"derived_removed\":[]'", "previous_amendment_hash": f"""'"previous_amendment_hash":"' || {previous} || '"'"""}
    return "'{' || concat_ws(',', " + ", ".join(fields[n] for n in sorted(fields)) + ") || '}'"


_AUDIT = {
    "a0": f"""SELECT session_id, seq, orderkey, {', '.join(f'{e.format(v="varchar")} AS {n}' for n, e in _AMENDED.items())},
        CASE WHEN seq = 1 THEN [] WHEN orderkey % 31 = 3 THEN ['x'] ELSE {_HELD.format(s='seq - 1', a='list_value')} END AS "before",
        {_HELD.format(s='seq', a='list_value')} AS "after", CASE WHEN orderkey % 10 = 0 THEN ['c9'] ELSE [] END AS removed,
        CASE WHEN seq = 1 THEN '{fixed.EMPTY_DIGEST}' ELSE 'sha256:' || sha256('k' || (seq - 1)) END AS previous_contract_hash,
        CASE WHEN orderkey % 29 = 1 THEN 'sha256:00' ELSE 'sha256:' || sha256('k' || seq) END AS new_contract_hash
      FROM log""",
    "a1": f"""SELECT *, CASE WHEN seq = 1 THEN '{fixed.EMPTY_DIGEST}' WHEN orderkey % 23 = 0 THEN NULL
          WHEN seq > 2 THEN 'sha256:' || sha256('k' || orderkey)
          ELSE lag('sha256:' || sha256({_amendment_json(f"'{fixed.EMPTY_DIGEST}'")})) OVER (PARTITION BY session_id ORDER BY seq)
        END AS previous_amendment_hash FROM a0""",
    "a2": f"SELECT *, 'sha256:' || sha256({_amendment_json('previous_amendment_hash')}) AS actual FROM a1",
    "a3": """SELECT *, lag(actual) OVER w AS linked, lag("after") OVER w AS held, lag(new_contract_hash) OVER w AS contract
      FROM a2 WINDOW w AS (PARTITION BY session_id ORDER BY seq)""",
}
_CHANGED = f"""CASE change_class WHEN 'strengthens' THEN {_GROWS} AND new_contract_hash <> previous_contract_hash
  WHEN 'clarifies' THEN {_SAME} ELSE {_SAME} AND new_contract_hash = previous_contract_hash END"""
_AMENDMENT_RULES = {
    "digest-format": "orderkey % 29 <> 1", "genesis": "true", "delta-flag": "delta_matches", "monotonicity": "orderkey % 14 <> 0",
    "duplicate-claims": "true",
    "removed-claims": 'len(list_filter("before", lambda b: NOT list_contains("after", b))) = 0 AND orderkey % 10 <> 0',
    "change-class": _CHANGED, "approval": "NOT approval_required AND approval_status = 'not_required'",
    "known-claims": """NOT list_contains("before", 'x')""",
}
SQL["ledger_audit"] = query(
    f"""SELECT session_id, seq,
      CASE WHEN previous_amendment_hash IS DISTINCT FROM coalesce(linked, '{fixed.EMPTY_DIGEST}') THEN 'previous-hash-mismatch'
        WHEN orderkey % 41 = 5 THEN 'row-hash-mismatch' ELSE '' END AS violation,
      concat_ws(',', CASE WHEN previous_amendment_hash IS NULL THEN 'previous_amendment_hash' END, CASE WHEN created_at IS NULL THEN 'created_at' END) AS missing,
      concat_ws(',', CASE WHEN seq > 1 AND "before" IS DISTINCT FROM held THEN 'before does not continue the prior state' END,
        CASE WHEN seq > 1 AND previous_contract_hash IS DISTINCT FROM contract THEN 'previous_contract_hash does not continue the prior state' END) AS breaks,
      {failed(_AMENDMENT_RULES)} AS failures FROM a3""", extra={**_LOG, **_AUDIT})


def _times(part: str, name: str, detail: str, copies: int) -> str:
    """Violations of one part; ids that are given twice break a rule as often as they meet."""
    key = "CAST(replace(id, 'e', '') AS BIGINT)"
    return (f"SELECT '{part}' AS part, id, {detail} AS detail FROM ({SQL[name]}), "
            f"LATERAL (SELECT unnest(range(CASE WHEN {key} % 50 = 7 THEN {copies} ELSE 1 END))) WHERE {detail} <> ''")


SQL["claim_audit"] = "\nUNION ALL ".join([
    _times("claim", "claim_failures", "failures", 2), _times("backlog", "backlog_violations", "backlog_row_id", 2),
    _times("evidence", "evidence_violations", "failures", 4),
    f"SELECT 'ceiling' AS part, id, difference AS detail FROM ({SQL['ceiling_differences']})",
    "SELECT 'duplicate-claim', CAST(doc_id AS VARCHAR), '2' FROM documents WHERE doc_id % 50 = 7",
    "SELECT 'duplicate-evidence', 'e' || doc_id, '2' FROM documents WHERE doc_id % 50 = 7",
])
