"""Append-only ledgers and claim tables: chains, transitions, references, set equality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spanalign import fixed
from spanalign.functions import checks
from spanalign.operators.prefix import row_block, running


def hash_chain(
    rows: DataFrame, fields: Sequence[str], previous: str, declared: str, key: str = "session_id",
) -> DataFrame:
    """Recomputed digest of every ledger row and whether the chain holds.

    A row's digest covers ``fields``; name ``previous`` among them if the log's digests cover it.  The
    previous row's *recomputed* digest (``expected_previous``) is carried across blocks, so a log of
    any length is checked in parallel.
    """
    hashed = rows.withColumn("actual_hash", checks.canonical_digest(fields))
    linked = running(
        hashed, [key], row_block("seq"), ["seq"], lags={"expected_previous": F.col("actual_hash")}
    )
    expected = F.coalesce("expected_previous", F.lit(fixed.EMPTY_DIGEST))
    return linked.withColumn("expected_previous", expected).withColumn(
        "violation",
        F.when(~F.coalesce(F.col(previous) == F.col("expected_previous"), F.lit(False)), "previous-hash-mismatch")
        .when(~F.coalesce(F.col(declared) == F.col("actual_hash"), F.lit(False)), "row-hash-mismatch"),
    )


def continuation(rows: DataFrame, pairs: dict[str, str], key: str = "session_id") -> DataFrame:
    """Rows whose ``before`` column differs from the previous row's ``after`` column.

    ``pairs`` maps before-columns to after-columns; arrays are compared as they are.
    """
    linked = running(
        rows, [key], row_block("seq"), ["seq"],
        lags={f"_prior_{b}": F.col(a) for b, a in pairs.items()} | {"_has_prior": F.lit(True)},
    )
    broken = checks.reasons([
        (F.col("_has_prior").isNotNull() & ~F.col(b).eqNullSafe(F.col(f"_prior_{b}")),
         f"{b} does not continue the prior state")
        for b in pairs
    ])
    return linked.withColumn("breaks", broken).drop(*[f"_prior_{b}" for b in pairs], "_has_prior")


def change_is_valid(
    change: Column, before: Column, after: Column, previous: Column, following: Column
) -> Column:
    grows = (F.size(F.array_except(before, after)) == 0) & ~checks.same_set(before, after)
    return (
        ((change == "strengthens") & grows & (following != previous))
        | ((change == "clarifies") & checks.same_set(before, after))
        | ((change == "evidence_refresh") & checks.same_set(before, after) & (following == previous))
    )


def transition_failures(rows: DataFrame, known_ids: Sequence[str] | None = None) -> DataFrame:
    """Failed transition rules of every amendment row."""
    before, after = F.col("before"), F.col("after")
    removed = F.array_except(before, after)
    sets = ["before", "after", "removed", "derived_removed"]
    unique = F.lit(True)
    for name in sets:
        unique = unique & (F.size(F.array_distinct(name)) == F.size(name))
    rules = {
        "digest-format": checks.is_digest(F.col("previous_contract_hash"))
        & checks.is_digest(F.col("new_contract_hash")),
        "genesis": (F.col("seq") != 1) | (
            (F.col("previous_contract_hash") == fixed.EMPTY_DIGEST) & (F.size(before) == 0)
        ),
        "delta-flag": F.col("delta_matches"),
        "monotonicity": F.col("monotonicity") == "preserves_or_strengthens",
        "duplicate-claims": unique,
        "removed-claims": (F.size(removed) == 0) & (F.size("removed") == 0)
        & (F.size("derived_removed") == 0),
        "change-class": F.col("change_class").isin(*fixed.CHANGE_CLASSES) & change_is_valid(
            F.col("change_class"), before, after,
            F.col("previous_contract_hash"), F.col("new_contract_hash"),
        ),
        "approval": ~F.col("approval_required") & (F.col("approval_status") == "not_required"),
    }
    if known_ids is not None:
        known = F.array(*[F.lit(i) for i in known_ids])
        rules["known-claims"] = F.size(F.array_except(F.concat(*sets), known)) == 0
    return rows.withColumn("failures", checks.failing(rules))


AMENDMENT_FIELDS = (
    "amendment_id", "previous_contract_hash", "new_contract_hash", "previous_amendment_hash",
    "change_class", "monotonicity", "before", "after", "removed", "derived_removed",
    "delta_matches", "approval_required", "approval_status", "created_at",
)


def ledger_audit(amendments: DataFrame, known_ids: Sequence[str] | None = None) -> DataFrame:
    """Required fields, chain, continuation and transition rules of every amendment row."""
    required = [*AMENDMENT_FIELDS, "amendment_hash"]
    chained = hash_chain(
        amendments, AMENDMENT_FIELDS, "previous_amendment_hash", "amendment_hash"
    )
    continued = continuation(
        chained, {"before": "after", "previous_contract_hash": "new_contract_hash"}
    )
    checked = transition_failures(continued, known_ids)
    return checked.select(
        "session_id", "seq", checks.missing_fields(required).alias("missing"), "violation",
        "breaks", "failures",
    )


# --- claims ---

def claim_failures(claims: DataFrame) -> DataFrame:
    """Domain and evidence rules of each claim (``evidence_count`` rows of evidence)."""
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    proven = F.col("status") == fixed.PROVEN_STATUS
    rules = {
        "scope": F.col("scope") == "required",
        "kind": F.col("kind").isin(*fixed.CLAIM_KINDS),
        "surface": F.col("surface").isin(*fixed.CLAIM_SURFACES),
        "effect": F.col("effect").isin(*fixed.CLAIM_EFFECTS),
        "status": F.col("status").isin(fixed.PROVEN_STATUS, *fixed.OPEN_STATUSES),
        "allowed-surfaces": F.forall(
            "allowed_surfaces", lambda s: s.isin(*fixed.CLAIM_SURFACES)
        ),
        "evidence": ~proven | (F.col("evidence_count") > 0),
        "backlog": proven | text("backlog_row_id"),
    }
    return claims.withColumn("failures", checks.failing(rules))


def backlog_violations(claims: DataFrame, backlog: DataFrame) -> DataFrame:
    """Open claims whose backlog row is missing or bound to another claim."""
    open_claims = claims.where(F.col("status").isin(*fixed.OPEN_STATUSES))
    rows = backlog.select(
        F.col("id").alias("backlog_row_id"), F.col("claim_id").alias("id")
    )
    return open_claims.join(rows, ["backlog_row_id", "id"], "left_anti").select("id", "backlog_row_id")


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def evidence_violations(evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """Evidence rows that break a rule, with the failed rules.

    ``evidence``: parent_id, id, claim_id, kind, surface, path, digest.
    """
    allowed = claims.select(F.col("id").alias("parent_id"), "allowed_surfaces")
    joined = evidence.join(allowed, "parent_id", "left")
    rules = {
        "claim": F.col("claim_id") == F.col("parent_id"),
        "surface": F.array_contains("allowed_surfaces", F.col("surface")),
        "digest": checks.is_digest(F.col("digest")),
        "path": F.trim("path") != "",
        "kind": F.col("kind").isin(*fixed.EVIDENCE_KINDS),
    }
    return joined.withColumn("failures", checks.failing(rules)).where(F.size("failures") > 0)


def ceiling_differences(claims: DataFrame, declared: DataFrame) -> DataFrame:
    """Two-way difference of proven claims and declared ceiling ids; empty means equal sets."""
    proven = claims.where(F.col("status") == fixed.PROVEN_STATUS).select("id").distinct()
    stated = declared.select("id").distinct()
    return proven.join(stated, "id", "left_anti").withColumn(
        "difference", F.lit("proven-not-declared")
    ).unionByName(stated.join(proven, "id", "left_anti").withColumn(
        "difference", F.lit("declared-not-proven")
    ))


def claim_audit(
    claims: DataFrame, backlog: DataFrame, evidence: DataFrame, declared: DataFrame
) -> DataFrame:
    """All violations of a claim set as one table (``part, id, detail``); empty means sound.

    Parts: ``claim`` rules, ``backlog`` and ``evidence`` references, the ``ceiling``, and ids given
    twice (``duplicate-claim``, ``duplicate-evidence``).
    """
    listed = lambda df: df.select("id", F.array_join("failures", ",").alias("detail"))
    repeated = lambda df: duplicate_keys(df, "id").select("id", F.col("n").cast("string").alias("detail"))
    parts = {
        "claim": listed(claim_failures(claims).where(F.size("failures") > 0)),
        "backlog": backlog_violations(claims, backlog).select("id", F.col("backlog_row_id").alias("detail")),
        "evidence": listed(evidence_violations(evidence, claims)),
        "ceiling": ceiling_differences(claims, declared).select("id", F.col("difference").alias("detail")),
        "duplicate-claim": repeated(claims),
        "duplicate-evidence": repeated(evidence),
    }
    labelled = [df.select(F.lit(part).alias("part"), "id", "detail") for part, df in parts.items()]
    out = labelled[0]
    for df in labelled[1:]:
        out = out.unionByName(df)
    return out


# --- metric floors ---

def floor_failures(reports: DataFrame) -> DataFrame:
    """Failed rules of metric reports: percent against policy and claim ceiling.

    ``reports``: id, policy, ceiling, percent, floor_percent, uncovered (count), owner, reason,
    debt_id, exclusions ARRAY<STRUCT<path,kind,rationale,counts_as_covered,reviewed>>.
    """
    full, ratchet, held = (
        F.col("policy") == p for p in ("100_percent_required", "ratchet_floor", "blocked_or_withheld")
    )
    explained = F.col("owner").isNotNull() & F.col("reason").isNotNull() & F.col("debt_id").isNotNull()
    rules = {
        "policy": full | ratchet | held,
        "percent": F.col("percent").isNotNull() & F.col("floor_percent").isNotNull(),
        "complete": ~full | (
            (F.col("percent") == 100.0) & (F.col("ceiling") == "supports_complete_claim")
            & (F.col("uncovered") == 0)
        ),
        "ratchet": ~ratchet | ((F.col("ceiling") == "ratchet_floor_only") & explained),
        "withheld": ~held | ((F.col("ceiling") == "withheld_or_blocked") & explained),
        "exclusions": F.forall("exclusions", lambda x: F.coalesce(
            x["path"].isNotNull() & x["kind"].isNotNull() & x["rationale"].isNotNull()
            & ~x["counts_as_covered"] & x["reviewed"], F.lit(False))),
    }
    return reports.withColumn("failures", checks.failing(rules))


def below_full(report_files: DataFrame) -> DataFrame:
    """Entries of flattened metric reports that are not at 100 percent."""
    return report_files.where(F.col("percent").isNotNull() & (F.col("percent") != 100.0))
