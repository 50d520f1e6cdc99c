"""Artifact inventories: bytes, lines, digests, leak scan, verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spanalign import fixed
from spanalign.fixed import EXPECTED_OPAQUE, EXPECTED_PATH, OVER_BUDGET, REQUIRED_DIGESTS, UNRESOLVED
from spanalign.functions import checks, sensitive, text as tx
from spanalign.operators.prefix import row_block, running
from spanalign.session import written

FOLD_ROWS = 1_000


def line_count(text: Column) -> Column:
    """Newlines, plus one for a last line without newline; 0 when empty."""
    breaks = F.regexp_count(text, F.lit("\n"))
    open_end = (~text.endswith("\n")) & (F.length(text) > 0)
    return (breaks + open_end.cast("int")).cast("bigint")


def file_stats(files: DataFrame) -> DataFrame:
    """``content BINARY`` to bytes, line count and fingerprint."""
    decoded = F.decode("content", "ISO-8859-1")
    return files.withColumns({
        "bytes": F.octet_length("content").cast("bigint"),
        "line_count": line_count(decoded),
        "fingerprint": checks.sha256(F.col("content")),
    })


def union_inventories(parts: dict[str, DataFrame]) -> DataFrame:
    """Recording, raw and generated inventories as one table with their policy."""
    labelled = [df.withColumn("policy", F.lit(policy)) for policy, df in parts.items()]
    out = labelled[0]
    for df in labelled[1:]:
        out = out.unionByName(df)
    return out


def _folded_budget(items: DataFrame, total: int) -> DataFrame:
    """Budget of sessions with few files: a fold over their (seq, bytes) list."""
    listed = items.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "bytes"))).alias("files")
    )
    start = F.struct(
        F.lit(total).cast("bigint").alias("left"), F.array().cast("array<bigint>").alias("taken")
    )

    def step(state: Column, item: Column) -> Column:
        fits = item["bytes"] <= state["left"]
        return F.struct(
            F.when(fits, state["left"] - item["bytes"]).otherwise(state["left"]).alias("left"),
            F.when(fits, F.array_append(state["taken"], item["seq"])).otherwise(state["taken"])
            .alias("taken"),
        )

    return listed.select(
        "session_id", F.explode(F.aggregate("files", start, step)["taken"]).alias("seq")
    )


def scan_budget(
    artifacts: DataFrame,
    total: int = fixed.SCAN_MAX_BYTES_PER_SESSION,
    per_file: int = fixed.SCAN_MAX_BYTES_PER_FILE,
    fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """Which artifacts of a session fit into its byte budget, in order, skipping what is too big.

    An item is taken when it fits into what is left; a skipped item uses nothing, so this is not a
    running sum.  Sessions of up to ``fold_rows`` files are folded in one row.  Longer ones are never
    gathered: while ``r`` bytes are left, items above ``r / 2`` are *big*; at most one of them can be taken before less than half is left, and
    all smaller items are taken until then.  So one pass over running sums settles everything up to
    the point where the remainder halves, and about log2(budget) passes settle the rest.
    ``artifacts`` holds ``session_id, seq, bytes``; adds ``scanned``.
    """
    todo = artifacts.select("session_id", "seq", "bytes").where(
        (F.col("bytes") > 0) & (F.col("bytes") <= min(per_file, total))
    )
    sizes = written(todo.groupBy("session_id").agg(
        F.sum("bytes").alias("all_bytes"), F.count("*").alias("n")
    ), "sizes")
    # a session whose files all fit together needs no order at all
    roomy = sizes.where(F.col("all_bytes") <= total)
    short = sizes.where((F.col("all_bytes") > total) & (F.col("n") <= fold_rows))
    long = sizes.where((F.col("all_bytes") > total) & (F.col("n") > fold_rows))
    taken = [
        todo.join(roomy, "session_id", "left_semi").select("session_id", "seq"),
        _folded_budget(todo.join(short, "session_id", "left_semi"), total),
    ]
    tight = todo.join(long, "session_id", "left_semi").select(
        "session_id", "seq", "bytes", F.lit(total).cast("bigint").alias("left")
    )
    open_sessions = not long.isEmpty()
    while open_sessions:
        small = F.col("bytes") * 2 <= F.col("left")
        summed = running(
            tight, ["session_id"], row_block("seq"), ["seq"],
            sums={"used": F.when(small, F.col("bytes")).otherwise(0)},
        )
        room = F.col("left") - F.col("used")
        # the phase ends with the first big item that fits, or where the smalls use up half
        big_hit = ~small & (F.col("bytes") <= room)
        half_gone = small & ((room - F.col("bytes")) * 2 < F.col("left"))
        ends = summed.where(big_hit | half_gone).groupBy("session_id").agg(
            F.min("seq").alias("end_seq"),
            F.min_by(room - F.col("bytes"), "seq").alias("next_left"),
        )
        phase = summed.join(ends, "session_id", "left")
        inside = F.col("end_seq").isNull() | (F.col("seq") <= F.col("end_seq"))
        accepted = phase.where(inside & (small | big_hit))
        taken.append(accepted.select("session_id", "seq"))
        tight = written(phase.where(
            (F.col("seq") > F.col("end_seq")) & (F.col("bytes") <= F.col("next_left"))
        ).select("session_id", "seq", "bytes", F.col("next_left").alias("left")), "budget")
        open_sessions = not tight.isEmpty()
    chosen = taken[0]
    for part in taken[1:]:
        chosen = chosen.unionByName(part)
    empty = artifacts.where(F.col("bytes") == 0).select("session_id", "seq")
    marks = chosen.unionByName(empty).withColumn("scanned", F.lit(True))
    return artifacts.join(marks, ["session_id", "seq"], "left").withColumn(
        "scanned", F.coalesce("scanned", F.lit(False))
    )


def private_paths(text: Column) -> Column:
    """Distinct private paths named in a text, without outer punctuation."""
    words = F.filter(tx.extract_all(text, sensitive.PATH_TOKEN), sensitive.is_private_path)
    return F.array_distinct(F.transform(words, sensitive.private_path_core))


def unexpected_paths(artifacts: DataFrame, approved: DataFrame) -> DataFrame:
    """(session_id, seq): artifacts that name a private path outside their session folder and
    outside the approved paths of the session (``approved``: session_id, path)."""
    named = artifacts.select(
        "session_id", "seq", "session_dir", F.explode(private_paths(F.col("text"))).alias("path")
    )
    folder = F.rtrim(F.col("session_dir"), F.lit("/"))
    inside = (F.col("path") == folder) | F.col("path").startswith(F.concat(folder, F.lit("/")))
    climbs = F.col("path").rlike(r"(?:\A|/)\.\.(?:/|\z)")
    outside = named.where(~F.coalesce(inside, F.lit(False)) | climbs)
    clean = approved.select("session_id", "path").where(~climbs).distinct()
    return outside.join(clean, ["session_id", "path"], "left_anti").select(
        "session_id", "seq"
    ).distinct()


def classified(artifacts: DataFrame) -> DataFrame:
    """Adds ``text_categories`` of the scanned artifacts, for reviews that need them more than once."""
    return artifacts.withColumn(
        "text_categories", F.when(F.col("scanned"), sensitive.sensitive_categories(F.col("text"))))


def _text_categories(artifacts: DataFrame) -> Column:
    if "text_categories" in artifacts.columns:
        return F.col("text_categories")
    return sensitive.sensitive_categories(F.col("text"))


def leak_findings(artifacts: DataFrame, approved: DataFrame) -> DataFrame:
    """Artifacts with sensitive content (or not scanned for size) and whether they block sharing.

    ``artifacts``: session_id, seq, name, session_dir, text, bytes, scanned (and what `classified` adds).  An opaque token never
    blocks, a private path blocks unless all paths of the artifact are expected, the rest blocks.
    """
    bad_paths = unexpected_paths(artifacts.where("scanned"), approved).withColumn(
        "unexpected", F.lit(True)
    )
    # the generator keeps the classifier at one place of the plan: nothing after it repeats it
    found = artifacts.withColumn("categories", F.explode(F.array(
        F.when(F.col("scanned"), _text_categories(artifacts))
        .otherwise(F.array(F.lit("unsafe-artifact-content")))
    )))
    # a path may hide behind another category of the same word, so it is looked for on its own
    hidden = F.col("scanned") & (F.size(private_paths(F.col("text"))) > 0) & ~F.array_contains(
        "categories", "private-path"
    )
    found = found.withColumn("categories", F.when(
        hidden, F.array_append("categories", F.lit("private-path"))
    ).otherwise(F.col("categories"))).where(F.size("categories") > 0)
    joined = found.join(bad_paths, ["session_id", "seq"], "left")
    names_path = F.array_contains("categories", "private-path")
    expected = names_path & F.col("unexpected").isNull()
    blocks = F.exists("categories", lambda c: (c != "opaque-token") & (c != "private-path")) | (
        names_path & ~expected
    )
    return joined.select(
        "session_id", "seq", "name", "categories",
        F.when(~F.col("scanned"), OVER_BUDGET).when(blocks, UNRESOLVED)
        .when(expected, EXPECTED_PATH).otherwise(EXPECTED_OPAQUE).alias("disposition"),
        blocks.alias("blocks_share"),
    )


def leak_status(findings: DataFrame, sessions: DataFrame) -> DataFrame:
    """Scan status, finding counts and blocking counts per session (a missing flag blocks)."""
    counted = findings.groupBy("session_id").agg(
        F.count("*").alias("findings"),
        F.count_if(F.coalesce("blocks_share", F.lit(True))).alias("blocking"),
    )
    zero = F.lit(0)
    return sessions.select("session_id").distinct().join(counted, "session_id", "left").select(
        "session_id", F.coalesce("findings", zero).alias("findings"),
        F.coalesce("blocking", zero).alias("blocking"),
        F.when(F.col("blocking") > 0, "blocked")
        .when(F.col("findings") > 0, "expected-local-references-only")
        .otherwise("no-obvious-sensitive-patterns-detected").alias("status"),
    )


def session_categories(findings: DataFrame) -> DataFrame:
    """Distinct categories per session in order of first appearance.

    Exploded and reduced per category before anything is gathered: at most one entry per category.
    """
    first = findings.select(
        "session_id", "seq", F.posexplode("categories").alias("pos", "category")
    ).groupBy("session_id", "category").agg(F.min(F.struct("seq", "pos")).alias("at"))
    return first.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "category"))).alias("entries")
    ).select("session_id", F.transform("entries", lambda e: e["category"]).alias("categories"))


def raw_sensitivity(artifacts: DataFrame) -> DataFrame:
    """Sizes, digests and categories of raw artifacts; no text is carried along."""
    text = F.col("text")
    categories = (
        F.when(F.col("name") == "retained-audio", F.array(F.lit("raw-audio")))
        .when(~F.col("scanned"), F.array(F.lit(OVER_BUDGET)))
        .otherwise(_text_categories(artifacts))
    )
    return artifacts.select(
        "session_id", "seq", "name", "bytes", line_count(text).alias("line_count"),
        checks.sha256(text).alias("fingerprint"), categories.alias("categories"),
    ).withColumn("sensitive", F.size("categories") > 0)


def missing_digests(
    inventory: DataFrame, sessions: DataFrame, required: Sequence[str] = REQUIRED_DIGESTS
) -> DataFrame:
    """(session_id, name) of required artifacts without a present, regular, well-formed entry."""
    # sessions x a fixed list of eleven names: an explode of a literal, not a join
    wanted = sessions.select("session_id").distinct().select(
        "session_id", F.explode(F.array(*[F.lit(n) for n in required])).alias("name")
    )
    good = inventory.where(
        F.col("exists") & F.col("is_regular") & F.coalesce(
            F.col("fingerprint").startswith("sha256:") & (F.length("fingerprint") == 71),
            F.lit(False),
        )
    ).select("session_id", "name").distinct()
    return wanted.join(good, ["session_id", "name"], "left_anti")


def snapshot_fingerprint(files: DataFrame) -> DataFrame:
    """One digest per file set, independent of row order and computable in two levels.

    A file's leaf is the digest of ``path`` and ``fingerprint``.  Leaves are grouped by their first
    three hex digits; each group hashes its sorted leaves, and the set hashes its groups in order.
    Groups keep a very large set from being gathered into one cell.
    """
    leaf = F.sha2(F.concat_ws("\n", F.col("path"), F.col("fingerprint")), 256)
    groups = files.select("session_id", leaf.alias("leaf")).groupBy(
        "session_id", F.substring("leaf", 1, 3).alias("prefix")
    ).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("leaf")), ""), 256).alias("group_digest"),
        F.count("*").alias("n"),
    )
    return groups.groupBy("session_id").agg(
        F.sum("n").alias("files"),
        checks.sha256(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("prefix", "group_digest"))),
            lambda g: F.concat(g["prefix"], g["group_digest"]),
        ), "")).alias("snapshot"),
    )


#: Leaves of one node of the tree below, about; a node above has at most sixteen children.
TREE_CELL = 256
TREE_LEVELS = 13


def tree_fingerprint(files: DataFrame, cell: int = TREE_CELL) -> DataFrame:
    """One digest per file set from a tree with as many levels as the set needs.

    ``files``: session_id, path, fingerprint, in any order.  A file's leaf is the digest of ``path`` and
    ``fingerprint`` (NULL as empty); equal leaves are one leaf with a count.  A set of n different leaves is
    cut ``depth`` times by the next hex digit, the fewest times for which n <= cell * 16 ** depth, so no
    cell grows with the set.  A lowest node hashes its sorted leaves, a higher one its children's digits
    and digests.  An empty table has no sets.
    """
    leaf = F.sha2(F.concat_ws("\n", F.coalesce("path", F.lit("")), F.coalesce("fingerprint", F.lit(""))), 256)
    counted = written(files.select("session_id", leaf.alias("leaf")).groupBy("session_id", "leaf").agg(
        F.count("*").alias("n")), "leaves")
    depth = sum((F.when(F.count("*") > cell * 16**k, 1).otherwise(0) for k in range(TREE_LEVELS)), F.lit(0))
    sets = counted.groupBy("session_id").agg(F.sum("n").alias("files"), depth.cast("bigint").alias("depth"))
    sets = written(sets, "sets")
    digits = lambda c, k: F.substring(c, 1, k).alias("digits")
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256).alias("digest")
    nodes = None
    for level in range(sets.agg(F.max("depth")).first()[0] or 0, -1, -1):
        here = sets.where(F.col("depth") == level).select("session_id")
        lowest = counted.join(here, counted["session_id"].eqNullSafe(here["session_id"]), "left_semi").groupBy("session_id", digits("leaf", level)).agg(
            joined(F.concat_ws(":", "leaf", F.col("n").cast("string"))))
        if nodes is not None:
            lowest = lowest.unionByName(nodes.groupBy("session_id", digits("digits", level)).agg(
                joined(F.concat_ws(":", "digits", "digest"))))
        nodes = lowest
    return sets.join(nodes, sets["session_id"].eqNullSafe(nodes["session_id"])).select(
        sets["session_id"], "files", "depth", F.concat(F.lit("sha256:"), F.col("digest")).alias("fingerprint"))


def lint_jsonl(lines: DataFrame) -> DataFrame:
    """Bad rows of JSONL text (session_id, seq, value): over-long or not JSON; blanks are fine."""
    value = F.col("value")
    reason = F.when(
        F.octet_length(value) > fixed.JSONL_MAX_ROW_BYTES, "row-byte-limit"
    ).when(~tx.is_blank(value) & F.try_parse_json(value).isNull(), "malformed-json")
    return lines.select("session_id", "seq", reason.alias("reason")).where("reason is not null")


def jsonl_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("session_id").agg(F.count("*").alias("rows")).withColumn(
        "over_row_limit", F.col("rows") > fixed.JSONL_MAX_ROWS
    )


def external_artifact(provided: Column, exists: Column, size: Column) -> dict[str, Column]:
    """Viability flags of one artifact a session may have been given."""
    present = F.coalesce(exists, F.lit(False))
    non_empty = present & (F.coalesce(size, F.lit(0)) > 0)
    return {
        "provided": provided, "exists": present, "non_empty": non_empty,
        "usable": provided & non_empty,
    }


def audio_chunk_spans(chunks: DataFrame) -> DataFrame:
    """Byte and sample spans of consecutive audio chunks (session_id, idx, bytes, ...)."""
    placed = running(
        chunks, ["session_id"], None, ["idx"], sums={"byte_start": F.col("bytes")}
    )
    end = F.col("byte_start") + F.col("bytes")
    half = lambda c: F.call_function("div", c, F.lit(fixed.BYTES_PER_SAMPLE))
    return placed.select(
        "session_id", "idx", F.col("byte_start").cast("bigint").alias("byte_start"),
        end.cast("bigint").alias("byte_end"), half(F.col("byte_start")).alias("sample_start"),
        half(end).alias("sample_end"), "monotonic_offset_ms",
    )


def merge_chunk_texts(
    chunks: DataFrame, max_bytes: int = fixed.MAX_ALIGNMENT_TEXT_BYTES_PER_SIDE
) -> DataFrame:
    """Texts of a session's chunks joined by newline in order, with their count.

    The merged text is one cell, whatever its length; ``oversize`` flags those above ``max_bytes``.
    """
    size = F.sum(F.octet_length("text")) + F.count("*")
    return chunks.groupBy("session_id").agg(
        F.count("*").alias("chunks"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda c: c["text"]
        ), "\n").alias("text"),
        (size > max_bytes).alias("oversize"),
    )
