"""Fuzzy token join without comparing everything with everything.

Two tokens at most two edits apart share one of the left token's three parts at nearly the same
place (pigeonhole).  The left side therefore emits its three parts, the right side the substrings
that could equal such a part, and an equi join on them yields a complete candidate set, which the
exact edit distance then filters.

Tokens and pieces are many times larger than the files they are cut from, by whose size Spark would choose a
broadcast, so their joins are merge joins by hint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spanalign import fixed
from spanalign.functions.similarity import EDIT_LIMIT, LONG_TOKEN

PARTS = EDIT_LIMIT + 1


def _part_start(length: Column, part: Column) -> Column:
    """0-based start of a part; the last parts take the remainder."""
    base = F.call_function("div", length, F.lit(PARTS))
    short = PARTS - length % PARTS
    return (base * part + F.greatest(part - short, F.lit(0))).cast("int")


def _with_piece(tokens: DataFrame, token: str, length: Column, part: Column, shift: Column) -> DataFrame:
    """Adds ``len``, ``part`` and the piece of ``token`` where that part of an n-letter token lies."""
    start, end = _part_start(length, part), _part_start(length, part + 1)
    return tokens.withColumns({"len": length, "part": part, "at": start + shift, "size": end - start}).where(
        (F.col("len") > LONG_TOKEN) & (F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.length(token))
    ).withColumn("piece", F.substring(token, F.col("at") + 1, F.col("size")))


def _left_pieces(tokens: DataFrame) -> DataFrame:
    parts = F.explode(F.array(*[F.lit(i) for i in range(PARTS)])).alias("p")
    placed = _with_piece(
        tokens.select("*", parts), "left_token", F.length("left_token"), F.col("p"), F.lit(0)
    )
    return placed.drop("p", "at", "size")


def _shifts() -> list[tuple[int, int, int]]:
    """(length difference right - left, part, shift of the part) that can occur.

    If no earlier part matched, each earlier part took an edit of its own, which bounds the shift
    from the left, and the later parts bound it from the right (multi-match-aware selection of
    partition-based similarity joins).  This leaves 19 of the 75 combinations.
    """
    found = []
    for diff in range(-EDIT_LIMIT, EDIT_LIMIT + 1):
        for part in range(PARTS):
            for shift in range(-EDIT_LIMIT, EDIT_LIMIT + 1):
                if abs(shift) <= part and abs(shift - diff) <= EDIT_LIMIT - part:
                    found.append((diff, part, shift))
    return found


def _right_pieces(tokens: DataFrame) -> DataFrame:
    """All (assumed left length, part, substring) the left side could have emitted."""
    options = F.explode(F.array(*[
        F.struct(F.lit(d).alias("diff"), F.lit(p).alias("part"), F.lit(s).alias("shift"))
        for d, p, s in _shifts()
    ])).alias("o")
    placed = _with_piece(
        tokens.select("*", options), "right_token", F.length("right_token") - F.col("o.diff"),
        F.col("o.part"), F.col("o.shift"),
    )
    return placed.drop("o", "at", "size")


def _distinct(tokens: DataFrame, key: str, name: str) -> DataFrame:
    return tokens.select(key, F.col("token").alias(name)).distinct()


def symmetric_pairs(left: DataFrame, right: DataFrame, key: str = "session_id") -> DataFrame:
    """Distinct (key, left_token, right_token) that are equal or spelled alike, which holds in both directions."""
    ls, rs = _distinct(left, key, "left_token"), _distinct(right, key, "right_token")
    equal = ls.join(
        rs.hint("merge"), (ls[key] == rs[key]) & (F.col("left_token") == F.col("right_token")), "left_semi"
    ).select(key, "left_token", F.col("left_token").alias("right_token"))
    emitted = _left_pieces(ls.where(F.length("left_token") > LONG_TOKEN))
    probes = _right_pieces(rs.where(F.length("right_token") > LONG_TOKEN))
    spelled = (
        emitted.join(probes.hint("merge"), [key, "len", "part", "piece"])
        .where(
            (F.col("left_token") != F.col("right_token"))
            & (F.levenshtein("left_token", "right_token", EDIT_LIMIT) >= 0)
        )
        .select(key, "left_token", "right_token")
    )
    return equal.unionByName(spelled.distinct())


def dictionary_pairs(
    left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]] = fixed.CANONICAL_PAIRS, key: str = "session_id",
) -> DataFrame:
    """Distinct (key, left_token, right_token) of a dictionary that is directed from left to right."""
    # a dictionary of fixed, small size (the pairs given by the caller)
    table = left.sparkSession.createDataFrame(list(pairs), "left_token string, right_token string")
    # few tokens are in the dictionary at all, so the others go before they are made distinct
    ls = _distinct(left.where(F.col("token").isin(*{a for a, _ in pairs})), key, "left_token")
    rs = _distinct(right.where(F.col("token").isin(*{b for _, b in pairs})), key, "right_token")
    return ls.join(F.broadcast(table), "left_token").join(rs.hint("merge"), [key, "right_token"]).select(key, "left_token", "right_token").distinct()


def similar_tokens(
    left: DataFrame,
    right: DataFrame,
    pairs: Sequence[tuple[str, str]] = fixed.CANONICAL_PAIRS,
    key: str = "session_id",
) -> DataFrame:
    """Distinct (key, left_token, right_token) that are equal, in the dictionary, or spelled alike.

    ``left`` and ``right`` hold ``key, token``; the dictionary is directed from left to right.
    """
    alike, listed = symmetric_pairs(left, right, key), dictionary_pairs(left, right, pairs, key)
    return alike.unionByName(listed.join(alike.hint("merge"), [key, "left_token", "right_token"], "left_anti"))
