"""Cutting two long token sequences of one session at unambiguous anchors.

A run of ``ANCHOR`` tokens that occurs once on either side is an anchor, a pair of places.  Anchors meet in an
equi-join on the run's hash.  At most one per ``SPACING`` left tokens is kept, the longest chain of these that
runs forwards on both sides is chosen, and both sequences are cut at its places.  The stretches between are
rows of their own, so the match of a session is many small programs instead of one large one.

The chain of a session is found in one row: the left side is one text cell, so it has at most some 10^9
tokens, and its thinned anchors some millions of number pairs.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from spanalign.operators.prefix import row_block, running

ANCHOR, SPACING = 4, 256


def _grams(tokens: Column, size: int) -> Column:
    """Hash of the run of ``size`` tokens from each place of an array on."""
    return F.transform(F.sequence(F.lit(0), F.size(tokens) - size), lambda k: F.xxhash64(F.slice(tokens, k + 1, size)))


def longest_chain(left: list[int], right: list[int]) -> list[int]:
    """Indices of a longest chain that rises on both sides; ``left`` is ascending and has no value twice."""
    tails, ends, before = [], [], []  # last values and indices of the best chain of each length
    for k, value in enumerate(right):
        at = bisect.bisect_left(tails, value)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(value)
            ends.append(k)
        else:
            tails[at], ends[at] = value, k
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(k)
        k = before[k]
    return chain[::-1]


def _chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for session, pairs in zip(batch["session_id"], batch["anchors"]):
            left, right = [p["i"] for p in pairs], [p["j"] for p in pairs]
            kept = longest_chain(left, right)
            yield pd.DataFrame({"session_id": [session], "left_cuts": [[left[k] for k in kept]], "right_cuts": [[right[k] for k in kept]]})


def cuts(left: DataFrame, right: DataFrame, size: int = ANCHOR, spacing: int = SPACING) -> DataFrame:
    """``session_id, left_cuts, right_cuts``: equally many ascending places on both sides of sessions with anchors.

    ``left`` holds ``session_id, tokens``; ``right`` holds ``session_id, base, tokens``, its pieces in any order,
    ``base`` being the place of a piece's first token.  Right runs do not cross pieces.
    """
    def once(pieces: DataFrame, base: Column, name: str) -> DataFrame:
        long = pieces.where(F.size("tokens") >= size)
        rows = long.select("session_id", base.alias("base"), F.posexplode(_grams(F.col("tokens"), size)).alias("at", "gram"))
        return rows.groupBy("session_id", "gram").agg(F.count("*").alias("n"), F.min(F.col("base") + F.col("at")).alias(name)).where("n = 1").drop("n")

    met = once(left, F.lit(0).cast("bigint"), "i").join(once(right, F.col("base"), "j"), ["session_id", "gram"])
    thin = met.groupBy("session_id", F.floor(F.col("i") / spacing).alias("part")).agg(F.min(F.struct("i", "j")).alias("anchor"))
    gathered = thin.groupBy("session_id").agg(F.array_sort(F.collect_list("anchor")).alias("anchors"))
    kind = left.schema["session_id"].dataType.simpleString()
    return gathered.mapInPandas(_chains, f"session_id {kind}, left_cuts array<bigint>, right_cuts array<bigint>")


def left_stretches(left: DataFrame, cut: DataFrame) -> DataFrame:
    """``session_id, stretch, base, tokens``: the left tokens between two cuts and the place of the first."""
    whole = left.join(cut, "session_id", "left")
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.coalesce("left_cuts", F.array().cast("array<bigint>")))
    rows = whole.select("session_id", "tokens", F.concat(starts, F.array(F.size("tokens").cast("bigint"))).alias("edges"))
    piece = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda k: F.struct(
        F.element_at("edges", k).alias("base"),
        F.slice("tokens", (F.element_at("edges", k) + 1).cast("int"), (F.element_at("edges", k + 1) - F.element_at("edges", k)).cast("int")).alias("tokens")))
    return rows.select("session_id", F.posexplode(piece).alias("stretch", "piece")).select("session_id", "stretch", "piece.base", "piece.tokens")


def right_stretches(right: DataFrame, cut: DataFrame, carried: str) -> DataFrame:
    """``session_id, stretch, tokens, <carried>``: the right tokens between two cuts in order, each with the value
    ``carried`` of its piece."""
    tokens = right.select("session_id", carried, "base", F.posexplode("tokens").alias("at", "token")).select(
        "session_id", (F.col("base") + F.col("at")).alias("place"), F.lit(1).alias("side"), "token", carried, F.lit(None).cast("int").alias("begun"))
    kind = right.schema[carried].dataType
    begins = cut.select("session_id", F.posexplode("right_cuts").alias("k", "place")).select(
        "session_id", "place", F.lit(0).alias("side"), F.lit(None).cast("string").alias("token"), F.lit(None).cast(kind).alias(carried),
        (F.col("k") + 1).cast("int").alias("begun"))
    lined = running(tokens.unionByName(begins), ["session_id"], row_block("place"), ["place", "side"], maxes={"stretch": F.col("begun")})
    placed = lined.where("side = 1").withColumn("stretch", F.coalesce("stretch", F.lit(0)))
    rows = placed.groupBy("session_id", "stretch").agg(F.array_sort(F.collect_list(F.struct("place", "token", carried))).alias("t"))
    return rows.select("session_id", "stretch", F.col("t.token").alias("tokens"), F.col(f"t.{carried}").alias(carried))
