"""Words of a cleaned text dealt to the segments of its session in order.

How many words a segment takes depends on where the segment before it ended, so the rule is a chain.  It is
cut into blocks of segments; a block is a function from its first word to the word behind its last one.  All
blocks are walked at once from expected first words; then each block's first word is the end of the block
before it, and only blocks for which that changed are walked again, until none is.  A block of which the
first word was right stays right, so the result is that of the whole chain.  A task holds one block, and of
the words only those the block can take.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from spanalign import fixed
from spanalign.functions import text as tx
from spanalign.functions.similarity import EDIT_LIMIT, LONG_TOKEN
from spanalign.operators.cleanup import within_edits
from spanalign.operators.prefix import row_block, running
from spanalign.session import written

#: Segments of a block, words of a block of words.
SEGMENTS, WORDS = 1 << 14, 1024
_HEARD = {a: tuple(right for left, right in fixed.CANONICAL_PAIRS if left == a) for a, _ in fixed.CANONICAL_PAIRS}


def _letters(token: str) -> int:
    """The letters of a token as bits; an edit changes two of them at most."""
    bits = 0
    for letter in token:
        bits |= 1 << (ord(letter) & 63)
    return bits


def best_take(spoken: Sequence[str], words: Sequence[Sequence[str]], expected: int) -> int:
    """How many of ``words`` (their tokens) resemble the spoken tokens best; of equals the number closest to
    ``expected``, the smaller one first.  More words never resemble less, except those of a silent segment."""
    most = len(words)
    if not spoken:
        silent = next((k for k, own in enumerate(words) if own), most)
        return min(expected, silent or most)
    first: dict[str, int] = {}
    for k, own in enumerate(words):
        for token in own:
            first.setdefault(token, k)
    longs = [(k, other, _letters(other)) for other, k in first.items() if len(other) > LONG_TOKEN]  # k ascends
    needed = 1
    listed = {token: min(first.get(other, most) for other in (token, *_HEARD.get(token, ()))) for token in spoken}
    # from the back, tokens that no word equals last: a token found among the needed words needs no more of them
    for token, at in sorted(listed.items(), key=lambda t: -t[1] if t[1] < most else 1):
        if at >= needed and len(token) > LONG_TOKEN:
            own, size = _letters(token), len(token)
            for k, other, letters in longs:
                if k >= at:
                    break
                if abs(len(other) - size) <= EDIT_LIMIT and (own ^ letters).bit_count() <= 2 * EDIT_LIMIT and within_edits(token, other, EDIT_LIMIT):
                    at = k
                    break
        if at < most:
            needed = max(needed, at + 1)
    return min(max(expected, needed), most)


def walk(segments: Sequence[dict], words: Sequence[str], tokens: Sequence[Sequence[str]], start: int, n_words: int, n_segments: int):
    """Texts of a block's segments, and the word behind the last one; ``words`` begin with word ``start``."""
    cursor, texts = start, []
    for seg in segments:
        left, later = n_words - cursor, n_segments - seg["segment_id"]
        low = cursor - start
        if left <= 0:
            take = 0
        elif later <= 0:
            take = left
        elif left <= later:
            take = 1
        else:
            most = max(min(left - later, 2 * seg["expected"] + 8), 1)
            take = best_take(seg["tokens"], tokens[low:low + most], seg["expected"])
        texts.append(" ".join(words[low:low + take]))
        cursor += take
    return texts, cursor


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            begun = r.start % WORDS
            parts = sorted(r.parts, key=lambda p: p["part"]) if r.parts is not None else []
            words = [w for p in parts for w in p["words"]][begun:]
            tokens = [list(t) for p in parts for t in p["tokens"]][begun:]
            segs = [{**s, "tokens": list(s["tokens"])} for s in r.segs]
            texts, end = walk(segs, words, tokens, r.start, r.n_words, r.n_segments)
            out.append((r.session_id, r.block, r.start, end, texts))
        yield pd.DataFrame(out, columns=["session_id", "block", "start", "end", "texts"])


def allocate(segments: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (``session_id, segment_id, text``) of the segments that can get words, and ``session_id, end``, the
    number of words that were dealt.

    ``segments`` holds ``session_id, segment_id`` (1, 2, ...), ``tokens`` and ``words`` (their number);
    ``words`` holds ``session_id, cleaned_words``.
    """
    totals = segments.groupBy("session_id").agg(F.sum("words").alias("total"), F.count("*").alias("n_segments"))
    sizes = words.select("session_id", F.size("cleaned_words").cast("bigint").alias("n_words"))
    facts = totals.join(sizes, "session_id")
    total = F.greatest("total", F.lit(1))
    rounded = F.col("n_words") * F.greatest("words", F.lit(1)) + F.call_function("div", total, F.lit(2).cast("bigint"))
    expected = F.greatest(F.call_function("div", rounded, total), F.lit(1))
    # every segment takes one word at least while there are any, so those behind the last word get none
    heads = segments.join(facts, "session_id").where(F.col("segment_id") <= F.greatest("n_words", F.lit(1)))
    heads = heads.withColumn("expected", expected).withColumn("block", F.call_function("div", F.col("segment_id") - 1, F.lit(SEGMENTS).cast("bigint")))
    blocks = heads.groupBy("session_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("segment_id", "tokens", "expected"))).alias("segs"),
        F.sum("expected").alias("expected"), F.sum(2 * F.col("expected") + 8).alias("most"), F.max("segment_id").alias("last"),
        F.first("n_words").alias("n_words"), F.first("n_segments").alias("n_segments"),
    )
    guessed = running(blocks, ["session_id"], row_block("block"), ["block"], sums={"start": F.col("expected")})
    guessed = written(guessed.withColumn("start", F.least("start", "n_words")), "blocks")
    pieces = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size("cleaned_words"), F.lit(WORDS)).cast("int")), lambda k: F.slice("cleaned_words", k * WORDS + 1, WORDS))
    parts = words.select("session_id", F.posexplode(pieces).alias("part", "words"))
    parts = written(parts.withColumn("tokens", F.transform("words", tx.tokens_ascii)), "words")

    def walked(rows: DataFrame) -> DataFrame:
        # the last segment takes all that is left
        upto = F.when(F.col("last") == F.col("n_segments"), F.col("n_words")).otherwise(F.least(F.col("n_words"), F.col("start") + F.col("most")))
        first, end = (F.call_function("div", c, F.lit(WORDS).cast("bigint")).cast("int") for c in (F.col("start"), upto))
        wanted = rows.select("session_id", "block", F.explode(F.sequence(first, F.greatest(first, end))).alias("part"))
        held = wanted.join(parts, ["session_id", "part"]).groupBy("session_id", "block").agg(
            F.collect_list(F.struct("part", "words", "tokens")).alias("parts"))
        joined = rows.join(held, ["session_id", "block"], "left").select("session_id", "block", "start", "n_words", "n_segments", "segs", "parts")
        kind = rows.schema["session_id"].dataType.simpleString()
        return written(joined.mapInPandas(_walked, f"session_id {kind}, block bigint, start bigint, end bigint, texts array<string>"), "walked")

    found, rows = None, guessed
    while True:
        new = walked(rows)
        found = new if found is None else written(found.join(new, ["session_id", "block"], "left_anti").unionByName(new), "found")
        ends = running(found.select("session_id", "block", "start", "end"), ["session_id"], row_block("block"), ["block"], lags={"right": F.col("end")})
        wrong = ends.where("right is not null and right <> start").select("session_id", "block", F.col("right").alias("start"))
        rows = guessed.drop("start").join(wrong, ["session_id", "block"])
        if rows.isEmpty():
            break
    texts = found.select("session_id", "block", F.posexplode("texts").alias("at", "text")).select(
        "session_id", (F.col("block") * SEGMENTS + F.col("at") + 1).alias("segment_id"), "text")
    return texts, found.groupBy("session_id").agg(F.max_by("end", "block").alias("end"))
