"""Cleaned text to utterances: marker spans, sentence spans, or fixed spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanalign.functions import text as tx
from spanalign.operators.prefix import row_block, running
from spanalign.session import written


def _marker_start() -> str:
    return rf"\A{tx.marker_pattern()}"


def utterance_pieces(text: Column) -> Column:
    """Array of pieces covering the text in order: marker pieces when there are two markers or
    more, else sentences, else (one sentence) runs of twenty words."""
    sentences = tx.sentence_spans(text)
    return (
        F.when(F.size(tx.marker_labels(text)) >= 2, F.transform(tx.marker_pieces(text), tx.squeeze))
        .when(F.size(sentences) >= 2, sentences)
        .otherwise(tx.fixed_spans(text))
    )


def _placed_pieces(cleaned: DataFrame) -> DataFrame:
    """``session_id, by_marker, pos, text``: the pieces of each text in order."""
    text = F.col("cleaned_text")
    # one explode for what holds for the whole text: beside the pieces it would be worked out again for each of them
    whole = cleaned.select("session_id", F.explode(F.array(F.struct(
        (F.size(tx.marker_labels(text)) >= 2).alias("by_marker"), utterance_pieces(text).alias("pieces"),
    ))).alias("whole"))
    return whole.select("session_id", "whole.by_marker", F.posexplode("whole.pieces").alias("pos", "text"))


def utterances(cleaned: DataFrame) -> DataFrame:
    """One row per utterance with its label and its half-open range of cleaned tokens.

    ``cleaned`` holds ``session_id, cleaned_text``.  Token offsets are counts of normalized tokens
    in every case, also for fixed spans.
    """
    rows = written(_placed_pieces(cleaned), "pieces")  # read by both running values, for rows and for totals
    tokens = tx.token_count(F.col("text"))
    placed = running(rows, ["session_id"], row_block("pos"), ["pos"], sums={"token_start": tokens})
    # text before the first marker counts for the offsets but is no utterance of its own
    kept = placed.where(
        (F.col("text") != "") & (~F.col("by_marker") | F.col("text").rlike(_marker_start()))
    )
    numbered = running(
        kept, ["session_id"], row_block("pos"), ["pos"], sums={"earlier": F.lit(1)}
    )
    labels = tx.marker_labels(F.col("text"))
    return numbered.select(
        "session_id",
        (F.col("earlier") + 1).cast("bigint").alias("utterance_id"),
        F.when(F.size(labels) > 0, F.element_at(labels, 1)).alias("marker_label"),
        "text",
        F.col("token_start").cast("bigint").alias("token_start"),
        (F.col("token_start") + tokens).cast("bigint").alias("token_end"),
    )
