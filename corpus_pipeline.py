"""Training-data pipeline: toxicity, near duplicates, repeated passages, source mix, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps, with the columns of
``documents``; the last one returns the packed pieces.  Stages are joined by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanalign.llm import best_fit_packing, mixing, ngram_jaccard, substring_dedup, toxicity
from spanalign.llm.queries import tokenizer_path
from spanalign.session import written

#: Part of the tokens that the source mix keeps.
MIXED_FRACTION = 0.9


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not call toxic."""
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    return ngram_jaccard.one_of_each_group(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without sentences of repeated runs; ``n_chars`` follows the text."""
    found = substring_dedup.without_repeats(docs)
    if "n_chars" in docs.columns:
        cut = F.col("__removed").isNotNull() & (F.size("__removed") > 0)
        found = found.withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled towards the target weights of sources, languages and topics."""
    return mixing.sample(docs, MIXED_FRACTION)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    parts = best_fit_packing.pieces(docs, tokenizer_path("word_bpe_49k.json"), with_ids=False)
    return best_fit_packing.pack(parts)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("repeated_passages", without_repeated_passages),
    ("source_mix", mixed_sources),
    ("packing", packed),
]
#: A trained classifier and packing have no SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
