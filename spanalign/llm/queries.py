"""Registered queries of the training-data operators and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanalign.llm import best_fit_packing as packing
from spanalign.llm import centroids
from spanalign.llm import conversation_repair as conversations
from spanalign.llm import lm_scoring as lm
from spanalign.llm import mixing
from spanalign.llm import nearest_vectors as vectors
from spanalign.llm import ngram_jaccard as jaccard
from spanalign.llm import quality_rules as quality
from spanalign.llm import sentence_pieces as pieces
from spanalign.llm import substring_dedup as substrings
from spanalign.llm import suffix_dedup as suffixes
from spanalign.llm import token_counts as tokens
from spanalign.llm import toxicity as toxic


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without sentences in repeated runs of sentences."""
    found = substrings.substring_dedup(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.size("removed").alias("n_removed"), "removed", "text")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    parts = packing.pieces(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False)
    return packing.pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: five words, a similarity of 0.75 or more."""
    return jaccard.similar_groups(_read(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its raked weight and whether it is in a sample of half the tokens."""
    found = mixing.mixed(_read(spark, sf_dir, "documents"), fraction=0.5)
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "sampled")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxic.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, before and after three edits."""
    import public_tokenizers

    documents = _read(spark, sf_dir, "documents").select("doc_id", "text", tokens.drafted_edits().alias("edits"))
    found = tokens.edited_counts(documents, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", *tokens.RESULTS)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and hashed n-gram log-likelihood ratio of every document."""
    return quality.quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth one."""
    return vectors.nearest(_read(spark, sf_dir, "embeddings"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document under the trigram model of all documents."""
    found = lm.lm_scores(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("score", 6).alias("score"), F.round("mean_score", 6).alias("mean_score"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without bytes of 100-byte strings that start earlier."""
    found = suffixes.suffix_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after the stated damage."""
    found = conversations.repair(_read(spark, sf_dir, "conversations"))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty clusters of all vectors after five rounds."""
    return centroids.clustered(_read(spark, sf_dir, "embeddings"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded."""
    found = pieces.encoded(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_source_mixing": op4_source_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_quality_rules": op7_quality_rules,
    "op8_nearest_vectors": op8_nearest_vectors,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_sentence_pieces": op13_sentence_pieces,
}

# doc_id is a key in the given tables
_LM = """
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), x AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t
), y AS (
  SELECT *, lag(w, 1) OVER p AS p1, lag(w, 2) OVER p AS p2 FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), c1 AS (SELECT w, count(*)::DOUBLE AS n FROM y GROUP BY w),
c2 AS (SELECT p1, w, count(*)::DOUBLE AS n FROM y WHERE p1 IS NOT NULL GROUP BY p1, w),
c3 AS (SELECT p2, p1, w, count(*)::DOUBLE AS n FROM y WHERE p2 IS NOT NULL GROUP BY p2, p1, w),
s AS (
  SELECT y.doc_id, sum(CASE
    WHEN c3.n IS NOT NULL THEN ln(c3.n / ctx.n)
    WHEN c2.n IS NOT NULL THEN ln(c2.n / before.n) + CASE WHEN y.i > 2 THEN ln(0.4) ELSE 0 END
    ELSE ln(c1.n / (SELECT count(*) FROM y)) + least(y.i - 1, 2) * ln(0.4) END) AS score
  FROM y JOIN c1 ON c1.w = y.w LEFT JOIN c1 AS before ON before.w = y.p1
  LEFT JOIN c2 ON c2.p1 = y.p1 AND c2.w = y.w LEFT JOIN c2 AS ctx ON ctx.p1 = y.p2 AND ctx.w = y.p1
  LEFT JOIN c3 ON c3.p2 = y.p2 AND c3.p1 = y.p1 AND c3.w = y.w
  GROUP BY y.doc_id
)
SELECT t.doc_id, len(t.ws)::BIGINT AS n_words, round(coalesce(s.score, 0), 6) AS score,
       round(s.score / nullif(len(t.ws), 0), 6) AS mean_score
FROM t LEFT JOIN s ON s.doc_id = t.doc_id
"""

_GROUPS = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(
    CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
         WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM t)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(t.doc_id, coalesce(m.least, t.doc_id)) AS component_id
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN (SELECT a, min(b) AS least FROM r GROUP BY a) m ON m.a = t.doc_id
"""



def _clusters(centroids: int = 40, rounds: int = 5) -> str:
    nearest = """n{k} AS MATERIALIZED (
  SELECT v.row, v.vec_id, arg_min(c.cluster, (c.distance, c.cluster)) AS cluster, min(c.distance) AS distance FROM (
    SELECT p.row, m.cluster, sum((p.x - m.x) * (p.x - m.x))::BIGINT AS distance FROM p JOIN m{k} AS m USING (d) GROUP BY ALL) c
  JOIN v USING (row) GROUP BY ALL)"""
    moved = """m{n} AS MATERIALIZED (
  SELECT cluster, d, coalesce(x, old) AS x FROM (
    SELECT m.cluster, m.d, any_value(m.x) AS old, floor_div(sum(p.x)::BIGINT, count(p.x)) AS x
    FROM m{k} AS m LEFT JOIN n{k} AS n USING (cluster) LEFT JOIN p ON p.row = n.row AND p.d = m.d GROUP BY ALL))"""
    moved = moved.replace("floor_div(sum(p.x)::BIGINT, count(p.x))",
                          "((sum(p.x)::BIGINT - ((sum(p.x)::BIGINT % count(p.x)) + count(p.x)) % count(p.x)) // nullif(count(p.x), 0))")
    steps = [nearest.format(k=0)]
    for k in range(rounds):
        steps += [moved.format(k=k, n=k + 1), nearest.format(k=k + 1)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), p AS MATERIALIZED (
  SELECT row, generate_subscripts(embedding, 1) AS d, unnest(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS x FROM v
), s AS (
  SELECT row, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster FROM v QUALIFY cluster < {centroids}
), m0 AS MATERIALIZED (SELECT cluster, d, x FROM s JOIN p USING (row)),
{", ".join(steps)},
h AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM m{rounds} GROUP BY cluster)
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM n{rounds} JOIN h USING (cluster)
"""


SQL: dict[str, str] = {
    "op3_ngram_jaccard": _GROUPS,
    "op9_lm_scoring": _LM,
    "op12_centroid_clustering": _clusters(),
}
