"""The pipeline's stages against plain-Python versions, and the registered queries."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from spanalign.llm import queries, toxicity
from tests.llm import fixtures as X

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = [tuple(r) for r in docs.collect()]
        found = stage(spark, docs, SF)
        if name != "packing":
            assert found.columns == columns
        got = [tuple(r) for r in found.collect()]
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
            assert sorted(got) == sorted(r for r in rows if not scores[r[0]])
        elif name == "near_duplicates":
            groups = X.groups(rows)
            assert sorted(got) == sorted(r for r in rows if groups[r[0]][1] == r[0])
        elif name == "repeated_passages":
            left = X.without_repeated_spans(rows)
            assert sorted(r[:2] for r in got) == sorted((r[0], left[r[0], r[1]][2]) for r in rows)
            assert all(r[4] == len(r[1]) for r in got if left[next(x for x in rows if x[0] == r[0])[:2]][1])
        elif name == "source_mix":
            assert set(got) <= set(rows) and len(got) > 0.7 * len(rows)
        else:
            assert {r[0] for r in got} == {r[0] for r in rows}
        docs = spark.createDataFrame(got, found.schema)
    assert corpus_pipeline.run(spark, SF).count() == len(got)


def test_registered(spark):
    found = entry.queries()
    assert "pipeline" in found and {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_groups_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(queries.SQL["op3_ngram_jaccard"]).fetchall())
    found = queries.QUERIES["op3_ngram_jaccard"](spark, SF)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == want


def test_lm_scores_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(queries.SQL["op9_lm_scoring"]).fetchall()}
    got = {r.doc_id: (r.n_words, r.score, r.mean_score) for r in queries.QUERIES["op9_lm_scoring"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(g[0] == w[0] and abs(g[1] - w[1]) < 2e-6 for g, w in ((got[k], want[k]) for k in want))


def test_stages_leave_values_of_clashing_columns_alone(spark):
    """Every column but the text comes back as it was, whatever its name."""
    docs = X.frame(spark)
    names = ["topic", "weight", "toxic_score", "removed", "n_sentences", "n_tokens", "probability", "sampled", "score", "component_id"]
    for n in names:
        docs = docs.withColumn(n, F.lit(f"my-{n}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns
        rows = found.collect()
        assert rows and all(r[n] == f"my-{n}" for r in rows for n in names), name
