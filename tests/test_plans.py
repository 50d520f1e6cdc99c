"""Shapes of plans that have to stay as they are."""

from pyspark.sql import functions as F

from spanalign.functions import text
from spanalign.operators import inventory as inv, timeline as tl, utterances
from spanalign.operators.fuzzy import similar_tokens
from spanalign.plans import record_queries, text_queries
from spanalign.sources import tables as src

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_classifier_stands_once_in_the_leak_findings(spark):
    full = record_queries.artifacts(spark, FOLDER).withColumn("scanned", F.lit(True))
    plan = plan_of(inv.leak_findings(full, record_queries.approved_paths(spark, FOLDER)))
    assert plan.count("unsafe-artifact-content") <= 1 and plan.count("explode(array(") >= 1


def test_session_counts_use_one_time_line(spark):
    segments = spark.createDataFrame([], "session_id bigint, segment_id bigint, start_ms bigint, end_ms bigint, text string")
    events = spark.createDataFrame([], "session_id bigint, seq bigint, unix_ms bigint, ui_hint string, window string")
    sessions = spark.createDataFrame([], "session_id bigint, audio_started_ms bigint")
    rows = tl.session_counts(segments, events, sessions)
    assert rows.columns == ["session_id", "segments", "events", "aligned_segments", "conflicts"]
    assert plan_of(rows).count("Window") <= 2 and rows.count() == 0


def test_filters_and_columns_reach_the_scan(spark):
    rows = src.table(spark, FOLDER, "lineitem").where("l_orderkey = 5").select("l_orderkey", "l_quantity")
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_orderkey,5)" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity" in text


def test_whole_texts_are_read_once_not_once_a_piece(spark):
    docs = spark.createDataFrame([(1, "One. Two. Alpha marker three."), (2, "")], "session_id bigint, cleaned_text string")
    above = plan_of(utterances._placed_pieces(docs)).split("Generate posexplode")[0]
    assert "cleaned_text" not in above
    # the pieces are cut once, not for each branch of the running values
    assert "cleaned_text" not in plan_of(utterances.utterances(docs))


def test_classes_are_found_for_distinct_tokens(spark, tmp_path):
    spark.createDataFrame([("a is a@b.co a",)] * 3, "text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a =",)], "html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = text_queries.token_classes(spark, str(tmp_path))
    assert "Aggregate [tok#" in plan_of(found)
    got = {r["class"]: (r.n, r.email, r.separator, r.connector) for r in found.collect()}
    assert got == {"N": (10, 3, 0, 0), "C": (3, 0, 0, 3), "S": (1, 0, 1, 0)}


def test_a_word_is_all_but_white_space(spark):
    every = "".join(chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000)
    old, new = (F.regexp_replace("t", p, "") for p in (f"[^{text.WS_CHARS}]", text.NON_WS))
    left = spark.createDataFrame([(every,)], "t string").select(old.alias("old"), new.alias("new")).first()
    assert left.old == left.new and len(left.new) == 25


def test_white_space_is_what_no_word_holds(spark):
    every = "".join(chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000)
    old, new = (F.regexp_replace("t", p, "") for p in (f"[{text.WS_CHARS}]", text.WS))
    left = spark.createDataFrame([(every,)], "t string").select(old.alias("old"), new.alias("new")).first()
    assert left.old == left.new and len(left.new) == len(every) - 25
    # one table is asked for a character, not a list of ranges
    assert not any(r in p for p in (text.WS, text.NON_WS) for r in "[-")


def test_token_tables_are_not_broadcast(spark, tmp_path):
    # a file of a few hundred bytes, from which Spark expects few tokens
    spark.createDataFrame([(1, "whatever")], "session_id bigint, token string").write.parquet(str(tmp_path / "tokens"))
    tokens = spark.read.parquet(str(tmp_path / "tokens"))
    plan = similar_tokens(tokens, tokens)._jdf.queryExecution().sparkPlan().toString()
    kinds = [line.split("Join")[0].split()[-1] for line in plan.splitlines() if "Join" in line]
    assert kinds.count("BroadcastHash") <= 1 and kinds.count("SortMerge") >= 4  # the dictionary alone
