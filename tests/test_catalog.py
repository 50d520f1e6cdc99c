import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from spanalign.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
# results that SQL cannot express; each has a brute-force test of its own
WITHOUT_SQL = {"align_cleaned", "align_fallback", "validate_cleanup", "delay_of_aligned"}
SAMPLE = ("assemble_segments", "aligned_segments", "align_events", "conflict_warnings", "redact_text",
          "sensitive_categories", "leak_findings", "utterance_spans", "hash_chain", "readiness_receipt",
          "compare_delay", "live_segments")


def test_every_query_has_sql_or_a_reason():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == WITHOUT_SQL
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == rows


def test_catalog_needs_no_session():
    code = "import __spark_entry__ as e; print(len(e.queries()) - len(e.oracle_sql()) >= 0)"
    folder = os.path.dirname(os.path.abspath(entry.__file__))
    found = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True)
    assert found.stdout.strip().endswith("True"), found.stderr


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
