"""Sentence spans, n-gram Jaccard join, suffix arrays, components."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from spanalign.llm import ngram_jaccard, substring_dedup, suffix_dedup
from spanalign.llm.graph import connected_components
from tests.llm import fixtures as X


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_sentence_spans(spark, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    rows = X.documents()
    found = substring_dedup.substring_dedup(X.frame(spark, rows))
    got = found.select("doc_id", F.col("text").alias("left"), "n_sentences", "removed", "n_chars", "source").collect()
    want = sorted((str(i), n, gone, str(left)) for (i, t, *_) in rows for n, gone, left in [X.without_repeated_spans(rows)[i, t]])
    assert sorted((str(r.doc_id), r.n_sentences, sorted(r.removed), str(r.left)) for r in got) == want
    assert sum(bool(w[2]) for w in want) >= 10


def test_passages_anywhere_are_found(spark):
    """Passages of 50 to 70 words, between sentences and inside one, with and without full stops."""
    rng = random.Random(21)
    rows = []
    for k in range(60):
        passage = X.prose(rng, rng.randint(50, 70)).strip()
        if k % 3 == 0:
            passage = re.sub("[.!?]", "", passage).replace("\n", " ")
        for side in range(2):
            before, behind = X.prose(rng, rng.randint(5, 80)).strip(), X.prose(rng, rng.randint(5, 80))
            rows.append((2 * k + side, f"{before}{' ' if k % 2 else '. '}{passage} {behind}", None, None, None))
        rows.append((1000 + k, X.prose(rng, 90), None, None, None))
    found = {r.doc_id: len(r.removed) for r in substring_dedup.substring_dedup(X.frame(spark, rows)).collect()}
    assert all(found[2 * k + 1] and not found[2 * k] for k in range(60)) and not any(found[1000 + k] for k in range(60))


def test_sentence_spans_edges(spark):
    df = X.frame(spark, clashes=True)
    found = substring_dedup.substring_dedup(df)
    assert set(found.columns) == set(df.columns) | {"n_sentences", "removed"} and found.count() == df.count()
    kept = substring_dedup.without_repeats(df).select(df.columns)
    others = [c for c in df.columns if c != "text"]
    assert sorted(map(str, kept.select(others).collect())) == sorted(map(str, df.select(others).collect()))
    assert substring_dedup.substring_dedup(X.frame(spark, [])).count() == 0


@pytest.mark.parametrize("frequent", [1 << 17, 16])
def test_similar_groups(spark, monkeypatch, frequent):
    monkeypatch.setattr(ngram_jaccard, "FREQUENT", frequent)
    rows = [r for r in X.documents() if r[0] is not None]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.similar_groups(X.frame(spark, rows)).collect()}
    assert got == {(i, n, c) for i, (n, c) in X.groups(rows).items()}
    assert sum(i != c for i, _, c in got) >= 15


def test_similar_groups_near_copies_form_chains(spark):
    """Many copies that differ more and more: neighbours are linked, ends are not."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(60):
        if k % 2:
            base[rng.randrange(60)] = f"n{k}"
        rows.append((k, " ".join(base), "en", "s", 0))
    rows += [(1000 + k, "a common line of words stands " + " ".join(f"u{k}x{j}" for j in range(12)), "en", "s", 0) for k in range(80)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.similar_groups(X.frame(spark, rows)).collect()}
    assert got == X.groups(rows)


def test_similar_groups_edges(spark):
    rows = X.documents()
    found = ngram_jaccard.similar_groups(X.frame(spark, rows, clashes=True)).collect()
    assert len(found) == len(rows)
    assert all(r.component_id is None for r in found if r.doc_id is None)
    assert all(r.component_id == r.doc_id for r in found if not r.n_shingles and r.doc_id is not None)
    assert ngram_jaccard.similar_groups(X.frame(spark, [])).count() == 0
    kept = ngram_jaccard.one_of_each_group(X.frame(spark, rows, clashes=True))
    ids = [r.doc_id for r in kept.collect()]
    want = X.groups(rows)
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (n, c) in want.items() if i == c)
    assert ids.count(None) == 3 and "gram" in kept.columns


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(7, k) for k in range(200, 260)]
    links = spark.createDataFrame([*chain, *star, (5, 5), (None, 3), (300, 299), (299, 300)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, **{k: 7 for k in range(200, 260)}, 7: 7, 299: 299, 300: 299}
    assert connected_components(links.limit(0)).count() == 0


@pytest.mark.parametrize("limits", [(1 << 20, 4096, 1 << 21), (30, 2, 300)])
@pytest.mark.parametrize("length,seed", [(100, 24), (20, 6)])
def test_suffix_dedup(spark, monkeypatch, limits, length, seed):
    for name, value in zip(("BLOCK", "GROUP", "ARRAY_BYTES"), limits):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = X.documents()
    found = suffix_dedup.suffix_dedup(X.frame(spark, rows), length, seed)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in found.withColumn("sha", F.sha2("kept", 256)).collect())
    want = X.without_repeated_bytes(rows, length)
    assert got == sorted((str(i), *want[i, t]) for i, t, *_ in rows)
    assert sum(w[1] > 0 for w in want.values()) >= 15


def test_suffix_dedup_edges(spark):
    df = X.frame(spark, clashes=True)
    found = suffix_dedup.suffix_dedup(df)
    assert set(found.columns) == set(df.columns) | {"n_bytes", "n_removed", "n_spans", "kept"} and found.count() == df.count()
    assert suffix_dedup.suffix_dedup(X.frame(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([1, 2, 3, 255]), max_size=60), st.integers(1, 80))
def test_suffix_order(values, depth):
    text = np.array([*values, 0], np.uint8)
    wanted = np.random.default_rng(len(values)).random(len(text)) < 0.6
    got = suffix_dedup.suffix_order(text, wanted, depth)
    assert sorted(got) == list(np.flatnonzero(wanted))
    keys = [text[k:k + depth].tobytes() for k in got]
    assert keys == sorted(keys)
