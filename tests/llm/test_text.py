"""Quality rules, toxicity, LM scores, token counts, packing, mixing, kernels."""

import collections
import math
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanalign.llm import best_fit_packing as packing, kernels as K, lm_scoring, mixing, quality_rules, token_counts, toxicity
from spanalign.llm.queries import tokenizer_path
from tests.llm import fixtures as X

LABELS = "doc_id long, quality int, toxic int"
SF = "/root/testdata/sf0.01"


# --- kernels ---

@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB \n\t\x0b\x1cé€\U0001f600.,<"), max_size=12)), max_size=6), st.sampled_from([1, 7, 1 << 20]))
def test_words_of_slices(texts, size):
    kept, old = K.Powers(), K.SLICE_BYTES
    K.SLICE_BYTES = size
    try:
        found, hashes = [], {}
        for _, data, offsets in K.slices(pa.array(texts, pa.string())):
            starts, ends, own, first = K.words(data, offsets, kept)
            got = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
            for w, h in zip(got, own):
                assert hashes.setdefault(w.translate(X.LOWER), h) == h
            found += [got[a:b] for a, b in zip(first[:-1], first[1:])]
        assert found == [X.words(t, lower=False) for t in texts]
        assert len(set(hashes.values())) == len(hashes)
    finally:
        K.SLICE_BYTES = old


# --- quality ---

def _labels(spark, rows):
    own = [(i, int(k % 5 > 0), int(k % 6 == 0)) for k, (i, *_) in enumerate(rows)]
    return spark.createDataFrame([*own, (None, 1, 1), (10**9, 1, None), (4, None, None)], LABELS)


def test_quality_rules(spark):
    rows = X.documents()
    labels = _labels(spark, rows)
    found = quality_rules.quality_rules(X.frame(spark, rows, clashes=True), labels).collect()
    want = collections.Counter()
    trusted = {r.doc_id for r in labels.where("quality = 1 and doc_id is not null").collect()}
    raw, target = np.zeros(1 << 16), np.zeros(1 << 16)

    def grams(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return quality_rules._grams(data, quality_rules.GRAM, quality_rules.BITS)

    for i, t, *_ in rows:
        np.add.at(raw, grams(t), 1)
        if i in trusted:
            np.add.at(target, grams(t), 1)
    share = lambda x: (x + 1) / (x.sum() + len(x))
    ratio = np.log(share(target) / share(raw))
    for i, t, *_ in rows:
        g = grams(t)
        want[(i, *X.base_rules(t), round(float(ratio[g].mean()) if len(g) else 0.0, 6))] += 1
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, round(r.score, 6)) for r in found)
    assert got == want
    for r in found:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_rules_without_labels_and_rows(spark):
    none = spark.createDataFrame([], LABELS)
    found = quality_rules.quality_rules(X.frame(spark), none).collect()
    assert all(r.kept != r.base_failed and r.score == 0 for r in found)
    assert quality_rules.quality_rules(X.frame(spark, []), none).count() == 0


def test_quality_rules_tell_junk(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality_rules(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


# --- toxicity ---

def test_toxicity_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    bad = np.array([r.score for r in rows if r.toxic == 1])
    good = np.array([r.score for r in rows if r.toxic == 0])
    assert (bad[:, None] > good[None]).mean() > 0.95
    assert (bad >= 0.5).mean() > 0.8 and (good >= 0.5).mean() < 0.01


def test_toxicity_does_not_learn_from_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: round(r.score, 9) for r in toxicity.toxicity(docs, x).collect()} for x in (labels, turned))
    assert a == b and len(a) == 1000


def test_toxicity_edges(spark):
    rows = X.documents()
    df = X.frame(spark, rows, clashes=True)
    for labels in (spark.createDataFrame([], LABELS), _labels(spark, rows), spark.createDataFrame([(1, 1, 1), (4, 1, 1), (4, 1, None), (None, 1, 1)], LABELS)):
        found = toxicity.toxicity(df, labels).collect()
        assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in found)
        assert len({r.score for r, in zip(found) if r.doc_id is None}) <= 3
        kept = toxicity.clean_documents(df, labels)
        assert kept.columns == df.columns and kept.count() == sum(not r.predicted for r in found)
    assert toxicity.toxicity(X.frame(spark, []), _labels(spark, rows)).count() == 0


# --- LM scores ---

@pytest.mark.parametrize("sizes", [(6 << 20, 8 << 20), (3000, 2000)])
def test_lm_scores(spark, sizes):
    rows = X.documents()
    found = lm_scoring.lm_scores(X.frame(spark, rows, clashes=True), block_chars=sizes[0], part_chars=sizes[1]).collect()
    want = X.backoff_scores(rows)
    assert sorted((str(r.doc_id), r.n_words, round(r.score, 6)) for r in found) == sorted((str(i), want[i, t][0], round(want[i, t][1], 6)) for i, t, *_ in rows)
    assert all((r.mean_score is None) == (r.n_words == 0) for r in found)


def test_lm_scores_with_a_least_count(spark):
    rows = X.documents()
    found = lm_scoring.lm_scores(X.frame(spark, rows), least_count=2, block_chars=3000, part_chars=2000).collect()
    want = X.backoff_scores(rows, least=2)
    assert sorted((str(r.doc_id), r.n_words, round(r.score, 6)) for r in found) == sorted((str(i), want[i, t][0], round(want[i, t][1], 6)) for i, t, *_ in rows)


def test_lm_scores_of_nothing(spark):
    assert lm_scoring.lm_scores(X.frame(spark, [])).count() == 0
    found = lm_scoring.lm_scores(X.frame(spark, [(1, None, None, None, None), (2, " ", None, None, None)])).collect()
    assert [(r.n_words, r.score, r.mean_score) for r in found] == [(0, 0.0, None)] * 2


# --- token counts ---

@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _edited(text, at, removed, inserted):
    at = min(max(at, 0), len(text))
    return text[:at] + inserted + text[min(at + max(removed, 0), len(text)):]


@pytest.mark.parametrize("leaf", [1, 2, 64])
def test_token_trees(counter, monkeypatch, leaf):
    monkeypatch.setattr(token_counts, "LEAF", leaf)
    rng, parts = random.Random(leaf), ["a", "b", " ", "  ", "\n", "'s", "'", "1", "23", ".", "!!", "é", "word ", "\t", " x"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 70)))
        tree = token_counts.TokenTree(text, counter)
        for _ in range(6):
            edit = rng.randint(-2, len(text) + 2), rng.randint(0, 12), "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))
            tree.edit(*edit)
            text = _edited(text, *edit)
            assert tree.text == text and tree.tokens == len(counter.encoding.encode_ordinary(text))
            assert [x for own, _ in tree.leaves for x in own] == [len(p) for p in counter.pattern.findall(text)]


def test_long_text_is_encoded_once(counter):
    text = X.prose(random.Random(1), 30_000)
    tree = token_counts.TokenTree(text, counter)
    for k in range(50):
        tree.edit(k * 1000, 3, "new words")
        text = _edited(text, k * 1000, 3, "new words")
    assert tree.tokens == len(counter.encoding.encode_ordinary(text)) and tree.encoded < 50 * 20


def test_edited_counts(spark, counter):
    rows = X.documents()
    df = X.frame(spark, rows, clashes=True).withColumn("edits", F.when(F.col("doc_id") % 5 != 0, token_counts.drafted_edits()))
    df = df.withColumn("edits", F.when(F.col("doc_id") % 11 == 0, F.array(F.lit(None).cast("struct<at:int,removed:int,inserted:string>"), F.struct(
        F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("removed"), F.lit(None).cast("string").alias("inserted")))).otherwise(F.col("edits")))
    found = token_counts.edited_counts(df, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(found) == len(rows)
    for r in found:
        text = r.text or ""
        assert r.n_tokens == len(counter.encoding.encode_ordinary(text)) and r.n_pretokens == len(counter.pattern.findall(text))
        for e in r.edits or []:
            if e is not None:
                text = _edited(text, e["at"] or 0, e["removed"] or 0, e["inserted"] or "")
        assert r.n_tokens_after == len(counter.encoding.encode_ordinary(text)) and r.n_edits == len(r.edits or [])
    empty = X.frame(spark, []).withColumn("edits", token_counts.drafted_edits())
    assert token_counts.edited_counts(empty, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


# --- packing ---

def test_word_ids_equal_the_tokenizer(monkeypatch):
    path = tokenizer_path("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), packing.WordIds(path)
    monkeypatch.setattr(packing, "CACHED_IDS", 50)
    texts = ["Hello, World. It's DON'T a<|endoftext|>b <|ENDOFTEXT|> <|endoftext|>,", "é, É. ñ!! foo&&&, a., b.. 12.5, x　y, İ. ΑΣ.", None, "",
             "\x00a. 'S. 'll, I'LL. a'", "ﬁ. ß. ẞ, ,a .b a,b. <A, <a,", *(t for _, t, *_ in X.documents())]
    for first, data, offsets in K.slices(pa.array(texts)):
        ids, bounds = own.encode(data, offsets)
        for k in range(len(bounds) - 1):
            assert ids[bounds[k]:bounds[k + 1]].tolist() == whole.encode(texts[first + k] or "", add_special_tokens=False).ids


@pytest.mark.parametrize("stream", [1 << 15, 16])
def test_packing(spark, monkeypatch, stream):
    monkeypatch.setattr(packing, "RUN_PIECES", 8)
    rows = X.documents()
    parts = packing.pieces(X.frame(spark, rows, clashes=True), tokenizer_path("word_bpe_49k.json"), length=256)
    found = packing.pack(parts, 256, open_bins=8, stream_pieces=stream).collect()
    whole = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        for n, a in enumerate(range(0, len(ids), 256)):
            own = ids[a:a + 256]
            want[i, n, a, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own)), tuple(own)] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in found) == want
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= 256
    assert len(sequences) <= math.ceil(sum(r.length for r in found) / 256) * 1.15 + 1


def test_open_bins():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7, 3, 4, 10, 8, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (3, 8)]
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n)[0] for n in (6, 7, 8, 2, 4)] == [0, 1, 2, 1, 0]  # the third bin closed the fullest: itself


def test_packing_of_nothing(spark):
    assert packing.pack(packing.pieces(X.frame(spark, []), tokenizer_path("word_bpe_49k.json"))).count() == 0


# --- mixing ---

def test_mixing(spark):
    rows = X.documents()
    df = X.frame(spark, rows, clashes=True)
    targets = {"source": {"src0": 2, "src1": 1, "src2": 1, "(none)": 1, "src9": 5}, "lang": {"en": 0.5, "de": 0.3, "(none)": 0.2}}
    found = mixing.mixed(df, 0.4, targets).collect()
    assert len(found) == len(rows) and all(r.n_tokens == len(X.words(r.text)) for r in found)
    tokens = sum(r.n_tokens for r in found)
    for margin, want in (("source", {"src0": 0.4, "src1": 0.2, "src2": 0.2, None: 0.2}), ("lang", {"en": 0.5, "de": 0.3, None: 0.2})):
        shares = collections.Counter()
        for r in found:
            shares[r[margin]] += r.n_tokens * r.weight
        total = sum(shares.values())
        assert all(abs(shares[k] / total - want.get(k, 0)) < 1e-6 for k in shares)
    assert abs(sum(r.n_tokens * r.probability for r in found) / tokens - 0.4) < 1e-3
    again = {(r.doc_id, r.text): r.sampled for r in mixing.mixed(df, 0.4, targets).collect()}
    assert all(again[r.doc_id, r.text] == r.sampled for r in found)
    kept = mixing.sample(df, 0.4, targets)
    assert kept.columns == df.columns and kept.count() == sum(r.sampled for r in found)


def test_mixing_many_categories_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CATEGORIES", 3)
    rows = [(k, "some words stand here", "en", f"s{k % 9}", 0) for k in range(90)]
    found = mixing.mixed(X.frame(spark, rows), 0.5).collect()
    assert len(found) == 90 and abs(sum(r.probability for r in found) / 90 - 0.5) < 1e-6
    assert mixing.mixed(X.frame(spark, []), 0.5).count() == 0
    assert mixing.mixed(X.frame(spark, [(1, None, None, None, None)]), 0.5).first().weight == 1.0


def test_mixing_keeps_every_category(spark):
    """More sources than are broadcast, with targets for the rarest ones, and by default."""
    rows = [(k, "some words stand here", "en", f"s{k % 200}" if k < 2000 else f"s{k % 100}", 0) for k in range(3000)]
    found = mixing.mixed(X.frame(spark, rows), 0.5, {"source": {f"s{k}": 1 + k % 2 for k in range(200)}}).collect()
    shares = collections.Counter()
    for r in found:
        shares[r.source] += r.n_tokens * r.weight
    total = sum(shares.values())
    assert len(shares) == 200 and all(abs(shares[f"s{k}"] / total - (1 + k % 2) / 300) < 1e-6 for k in range(200))
    weights = {r.source: r.weight for r in mixing.mixed(X.frame(spark, rows), 0.5).collect()}
    assert all(abs(weights["s150"] / weights[f"s{k}"] - (2 if k < 100 else 1) ** 0.5) < 1e-6 for k in range(200))


def test_rows_without_an_id_are_drawn_one_by_one(spark):
    rows = [(None, f"some words stand here {k}", "en", "a", 0) for k in range(2000)]
    found = mixing.mixed(X.frame(spark, rows), 0.5).collect()
    assert abs(sum(r.sampled for r in found) / len(found) - 0.5) < 0.06


def test_sampling_follows_the_probabilities(spark):
    rows = [(k, "one two three", "en", "a" if k % 4 else "b", 0) for k in range(4000)]
    found = mixing.mixed(X.frame(spark, rows), 0.5, {"source": {"a": 1, "b": 1}}).collect()
    for source, want in (("a", 1000 / 3000), ("b", 1.0)):
        own = [r for r in found if r.source == source]
        assert abs(sum(r.sampled for r in own) / len(own) - want) < 0.04
