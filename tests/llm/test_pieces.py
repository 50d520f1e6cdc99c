"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanalign.llm import sentence_pieces as S
from spanalign.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return S.Encoder(MODEL)


def _library(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), True)


def _texts(n, seed=1):
    rng = random.Random(seed)
    letters = "aäb é\n▁<>0x A\u0000漢字한\U0001f600﻿the. \t" + " " * 6
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 20, 80, 200]))) for _ in range(n)]
    return texts + ["", " ", "  ", "▁", "\n", "a", "<s>", "</s>", "<0x0A>", "<unk>", "aaaa" * 900, "ab" * 700, " " * 900, "漢" * 300, "x" * 33, " x" * 40, "the " * 500]


def test_equals_the_library(encoder):
    texts = _texts(3000)
    assert S.digests(encoder, texts) == [_library(encoder.vocabulary.library, t) for t in texts]


def test_parts_of_long_texts(encoder, monkeypatch):
    monkeypatch.setattr(S, "PART", 40)
    monkeypatch.setattr(S, "KNOWN", 500)
    texts = _texts(400, 2)
    assert S.digests(encoder, texts) == [_library(encoder.vocabulary.library, t) for t in texts]


def test_agendas_in_step_and_by_heap_agree(encoder):
    rng = random.Random(3)
    v = encoder.vocabulary
    stretches = ["".join(rng.choice("▁aeinrstbcäß漢\U0001f600.") for _ in range(rng.randint(1, S.IN_STEP))) for _ in range(2000)]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in v.in_step(stretches)] == [v.by_heap(s) for s in stretches]


def test_any_ids_decode_as_by_the_library(encoder):
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, 3, 13, 259, 28705, 200, 201, 198, 150, 177, 230, 264]) for _ in range(rng.randrange(7))]
        assert encoder.vocabulary.decode(ids) == encoder.vocabulary.library.decode(ids)


def test_a_wrong_stretch_is_told(encoder):
    other = S.Encoder(MODEL)
    other.vocabulary.joins = {}
    other.vocabulary.keys, other.vocabulary.ranks, other.vocabulary.joined = (x[:1] for x in (other.vocabulary.keys, other.vocabulary.ranks, other.vocabulary.joined))
    assert [r[3] for r in S.digests(other, ["hello there", "", "\n"])] == [False, True, True]


def test_table(spark, encoder):
    texts = [*_texts(60, 5), None, None, "Once more.", "Once more.", "a long text " * 120_000]
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x")).withColumn("ids", F.lit(1)).repartition(3)
    found = S.encoded(df, MODEL)
    assert found.columns == ["doc_id", "text", "ids", *S.RESULTS]
    key = lambda r: (r[0] is None, r[0] or 0, *r[2:])
    got = sorted(((r.doc_id, r.text, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agrees) for r in found.collect()), key=key)
    assert got == sorted(((i, t, *_library(encoder.vocabulary.library, t)) for i, t in rows), key=key)
    assert S.encoded(df.limit(0), MODEL).count() == 0
