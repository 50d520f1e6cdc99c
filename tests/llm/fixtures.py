"""Small documents with every awkward case, and plain-Python versions of the operators."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np

from spanalign.llm import kernels as K

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that the operators use themselves; inputs may have them too.
CLASHES = ("gram", "node", "hash", "place", "version", "removed", "score", "size", "length", "of_id", "of_version", "ranges",
           "stream", "bin", "at", "weight", "topic", "kept", "component", "block", "toxic_score", "n_tokens", "kept_id", "source_", "bucket")


def words(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    out = []
    for k in range(n):
        w = "".join(rng.choice(["an", "the", "or", "é", "tion", "st", "ou"]) for _ in range(rng.randint(1, 4))) + str(rng.randrange(vocabulary) if rng.random() < 0.3 else "")
        if rng.random() < 0.12:
            w += rng.choice([".", ".", "!", "?", ","])
        out.append(w + rng.choice([" ", " ", " ", "\n", "  "]))
    return "".join(out)


def documents():
    """Rows ``doc_id, text, lang, source, n_chars``."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    passage = "Once more this passage stands here. It has several sentences in a row! Does it come again? It does. " + prose(rng, 40)
    base = prose(rng, 150)
    near = []
    for k in range(14):
        own = base.split(" ")
        for _ in range(k // 3):
            own[rng.randrange(len(own))] = f"new{rng.randrange(99)}"
        near.append(" ".join(own))
    texts += near + [near[0]] * 5
    texts += [prose(rng, 30) + passage + prose(rng, 10) for _ in range(6)]
    texts += [None, "", "   \n ", "one", "one two", "One TWO", "a b c d", "a b c d e", "Er. Er. Er. Er.", "x" * 500, "ab" * 400,
              "same line here\n" * 30, "### $$$ %%% &&& | <> *", prose(rng, 6000), "äöü € \U0001f600 ends.", "line\r\nline\r\nother\x0bmore"]
    rows = [(3 * k + 1, t, ("en", "de", None)[k % 3], f"src{k % 4}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[2], rows[2], rows[45], (None, texts[2], "en", "src1", 5), (None, None, None, None, None), (None, texts[60], "fr", "src2", None)]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None, clashes=False):
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    if clashes:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))
    return df


def _cuts(word):
    """Whether a long sentence is cut after the word (the operator's own hash of a word)."""
    raw = np.frombuffer(word.encode(), np.uint8)
    own = K.words(raw, np.array([0, len(raw)]), K.Powers())[2]
    return int(K.mix(own)[0]) % 6 == 0


def sentences(text):
    """Word matches of each unit: sentences, those of more than 12 words cut after some words."""
    found, out, own = list(WORD.finditer(text or "")), [], []
    for k, m in enumerate(found):
        own.append(m)
        if m.group()[-1] in ".!?" or k + 1 == len(found) or "\n" in text[m.end():found[k + 1].start()]:
            part = []
            for x in own:
                part.append(x)
                if len(own) > 12 and x is not own[-1] and _cuts(x.group()):
                    out.append(part)
                    part = []
            out.append(part)
            own = []
    return out


def without_repeated_spans(rows, span=2, least=12):
    """``(id, text) -> (number of units, removed places, text left)``."""
    known = sorted({(i, t) for i, t, *_ in rows if i is not None and t is not None})
    runs = collections.defaultdict(list)
    for i, t in known:
        keys = [tuple(m.group().translate(LOWER) for m in s) for s in sentences(t)]
        for k in range(len(keys)):
            end = next((e for e in range(k + span, len(keys) + 1) if sum(map(len, keys[k:e])) >= least), None)
            if end:
                runs[tuple(keys[k:end])].append((i, k, t, end))
    gone = collections.defaultdict(set)
    for places in runs.values():
        first = min(p[:2] for p in places)
        for i, k, t, end in places:
            if (i, k) != first:
                gone[i, t].update(range(k, end))
    out = {}
    for i, t, *_ in rows:
        own, drop = sentences(t), gone.get((i, t), set())
        starts = [s[0].start() for s in own] + [len(t or "")]
        left = t if t is None or not own else t[:starts[0]] + "".join(t[starts[k]:starts[k + 1]] for k in range(len(own)) if k not in drop)
        out[i, t] = len(own), sorted(drop), left
    return out


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def groups(rows, percent=75):
    """``id -> (size of the set, smallest linked id)`` over rows with an id."""
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def base_rules(text):
    w, text = words(text, lower=False), text or ""
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    found = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    covered = set()
    for k in range(len(w) - 7):
        if found[tuple(w[k:k + 8])] > 1:
            covered.update(range(k, k + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), lines, len(covered)


def backoff_scores(rows, order=3, alpha=0.4, least=1):
    """``(id, text) -> (words, score)``."""
    texts = [words(t) for _, t, *_ in rows]
    counts = [collections.Counter(tuple(w[k:k + n]) for w in texts for k in range(len(w) - n + 1)) for n in range(1, order + 1)]
    total = sum(map(len, texts))
    out = {}
    for (i, t, *_), w in zip(rows, texts):
        score = 0.0
        for k in range(len(w)):
            longest = min(k + 1, order)
            for n in range(longest, 0, -1):
                c = counts[n - 1][tuple(w[k - n + 1:k + 1])]
                if n == 1 or c >= least:
                    before = total if n == 1 else counts[n - 2][tuple(w[k - n + 1:k])]
                    score += math.log(c / before) + (longest - n) * math.log(alpha)
                    break
        out[i, t] = len(w), score
    return out


def without_repeated_bytes(rows, length=100):
    """``(id, text) -> (bytes, removed, spans, sha256 of the rest)``."""
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t, *_ in rows if i is not None and t is not None}):
        raw = t.encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            if raw[s:s + length] in seen:
                gone[s:s + length] = [True] * length
            seen.add(raw[s:s + length])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i, t] = len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    for i, t, *_ in rows:
        raw = (t or "").encode()
        out.setdefault((i, t), (len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
    return out
