import os
import random

from pyspark.sql import functions as F

from spanalign import fixed
from spanalign.operators import alignment as al, sessionwise as sw
from spanalign.operators.edits import close_pairs
from tests import brute

SEG = "session_id bigint, segment_id bigint, start_ms bigint, end_ms bigint, text string"
TEXT = "session_id bigint, cleaned_text string"
VOCABULARY = [
    "alpha", "marker", "Bravo", "kilo", "keyhole", "pop", "a", "papa", "settings", "setting", "document", "documents", "documentt",
    "save", "chat", "g", "p", "t", "chatgpt", "cloud", "claude", "mic", "MIKE marker,", "tinga", "tinka", "papa marker", "Alpha marker",
    "kilo marker", "internationalization", "internationalisation", "\xe9t\xe9", "\u212ailo marker", "\xa0", "\x1c", "...", "!?", "123456", "123457",
    "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxy", "abcdefghijklmnopqrstuvwx", "xabcdefghijklmnopqrstuvwxyz",
]


def _sessions(rng, ids, most, vocabulary):
    segs, cleaned = [], []
    for sid in ids:
        own = rng.sample(vocabulary, rng.randint(3, len(vocabulary)))
        texts = [" ".join(rng.choices(own, k=rng.randint(0, 9))) for _ in range(rng.randint(1, most))]
        words = [w if rng.random() > 0.15 else rng.choice(vocabulary) for t in texts for w in t.split(" ") if rng.random() > 0.2]
        ends = rng.choice([0, 0.2])
        at = rng.choice([0, 0, -5000])
        for k, text in enumerate(texts, 1):
            segs.append((sid, k, at, at + 1000 * (k % 3), text))
            at += 1000 * (k % 3) - rng.choice([0, 0, 700])
        cleaned.append((sid, "".join(w + (rng.choice([". ", "! ", "\n", "? ", "\u3000", "  "]) if rng.random() < ends else " ") for w in words)))
    return segs, cleaned


def _rows(final):
    names = al.FINAL_SCHEMA
    return sorted((tuple(r[n] for n in names) for r in final.select(*names).collect()), key=lambda r: r[:2])


def test_a_session_in_a_row_gets_the_segments_of_joins_and_windows(spark):
    rng = random.Random(41)
    segs, cleaned = _sessions(rng, range(120), 14, VOCABULARY)
    # one that is cut at anchors, and two without one of the sides
    long, text = _sessions(rng, [200], 1, [f"w{rng.randrange(2000)}ord" for _ in range(2600)])
    words = [f"w{rng.randrange(1800)}ord" for _ in range(2400)]
    long = [(200, k + 1, 900 * k, 900 * k + 900, " ".join(words[12 * k:12 * k + 12])) for k in range(200)]
    text = [(200, "".join(w + (". " if k % 17 == 3 else " ") for k, w in enumerate(words) if k % 7 != 6))]
    assert len(words) * len(text[0][1].split()) > fixed.MAX_ALIGNMENT_CELLS
    segs = spark.createDataFrame(segs + long + [(300, 1, 0, 5, "alone")], SEG)
    cleaned = spark.createDataFrame(cleaned + text + [(301, "alone")], TEXT)
    found = _rows(al.align_cleaned(segs, cleaned))
    assert found == _rows(al.align_in_parts(segs, cleaned))
    assert {r[0] for r in found} == {*range(120), 200} and len({r[-1] for r in found}) >= 4


def test_sessions_beyond_a_row_are_aligned_in_parts(spark, monkeypatch):
    segs, cleaned = _sessions(random.Random(42), range(6), 5, VOCABULARY)
    frames = spark.createDataFrame(segs, SEG), spark.createDataFrame(cleaned, TEXT)
    whole = _rows(al.align_cleaned(*frames))
    area = sorted(len(t.encode()) * sum(len(s[4].encode()) for s in segs if s[0] == sid) for sid, t in cleaned)
    monkeypatch.setattr(sw, "ROW_AREA", area[3])
    assert sw.beyond(*frames).count() == 2
    assert _rows(al.align_cleaned(*frames)) == whole


def test_ordinary_sessions_take_few_jobs_and_no_events_are_written(spark):
    from spanalign.plans import quality_queries
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    spark.sparkContext.setJobGroup("few-jobs", "delay_of_aligned")
    try:
        rows = quality_queries.delay_of_aligned(spark, "/root/testdata/sf0.001").count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert rows > 0 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) < 80
    made = {name.rsplit("-", 1)[0] for name in set(os.listdir(shared)) - before}
    assert "final" in made and "ui-events" not in made and "alike" not in made


def test_running_values_nobody_reads_are_not_made(spark):
    from spanalign.operators.prefix import row_block, running
    rows = running(spark.range(10).withColumn("g", F.col("id") % 2), ["g"], row_block("id"), ["id"], sums={"before": F.lit(1)})
    assert "Join" not in rows.groupBy("g").count()._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.before for r in rows.collect()) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_close_pairs_equal_plain_edit_distance():
    rng = random.Random(43)

    def changed(word):
        word = list(word)
        for _ in range(rng.randint(0, 3)):
            k, kind = rng.randrange(len(word)), rng.random()
            if kind < 0.4:
                word[k] = rng.choice("abz01")
            elif kind < 0.7 and len(word) > 6:
                del word[k]
            else:
                word.insert(k, rng.choice("abz01"))
        return "".join(word)

    groups = []
    for _ in range(60):
        base = ["".join(rng.choices("abz019", k=rng.choice([6, 7, 9, 22, 23, 24, 25, 26, 60, 130]))) for _ in range(rng.randint(0, 3))]
        left, right = (list({changed(w) for w in base for _ in range(4)}) for _ in range(2))
        groups.append((left, right if rng.random() > 0.1 else []))
    groups.append((["a" * 255, "a" * 256], ["a" * 257, "a" * 258, "a" * 259]))
    total = 0
    for (left, right), found in zip(groups, close_pairs(groups)):
        want = {(a, b) for a in left for b in right if a != b and abs(len(a) - len(b)) <= 2 and brute.edits(a, b) <= 2}
        assert set(found) == want and len(found) == len(want)
        total += len(want)
    assert total > 200 and list(close_pairs([])) == []


def test_a_match_whose_rows_are_not_all_kept_is_the_same(monkeypatch):
    rng = random.Random(44)
    for _ in range(40):
        left, right = ([rng.randrange(6) for _ in range(rng.randint(0, 40))] for _ in range(2))
        place = sw.places(right)
        masks = {t: place.get(t, 0) | place.get(t + 1, 0) * (t % 2) for t in range(6)}
        monkeypatch.setattr(sw, "KEPT_BITS", 1 << 28)
        whole = sw.longest_match(left, masks, len(right))
        monkeypatch.setattr(sw, "KEPT_BITS", 0)
        assert sw.longest_match(left, masks, len(right)) == whole
