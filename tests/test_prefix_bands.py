import random

from pyspark.sql import Window, functions as F

from spanalign.operators.bands import band_pairs, nearest_points
from spanalign.operators.prefix import ranged, row_block, running


def test_running_equals_plain_windows_for_any_block_size(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randint(-5, 20), rng.choice(["a", None, "b"]))
            for k in range(3) for i in range(rng.randint(1, 60))]
    df = spark.createDataFrame(rows, "session_id bigint, seq bigint, v bigint, s string")
    w = Window.partitionBy("session_id").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("session_id", "seq", F.coalesce(F.sum("v").over(before), F.lit(0)),
                     F.max("v").over(before), F.lag("s").over(w)).orderBy("session_id", "seq").collect()
    for size in (1, 7, 1000):
        got = running(df, ["session_id"], row_block("seq", size), ["seq"], sums={"a": F.col("v")},
                      maxes={"b": F.col("v")}, lags={"c": F.col("s")})
        got = got.select("session_id", "seq", "a", "b", "c").orderBy("session_id", "seq").collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_running_over_sparse_order_values(spark):
    """Ids spread over 10**12: blocks are ranges of rows, no more than partitions, and hold a hot group too."""
    rng = random.Random(3)
    ids = rng.sample(range(10 ** 12), 4000) + [None]
    rows = [(1 if k % 3 else rng.choice([2, 3, None]), i, rng.randint(0, 99), rng.choice(["a", None])) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "session_id bigint, seq bigint, v bigint, s string").repartition(3)
    w = Window.partitionBy("session_id").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("session_id", "seq", F.coalesce(F.sum("v").over(before), F.lit(0)), F.max("v").over(before), F.lag("s").over(w))
    got = running(df, ["session_id"], None, ["seq"], sums={"a": F.col("v")}, maxes={"b": F.col("v")}, lags={"c": F.col("s")})
    assert got.columns == ["session_id", "seq", "v", "s", "a", "b", "c"]
    assert sorted(map(str, got.select("session_id", "seq", "a", "b", "c").collect())) == sorted(
        str(r) for r in want.toDF("session_id", "seq", "a", "b", "c").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = {r[0]: r[1:] for r in ranged(df, ["session_id"], ["seq"]).groupBy("_ranked").agg(F.count("*")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(blocks) == 8 and max(n for n, in blocks.values()) < 2 * 4001 / 8


def _points(spark, rng, n, name):
    rows = [(rng.choice([1, 1, 1, 2]), i, rng.choice([rng.randint(-2000, 60_000), 30_000, None]))
            for i in range(n)]
    return rows, spark.createDataFrame(rows, f"session_id bigint, {name}_id bigint, {name}_ms bigint")


def test_band_pairs_salted_or_not_equal_all_pairs(spark):
    rng = random.Random(2)
    ls, left = _points(spark, rng, 40, "l")
    rs, right = _points(spark, rng, 90, "r")
    want = sorted((l[1], r[1], r[2] - l[2]) for l in ls for r in rs
                  if l[0] == r[0] and None not in (l[2], r[2]) and abs(r[2] - l[2]) <= 1500)
    for hot in (3, 10, 1000):
        got = band_pairs(left, right, "l_ms", "r_ms", 1500, hot_rows=hot)
        assert sorted((r.l_id, r.r_id, r.delta_ms) for r in got.collect()) == want


def test_one_bucket_that_is_hot_on_both_sides_becomes_a_grid(spark):
    left = spark.range(900).select(F.lit(1).cast("bigint").alias("session_id"), F.col("id").alias("l_id"), F.lit(500).cast("bigint").alias("l_ms"))
    right = spark.range(700).select(F.lit(1).cast("bigint").alias("session_id"), F.col("id").alias("r_id"), F.lit(900).cast("bigint").alias("r_ms"))
    cells = {}
    pairs = band_pairs(left, right, "l_ms", "r_ms", 1500, hot_rows=50)
    assert pairs.select("l_id", "r_id").distinct().count() == pairs.count() == 900 * 700
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "_l" in plan and "_r" in plan
    # no cell is much larger than hot_rows squared: 18 x 14 cells for 900 x 700 pairs
    salts = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n))
    for (l,), (r,) in zip(left.groupBy(salts(left, 18)).count().select("count").collect(), right.groupBy(salts(right, 14)).count().select("count").collect()):
        cells[len(cells)] = l * r
    assert max(cells.values()) < 4 * 50 * 50


def test_nearest_points_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2]), rng.randint(0, 3000), rng.random() < 0.2, rng.random() < 0.1, 1)
            for _ in range(150)]
    df = spark.createDataFrame(rows, "session_id bigint, ms bigint, a boolean, b boolean, n bigint")
    for block in (50, 700, 10_000):
        for r in nearest_points(df, "ms", ["a", "b"], ["n"], block_ms=block).collect():
            same = [x for x in rows if x[0] == r.session_id]
            for flag, k in (("a", 2), ("b", 3)):
                near = [abs(x[1] - r.ms) for x in same if x[k]]
                assert r[f"near_{flag}"] == (min(near) if near else None)
            assert r.n == sum(x[4] for x in same if x[1] == r.ms)


def test_running_keeps_rows_without_key_or_order(spark):
    rows = [(1, 1, 5), (1, 2, 6), (None, 1, 7), (None, 2, 8), (2, None, 9), (2, 5000, 10)]
    df = spark.createDataFrame(rows, "session_id bigint, seq bigint, v bigint")
    found = running(df, ["session_id"], row_block("seq"), ["seq"], sums={"before": F.col("v")}, lags={"last": F.col("v")})
    got = sorted(((r.session_id, r.seq, r.before, r.last) for r in found.collect()), key=repr)
    assert got == sorted([(1, 1, 0, None), (1, 2, 5, 5), (None, 1, 0, None), (None, 2, 7, 7), (2, None, 0, None), (2, 5000, 9, 9)], key=repr)
