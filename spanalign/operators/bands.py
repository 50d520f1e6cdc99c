"""Time-band work inside a session: pairs within a window, and nearest neighbours.

Two different questions get two different plans.

*Which pairs are within W milliseconds?* (:func:`band_pairs`) is an equi join on a time bucket: the
right side is looked up in its own bucket and both neighbours, so every pair meets exactly once.
Buckets with very many rows are cut into a grid: their left and their right rows are dealt to salts whose
numbers follow from both counts, and every pair of salts is a cell of its own, so no single bucket decides
the run time whichever side is large.

*Is there anything within W, and how close?* (:func:`nearest_points`) needs no pairs at all: equal
instants are first merged by a partial aggregate and the rest is a running maximum and minimum over
short time blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanalign import fixed

HOT_BUCKET_ROWS = 50_000
POINT_BLOCK_MS = 60_000


def _bucket(ms: Column, width: int) -> Column:
    return F.floor(ms / width).cast("bigint")


def band_pairs(
    left: DataFrame,
    right: DataFrame,
    left_ms: str,
    right_ms: str,
    window_ms: int = fixed.ALIGNMENT_WINDOW_MS,
    key: str = "session_id",
    hot_rows: int = HOT_BUCKET_ROWS,
) -> DataFrame:
    """All (left, right) pairs of one key with ``abs(right_ms - left_ms) <= window_ms``.

    Left and right must not share column names other than ``key``.
    """
    width = max(window_ms, 1)
    at = [key, "_bucket"]
    points = right.where(F.col(right_ms).isNotNull()).withColumn("_bucket", _bucket(F.col(right_ms), width))
    home = _bucket(F.col(left_ms), width)
    probes = left.where(F.col(left_ms).isNotNull()).withColumn("_bucket", F.explode(F.array(home - 1, home, home + 1)))
    # Sizes of the buckets, counted with a map-side combine; only the hot ones are kept.
    sizes = probes.groupBy(*at).agg(F.count("*").alias("_nl")).join(points.groupBy(*at).agg(F.count("*").alias("_nr")), at)
    salts = lambda n: F.ceil(F.col(n) / hot_rows).cast("int")
    hot = sizes.where(F.greatest("_nl", "_nr") > hot_rows).select(*at, salts("_nl").alias("_ls"), salts("_nr").alias("_rs"))

    def celled(rows: DataFrame, columns: Sequence[str], own: str, own_salts: str, other: str, other_salts: str) -> DataFrame:
        """A row has one salt of its own side and goes to every salt of the other side."""
        spread = F.pmod(F.xxhash64(*columns), F.coalesce(F.col(own_salts), F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other_salts), F.lit(1)) - 1))
        return rows.join(hot, at, "left").withColumn(own, spread).withColumn(other, every).drop("_ls", "_rs")

    probes = celled(probes, left.columns, "_l", "_ls", "_r", "_rs")
    points = celled(points, right.columns, "_r", "_rs", "_l", "_ls")
    delta = F.col(right_ms) - F.col(left_ms)
    return (
        probes.join(points, [*at, "_l", "_r"])
        .where(F.abs(delta) <= window_ms)
        .withColumn("delta_ms", delta)
        .drop("_bucket", "_l", "_r")
    )


def nearest_points(
    points: DataFrame,
    ms: str,
    flags: Sequence[str],
    counts: Sequence[str] = (),
    key: str = "session_id",
    block_ms: int = POINT_BLOCK_MS,
) -> DataFrame:
    """Distance from every instant to the nearest instant that carries each flag.

    ``points`` holds ``key``, ``ms``, boolean ``flags`` and number columns ``counts``.  The result
    has one row per distinct (key, ms) with the flags (any), the counts (sum) and ``near_<flag>``,
    the smallest absolute distance to an instant with that flag (NULL when there is none).
    """
    merged = points.groupBy(key, ms).agg(
        *[F.bool_or(f).alias(f) for f in flags], *[F.sum(c).alias(c) for c in counts]
    ).withColumn("_block", _bucket(F.col(ms), block_ms))

    # At most ``block_ms`` distinct instants per (key, block): the window partitions stay small.
    inside = Window.partitionBy(key, "_block").orderBy(ms)
    up_to = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    at = {f: F.when(F.col(f), F.col(ms)) for f in flags}
    local = {f"_p_{f}": F.max(at[f]).over(up_to) for f in flags}
    local |= {f"_n_{f}": F.min(at[f]).over(from_here) for f in flags}

    totals = merged.groupBy(key, "_block").agg(
        *[F.max(at[f]).alias(f"_hi_{f}") for f in flags],
        *[F.min(at[f]).alias(f"_lo_{f}") for f in flags],
    )
    across = Window.partitionBy(key).orderBy("_block")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    later = across.rowsBetween(1, Window.unboundedFollowing)
    carried = totals.select(
        key, "_block",
        *[F.max(f"_hi_{f}").over(earlier).alias(f"_cp_{f}") for f in flags],
        *[F.min(f"_lo_{f}").over(later).alias(f"_cn_{f}") for f in flags],
    )
    joined = merged.withColumns(local).join(carried, [key, "_block"])
    here = F.col(ms)
    near = {
        f: F.least(
            here - F.coalesce(F.col(f"_p_{f}"), F.col(f"_cp_{f}")),
            F.coalesce(F.col(f"_n_{f}"), F.col(f"_cn_{f}")) - here,
        )
        for f in flags
    }
    return joined.select(
        key, ms, *flags, *counts, *[c.alias(f"near_{f}") for f, c in near.items()]
    )
