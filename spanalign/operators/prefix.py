"""Running values over ordered groups of any size.

A plain window over ``session_id`` sorts one session in one task, which stops working when a single
session holds a large share of the rows.  Here a group is split into ordered blocks: windows run
inside a block, block totals (one row per block) are carried forward, and both are joined.  The
rows are shuffled once, on ``keys + block``; the carried side is small.

Blocks follow from the order column where it is a row number or an instant.  Where its values may lie anywhere
(ids spread over a wide range), :func:`ranged` cuts at range-partition bounds, which Spark samples from the rows:
blocks hold about equally many rows, and a group never has more of them than there are partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanalign.session import written

BLOCK_ROWS = 4096
BLOCK_MS = 3_600_000


def row_block(seq: str | Column, rows: int = BLOCK_ROWS) -> Column:
    """Block number of a row number."""
    col = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(col / rows).cast("bigint")


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``_ranked``, the number of the range of (keys, order) that holds the row.

    The rows are written, as bounds that were sampled twice need not be the same.
    """
    parts = df.repartitionByRange(*keys, *order).withColumn("_ranked", F.spark_partition_id().cast("bigint"))
    return written(parts, "ranged")


def running(
    df: DataFrame,
    keys: Sequence[str],
    block: Column | None,
    order: Sequence[str | Column],
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add columns that look at the rows *before* each row of its group.

    ``block`` must not decrease along ``order``; without one the blocks are ranges of rows.  ``sums`` start at 0; ``maxes`` and ``lags`` are
    NULL on the first row.  NULL keys are a group of their own, NULL orders come first.
    """
    sums, maxes, lags = dict(sums or {}), dict(maxes or {}), dict(lags or {})
    own = df.columns
    if block is None:
        df, block = ranged(df, keys, order), F.col("_ranked")
    # one struct as the key: unlike plain columns, it joins rows whose key or block is NULL as well
    rows = df.withColumn("_group", F.struct(*keys, block.alias("_block")))
    by = ["_group"]
    position = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])

    inside = Window.partitionBy(*by).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = {}
    for name, value in sums.items():
        local[f"_l_{name}"] = F.coalesce(F.sum(value).over(before), F.lit(0))
    for name, value in maxes.items():
        local[f"_l_{name}"] = F.max(value).over(before)
    for name, value in lags.items():
        local[f"_l_{name}"] = F.lag(value).over(inside)
    if lags:
        local["_first"] = F.row_number().over(inside) == 1

    totals = rows.groupBy(*by).agg(*(
        [F.sum(v).alias(f"_t_{n}") for n, v in sums.items()]
        + [F.max(v).alias(f"_t_{n}") for n, v in maxes.items()]
        + [F.max_by(v, position).alias(f"_t_{n}") for n, v in lags.items()]
    ))
    across = Window.partitionBy(*[F.col(f"_group.{k}") for k in keys]).orderBy("_group._block")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *by,
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in maxes],
        *[F.lag(f"_t_{n}").over(across).alias(f"_c_{n}") for n in lags],
    )
    # every row has its block's totals; as an outer join, Spark can leave it out where no running value is read
    joined = rows.withColumns(local).join(carried, by, "left")
    done = {n: F.col(f"_l_{n}") + F.col(f"_c_{n}") for n in sums}
    done |= {n: F.greatest(f"_l_{n}", f"_c_{n}") for n in maxes}
    done |= {n: F.when(F.col("_first"), F.col(f"_c_{n}")).otherwise(F.col(f"_l_{n}")) for n in lags}
    return joined.select(*own, *[c.alias(n) for n, c in done.items()])
