"""A bit table of ids: a filter of fixed size for scans, ahead of an exact join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

FILTER_BITS = 22


def place(*columns: str) -> Column:
    """Bit of a row with these ids."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - FILTER_BITS).cast("int")


def bit_table(rows: DataFrame, *columns: str) -> np.ndarray:
    """One flag per bit; all of it (``2 ** FILTER_BITS`` bits, whatever the input) comes to the driver."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)))
    words = rows.select(place(*columns).alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("bits"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for at, bits in words.collect():
        table[at] = bits
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)
