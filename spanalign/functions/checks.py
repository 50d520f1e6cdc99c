"""Row checks: digests, required fields, allowed values, canonical row digests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

DIGEST = r"\Asha256:[0-9a-fA-F]{64}\z"


def is_digest(value: Column) -> Column:
    return F.coalesce(value.rlike(DIGEST), F.lit(False))


def sha256(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def failing(checks: Mapping[str, Column]) -> Column:
    """Names of the checks that are not true (NULL counts as failed), in the given order."""
    return F.array_compact(
        F.array(*[
            F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()
        ])
    )


def reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """Messages of the rules that apply (NULL counts as not applying), in the given order."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(text)) for when, text in rules])
    )


def missing_fields(names: Sequence[str]) -> Column:
    """Required columns that are NULL in a row."""
    return F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))


def same_set(left: Column, right: Column) -> Column:
    return F.array_sort(F.array_distinct(left)) == F.array_sort(F.array_distinct(right))


def canonical_digest(columns: Sequence[str]) -> Column:
    """Digest of a row: its columns by name, as compact JSON without NULL fields."""
    ordered = sorted(columns)
    return sha256(F.to_json(F.struct(*[F.col(c) for c in ordered])))


def fields_equal(left: Column, right: Column, names: Sequence[str]) -> Column:
    """All named entries of two string maps are present and equal."""
    return F.forall(
        F.array(*[F.lit(n) for n in names]),
        lambda n: F.coalesce(F.element_at(left, n) == F.element_at(right, n), F.lit(False)),
    )
