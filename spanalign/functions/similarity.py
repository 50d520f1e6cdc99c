"""Token and phrase similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from spanalign import fixed

EDIT_LIMIT = 2
LONG_TOKEN = 5


def canonical_pair(
    left: Column, right: Column, pairs: Sequence[tuple[str, str]] = fixed.CANONICAL_PAIRS
) -> Column:
    """Directed dictionary of words heard for one another; ``left`` and ``right`` are not equal."""
    table = F.array(*[F.lit(f"{a} {b}") for a, b in pairs])
    listed = left.isin(*{a for a, _ in pairs}) & right.isin(*{b for _, b in pairs})
    return listed & F.array_contains(table, F.concat_ws(" ", left, right))


def bounded_edit_distance(left: Column, right: Column, limit: int) -> Column:
    """Edit distance, or ``limit + 1`` when it is larger."""
    distance = F.levenshtein(left, right, limit)
    return F.when(distance < 0, F.lit(limit + 1)).otherwise(distance)


def close_spelling(left: Column, right: Column) -> Column:
    """Both longer than five letters and at most two edits apart."""
    return (
        (F.length(left) > LONG_TOKEN)
        & (F.length(right) > LONG_TOKEN)
        & (F.abs(F.length(left) - F.length(right)) <= EDIT_LIMIT)
        & (F.levenshtein(left, right, EDIT_LIMIT) >= 0)
    )


def token_similar(left: Column, right: Column) -> Column:
    return (left == right) | canonical_pair(left, right) | close_spelling(left, right)


def has_similar(token: Column, candidates: Column) -> Column:
    """Some candidate is similar to the token: equal ones first, and only tokens that are long or
    in the dictionary are compared with every candidate."""
    worth = (F.length(token) > LONG_TOKEN) | token.isin(*{a for a, _ in fixed.CANONICAL_PAIRS})
    return F.array_contains(candidates, token) | (
        worth & F.exists(candidates, lambda other: token_similar(token, other))
    )


def phrase_similarity(left: Column, right: Column) -> Column:
    """Share of the left tokens that have a similar right token.

    Both sides are bound to the variable of a lambda, so that they are computed once a row whatever they are made
    of, and not once for each left token.
    """
    def share(sides: Column) -> Column:
        left, right = sides["left"], sides["right"]
        hits = F.filter(left, lambda token: has_similar(token, right))
        return (
            F.when((F.size(left) == 0) & (F.size(right) == 0), F.lit(1.0))
            .when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0))
            .otherwise(F.size(hits) / F.size(left))
        )

    sides = F.struct(left.alias("left"), F.array_distinct(right).alias("right"))
    return F.element_at(F.transform(F.array(sides), share), 1)
