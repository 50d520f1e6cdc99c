"""Milliseconds, offsets and strict UTC instants."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spanalign import fixed

_SECONDS = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
UTC_MILLIS_SHAPE = rf"\A{_SECONDS}(?:\.[0-9]{{1,9}})?Z\z"
UTC_SECONDS_SHAPE = rf"\A{_SECONDS}Z\z"


def whole(value: Column, divisor: int) -> Column:
    """Integer quotient (``div``), rounded towards minus infinity."""
    return F.call_function("div", value - F.pmod(value, F.lit(divisor)), F.lit(divisor))


def _second_millis(text: Column) -> Column:
    return F.unix_millis(F.substring(text, 1, 19).try_cast("timestamp"))


def parse_utc_ms(text: Column) -> Column:
    """Strict ``...Z`` instant to epoch milliseconds (fraction cut to ms), else NULL."""
    digits = F.rpad(F.regexp_extract(text, r"\.([0-9]+)Z", 1), 3, "0")
    return F.when(
        text.rlike(UTC_MILLIS_SHAPE) & ~text.startswith("0000"),
        _second_millis(text) + F.substring(digits, 1, 3).cast("bigint"),
    )


def parse_utc_seconds(text: Column) -> Column:
    """As above for exactly twenty characters without a fraction."""
    return F.when(
        text.rlike(UTC_SECONDS_SHAPE) & ~text.startswith("0000"), _second_millis(text)
    )


def timestamp_status(text: Column) -> Column:
    return (
        F.when(text.isNull(), "missing").when(parse_utc_ms(text).isNull(), "invalid")
        .otherwise("valid")
    )


def format_offset(ms: Column) -> Column:
    """``MM:SS``; minutes keep growing past an hour."""
    seconds = whole(ms, 1000)
    return F.format_string("%02d:%02d", whole(seconds, 60), seconds % 60)


def is_fresh(generated_ms: Column, as_of_ms: Column) -> Column:
    """Not older than a day and not more than five minutes ahead of an explicit as-of instant."""
    return (as_of_ms - generated_ms).between(
        -fixed.MAX_FUTURE_SKEW_MS, fixed.MAX_RECEIPT_AGE_MS
    )


def confidence_band(delta_ms: Column) -> Column:
    distance = F.abs(delta_ms)
    return (
        F.when(distance <= fixed.HIGH_CONFIDENCE_MS, "high")
        .when(distance <= fixed.MEDIUM_CONFIDENCE_MS, "medium")
        .otherwise("low")
    )


def clock_skew_status(skew_ms: Column) -> Column:
    return (
        F.when(skew_ms.isNull(), "missing-anchor")
        .when(F.abs(skew_ms) <= fixed.CLOCK_SKEW_WARNING_MS, "within-window")
        .otherwise("exceeds-window")
    )


def effective_offset(monotonic: Column, audio: Column) -> Column:
    return F.coalesce(monotonic, audio, F.lit(0)).cast("bigint")


def timing_source(monotonic: Column) -> Column:
    return F.when(monotonic.isNotNull(), fixed.MONOTONIC_SOURCE).otherwise(fixed.WALL_CLOCK_SOURCE)


def midpoint(anchor: Column, start: Column, end: Column) -> Column:
    """Integer middle of a segment on the wall clock."""
    return anchor + F.shiftright(start + end, 1)
