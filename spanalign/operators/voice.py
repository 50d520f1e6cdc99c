"""Voice parameters per segment and the cues planned from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanalign import fixed

# --- fixed values: voice tables ---
PACE_MULTIPLIERS = {"slow": 0.8, "normal": 1.0, "fast": 1.25}
EMPHASIS_GAINS = {"low": 0.85, "balanced": 1.0, "high": 1.2}
STYLE_TONES = {
    "neutral": "neutral and literal",
    "calm": "steady and low-variance",
    "focused": "concise and task-forward",
    "energetic": "brighter and higher-variance",
}


def _lookup(table: dict, key: Column, default) -> Column:
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def is_valid_voice(style: Column, pace: Column, emphasis: Column) -> Column:
    return F.coalesce(
        style.isin(*fixed.VOICE_STYLES) & pace.isin(*fixed.VOICE_PACES)
        & emphasis.isin(*fixed.VOICE_EMPHASES),
        F.lit(False),
    )


def voice_bindings(
    segments: DataFrame, style: str = "neutral", pace: str = "normal", emphasis: str = "balanced"
) -> DataFrame:
    """One planned binding per segment with the chosen voice."""
    for value, allowed in (
        (style, fixed.VOICE_STYLES), (pace, fixed.VOICE_PACES), (emphasis, fixed.VOICE_EMPHASES)
    ):
        if value not in allowed:
            raise ValueError(f"{value!r} is not one of {', '.join(allowed)}")
    return segments.select(
        "session_id", "segment_id", "start_ms", "end_ms", F.lit(style).alias("style"),
        F.lit(pace).alias("pace"), F.lit(emphasis).alias("emphasis"),
        F.lit("planned-not-executed").alias("replay_status"),
    )


def planned_duration(start: Column, end: Column, pace: Column) -> Column:
    base = F.greatest(end - start, F.lit(1)).cast("bigint")
    div = lambda value: F.call_function("div", value, F.lit(4))
    return F.when(pace == "slow", div(base * 5)).when(pace == "fast", div(base * 3)).otherwise(base)


def voice_cues(bindings: DataFrame) -> DataFrame:
    """Cues of all bindings; a binding that ends before it starts, or lacks a field, is marked
    invalid and has no duration."""
    start, end = F.col("start_ms"), F.col("end_ms")
    whole = (
        start.isNotNull() & end.isNotNull() & (end >= start) & F.col("style").isNotNull()
        & F.col("pace").isNotNull() & F.col("emphasis").isNotNull()
    )
    return bindings.select(
        "session_id", "segment_id", start.alias("scheduled_at_ms"),
        F.when(whole, planned_duration(start, end, F.col("pace"))).alias("planned_ms"),
        _lookup(STYLE_TONES, F.col("style"), STYLE_TONES["neutral"]).alias("tone"),
        _lookup(PACE_MULTIPLIERS, F.col("pace"), 1.0).alias("pace_multiplier"),
        _lookup(EMPHASIS_GAINS, F.col("emphasis"), 1.0).alias("emphasis_gain"),
        F.when(whole, "dry-run-not-spoken").otherwise("invalid-binding").alias("status"),
    )


def plan_is_valid(cue_count: Column, cues: Column, status: Column, speaks: Column) -> Column:
    """A stored cue plan: dry run, silent, and as many cues as it says."""
    return F.coalesce(
        (status == "dry-run-not-spoken") & (cue_count == F.size(cues)) & (speaks == F.lit(False)),
        F.lit(False),
    )
