"""Durations, progress lines, hashes, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framesift.functions.sampling import div, half_even


def format_duration(seconds: Column) -> Column:
    """``--`` if null or negative, else the two or three largest units, days to seconds."""
    whole = half_even(seconds)
    day, hour, minute = div(whole, 86_400), div(whole % 86_400, 3_600), div(whole % 3_600, 60)
    return (
        F.when(seconds.isNull() | (seconds < 0), F.lit("--"))
        .when(day > 0, F.format_string("%dd %02dh %02dm", day, hour, minute))
        .when(hour > 0, F.format_string("%dh %02dm", hour, minute))
        .when(minute > 0, F.format_string("%dm %02ds", minute, whole % 60))
        .otherwise(F.format_string("%ds", whole))
    )


def progress_line(completed: Column, total: Column, unit: str, percent: Column, rate: Column, eta: Column, elapsed: Column) -> Column:
    speed = F.when(rate.isNull(), F.lit("--")).otherwise(F.format_string(f"%.2f {unit}/s", rate))
    return F.concat(
        F.format_number(completed, 0), F.lit("/"), F.format_number(total, 0), F.format_string(f" {unit} (%.2f%%) rate=", percent), speed,
        F.lit(" ETA="), format_duration(eta), F.lit(" elapsed="), format_duration(elapsed),
    )


def shot_uid(video_id: Column, shot_id: Column) -> Column:
    return F.concat_ws(":", video_id, shot_id.cast("string"))


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def or_default(value: Column, default: Column) -> Column:
    """``default`` where ``value`` is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def as_json(value: Column) -> Column:
    return F.to_json(value)
