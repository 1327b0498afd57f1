"""Local calendar parts of an instant and wall spans of a session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
MINUTE_MS = 60_000


def local_time(ms: Column, tz: str) -> Column:
    """Wall clock in a named zone, carried as a UTC timestamp."""
    return F.from_utc_timestamp(F.timestamp_millis(ms), tz)


def local_day(ms: Column, tz: str) -> Column:
    return F.to_date(local_time(ms, tz))


def local_hour(ms: Column, tz: str) -> Column:
    return F.hour(local_time(ms, tz))


def local_day_ms(ms: Column, tz: str) -> Column:
    """Milliseconds since local midnight on the wall clock, whole seconds."""
    wall = local_time(ms, tz)
    seconds = F.hour(wall) * 3600 + F.minute(wall) * 60 + F.second(wall)
    return (seconds * 1000).cast("bigint")


def local_minute(ms: Column, tz: str) -> Column:
    return local_day_ms(ms, tz) / F.lit(60_000.0)


def wall_end_ms(start_ms: Column, end_ms: Column, dur_sec: Column) -> Column:
    """Recorded end when it follows the start, else start plus at least 60 s."""
    fallback = F.greatest(F.lit(60), F.coalesce(dur_sec, F.lit(60)))
    return F.when(end_ms > start_ms, end_ms).otherwise(start_ms + fallback * 1000)


def micro_velocity(tokens: Column, start_ms: Column, end_ms: Column) -> Column:
    """Tokens per wall minute in millionths, an exact integer.

    Spans under one minute count as a minute. Integers keep sums over
    sessions independent of their order.
    """
    span = F.greatest(F.lit(MINUTE_MS), end_ms - start_ms).cast("decimal(18,0)")
    scaled = tokens.cast("decimal(20,0)") * F.lit(MINUTE_MS * 1_000_000).cast("decimal(12,0)")
    return F.call_function("div", scaled, span)


def tokens_per_minute(tokens: Column, start_ms: Column, end_ms: Column) -> Column:
    minutes = (end_ms - start_ms) / F.lit(60_000.0)
    return tokens.cast("double") / F.greatest(F.lit(1.0), minutes)
