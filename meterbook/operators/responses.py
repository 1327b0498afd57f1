"""Billed responses: which records bill, and each billing event once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ["input", "output", "cache_write", "cache_read"]
SYNTHETIC = "<synthetic>"

# The shape every provider's responses share. ``ord`` orders a session's rows
# and ``chunk`` is a prefix of it that bounds how many rows share a value.
RESPONSE_COLUMNS = [
    "provider", "session_id", "response_id", "turn_id", "ts", "ts_ms",
    "model_raw", "model", *COUNTS, "speed",
]


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in the given order.

    An aggregate rather than a window: repeats collapse before the shuffle,
    so a key with very many copies sends one row per task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def non_negative(value: Column) -> Column:
    return F.greatest(F.lit(0), F.coalesce(value, F.lit(0))).cast("bigint")


def drop_malformed(df: DataFrame, column: str = "value") -> DataFrame:
    """Keep the rows whose text is one readable JSON document."""
    return df.filter(F.try_parse_json(column).isNotNull())


def billable_claude() -> Column:
    """Assistant records with usage and a real model."""
    model = F.col("message.model")
    return (
        (F.col("type") == "assistant")
        & F.col("message.usage").isNotNull()
        & (F.coalesce(model, F.lit("")) != "")
        & (model != SYNTHETIC)
    )


def billable_codex() -> Column:
    """Token-count events that carry the last request's usage."""
    return (
        (F.col("type") == "event_msg")
        & (F.col("payload.type") == "token_count")
        & F.col("payload.info.last_token_usage").isNotNull()
    )


def _first_of_named(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """First row per name in a session; rows without one all stay. One scan.

    A row without a name gets a number of its own as part of the key.
    """
    own = F.when(F.col(name).isNull(), F.monotonically_increasing_id())
    keys = [name, "session_id", "provider", "_own"]
    return first_by(df.withColumn("_own", own), keys, order).drop("_own")


def dedupe_claude(responses: DataFrame, order: list[str]) -> DataFrame:
    """One billing event per response id over the whole session tree.

    Rows without an id are never taken for repeats.
    """
    return _first_of_named(responses, "response_id", order)


def usage_key(usage: Column) -> Column:
    """Key of six cumulative counts, null when there are none."""
    fields = [
        "input_tokens", "cached_input_tokens", "cache_write_tokens",
        "output_tokens", "reasoning_output_tokens", "total_tokens",
    ]
    joined = F.concat_ws(
        ":", *[F.coalesce(usage[f], F.lit(0)).cast("string") for f in fields]
    )
    return F.when(usage.isNotNull(), joined)


def dedupe_codex(events: DataFrame, order: list[str]) -> DataFrame:
    """First event per cumulative key in a session; keyless events all stay."""
    return _first_of_named(events, "usage_key", order)


def codex_token_split(usage_input: Column, cached: Column, write: Column) -> dict[str, Column]:
    """Split a request's input into uncached, cache write and cache read."""
    total = non_negative(usage_input)
    read = F.least(total, non_negative(cached))
    written = F.least(total - read, non_negative(write))
    return {"input": total - read - written, "cache_write": written, "cache_read": read}


def drop_zero_usage(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("total_tokens") > 0)
