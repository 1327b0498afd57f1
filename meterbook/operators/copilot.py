"""Copilot sessions: usage of the last shutdown and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as cf
from ..functions import models as mf
from ..functions import text as xf
from .breakdown import total_tokens
from .pricing import native_cost, price_responses
from .responses import COUNTS, non_negative


def _last_shutdown(records: DataFrame) -> DataFrame:
    return (
        records.filter("type = 'session.shutdown'")
        .groupBy("provider", "session_id")
        .agg(F.max_by("data.modelMetrics", "ord").alias("metrics"))
    )


def copilot_usage(records: DataFrame) -> DataFrame:
    """Token counts per model id of the last shutdown.

    Token details beat the usage block. Two raw ids with one normal form stay
    two rows.
    """
    rows = _last_shutdown(records).select(
        "provider",
        "session_id",
        F.posexplode("metrics").alias("pos", "model_raw", "m"),
    )
    detail, usage = F.col("m.tokenDetails"), F.col("m.usage")

    def count(name: str, other: Column) -> Column:
        return non_negative(F.coalesce(detail[name]["tokenCount"], other))

    write = count("cache_write", usage["cacheWriteTokens"])
    read = count("cache_read", usage["cacheReadTokens"])
    left = non_negative(usage["inputTokens"]) - F.col("cache_write") - F.col("cache_read")
    return (
        rows.withColumns({"cache_write": write, "cache_read": read})
        .select(
            "provider",
            "session_id",
            "pos",
            "model_raw",
            mf.normalize_model_for(F.lit("copilot"), F.col("model_raw")).alias("model"),
            non_negative(F.coalesce(detail["input"]["tokenCount"], left)).alias("input"),
            count("output", usage["outputTokens"]).alias("output"),
            "cache_write",
            "cache_read",
            F.col("m.totalNanoAiu").alias("host_nano_aiu"),
            F.lit(None).cast("double").alias("host_cost"),
            F.lit(None).cast("string").alias("speed"),
        )
        .withColumn("total_tokens", total_tokens())
    )


def copilot_breakdown(records: DataFrame, dim: DataFrame) -> DataFrame:
    """Per model: counts and cost, the host's own figure first."""
    from ..functions.money import to_usd

    priced = price_responses(copilot_usage(records), dim)
    return native_cost(priced.withColumn("cost", to_usd(F.col("cost_units")))).select(
        "provider", "session_id", "model", *COUNTS, "total_tokens", "cost", "unknown",
        F.struct("pos").alias("first_ord"),
    )


def copilot_metadata(records: DataFrame) -> DataFrame:
    """Session metadata from the start record, else the first dated one."""
    at = F.col("ord")
    starts, ends = F.col("type") == "session.start", F.col("type") == "session.shutdown"
    user, reply = F.col("type") == "user.message", F.col("type") == "assistant.message"
    said = xf.clip(xf.strip(xf.content_text(F.col("data.content"))))
    rows = records.withColumns({"_ms": cf.instant_ms(F.col("timestamp")), "_said": said})
    opened = F.struct(
        F.col("data.sessionId").alias("id"),
        F.col("data.startTime").alias("start"),
        "timestamp",
        F.col("data.context.cwd").alias("cwd"),
        F.col("data.context.branch").alias("branch"),
    )
    found = rows.groupBy("provider", "session_id").agg(
        F.min_by(opened, F.when(starts, at)).alias("s"),
        F.max_by("timestamp", F.when(ends, at)).alias("closed"),
        F.min_by("_ms", F.when(F.col("_ms").isNotNull(), at)).alias("first_ms"),
        F.max_by("_ms", F.when(F.col("_ms").isNotNull(), at)).alias("last_ms"),
        F.min_by("_said", F.when(user, at)).alias("said"),
        F.count_if(user).alias("user_messages"),
        F.count_if(reply).alias("assistant_messages"),
    )
    prompt = F.coalesce(F.nullif("said", F.lit("")), F.lit(xf.NO_PROMPT))
    identity = F.coalesce(F.nullif("s.id", F.lit("")), "session_id")
    begun = F.coalesce(
        cf.instant_ms(F.nullif("s.start", F.lit(""))),
        cf.instant_ms(F.nullif("s.timestamp", F.lit(""))),
        "first_ms",
    )
    return found.select(
        "provider",
        "session_id",
        identity.alias("identity"),
        begun.alias("start_ms"),
        F.coalesce(cf.instant_ms(F.nullif("closed", F.lit(""))), "last_ms", begun).alias("end_ms"),
        F.col("s.cwd").alias("cwd"),
        F.col("s.branch").alias("branch"),
        xf.prompt_slug(F.lit("copilot"), prompt, identity).alias("slug"),
        prompt.alias("first_prompt"),
        "user_messages",
        "assistant_messages",
        (F.col("user_messages") + F.col("assistant_messages")).alias("total_messages"),
    )
