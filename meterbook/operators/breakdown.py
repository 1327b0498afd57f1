"""Folding priced responses into models, turns and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models as mf
from ..functions.money import to_usd, units_sum
from .responses import COUNTS


def _token_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in COUNTS]


def total_tokens() -> Column:
    return F.col("input") + F.col("output") + F.col("cache_write") + F.col("cache_read")


def model_breakdown(priced: DataFrame, order: list[str]) -> DataFrame:
    """Per session and model: token counts, cost and first appearance."""
    return priced.groupBy("session_id", "model", "provider").agg(
        *_token_sums(),
        units_sum(F.col("cost_units")).alias("cost_units"),
        F.min(F.struct(*order)).alias("first_ord"),
        F.bool_and("priced").alias("priced"),
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
    ).withColumns(
        {"total_tokens": total_tokens(), "cost": to_usd(F.col("cost_units"))}
    )


def session_usage(breakdown: DataFrame) -> DataFrame:
    """Session totals from the breakdown alone, models by cost.

    The list holds one entry per distinct model of the session, never one per
    response.
    """
    place = F.struct((-F.col("cost_units")).alias("rank"), F.col("first_ord"), F.col("model"))
    part = F.struct(place.alias("place"), *COUNTS, "total_tokens", "cost")
    span = [c for c in ("first_ms", "last_ms") if c in breakdown.columns]
    # One row per model of a session, so a task's share has nothing to fold. Dealt by the session
    # alone, the totals lie as the joins that follow need them and are not moved again.
    # Two lists, so a reader of the names alone never moves the figures.
    grouped = breakdown.repartition("session_id").groupBy("session_id", "provider").agg(
        *[(F.min if c == "first_ms" else F.max)(c).alias(c) for c in span],
        *_token_sums(),
        F.sum("cost_units").alias("cost_units"),
        F.sort_array(F.collect_list(place)).alias("_names"),
        F.sort_array(F.collect_list(part)).alias("_parts"),
    )

    def shown(p: Column) -> Column:
        model = p["place"]["model"]
        figures = [p[f].alias(f) for f in (*COUNTS, "total_tokens", "cost")]
        return F.struct(model.alias("model"), mf.model_vendor(model).alias("vendor"), *figures)

    return grouped.withColumns(
        {
            "total_tokens": total_tokens(),
            "cost": to_usd(F.col("cost_units")),
            "models": F.col("_names.model"),
            "model_breakdowns": F.transform("_parts", shown),
        }
    ).drop("_names", "_parts", "cost_units")


def _undated(priced: DataFrame) -> DataFrame:
    """Claude sessions with an undated billed response: they have no turns at all."""
    return (
        priced.filter((F.col("provider") == "claude") & F.col("ts_ms").isNull())
        .select("provider", "session_id")
        .distinct()
    )


def turn_models(priced: DataFrame) -> DataFrame:
    """Per session, turn and model: counts and cost, in long form.

    A turn may use any number of models, so they are rows beside the turn, keyed
    like it, not a list inside it.
    """
    parts = (
        priced.groupBy("turn_id", "session_id", "provider", "model")
        .agg(*_token_sums(), units_sum(F.col("cost_units")).alias("cost_units"))
        .withColumns({"total_tokens": total_tokens(), "cost": to_usd(F.col("cost_units"))})
        .withColumn("vendor", mf.model_vendor(F.col("model")))
        .drop("cost_units")
    )
    return parts.join(_undated(priced), ["provider", "session_id"], "left_anti")


def turn_usage(priced: DataFrame) -> DataFrame:
    """Per session and turn: span, counts and cost; ``turn_models`` has its models."""
    turns = (
        priced.groupBy("turn_id", "session_id", "provider")
        .agg(
            F.min("ts_ms").alias("start_ms"),
            F.max("ts_ms").alias("end_ms"),
            *_token_sums(),
            units_sum(F.col("cost_units")).alias("cost_units"),
        )
        .withColumns({"total_tokens": total_tokens(), "cost": to_usd(F.col("cost_units"))})
        .drop("cost_units")
    )
    return turns.join(_undated(priced), ["provider", "session_id"], "left_anti")
