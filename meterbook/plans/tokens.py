"""Token marts: composition, cache, traffic by interval, axis scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import nice_max, ratio
from ..functions.timeparts import DAY_MS, MINUTE_MS
from .sessions import Period
from .spend import SUMS, daily_usage, usage_summary

TRAFFIC = [*SUMS, "total_tokens"]


def token_kpis(sessions: DataFrame) -> DataFrame:
    """Token totals, output and cache shares, tokens per dollar."""
    tokens = F.greatest(F.lit(1), F.col("tokens"))
    return usage_summary(sessions).select(
        "tokens",
        "output",
        ratio(F.col("output"), tokens).alias("output_share"),
        "cache_read",
        "cache_ratio",
        ratio(F.col("tokens"), F.col("cost")).alias("tokens_per_dollar"),
    )


def token_mix(sessions: DataFrame) -> DataFrame:
    """The four token kinds with their share of all tokens, one row each."""
    kinds = usage_summary(sessions).unpivot("tokens", SUMS, "kind", "value")
    return kinds.select(
        "kind", "value", ratio(F.col("value"), F.greatest(F.lit(1), F.col("tokens"))).alias("share")
    )


def cache_by_day(sessions: DataFrame, period: Period, tz: str, last: int = 10) -> DataFrame:
    """Cache-read share of the last active days."""
    days = daily_usage(sessions, period, tz).filter("tokens > 0")
    return (
        days.orderBy(F.desc("day"))
        .limit(last)
        .select("day", "cache_read", ratio(F.col("cache_read"), F.col("tokens")).alias("share"))
    )


def traffic_interval_ms(period: Period) -> Column:
    """A quarter hour up to two weeks, else an hour."""
    short = period.end - period.start <= 14 * DAY_MS
    return F.when(short, F.lit(15 * MINUTE_MS)).otherwise(F.lit(60 * MINUTE_MS))


def complete_turns(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions whose turns add up to the session in every token field."""
    keys = ["provider", "session_id"]
    sums = turns.groupBy(*keys).agg(*[F.sum(c).alias(f"turn_{c}") for c in TRAFFIC])
    same = None
    for c in TRAFFIC:
        close = F.abs(F.col(c) - F.col(f"turn_{c}")) < 0.5
        same = close if same is None else same & close
    return sessions.join(sums, keys).filter(same).select(*keys)


def token_traffic(
    sessions: DataFrame, turns: DataFrame, period: Period, interval_ms: Column | None = None
) -> DataFrame:
    """Tokens per interval, by turn where turns are complete, else by session.

    Each lands where it ended, clamped into the window; empty intervals stay.
    """
    step = traffic_interval_ms(period) if interval_ms is None else interval_ms
    inside = sessions.filter(period.holds())
    keys = ["provider", "session_id"]
    whole = complete_turns(inside, turns)

    by_turn = turns.join(whole, keys, "left_semi").select(
        F.coalesce("end_ms", "start_ms").alias("at_ms"), *TRAFFIC,
        F.lit(1).alias("turns"), F.lit(0).alias("sessions"),
    )
    by_session = inside.join(whole, keys, "left_anti").select(
        F.coalesce("end_ms", "start_ms").alias("at_ms"), *TRAFFIC,
        F.lit(0).alias("turns"), F.lit(1).alias("sessions"),
    )
    clamped = F.greatest(period.start, F.least(period.end - 1, F.col("at_ms")))
    slot = (F.floor(clamped / step) * step).cast("bigint")
    values = [*TRAFFIC, "turns", "sessions"]
    filled = (
        by_turn.unionByName(by_session)
        .groupBy(slot.alias("start_ms"))
        .agg(*[F.sum(v).alias(v) for v in values])
    )
    first = (F.floor(period.start / step) * step).cast("bigint")
    last = F.greatest(first, ((F.ceil(period.end / step) - 1) * step).cast("bigint"))
    slots = sessions.sparkSession.range(1).select(
        F.explode(F.sequence(first, last, step.cast("bigint"))).alias("start_ms")
    )
    return slots.join(filled, "start_ms", "left").select(
        "start_ms", *[F.coalesce(v, F.lit(0)).alias(v) for v in values]
    )


def traffic_summary(traffic: DataFrame) -> DataFrame:
    """Active intervals, the first peak, turn and session counts."""
    peak = F.min_by(
        F.struct("start_ms", "total_tokens"),
        F.struct((-F.col("total_tokens")).alias("v"), "start_ms"),
    )
    return traffic.agg(
        F.sum("total_tokens").alias("tokens"),
        F.count_if(F.col("total_tokens") > 0).alias("active"),
        peak.alias("peak"),
        F.sum("turns").alias("turns"),
        F.sum("sessions").alias("sessions"),
    ).select(
        "tokens", "active", F.col("peak.start_ms").alias("peak_ms"),
        F.col("peak.total_tokens").alias("peak_tokens"), "turns", "sessions",
    )


def robust_scale(values: DataFrame, column: str) -> DataFrame:
    """Axis maximum that a few outliers do not stretch.

    For values already bucketed by interval or day: the quartiles and the list
    of positive values hold one entry per bucket of the window, not per row of
    the ledger.
    """
    v = F.col(column).cast("double")
    positive = F.when(v > 0, v)
    quart = F.percentile(positive, F.array(F.lit(0.25), F.lit(0.75)))
    one = values.agg(
        F.greatest(F.lit(1.0), F.coalesce(F.max(v), F.lit(1.0))).alias("raw_max"),
        F.count(positive).alias("n"),
        quart.alias("q"),
        F.collect_list(positive).alias("above"),
    )
    q1, q3 = F.col("q")[0], F.col("q")[1]
    fenced = one.withColumn("fence", q3 + (q3 - q1) * F.lit(1.5))
    most = F.array_max(F.filter("above", lambda x: x <= F.col("fence")))
    scaled = fenced.withColumn(
        "ceiling", nice_max(F.greatest(F.lit(1.0), F.coalesce(most, F.lit(1.0))))
    )
    cut = (
        (F.col("n") >= 4)
        & (F.col("raw_max") > F.col("fence"))
        & (F.col("raw_max") > F.col("ceiling") * 1.5)
    )
    judged = scaled.withColumn("broken", F.coalesce(cut, F.lit(False)))
    over = F.size(F.filter("above", lambda x: x > F.col("ceiling")))
    return judged.select(
        F.when(F.col("broken"), F.col("ceiling")).otherwise(nice_max(F.col("raw_max"))).alias("max"),
        "raw_max",
        "broken",
        F.when(F.col("broken"), over).otherwise(F.lit(0)).alias("outliers"),
    )
