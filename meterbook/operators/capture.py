"""Capture runs and hook health as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .carry import running_total


def settle_runs(pending: DataFrame, results: DataFrame) -> DataFrame:
    """Outcome of each run, with its latest recorded result.

    ``pending`` has (run_id, capture_id); ``results`` are valid capture
    results. A capture is unresolved while it has no result.
    """
    keys = ["run_id", "capture_id"]
    open_ = pending.join(results.select(*keys), keys, "left_anti").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("unresolved")
    )
    recorded = F.col("status") == "recorded"
    order = F.when(recorded, F.struct("completed_at", "capture_id"))
    done = results.groupBy("run_id").agg(
        F.count_if(recorded).alias("recorded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "no_usage").alias("no_usage"),
        F.max_by(F.struct("completed_at", "provider", "project", "total_tokens"), order)
        .alias("latest"),
    )
    runs = done.join(open_, "run_id", "full_outer")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("recorded", "failed", "no_usage", "unresolved")}
    outcome = (
        F.when((n["recorded"] > 0) & (n["failed"] > 0), "recorded+failed")
        .when((n["recorded"] > 0) & (n["unresolved"] > 0), "recorded+unresolved")
        .when(n["recorded"] > 0, "recorded")
        .when(n["failed"] > 0, "failed")
        .when(n["unresolved"] > 0, "unresolved")
        .when(n["no_usage"] > 0, "no_usage")
        .otherwise("none")
    )
    return runs.select(
        "run_id", outcome.alias("outcome"), *[c.alias(k) for k, c in n.items()],
        F.col("latest.completed_at").alias("latest_at"),
        F.col("latest.provider").alias("latest_provider"),
        F.col("latest.project").alias("latest_project"),
        F.col("latest.total_tokens").alias("latest_tokens"),
    )


HEALTH = [
    "last_attempt_ms", "last_attempt_event", "last_attempt_status",
    "last_success_ms", "last_failure_ms", "last_failure_message",
]


def capture_health(events: DataFrame, keys: list[str] | None = None, before: DataFrame | None = None) -> DataFrame:
    """Latest attempt, success and failure of hooks per provider.

    Events apply in arrival order (``event_id``) and one older than the newest
    attempt so far is ignored. Chunks of ids keep the running maximum of a
    busy provider off a single task. ``before`` is the health that earlier events
    left, and then part of the result: the health of a whole is that of its last
    part, given that of the parts before.
    """
    keys = keys or ["provider"]
    chunked = events.withColumn("_chunk", F.floor(F.col("event_id") / 65_536))
    seen = running_total(
        chunked, keys, "_chunk", ["event_id"], maxima_before={"_newest": F.col("occurred_ms")}
    )
    if before is not None:
        had = before.select(*keys, F.col("last_attempt_ms").alias("_had"))
        seen = seen.join(had, keys, "left").withColumn("_newest", F.greatest("_newest", "_had")).drop("_had")
    taken = seen.filter("_newest IS NULL OR occurred_ms >= _newest")
    good = F.col("status").isin("recorded", "no_usage")
    bad = F.col("status") == "failed"
    at = F.col("event_id")
    said = F.coalesce(F.nullif("message", F.lit("")), F.lit("Unknown hook capture failure"))
    found = (
        taken.groupBy(*keys)
        .agg(
            F.max_by(F.struct("occurred_ms", "hook_event_name", "status"), at).alias("last"),
            F.max(F.when(good, F.col("occurred_ms"))).alias("last_success_ms"),
            F.max(F.when(bad, F.col("occurred_ms"))).alias("last_failure_ms"),
            F.max_by(said, F.when(bad, at)).alias("last_failure_message"),
        )
        .select(
            *keys,
            F.col("last.occurred_ms").alias("last_attempt_ms"),
            F.col("last.hook_event_name").alias("last_attempt_event"),
            F.col("last.status").alias("last_attempt_status"),
            "last_success_ms",
            "last_failure_ms",
            "last_failure_message",
        )
    )
    if before is None:
        return found
    # What a later part did not see stays; its last attempt is known as a whole, even where a field is null.
    old = before.select(*keys, *(F.col(c).alias(f"_{c}") for c in HEALTH))
    both = found.withColumn("_new", F.lit(True)).join(old, keys, "full_outer")
    latest = [F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in HEALTH[:3]]
    failure = [F.when(F.col("last_failure_ms").isNotNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in HEALTH[4:]]
    return both.select(*keys, *latest, F.coalesce("last_success_ms", "_last_success_ms").alias("last_success_ms"), *failure)


def capture_monitor(hosts: DataFrame, health: DataFrame) -> DataFrame:
    """Status and reason of each host's hook, by the first rule that fits.

    ``hosts`` has (provider, strategy, available, hook_state, owns_hook_file),
    strategy already resolved; hook_state is configured, missing, disabled or
    invalid.
    """
    seen = health.select("provider", "last_attempt_ms", "last_attempt_status")
    batch = F.col("strategy") == "batch"
    absent = ~F.col("available")
    unset = F.col("hook_state") != "configured"
    never = F.col("last_attempt_ms").isNull()
    failed = F.col("last_attempt_status") == "failed"
    cause = (
        F.when(F.col("hook_state") == "disabled", "hooks_disabled")
        .when(F.col("hook_state") == "invalid", "settings_invalid")
        .otherwise("hook_missing")
    )
    status = (
        F.when(batch, "off").when(absent, "not_detected").when(unset, "needs_attention")
        .when(never | failed, "warning").otherwise("observed")
    )
    reason = (
        F.when(batch, "batch_capture").when(absent, "agent_not_detected").when(unset, cause)
        .when(never, "awaiting_first_attempt").when(failed, "last_attempt_failed")
        .otherwise("hook_observed")
    )
    fixable = (F.col("reason") == "hook_missing") | (
        (F.col("reason") == "settings_invalid") & F.coalesce("owns_hook_file", F.lit(False))
    )
    return (
        hosts.join(seen, "provider", "left")
        .withColumns({"status": status, "reason": reason})
        .withColumn("repairable", (F.col("status") == "needs_attention") & fixable)
    )


def capture_strategy(hosts: DataFrame, default: str | None, overrides: DataFrame) -> DataFrame:
    """Resolved strategy: a host's override, else the default, else continuous."""
    base = "batch" if default == "batch" else "continuous"
    own = overrides.select("provider", F.col("strategy").alias("_own"))
    return hosts.join(own, "provider", "left").withColumn(
        "strategy", F.coalesce("_own", F.lit(base))
    ).drop("_own")


def fleet_status(monitors: DataFrame) -> DataFrame:
    """Worst status over all hosts, with the counts behind it."""
    def n(status):
        return F.count_if(F.col("status") == status)

    def why(reason):
        return F.count_if((F.col("status") == "warning") & (F.col("reason") == reason))

    counts = monitors.agg(
        n("needs_attention").alias("needs_attention"),
        n("warning").alias("warning"),
        n("observed").alias("observed"),
        why("awaiting_first_attempt").alias("awaiting"),
        why("last_attempt_failed").alias("last_failed"),
    )
    worst = (
        F.when(F.col("needs_attention") > 0, "needs_attention")
        .when(F.col("warning") > 0, "warning")
        .when(F.col("observed") > 0, "observed")
        .otherwise("off")
    )
    return counts.withColumn("status", worst)


def coalesce_bursts(
    writes: DataFrame, at: str = "at", quiet_ms: int = 1_500, keys: list[str] | None = None
) -> DataFrame:
    """Writes closer together than the quiet period form one refresh.

    Bursts chain over hours of writes, so an hour is a chunk and only one row
    per hour is walked as a whole.
    """
    keys = keys or []
    us = F.unix_micros(at)
    moments = writes.groupBy(*keys, us.alias("us")).agg(F.count(F.lit(1)).alias("n"))
    hour = moments.withColumn("hour", F.floor(F.col("us") / 3_600_000_000))
    seen = running_total(hour, keys, "hour", ["us"], maxima_before={"before": F.col("us")})
    opens = F.col("before").isNull() | (F.col("us") >= F.col("before") + quiet_ms * 1000)
    numbered = running_total(
        seen, keys, "hour", ["us"], sums={"burst": opens.cast("int")}
    )
    return numbered.groupBy(*keys, "burst").agg(
        F.timestamp_micros(F.min("us")).alias("first_at"),
        F.timestamp_micros(F.max("us") + quiet_ms * 1000).alias("refresh_at"),
        F.sum("n").alias("writes"),
    ).drop("burst")
