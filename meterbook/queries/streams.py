"""Batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import capture as cp
from ..streaming.traffic import turn_windows
from .registry import query


@query(
    "capture_health", ["health_events"],
    """SELECT provider, max(occurred_ms) AS last_attempt_ms, arg_max(hook_event_name, CAST(occurred_ms AS HUGEINT) * 10000000 + event_id) AS last_attempt_event,
      arg_max(status, CAST(occurred_ms AS HUGEINT) * 10000000 + event_id) AS last_attempt_status,
      max(occurred_ms) FILTER (WHERE status IN ('recorded', 'no_usage')) AS last_success_ms,
      max(occurred_ms) FILTER (WHERE status = 'failed') AS last_failure_ms,
      arg_max(coalesce(message, 'Unknown hook capture failure'), CAST(occurred_ms AS HUGEINT) * 10000000 + event_id) FILTER (WHERE status = 'failed') AS last_failure_message
    FROM health_events GROUP BY 1""",
)
def _(b):
    return cp.capture_health(b.health_events)


@query(
    "coalesce_bursts", [],
    """WITH g AS (SELECT ts, CASE WHEN ts < lag(ts) OVER (ORDER BY ts) + INTERVAL 90 SECOND THEN 0 ELSE 1 END AS opens FROM events),
    n AS (SELECT ts, sum(opens) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
    SELECT epoch_us(min(ts)) // 1000 AS first_at, epoch_us(max(ts) + INTERVAL 90 SECOND) // 1000 AS refresh_at, count(*) AS writes FROM n GROUP BY burst""",
)
def _(b):
    # The table's events lie minutes apart, so the quiet period is longer here.
    writes = b.table("events").select(F.col("ts").cast("timestamp").alias("at"))
    return cp.coalesce_bursts(writes, quiet_ms=90_000)


@query(
    "traffic_windows", ["turns"],
    """SELECT end_ms // 900000 * 900000 AS start_ms, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output,
      CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(cache_read) AS BIGINT) AS cache_read,
      CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS turns FROM turns GROUP BY 1""",
)
def _(b):
    return turn_windows(b.turns.withColumn("at", F.timestamp_millis("end_ms")), "15 minutes")


# Capture runs: a user is a run, an event a capture; every seventh has no result.
@query(
    "settle_runs", ["health_events"],
    """WITH p AS (SELECT 'run-' || user_id AS run_id, event_id, status, occurred_ms, provider, tokens, event_id % 7 = 0 AS open_ FROM health_events
        WHERE user_id % 3 <> 1 OR status <> 'failed'),
    a AS (SELECT run_id, count(*) FILTER (WHERE NOT open_ AND status = 'recorded') AS recorded,
      count(*) FILTER (WHERE NOT open_ AND status = 'failed') AS failed, count(*) FILTER (WHERE NOT open_ AND status = 'no_usage') AS no_usage,
      count(*) FILTER (WHERE open_ AND status <> 'failed') AS unresolved,
      arg_max(struct_pack(at_ := occurred_ms, p := provider, t := tokens), CAST(occurred_ms AS HUGEINT) * 10000000 + event_id) FILTER (WHERE NOT open_ AND status = 'recorded') AS latest
      FROM p GROUP BY 1)
    SELECT run_id, CASE WHEN recorded > 0 AND failed > 0 THEN 'recorded+failed' WHEN recorded > 0 AND unresolved > 0 THEN 'recorded+unresolved'
      WHEN recorded > 0 THEN 'recorded' WHEN failed > 0 THEN 'failed' WHEN unresolved > 0 THEN 'unresolved'
      WHEN no_usage > 0 THEN 'no_usage' ELSE 'none' END AS outcome, recorded, failed, no_usage, unresolved,
      latest.at_ AS latest_at, latest.p AS latest_provider, latest.t AS latest_tokens FROM a
      WHERE recorded + failed + no_usage + unresolved > 0""",
)
def _(b):
    runs = b.health_events.filter("user_id % 3 <> 1 OR status <> 'failed'").select(
        F.concat(F.lit("run-"), "user_id").alias("run_id"),
        F.col("event_id").alias("capture_id"),
        F.col("occurred_ms").alias("completed_at"),
        "status", "provider", F.lit("p").alias("project"), F.col("tokens").alias("total_tokens"),
    )
    pending = runs.filter("status <> 'failed'").select("run_id", "capture_id")
    results = runs.filter("capture_id % 7 <> 0")
    return cp.settle_runs(pending, results).drop("latest_project")


# Users are hosts: their hook settings come from their id.
HOSTS = """hosts AS (SELECT DISTINCT 'host-' || user_id AS provider, CASE WHEN user_id % 5 = 0 THEN 'batch' ELSE 'continuous' END AS strategy,
    user_id % 11 <> 0 AS available, CASE user_id % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'disabled' WHEN 2 THEN 'invalid' ELSE 'configured' END AS hook_state,
    user_id % 2 = 0 AS owns FROM events),
  last_ AS (SELECT 'host-' || user_id AS provider, arg_max(status, CAST(occurred_ms AS HUGEINT) * 10000000 + event_id) AS st FROM health_events WHERE user_id % 13 <> 0 GROUP BY 1),
  mon AS (SELECT h.provider, CASE WHEN strategy = 'batch' THEN 'off' WHEN NOT available THEN 'not_detected' WHEN hook_state <> 'configured' THEN 'needs_attention'
      WHEN st IS NULL OR st = 'failed' THEN 'warning' ELSE 'observed' END AS status,
    CASE WHEN strategy = 'batch' THEN 'batch_capture' WHEN NOT available THEN 'agent_not_detected'
      WHEN hook_state <> 'configured' THEN CASE hook_state WHEN 'disabled' THEN 'hooks_disabled' WHEN 'invalid' THEN 'settings_invalid' ELSE 'hook_missing' END
      WHEN st IS NULL THEN 'awaiting_first_attempt' WHEN st = 'failed' THEN 'last_attempt_failed' ELSE 'hook_observed' END AS reason, owns
    FROM hosts h LEFT JOIN last_ l ON l.provider = h.provider)"""


def _monitors(b):
    u = F.col("user_id")
    hosts = b.table("events").select(u).distinct().select(
        F.concat(F.lit("host-"), u).alias("provider"),
        F.when(u % 5 == 0, "batch").otherwise("continuous").alias("strategy"),
        (u % 11 != 0).alias("available"),
        F.when(u % 7 == 0, "missing").when(u % 7 == 1, "disabled").when(u % 7 == 2, "invalid")
        .otherwise("configured").alias("hook_state"),
        (u % 2 == 0).alias("owns_hook_file"),
    )
    seen = b.health_events.filter(u % 13 != 0).withColumn("provider", F.concat(F.lit("host-"), u))
    return cp.capture_monitor(hosts, cp.capture_health(seen))


@query(
    "capture_monitor", ["health_events"],
    f"""WITH {HOSTS} SELECT provider, status, reason, status = 'needs_attention' AND (reason = 'hook_missing'
      OR (reason = 'settings_invalid' AND owns)) AS repairable FROM mon""",
)
def _(b):
    return _monitors(b).select("provider", "status", "reason", "repairable")


@query(
    "fleet_status", ["health_events"],
    f"""WITH {HOSTS}, c AS (SELECT count(*) FILTER (WHERE status = 'needs_attention') AS needs_attention, count(*) FILTER (WHERE status = 'warning') AS warning,
      count(*) FILTER (WHERE status = 'observed') AS observed, count(*) FILTER (WHERE reason = 'awaiting_first_attempt') AS awaiting,
      count(*) FILTER (WHERE reason = 'last_attempt_failed') AS last_failed FROM mon)
    SELECT *, CASE WHEN needs_attention > 0 THEN 'needs_attention' WHEN warning > 0 THEN 'warning' WHEN observed > 0 THEN 'observed' ELSE 'off' END AS status FROM c""",
)
def _(b):
    return cp.fleet_status(_monitors(b))
