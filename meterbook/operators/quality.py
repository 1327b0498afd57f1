"""Data-quality checks over a ledger, all as (check, severity, subject, n) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import models as mf
from .pricing import unknown_models

QUIET_DAYS = 14
WEEK_MS = 7 * 86_400_000


def _finding(df: DataFrame, check: str, severity, subject, n) -> DataFrame:
    return df.select(
        F.lit(check).alias("check"),
        (severity if not isinstance(severity, str) else F.lit(severity)).alias("severity"),
        subject.cast("string").alias("subject"),
        n.cast("bigint").alias("n"),
    )


def check_unparseable(bad_files: DataFrame) -> DataFrame:
    """Red for each ledger file that is no readable document."""
    return _finding(bad_files, "unparseable", "red", F.col("file"), F.lit(1))


def check_pricing_misses(misses: DataFrame, dim: DataFrame, now_ms: int) -> DataFrame:
    """Misses of the last week: red while unpriced, yellow once priced.

    ``misses`` has (line_id, at_ms, line, provider, model), one row per model of a
    log line. A line with one unpriced model, or with none named, is still
    live. Equal lines are findings of their own.
    """
    recent = misses.filter(
        (F.col("at_ms") >= now_ms - WEEK_MS) & ~F.col("line").contains("<synthetic>")
    )
    gone = unknown_models(recent, dim).withColumn("gone", F.lit(True))
    live = F.bool_or(F.coalesce("gone", F.lit(False)) | F.col("model").isNull())
    lines = recent.join(gone, ["provider", "model"], "left").groupBy("line_id", "line").agg(
        F.when(live, "red").otherwise("yellow").alias("severity")
    )
    return _finding(lines, "pricing_miss", F.col("severity"), F.col("line"), F.lit(1))


def check_zero_cost(ledger: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Sessions with tokens that cost nothing, minus known ones.

    ``allowed`` has ``prefix``, the first eight characters of an id.
    """
    bad = ledger.filter("total_tokens > 0 AND NOT coalesce(cost > 0, false)").withColumn(
        "prefix", F.left("session_id", F.lit(8))
    )
    if allowed is not None:
        bad = bad.join(allowed.select("prefix"), "prefix", "left_anti")
    return _finding(bad, "zero_cost", "yellow", F.col("session_id"), F.col("total_tokens"))


def check_unpriced_models(ledger: DataFrame, dim: DataFrame) -> DataFrame:
    """Provider and model pairs in the ledger that have no rate."""
    used = ledger.select("provider", F.explode("models").alias("_raw")).distinct()
    named = used.withColumn("model", mf.normalize_model_for(F.col("provider"), F.col("_raw")))
    missing = named.join(unknown_models(named, dim), ["provider", "model"], "left_semi")
    return _finding(
        missing, "unpriced_model", "yellow", F.concat_ws(":", "provider", "_raw"), F.lit(1)
    )


def check_machine_recency(ledger: DataFrame, today) -> DataFrame:
    """Machines whose last session is more than two weeks old."""
    last = ledger.groupBy("machine").agg(
        F.max(F.to_date(F.timestamp_millis("end_ms"))).alias("last")
    )
    age = F.date_diff(F.lit(today), F.col("last"))
    return _finding(last.filter(age > QUIET_DAYS), "quiet_machine", "yellow", F.col("machine"), age)


def check_token_arithmetic(ledger: DataFrame) -> DataFrame:
    """One row with the number of sessions whose counts miss their total."""
    off = F.count_if(
        F.col("input") + F.col("output") + F.col("cache_write") + F.col("cache_read")
        != F.col("total_tokens")
    )
    counted = ledger.agg(off.alias("n")).filter("n > 0")
    return _finding(counted, "token_arithmetic", "yellow", F.lit("ledger"), F.col("n"))


def check_forked_ledgers(main: DataFrame, fallback: DataFrame) -> DataFrame:
    """Sessions that only the fallback ledger holds."""
    only = fallback.join(main.select("session_id"), "session_id", "left_anti")
    return _finding(only, "forked_ledger", "red", F.col("session_id"), F.lit(1))


def health_report(*findings: DataFrame) -> DataFrame:
    """All findings in one table."""
    report = findings[0]
    for f in findings[1:]:
        report = report.unionByName(f)
    return report


def severity_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))
