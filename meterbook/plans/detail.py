"""Detail panels: a slice of the sessions and its roll-up."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeparts import local_day
from .sessions import first_seen
from .spend import family_totals, group_totals, usage_summary


def slice_day(sessions: DataFrame, day: date, tz: str) -> DataFrame:
    """Sessions whose activity falls on a local day, over the whole ledger."""
    return sessions.filter(local_day(F.col("t_ms"), tz) == F.lit(day))


def slice_project(sessions: DataFrame, project: str) -> DataFrame:
    return sessions.filter(F.col("project") == project)


def slice_family(sessions: DataFrame, family: str) -> DataFrame:
    return sessions.filter(F.col("family") == family)


def slice_cell(sessions: DataFrame, project: str, family: str) -> DataFrame:
    """One project in one family; Other means outside the top three families."""
    own = slice_project(sessions, project)
    if family != "Other":
        return own.filter(F.col("family") == family)
    top = family_totals(sessions).filter("rank <= 3").select("family")
    return own.join(top, "family", "left_anti")


def slice_session(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.filter(F.col("session_id") == session_id)


def slice_ids(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    return sessions.join(ids.select("session_id").distinct(), "session_id", "left_semi")


def detail_rollup(part: DataFrame, vendors: DataFrame | None = None) -> DataFrame:
    """Long form: one ``all`` row, then one row per member of each dimension.

    ``vendors`` has (provider, session_id, vendor, cost, tokens).
    """
    def shaped(df, section, key):
        return df.select(
            F.lit(section).alias("section"), key.alias("key"),
            F.col("cost").cast("double").alias("cost"),
            F.col("tokens").cast("double").alias("tokens"), "sessions",
        )

    out = shaped(usage_summary(part), "all", F.lit("all"))
    for section in ("project", "family", "provider"):
        rows = usage_summary(part, [section])
        out = out.unionByName(shaped(rows, section, F.col(section)))
    if vendors is not None:
        keys = ["provider", "session_id"]
        per = vendors.join(part.select(*keys), keys, "left_semi").groupBy("vendor").agg(
            F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens"),
            F.count(F.lit(1)).alias("sessions"),
        )
        out = out.unionByName(shaped(per, "vendor", F.col("vendor")))
    return out


def day_sessions(part: DataFrame) -> DataFrame:
    """Sessions of a day in time order."""
    return part.orderBy("t_ms", "session_id").select("t_ms", "session_id", "project", "cost")


def recent_sessions(part: DataFrame, k: int = 6) -> DataFrame:
    return (
        part.orderBy(F.desc("t_ms"), *first_seen())
        .limit(k)
        .select("t_ms", "session_id", "primary_model", "cost")
    )


def top_projects_of(part: DataFrame, k: int = 6) -> DataFrame:
    return group_totals(part, "project", F.col("cost")).limit(k)


def band_detail(active: DataFrame) -> DataFrame:
    """Sessions of an activity band by tokens, with their velocity."""
    return active.orderBy(F.desc("total_tokens"), *first_seen()).select(
        "session_id", "project", "primary_model", "total_tokens", "velocity"
    )


def band_summary(active: DataFrame) -> DataFrame:
    """Concurrent sessions, their tokens and summed velocity."""
    speed = F.sum(F.col("micro_velocity").cast("decimal(20,0)")).cast("double")
    return active.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("total_tokens").alias("tokens"),
        (speed / F.lit(1_000_000.0)).alias("velocity"),
    )
