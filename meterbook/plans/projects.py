"""Projects and sessions: summaries, rankings, tables and the family matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import ratio
from .sessions import first_seen, session_search
from .spend import family_totals

PROJECT_SORTS = [
    "project", "sessions", "cost", "tokens", "avg_cost", "dur_sec", "family", "machines", "last_ms",
]
SESSION_SORTS = [
    "slug", "project", "machine", "primary_model", "start_ms", "dur_sec", "total_tokens", "cost",
]


def project_families(sessions: DataFrame) -> DataFrame:
    """Cost per project and family with the first appearance."""
    return sessions.groupBy("project", "family").agg(
        F.sum("cost").alias("cost"),
        F.count(F.lit(1)).alias("sessions"),
        F.sum("total_tokens").alias("tokens"),
        F.sum("dur_sec").alias("dur_sec"),
        F.max("t_ms").alias("last_ms"),
        F.min(F.struct(*first_seen())).alias("seen"),
    )


def project_summary(sessions: DataFrame) -> DataFrame:
    """One row per project; the dominant family has the most cost."""
    families = project_families(sessions)
    order = F.struct((-F.col("cost")).alias("c"), "seen")
    totals = families.groupBy("project").agg(
        F.sum("sessions").alias("sessions"),
        F.sum("cost").alias("cost"),
        F.sum("tokens").alias("tokens"),
        F.sum("dur_sec").alias("dur_sec"),
        F.max("last_ms").alias("last_ms"),
        F.min_by("family", order).alias("family"),
        F.min("seen").alias("seen"),
    )
    machines = sessions.groupBy("project").agg(F.count_distinct("machine").alias("machines"))
    return totals.join(machines, "project").withColumn(
        "avg_cost", ratio(F.col("cost"), F.greatest(F.lit(1), F.col("sessions")))
    )


def _first_by(column: str) -> Column:
    """Ranking key: most of a column, the project seen first on ties."""
    return F.struct((-F.col(column)).alias("v"), "seen")


def project_kpis(projects: DataFrame) -> DataFrame:
    """Project count, top spender, busiest project and average spend."""
    one = projects.agg(
        F.count(F.lit(1)).alias("projects"),
        F.sum("cost").alias("cost"),
        F.min_by(F.struct("project", "cost"), _first_by("cost")).alias("top"),
        F.min_by(F.struct("project", "sessions"), _first_by("sessions")).alias("busy"),
    )
    return one.select(
        "projects",
        F.col("top.project").alias("top_project"),
        F.col("top.cost").alias("top_cost"),
        F.col("busy.project").alias("busiest_project"),
        F.col("busy.sessions").alias("busiest_sessions"),
        ratio(F.col("cost"), F.greatest(F.lit(1), F.col("projects"))).alias("avg_cost"),
    )


def top_projects(projects: DataFrame, by: str = "cost", k: int = 10) -> DataFrame:
    """The k largest projects with their rank and share of the largest."""
    best = projects.orderBy(F.desc(by), F.asc("seen")).limit(k)
    # Only k rows reach these windows.
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(by), F.asc("seen"))
    top = F.max(by).over(Window.partitionBy(F.lit(0)))
    return best.select(
        F.row_number().over(order).alias("rank"),
        "project",
        "family",
        F.col(by).alias("value"),
        ratio(F.col(by), top).alias("share_of_top"),
    )


def top_sessions(sessions: DataFrame, k: int = 10) -> DataFrame:
    """The k most expensive sessions."""
    return (
        sessions.orderBy(F.desc("cost"), *first_seen())
        .limit(k)
        .select("session_id", "project", "slug", "primary_model", "cost")
    )


def concentration(projects: DataFrame) -> DataFrame:
    """Shares of the top three projects and of everything else."""
    whole = projects.agg(
        F.struct(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("projects"))
    ).scalar()
    top = projects.orderBy(F.desc("cost"), F.asc("seen")).limit(3)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("cost"), F.asc("seen"))
    rows = top.select(
        F.row_number().over(order).alias("rank"),
        "project",
        "family",
        F.lit(1).cast("bigint").alias("projects"),
        F.col("cost").cast("decimal(28,6)").alias("cost"),
    )
    held = F.coalesce(F.sum("cost"), F.lit(0).cast("decimal(28,6)"))
    rest = rows.agg(held.alias("held"), F.count(F.lit(1)).alias("n")).select(
        F.lit(4).alias("rank"),
        F.lit("Other projects").alias("project"),
        F.lit(None).cast("string").alias("family"),
        (whole["projects"] - F.col("n")).alias("projects"),
        F.greatest(F.lit(0), whole["cost"] - F.col("held")).cast("decimal(28,6)").alias("cost"),
    )
    return rows.unionByName(rest).withColumn("share", ratio(F.col("cost"), whole["cost"]))


def project_family_matrix(sessions: DataFrame) -> DataFrame:
    """Top seven projects by family, in long form.

    Each cell has its project's total and dominant family, its family's share
    of all spend, and its size against the largest shown cell.
    """
    ranked = family_totals(sessions)
    folded = (F.col("families") > 4) & (F.col("rank") > 3)
    shown = ranked.select(
        "family", F.when(folded, "Other").otherwise(F.col("family")).alias("series"), "cost"
    )
    total = ranked.agg(F.sum("cost")).scalar().cast("double")
    feet = shown.groupBy("series").agg(
        (F.sum("cost").cast("double") / F.greatest(F.lit(1.0), total)).alias("family_share")
    )
    top = (
        project_summary(sessions)
        .orderBy(F.desc("cost"), F.asc("seen"))
        .limit(7)
        .select("project", F.col("cost").alias("project_cost"), F.col("family").alias("dominant"))
    )
    cells = (
        project_families(sessions)
        .join(top, "project")
        .join(shown.select("family", "series"), "family")
        .groupBy("project", "series", "project_cost", "dominant")
        .agg(F.sum("cost").alias("cost"))
    )
    # Seven projects by at most four families.
    largest = F.max("cost").over(Window.partitionBy(F.lit(0))).cast("double")
    return (
        cells.withColumn(
            "cell_share", F.col("cost").cast("double") / F.greatest(F.lit(1.0), largest)
        )
        .filter("cost <> 0")
        .join(feet, "series")
        .withColumnRenamed("series", "family")
    )


def _table_order(key: str, names: list[str], descending: bool, text: set[str], ties: list):
    if key not in names:
        raise ValueError(f"unknown sort key: {key}")
    column = F.lower(F.col(key)) if key in text else F.col(key)
    return [column.desc() if descending else column.asc(), *ties]


def project_table(projects: DataFrame, sort: str = "cost", descending: bool = True) -> DataFrame:
    """Every project, sorted by any column."""
    keys = _table_order(sort, PROJECT_SORTS, descending, {"project"}, [F.asc("seen")])
    return projects.orderBy(*keys).select(*PROJECT_SORTS)


def session_table(
    sessions: DataFrame, sort: str = "start_ms", descending: bool = True, search: str = ""
) -> DataFrame:
    """Sessions that match a search, sorted by any column."""
    named = session_search(sessions, search).withColumn(
        "slug", F.coalesce(F.nullif("slug", F.lit("")), "session_id")
    )
    ties = [F.col(c).asc() for c in first_seen()]
    keys = _table_order(sort, SESSION_SORTS, descending, {"project", "machine"}, ties)
    return named.orderBy(*keys).select("session_id", *SESSION_SORTS)


def session_table_count(sessions: DataFrame, search: str = "") -> DataFrame:
    """How many sessions match a search, out of how many, and their cost."""
    total = sessions.agg(F.count(F.lit(1))).scalar()
    return session_search(sessions, search).agg(
        F.count(F.lit(1)).alias("shown"),
        F.coalesce(F.sum("cost"), F.lit(0).cast("decimal(28,6)")).alias("cost"),
    ).withColumn("of", total)
