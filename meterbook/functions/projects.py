"""Project attribution from a working directory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segments(cwd: Column) -> Column:
    return F.filter(F.split(F.coalesce(cwd, F.lit("")), r"[\\/]+"), lambda s: s != "")


def worktree_project(cwd: Column) -> Column:
    """Project owning a worktree checkout, null outside known layouts.

    ``<project>/.claude/worktrees/<tree>`` names the project two segments above
    the container entry; ``.t3/worktrees/<project>/<tree>`` one below.
    """
    parts = _segments(cwd)

    def container(segment, i):
        # element_at is 1-based, so index i is the segment before this one.
        before = F.lower(F.try_element_at(parts, F.when(i > 0, i)))
        return F.when(
            (F.lower(segment) == "worktrees") & before.isin(".claude", ".t3"), i
        )

    at = F.array_max(F.transform(parts, container))
    above = F.try_element_at(parts, F.when(at >= 2, at - 1))
    below = F.try_element_at(parts, at + 2)
    return F.when(F.lower(F.try_element_at(parts, at)) == ".claude", above).otherwise(below)


def project_from_cwd(cwd: Column) -> Column:
    """Worktree owner, else the last path segment, else an empty string."""
    last = F.try_element_at(_segments(cwd), F.lit(-1))
    return F.coalesce(worktree_project(cwd), last, F.lit(""))


def recorded_project(cwd: Column, project: Column) -> Column:
    """Project of a stored record: replaced only where the path proves it."""
    return F.coalesce(worktree_project(cwd), F.trim(F.coalesce(project, F.lit("-"))))
