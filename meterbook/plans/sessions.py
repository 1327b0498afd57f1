"""The sessions table every mart reads, and its time windows.

Instants are epoch milliseconds (BIGINT). Columns: provider, session_id, slug,
project, branch, cwd, machine, start_ms, end_ms, dur_sec, input, output,
cache_write, cache_read, total_tokens, cost DECIMAL(18,6), models, t_ms,
primary_model, family.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models as mf
from ..functions.timeparts import DAY_MS

RANGE_DAYS = {"7d": 7, "14d": 14, "30d": 30, "90d": 90, "all": None}


def derive(sessions: DataFrame) -> DataFrame:
    """Fill defaults and add the activity instant, primary model and family."""
    model = F.coalesce(F.try_element_at("models", F.lit(1)), F.lit("unknown"))

    def filled(name, value):
        return F.when(F.coalesce(F.col(name), F.lit("")) == "", value).otherwise(F.col(name))

    return sessions.withColumns(
        {
            "project": filled("project", "Unassigned"),
            "machine": filled("machine", "Unknown"),
            "provider": filled("provider", "claude"),
            "t_ms": F.coalesce("end_ms", "start_ms"),
            "primary_model": model,
            "family": mf.model_family(model),
        }
    )


class Period:
    """A window of the ledger; both ends count as inside.

    Bounds are columns, or numbers that become literals when they are used, so
    that a fixed window needs no session to be named.
    """

    def __init__(self, start: Column | int, end: Column | int, days: Column | int):
        self._start, self._end, self._days = start, end, days

    @property
    def start(self) -> Column:
        return F.lit(self._start) if isinstance(self._start, int) else self._start

    @property
    def end(self) -> Column:
        return F.lit(self._end) if isinstance(self._end, int) else self._end

    @property
    def days(self) -> Column:
        return F.lit(self._days).cast("bigint") if isinstance(self._days, int) else self._days

    @classmethod
    def at(cls, now_ms: int, days: int) -> "Period":
        """Window ending at a snapshot time known to follow every session.

        Literal bounds, so they prune at the source.
        """
        return cls(now_ms - days * DAY_MS, now_ms, days)

    @classmethod
    def of(cls, sessions: DataFrame, range_key: str, now_ms: int = 0) -> "Period":
        """Window of a range chip, ending at the newest of now and any session."""
        span = sessions.agg(
            F.struct(F.min("t_ms").alias("lo"), F.max("t_ms").alias("hi")).alias("span")
        ).scalar()
        end = F.greatest(span["hi"], F.lit(now_ms))
        days = RANGE_DAYS[range_key]
        if days is not None:
            return cls(end - days * DAY_MS, end, days)
        start = span["lo"]
        whole = F.greatest(F.lit(1), F.ceil((end - start) / DAY_MS)).cast("bigint")
        return cls(start, end, whole)

    def holds(self, t: Column | None = None) -> Column:
        t = F.col("t_ms") if t is None else t
        return (t >= self.start) & (t <= self.end)

    def previous(self) -> "Period":
        """The window before: it shares the instant where this one starts."""
        return Period(self.start - self.days * DAY_MS, self.start, self.days)

    def day_count(self, low: int, high: int) -> Column:
        days = F.ceil((self.end - self.start) / DAY_MS)
        return F.least(F.greatest(days, F.lit(low)), F.lit(high)).cast("int")


def period_filter(sessions: DataFrame, period: Period) -> DataFrame:
    return sessions.filter(period.holds())


def previous_period(sessions: DataFrame, period: Period) -> DataFrame:
    return sessions.filter(period.previous().holds())


def session_search(sessions: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring over names, places and every model."""
    needle = text.strip().lower()
    if not needle:
        return sessions
    hit = F.exists("models", lambda m: F.lower(m).contains(needle))
    for name in ("slug", "session_id", "project", "machine", "provider"):
        hit = hit | F.lower(F.coalesce(F.col(name), F.lit(""))).contains(needle)
    return sessions.filter(hit)


def first_seen() -> list[str]:
    """Snapshot order: by start, then id."""
    return ["start_ms", "session_id"]


def snapshot_meta(sessions: DataFrame) -> DataFrame:
    """Counts, total and span of the whole table, one row."""
    return sessions.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_distinct("project").alias("projects"),
        F.count_distinct("machine").alias("machines"),
        F.sum("cost").cast("decimal(28,2)").alias("total_cost"),
        F.min("start_ms").alias("from_ms"),
        F.max("start_ms").alias("to_ms"),
    )
