"""Spend and usage over time: summaries, buckets, calendars, family mixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import period_change, ratio
from ..functions.timeparts import DAY_MS, local_day
from .sessions import Period, first_seen

SUMS = ["input", "output", "cache_write", "cache_read"]


def _zero_cost() -> Column:
    return F.lit(0).cast("decimal(28,6)")


def _summary_aggs(where: Column | None = None, prefix: str = "") -> list[Column]:
    """Cost, session and token totals of the rows a condition holds for."""

    def pick(value):
        return value if where is None else F.when(where, value)

    def total(name):
        return F.coalesce(F.sum(pick(F.col(name))), F.lit(0)).alias(prefix + name)

    return [
        F.coalesce(F.sum(pick(F.col("cost"))), _zero_cost()).alias(prefix + "cost"),
        F.count(pick(F.lit(1))).alias(prefix + "sessions"),
        F.coalesce(F.sum(pick(F.col("total_tokens"))), F.lit(0)).alias(prefix + "tokens"),
        *[total(c) for c in SUMS],
    ]


def usage_summary(sessions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Totals, average cost and cache ratio, for all rows or per key."""
    return sessions.groupBy(*(keys or [])).agg(*_summary_aggs()).withColumns(
        {
            "avg_cost": ratio(F.col("cost"), F.col("sessions")),
            "cache_ratio": ratio(F.col("cache_read"), F.col("tokens")),
        }
    )


def period_comparison(sessions: DataFrame, period: Period) -> DataFrame:
    """Current and previous window side by side, in one scan.

    A session at the shared instant counts in both, hence two flags.
    """
    before = period.previous()
    inside = sessions.filter((F.col("t_ms") >= before.start) & (F.col("t_ms") <= period.end))
    both = inside.agg(
        *_summary_aggs(period.holds(), "cur_"), *_summary_aggs(before.holds(), "prev_")
    )
    for side in ("cur", "prev"):
        both = both.withColumns(
            {
                f"{side}_avg_cost": ratio(F.col(f"{side}_cost"), F.col(f"{side}_sessions")),
                f"{side}_cache_ratio": ratio(F.col(f"{side}_cache_read"), F.col(f"{side}_tokens")),
            }
        )
    changes = {}
    for name in ("cost", "sessions", "tokens", "avg_cost"):
        change = period_change(F.col(f"cur_{name}"), F.col(f"prev_{name}"))
        changes[f"{name}_kind"] = change["kind"]
        changes[f"{name}_change"] = change["value"]
    return both.withColumns(changes)


def spine(sessions: DataFrame, count: Column) -> DataFrame:
    """Rows 0 to count - 1 in column ``i``."""
    one = sessions.sparkSession.range(1)
    return one.select(F.explode(F.sequence(F.lit(0), count.cast("int") - 1)).alias("i"))


def _bucket_index(period: Period, count: Column) -> Column:
    span = F.greatest(F.lit(DAY_MS), period.end - period.start)
    width = span / count
    raw = F.floor((F.col("t_ms") - period.start) / width)
    return F.least(F.greatest(raw, F.lit(0)), count - 1).cast("int")


def interval_buckets(sessions: DataFrame, period: Period, count: Column | int) -> DataFrame:
    """Equal slices of a window, empty ones included; 1 to 180 of them.

    Sessions outside the window fall into the nearest end slice.
    """
    n = count if isinstance(count, Column) else F.lit(count)
    n = F.least(F.greatest(n, F.lit(1)), F.lit(180))
    span = F.greatest(F.lit(DAY_MS), period.end - period.start)
    width = span / n
    filled = sessions.groupBy(_bucket_index(period, n).alias("i")).agg(
        F.sum("cost").alias("cost"),
        F.count(F.lit(1)).alias("sessions"),
        F.sum("total_tokens").alias("tokens"),
    )
    return (
        spine(sessions, n)
        .join(filled, "i", "left")
        .select(
            "i",
            (period.start + F.col("i") * width).alias("start_ms"),
            (period.start + (F.col("i") + 1) * width).alias("end_ms"),
            F.coalesce("cost", _zero_cost()).alias("cost"),
            F.coalesce("sessions", F.lit(0)).alias("sessions"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
        )
    )


def interval_families(sessions: DataFrame, period: Period, count: int) -> DataFrame:
    """Cost per slice and model family."""
    n = F.lit(max(1, min(180, count)))
    return sessions.groupBy(_bucket_index(period, n).alias("i"), "family").agg(
        F.sum("cost").alias("cost")
    )


def cadence(sessions: DataFrame, period: Period) -> DataFrame:
    """Session activity per slice against the busiest, which is hot."""
    buckets = interval_buckets(
        sessions.filter(period.holds()), period, period.day_count(7, 30)
    )
    # At most 30 rows reach this window.
    top = F.greatest(F.lit(1), F.max("sessions").over(Window.partitionBy(F.lit(0))))
    return buckets.withColumns(
        {"activity": ratio(F.col("sessions"), top), "hot": F.col("sessions") == top}
    )


def day_spine(sessions: DataFrame, last_ms: Column, count: Column, tz: str) -> DataFrame:
    """The last ``count`` local days up to an instant, oldest first."""
    last = local_day(last_ms, tz)
    one = sessions.sparkSession.range(1)
    first = F.date_sub(last, count.cast("int") - 1)
    return one.select(F.explode(F.sequence(first, last)).alias("day"))


def _on_days(sessions: DataFrame, last_ms: Column, count: Column, tz: str) -> DataFrame:
    """Sessions with their local day, limited to the days of the spine."""
    # A local day never starts more than 15 hours from the UTC day.
    low = last_ms - (count.cast("bigint") + 2) * DAY_MS
    return sessions.filter(F.col("t_ms") >= low).withColumn(
        "day", local_day(F.col("t_ms"), tz)
    )


def calendar_days(
    sessions: DataFrame, last_ms: Column, count: Column | int, tz: str
) -> DataFrame:
    """Daily totals over the last local days, empty days included."""
    n = count if isinstance(count, Column) else F.lit(max(1, count))
    per_day = _on_days(sessions, last_ms, n, tz).groupBy("day").agg(*_summary_aggs())
    values = ["sessions", "tokens", *SUMS]
    return (
        day_spine(sessions, last_ms, n, tz)
        .join(per_day, "day", "left")
        .select(
            "day",
            F.coalesce("cost", _zero_cost()).alias("cost"),
            *[F.coalesce(v, F.lit(0)).alias(v) for v in values],
        )
    )


def calendar_families(
    sessions: DataFrame, last_ms: Column, count: Column | int, tz: str
) -> DataFrame:
    """Cost per local day and family, with the family's first appearance."""
    n = count if isinstance(count, Column) else F.lit(max(1, count))
    last = local_day(last_ms, tz)
    return (
        _on_days(sessions, last_ms, n, tz)
        .filter(F.col("day").between(F.date_sub(last, n.cast("int") - 1), last))
        .groupBy("day", "family")
        .agg(F.sum("cost").alias("cost"), F.min(F.struct(*first_seen())).alias("first_ord"))
    )


def daily_usage(sessions: DataFrame, period: Period, tz: str) -> DataFrame:
    """Calendar days of a window, 7 to 30 of them."""
    inside = sessions.filter(period.holds())
    return calendar_days(inside, period.end, period.day_count(7, 30), tz)


def _tagged(period: Period, selected: int | None, tz: str) -> Column:
    if selected is None:
        return F.lit("current")
    first = F.date_sub(local_day(period.end, tz), selected - 1)
    return (
        F.when(F.col("day") >= first, "current")
        .when(F.col("day") >= F.date_sub(first, selected), "prior")
        .otherwise("outside")
    )


def spend_heatmap(
    sessions: DataFrame, period: Period, selected: int | None, tz: str
) -> DataFrame:
    """A year or more of days with a spend level, window tag and first peak."""
    oldest = sessions.agg(F.min("t_ms")).scalar()
    first = local_day(F.least(oldest, period.end), tz)
    age = F.date_diff(local_day(period.end, tz), first) + 1
    days = calendar_days(sessions, period.end, F.greatest(F.lit(365), age), tz)
    # One row per calendar day: small whatever the ledger holds.
    whole = Window.partitionBy(F.lit(0))
    ranked = days.withColumns({"top": F.max("cost").over(whole)})
    share = F.col("cost").cast("double") / F.greatest(F.lit(1.0), F.col("top").cast("double"))
    level = (
        F.when(F.col("cost") == 0, 0)
        .when(share < 0.18, 1)
        .when(share < 0.4, 2)
        .when(share < 0.7, 3)
        .otherwise(4)
    )
    first_top = F.min(F.when(F.col("cost") == F.col("top"), F.col("day"))).over(whole)
    return ranked.select(
        "day",
        "cost",
        "sessions",
        level.alias("level"),
        _tagged(period, selected, tz).alias("tag"),
        ((F.col("top") > 0) & (F.col("day") == first_top)).alias("peak"),
    )


def heatmap_summary(heatmap: DataFrame) -> DataFrame:
    """Current and prior spend of a heatmap and the change, null without a prior."""
    side = {
        tag: F.coalesce(F.sum(F.when(F.col("tag") == tag, F.col("cost"))), _zero_cost())
        for tag in ("current", "prior")
    }
    totals = heatmap.agg(
        side["current"].alias("current_cost"), side["prior"].alias("prior_cost")
    )
    cur, prev = F.col("current_cost").cast("double"), F.col("prior_cost").cast("double")
    return totals.withColumn("change", F.when(prev != 0, (cur - prev) / prev))


def _chart_days(period: Period, selected: int | None, longest: int | None) -> Column:
    """Days of a chart: the chosen ones, else the whole span, at least 30.

    ``longest`` bounds the span, for a chart that must fit a screen; days before it
    are then not shown.
    """
    if selected:
        return F.lit(selected)
    return period.day_count(30, longest if longest else 1 << 30)


def spend_by_day_family(
    sessions: DataFrame, period: Period, selected: int | None, tz: str, longest: int | None = None
) -> DataFrame:
    """Days by family; with more than seven families the rest is Other."""
    inside = sessions.filter(period.holds())
    cells = calendar_families(inside, period.end, _chart_days(period, selected, longest), tz)
    # A cell is a day of the chart and one of ten families: few rows, whatever the
    # ledger's size, so ranks come from windows over the cells, not a second pass.
    own, every = Window.partitionBy("family"), Window.partitionBy(F.lit(0))
    totals = cells.withColumns(
        {
            "total": F.sum("cost").over(own),
            "seen": F.min(F.struct("day", "first_ord")).over(own),
        }
    )
    ranked = totals.withColumn(
        "rank", F.dense_rank().over(every.orderBy(F.desc("total"), F.asc("seen"), F.asc("family")))
    ).withColumn("families", F.max("rank").over(every))
    label = F.when((F.col("families") <= 7) | (F.col("rank") <= 7), F.col("family"))
    return (
        ranked.withColumn("family", F.coalesce(label, F.lit("Other")))
        .groupBy("day", "family")
        .agg(F.sum("cost").alias("cost"))
        .filter("cost <> 0")
    )


def cumulative_spend(
    sessions: DataFrame, period: Period, selected: int | None, tz: str, longest: int | None = None
) -> DataFrame:
    """Running spend by day; marks the start, each Monday and the end."""
    inside = sessions.filter(period.holds())
    days = calendar_days(inside, period.end, _chart_days(period, selected, longest), tz)
    # One row per calendar day reaches these windows.
    whole = Window.partitionBy(F.lit(0))
    upto = whole.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    mark = (
        F.when(F.col("day") == F.max("day").over(whole), "end")
        .when(F.col("day") == F.min("day").over(whole), "start")
        .when(F.weekday("day") == 0, "week")
    )
    return days.select(
        "day", "cost", F.sum("cost").over(upto).alias("running"), mark.alias("mark")
    )


def family_totals(sessions: DataFrame) -> DataFrame:
    """Cost per family with its rank; ties go to the family seen first."""
    totals = sessions.groupBy("family").agg(
        F.sum("cost").alias("cost"), F.min(F.struct(*first_seen())).alias("seen")
    )
    # Families come from a fixed list of ten.
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("cost"), F.asc("seen"))
    return totals.withColumns(
        {
            "rank": F.row_number().over(order),
            "families": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))),
        }
    )


def family_mix(sessions: DataFrame) -> DataFrame:
    """Spend per family; beyond four families three stay and the rest folds."""
    ranked = family_totals(sessions)
    folded = (F.col("families") > 4) & (F.col("rank") > 3)
    rows = (
        ranked.groupBy(
            F.when(folded, 4).otherwise(F.col("rank")).alias("rank"),
            F.when(folded, "Other").otherwise(F.col("family")).alias("family"),
        )
        .agg(F.sum("cost").alias("cost"))
    )
    total = F.sum("cost").over(Window.partitionBy(F.lit(0))).cast("double")
    share = F.col("cost").cast("double") / F.greatest(F.lit(1.0), total)
    return rows.withColumn("share", share)


def spend_kpis(sessions: DataFrame, tz: str) -> DataFrame:
    """Total, averages, active local days and the most expensive session."""
    order = F.struct((-F.col("cost")).alias("c"), *first_seen())
    one = sessions.agg(
        *_summary_aggs()[:2],
        F.count_distinct(local_day(F.col("t_ms"), tz)).alias("active_days"),
        F.min_by(F.struct("session_id", "project", "cost"), order).alias("top"),
    )
    return one.select(
        "cost",
        "sessions",
        ratio(F.col("cost"), F.col("sessions")).alias("avg_cost"),
        "active_days",
        ratio(F.col("cost"), F.greatest(F.lit(1), F.col("active_days"))).alias("per_active_day"),
        F.col("top.session_id").alias("top_session"),
        F.col("top.project").alias("top_project"),
        F.coalesce(F.col("top.cost"), _zero_cost()).alias("top_cost"),
    )


def group_totals(sessions: DataFrame, key: str, value: Column | None = None) -> DataFrame:
    """Sum of a value (or a count) per key, largest first."""
    measure = F.count(F.lit(1)) if value is None else F.sum(value)
    return (
        sessions.groupBy(F.col(key).alias("key"))
        .agg(measure.alias("value"), F.min(F.struct(*first_seen())).alias("_seen"))
        .orderBy(F.desc("value"), F.asc("_seen"))
        .drop("_seen")
    )
