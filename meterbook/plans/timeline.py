"""Work timeline: day segments, quarter-hour bands, concurrency, velocity."""

from __future__ import annotations

import calendar
import heapq
from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timeparts import (
    DAY_MS,
    MINUTE_MS,
    local_day,
    local_day_ms,
    micro_velocity,
    tokens_per_minute,
    wall_end_ms,
)
from .quantiles import exact_quantiles
from .sessions import first_seen

SLOT_MS = 15 * MINUTE_MS


def calendar_window(view: str, anchor: date) -> tuple[date, date]:
    """First and last day of the anchor's ISO week or month."""
    if view == "week":
        monday = anchor - timedelta(days=anchor.weekday())
        return monday, monday + timedelta(days=6)
    last = calendar.monthrange(anchor.year, anchor.month)[1]
    return anchor.replace(day=1), anchor.replace(day=last)


def shift_anchor(view: str, anchor: date, direction: int) -> date:
    """Anchor moved by one week, or to the first of the next or last month."""
    if view == "week":
        return anchor + timedelta(days=7 * direction)
    month = anchor.year * 12 + anchor.month - 1 + direction
    return date(month // 12, month % 12 + 1, 1)


def wall_spans(sessions: DataFrame) -> DataFrame:
    """Add the wall-clock end and token velocity of each session."""
    end = wall_end_ms(F.col("start_ms"), F.col("end_ms"), F.col("dur_sec"))
    tokens, start, wall = F.col("total_tokens"), F.col("start_ms"), F.col("wall_end_ms")
    return sessions.withColumn("wall_end_ms", end).withColumns(
        {
            "velocity": tokens_per_minute(tokens, start, wall),
            "micro_velocity": micro_velocity(tokens, start, wall),
        }
    )


def overlapping(spans: DataFrame, first: date, last: date, tz: str) -> DataFrame:
    """Sessions that touch the local days from first to last."""
    near = spans.filter(
        (F.col("wall_end_ms") >= _utc_ms(first) - DAY_MS)
        & (F.col("start_ms") < _utc_ms(last) + 2 * DAY_MS)
    )
    return near.filter(
        (local_day(F.col("wall_end_ms"), tz) >= F.lit(first))
        & (local_day(F.col("start_ms"), tz) <= F.lit(last))
    )


def _utc_ms(day: date) -> int:
    return (day - date(1970, 1, 1)).days * DAY_MS


def session_day_segments(spans: DataFrame, first: date, last: date, tz: str) -> DataFrame:
    """One row per session and local day it touches, as a range of that day.

    An end at exactly midnight adds nothing to its day; a session without
    length on one day counts a minute.
    """
    start_day, end_day = local_day(F.col("start_ms"), tz), local_day(F.col("wall_end_ms"), tz)
    days = F.sequence(F.greatest(start_day, F.lit(first)), F.least(end_day, F.lit(last)))
    rows = overlapping(spans, first, last, tz).select(
        "*", start_day.alias("start_day"), end_day.alias("end_day"), F.explode(days).alias("day")
    )
    opens = F.when(
        F.col("day") == F.col("start_day"), local_day_ms(F.col("start_ms"), tz)
    ).otherwise(F.lit(0).cast("bigint"))
    closes = F.when(
        F.col("day") == F.col("end_day"), local_day_ms(F.col("wall_end_ms"), tz)
    ).otherwise(F.lit(DAY_MS).cast("bigint"))
    one_day = F.col("start_day") == F.col("end_day")
    empty = one_day & (F.col("day_end_ms") <= F.col("day_start_ms"))
    return (
        rows.withColumns({"day_start_ms": opens, "day_end_ms": closes})
        .withColumn(
            "day_end_ms",
            F.when(empty, F.col("day_start_ms") + MINUTE_MS).otherwise(F.col("day_end_ms")),
        )
        .filter(f"day_end_ms > 0 AND day_start_ms < {DAY_MS}")
        .withColumn("day_end_ms", F.least(F.col("day_end_ms"), F.lit(DAY_MS)))
        .drop("start_day", "end_day")
    )


def _slot_range(segments: DataFrame) -> DataFrame:
    return segments.withColumns(
        {
            "first_slot": F.floor(F.col("day_start_ms") / SLOT_MS).cast("int"),
            "last_slot": (F.ceil(F.col("day_end_ms") / SLOT_MS) - 1).cast("int"),
        }
    )


def month_slots(segments: DataFrame) -> DataFrame:
    """Quarter hours of the day in which each session is active."""
    return _slot_range(segments).select(
        "day",
        F.explode(F.sequence("first_slot", "last_slot")).alias("slot"),
        "provider",
        "session_id",
        "micro_velocity",
    )


def month_bands(segments: DataFrame) -> DataFrame:
    """Maximal runs of quarter hours with the same active sessions.

    The active set changes exactly where a session enters or leaves, so bands
    are the stretches between such slots. Only entries and exits per slot are
    summed, at most 97 rows a day; no list of sessions is ever built.
    """
    ranged = _slot_range(segments)
    move = F.explode(
        F.array(
            F.struct(
                F.col("first_slot").alias("slot"),
                F.lit(1).alias("enter"),
                F.col("micro_velocity").cast("decimal(20,0)").alias("speed"),
            ),
            F.struct(
                (F.col("last_slot") + 1).alias("slot"),
                F.lit(-1).alias("enter"),
                (-F.col("micro_velocity")).cast("decimal(20,0)").alias("speed"),
            ),
        )
    )
    changes = (
        ranged.select("day", move.alias("m"))
        .groupBy("day", F.col("m.slot").alias("slot"))
        .agg(F.sum("m.enter").alias("enter"), F.sum("m.speed").alias("speed"))
    )
    order = Window.partitionBy("day").orderBy("slot")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        changes.select(
            "day",
            F.col("slot").alias("first_slot"),
            F.lead("slot").over(order).alias("end_slot"),
            F.sum("enter").over(upto).alias("active"),
            F.sum("speed").over(upto).alias("speed"),
        )
        .filter("active > 0")
        .select(
            "day",
            (F.col("first_slot") * 15).alias("start_minute"),
            (F.col("end_slot") * 15).alias("end_minute"),
            "active",
            (F.col("speed").cast("double") / F.lit(1_000_000.0)).alias("velocity"),
        )
    )


def band_sessions(segments: DataFrame, day: date, minute: int) -> DataFrame:
    """Sessions active in the band that starts at a minute of a day."""
    slot = minute // 15
    return _slot_range(segments.filter(F.col("day") == F.lit(day))).filter(
        F.lit(slot).between(F.col("first_slot"), F.col("last_slot"))
    )


def _starts(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments of one start collapsed, with their cluster number.

    Starts are whole seconds, so a day has at most 86,400 of them per key and
    the windows stay small however many sessions ran.
    """
    starts = segments.groupBy(*keys, "day_start_ms").agg(
        F.max("day_end_ms").alias("reach"), F.count(F.lit(1)).alias("segments")
    )
    order = Window.partitionBy(*keys).orderBy("day_start_ms")
    before = F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("day_start_ms") >= before), 1).otherwise(0)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return starts.withColumn("opens", opens).withColumn("cluster", F.sum("opens").over(upto))


def concurrency_clusters(segments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per day, chains of segments that overlap one another."""
    keys = keys or ["day"]
    return (
        _starts(segments, keys)
        .groupBy(*keys, "cluster")
        .agg(
            F.min("day_start_ms").alias("cluster_start_ms"),
            F.max("reach").alias("cluster_end_ms"),
            F.sum("segments").alias("segments"),
        )
    )


def concurrency_lanes(segments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Lane of each segment: the lowest that is free when it starts.

    Greedy placement depends on every earlier segment of its cluster, so a
    cluster is walked in order. Clusters spread over the tasks, and a task
    holds one batch and the open lanes, never a whole cluster. ``keys`` names
    the timeline; give a machine or user beside the day for a large fleet.
    """
    keys = keys or ["day"]
    clusters = _starts(segments, keys).select(*keys, "day_start_ms", "cluster")
    placed = segments.join(clusters, [*keys, "day_start_ms"])
    group = [*keys, "cluster"]
    columns = [*group, "day_start_ms", "day_end_ms", "provider", "session_id"]
    rows = (
        placed.select(*columns)
        .repartition(*group)
        .sortWithinPartitions(*columns)
    )
    schema = T.StructType([*rows.schema.fields, T.StructField("lane", T.IntegerType())])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, busy, free, opened = None, [], [], 0
        for batch in batches:
            lanes = []
            marks = batch[group].itertuples(index=False, name=None)
            for mark, start, end in zip(marks, batch["day_start_ms"], batch["day_end_ms"]):
                if mark != current:
                    current, busy, free, opened = mark, [], [], 0
                while busy and busy[0][0] <= start:
                    heapq.heappush(free, heapq.heappop(busy)[1])
                if free:
                    lane = heapq.heappop(free)
                else:
                    lane, opened = opened, opened + 1
                heapq.heappush(busy, (end, lane))
                lanes.append(lane)
            yield batch.assign(lane=pd.Series(lanes, index=batch.index, dtype="int32"))

    lanes = rows.mapInPandas(place, schema)
    counts = lanes.groupBy(*group).agg((F.max("lane") + 1).alias("lane_count"))
    return lanes.join(counts, group)


def rhythm_table(
    segments: DataFrame, first: date, last: date, observed_through: date
) -> DataFrame:
    """Per day: active span, sessions, tokens; later days are not observed."""
    days = segments.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day")
    )
    # A session has one segment a day, so rows are distinct sessions.
    filled = segments.groupBy("day").agg(
        F.min("day_start_ms").alias("first_ms"),
        F.max("day_end_ms").alias("last_ms"),
        F.count(F.lit(1)).alias("sessions"),
        F.sum("total_tokens").alias("tokens"),
    )
    return days.join(filled, "day", "left").select(
        "day",
        (F.col("first_ms") / F.lit(60_000.0)).alias("first_minute"),
        (F.col("last_ms") / F.lit(60_000.0)).alias("last_minute"),
        F.coalesce("sessions", F.lit(0)).alias("sessions"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        (F.col("day") > F.lit(observed_through)).alias("outside"),
    )


def velocity_bounds(spans: DataFrame) -> DataFrame:
    """10th and 90th percentile of log velocity, one row."""
    logged = F.log1p(F.col("velocity"))
    return exact_quantiles(spans, logged, [0.1, 0.9]).select(
        F.coalesce("q0", F.lit(0.0)).alias("low"), F.coalesce("q1", F.lit(0.0)).alias("high")
    )


def velocity_scale(spans: DataFrame) -> DataFrame:
    """Add each session's place between the bounds, one half when flat."""
    bounds = velocity_bounds(spans).select(F.struct("low", "high")).scalar()
    low, high = bounds["low"], bounds["high"]
    place = (F.log1p(F.col("velocity")) - low) / (high - low)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), place))
    return spans.withColumn("normalized", F.when(high > low, clamped).otherwise(F.lit(0.5)))


def series_slots(sessions: DataFrame, visible: DataFrame, slots: int = 4) -> DataFrame:
    """Project and colour slot: the first distinct projects, visible ones first.

    Projects beyond the slots get -1 and share the Other series.
    """
    def ranked(df, source):
        return df.groupBy("project").agg(
            F.min(F.struct(F.lit(source).alias("source"), *first_seen())).alias("seen")
        )

    both = ranked(visible, 0).unionByName(ranked(sessions, 1))
    projects = both.groupBy("project").agg(F.min("seen").alias("seen"))
    head = projects.orderBy("seen").limit(slots)
    order = Window.partitionBy(F.lit(0)).orderBy("seen")
    numbered = head.select("project", (F.row_number().over(order) - 1).alias("slot"))
    return projects.select("project").join(numbered, "project", "left").select(
        "project", F.coalesce("slot", F.lit(-1)).alias("slot")
    )
