"""Timeline marts over the event-day sessions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..plans import detail, timeline as tl
from .bridge import ZONE, sql_day, sql_local
from .registry import query

WEEK = tl.calendar_window("week", date(2024, 1, 17))
MONTH = tl.calendar_window("month", date(2024, 1, 17))


def sql_day_ms(ms: str) -> str:
    t = sql_local(ms)
    return f"(hour({t}) * 3600 + minute({t}) * 60 + second({t})) * 1000"


def _segments_sql(window) -> str:
    first, last = (f"DATE '{d}'" for d in window)
    return f"""spans AS (SELECT *, total_tokens / greatest(1.0::DOUBLE, (wall_end_ms - start_ms) / 60000.0::DOUBLE) AS velocity,
      CAST(CAST(total_tokens AS HUGEINT) * 60000000000 // greatest(60000, wall_end_ms - start_ms) AS BIGINT) AS micro_velocity
      FROM (SELECT *, CASE WHEN end_ms > start_ms THEN end_ms
        ELSE start_ms + greatest(60, coalesce(dur_sec, 60)) * 1000 END AS wall_end_ms FROM wall_sessions)),
    visible AS (SELECT *, {sql_day('start_ms')} AS sd, {sql_day('wall_end_ms')} AS ed FROM spans
      WHERE {sql_day('wall_end_ms')} >= {first} AND {sql_day('start_ms')} <= {last}),
    days AS (SELECT CAST(unnest(generate_series({first}::TIMESTAMP, {last}::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day),
    cut AS (SELECT v.*, day, CASE WHEN day = sd THEN {sql_day_ms('start_ms')} ELSE 0 END AS a,
      CASE WHEN day = ed THEN {sql_day_ms('wall_end_ms')} ELSE 86400000 END AS b
      FROM visible v JOIN days ON day BETWEEN sd AND ed),
    segments AS (SELECT * EXCLUDE (a, b), a AS day_start_ms, least(b2, 86400000) AS day_end_ms FROM (
      SELECT *, CASE WHEN sd = ed AND b <= a THEN a + 60000 ELSE b END AS b2 FROM cut)
      WHERE b2 > 0 AND a < 86400000)"""


def _segments(b, window=WEEK):
    return tl.session_day_segments(tl.wall_spans(b.wall_sessions), *window, ZONE)


@query(
    "wall_span", ["wall_sessions"],
    f"WITH {_segments_sql(WEEK)} SELECT session_id, wall_end_ms, round(velocity, 6) AS velocity, "
    "micro_velocity FROM spans",
)
def _(b):
    return tl.wall_spans(b.wall_sessions).select(
        "session_id", "wall_end_ms", F.round("velocity", 6).alias("velocity"), "micro_velocity"
    )


@query(
    "calendar_window", ["wall_sessions"],
    f"WITH {_segments_sql(MONTH)} SELECT session_id, start_ms, wall_end_ms FROM visible",
)
def _(b):
    spans = tl.wall_spans(b.wall_sessions)
    return tl.overlapping(spans, *MONTH, ZONE).select("session_id", "start_ms", "wall_end_ms")


@query(
    "session_day_segments", ["wall_sessions"],
    f"WITH {_segments_sql(WEEK)} SELECT session_id, strftime(day, '%Y-%m-%d') AS day, day_start_ms, day_end_ms FROM segments",
)
def _(b):
    return _segments(b).select("session_id", "day", "day_start_ms", "day_end_ms")


SLOTS = """slots AS (SELECT s.*, g.slot FROM segments s JOIN (SELECT unnest(range(96)) AS slot) g
  ON s.day_start_ms < (g.slot + 1) * 900000 AND s.day_end_ms > g.slot * 900000)"""


@query(
    "month_slots", ["wall_sessions"],
    f"""WITH {_segments_sql(MONTH)}, {SLOTS} SELECT strftime(day, '%Y-%m-%d') AS day, slot, count(*) AS active,
    CAST(sum(micro_velocity) AS BIGINT) AS micro_velocity FROM slots GROUP BY 1, 2""",
)
def _(b):
    return tl.month_slots(_segments(b, MONTH)).groupBy("day", "slot").agg(
        F.count(F.lit(1)).alias("active"), F.sum("micro_velocity").alias("micro_velocity")
    )


@query(
    "month_bands", ["wall_sessions"],
    f"""WITH {_segments_sql(MONTH)}, {SLOTS},
    sets AS (SELECT day, slot, list(session_id ORDER BY session_id) AS ids,
      sum(micro_velocity) AS speed FROM slots GROUP BY 1, 2),
    marked AS (SELECT *, CASE WHEN lag(slot) OVER w = slot - 1 AND lag(ids) OVER w = ids THEN 0 ELSE 1 END AS opens
      FROM sets WINDOW w AS (PARTITION BY day ORDER BY slot)),
    banded AS (SELECT *, sum(opens) OVER (PARTITION BY day ORDER BY slot) AS band FROM marked)
    SELECT strftime(day, '%Y-%m-%d') AS day, min(slot) * 15 AS start_minute, max(slot) * 15 + 15 AS end_minute,
      any_value(len(ids)) AS active, CAST(any_value(speed) AS DOUBLE) / 1000000.0::DOUBLE AS velocity
    FROM banded GROUP BY day, band""",
)
def _(b):
    return tl.month_bands(_segments(b, MONTH))


@query(
    "concurrency_clusters", ["wall_sessions"],
    f"""WITH {_segments_sql(WEEK)},
    marked AS (SELECT *, CASE WHEN day_start_ms < max(day_end_ms) OVER (PARTITION BY machine, day
        ORDER BY day_start_ms, day_end_ms, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      THEN 0 ELSE 1 END AS opens FROM segments),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY machine, day
      ORDER BY day_start_ms, day_end_ms, session_id) AS cluster FROM marked)
    SELECT machine, strftime(day, '%Y-%m-%d') AS day, CAST(cluster AS BIGINT) AS cluster,
      min(day_start_ms) AS cluster_start_ms, max(day_end_ms) AS cluster_end_ms, count(*) AS segments
    FROM numbered GROUP BY 1, day, 3""",
)
def _(b):
    return tl.concurrency_clusters(_segments(b), ["machine", "day"])


# Each step places one segment: the lowest lane whose last segment has ended, else a new one.
@query(
    "concurrency_lanes", ["wall_sessions"],
    f"""WITH RECURSIVE {_segments_sql(WEEK)},
    marked AS (SELECT *, CASE WHEN day_start_ms < max(day_end_ms) OVER (PARTITION BY machine, day
        ORDER BY day_start_ms, day_end_ms, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      THEN 0 ELSE 1 END AS opens FROM segments),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY machine, day
      ORDER BY day_start_ms, day_end_ms, session_id) AS cluster FROM marked),
    o AS (SELECT *, row_number() OVER (PARTITION BY machine, day, cluster
      ORDER BY day_start_ms, day_end_ms, provider, session_id) AS k FROM numbered),
    w AS (SELECT machine, day, cluster, k, session_id, CAST(1 AS BIGINT) AS place, [day_end_ms] AS ends FROM o WHERE k = 1
      UNION ALL SELECT machine, day, cluster, k, session_id, place,
        CASE WHEN place > len(ends) THEN list_append(ends, day_end_ms)
          ELSE list_concat(list_append(ends[:place - 1], day_end_ms), ends[place + 1:]) END
      FROM (SELECT o.machine, o.day, o.cluster, o.k, o.session_id, o.day_end_ms, w.ends,
          CAST(coalesce(list_position(list_transform(w.ends, lambda e: e <= o.day_start_ms), true), len(w.ends) + 1) AS BIGINT) AS place
        FROM w JOIN o ON o.machine = w.machine AND o.day = w.day AND o.cluster = w.cluster AND o.k = w.k + 1))
    SELECT machine, strftime(day, '%Y-%m-%d') AS day, CAST(cluster AS BIGINT) AS cluster, session_id, place - 1 AS lane,
      max(place) OVER (PARTITION BY machine, day, cluster) AS lane_count FROM w""",
)
def _(b):
    return tl.concurrency_lanes(_segments(b), ["machine", "day"]).select(
        "machine", "day", "cluster", "session_id", "lane", "lane_count"
    )


@query(
    "rhythm_table", ["wall_sessions"],
    f"""WITH {_segments_sql(WEEK)}
    SELECT strftime(d.day, '%Y-%m-%d') AS day, min(day_start_ms) / 60000.0::DOUBLE AS first_minute,
      max(day_end_ms) / 60000.0::DOUBLE AS last_minute, count(DISTINCT session_id) AS sessions,
      coalesce(CAST(sum(total_tokens) AS BIGINT), 0) AS tokens, d.day > DATE '2024-01-19' AS outside
    FROM days d LEFT JOIN segments s ON s.day = d.day GROUP BY d.day""",
)
def _(b):
    return tl.rhythm_table(_segments(b), *WEEK, date(2024, 1, 19))


@query(
    "velocity_scale", ["wall_sessions"],
    f"""WITH {_segments_sql(MONTH)}, q AS (SELECT quantile_cont(ln(1 + velocity), 0.1) AS low,
      quantile_cont(ln(1 + velocity), 0.9) AS high FROM visible)
    SELECT session_id, round(CASE WHEN high > low THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE,
      (ln(1 + velocity) - low) / (high - low))) ELSE 0.5 END, 6) AS normalized FROM visible, q""",
)
def _(b):
    seen = tl.overlapping(tl.wall_spans(b.wall_sessions), *MONTH, ZONE)
    return tl.velocity_scale(seen).select(
        "session_id", F.round("normalized", 6).alias("normalized")
    )


@query(
    "velocity_bounds", ["wall_sessions"],
    f"""WITH {_segments_sql(WEEK)} SELECT round(quantile_cont(ln(1 + velocity), 0.1), 6) AS low,
      round(quantile_cont(ln(1 + velocity), 0.9), 6) AS high FROM visible""",
)
def _(b):
    seen = tl.overlapping(tl.wall_spans(b.wall_sessions), *WEEK, ZONE)
    return tl.velocity_bounds(seen).select(
        F.round("low", 6).alias("low"), F.round("high", 6).alias("high")
    )


@query(
    "series_slots", ["wall_sessions"],
    """WITH seen AS (SELECT project, min(struct_pack(r := CASE WHEN machine = 'box-1' THEN 0 ELSE 1 END,
      s := start_ms, i := session_id)) AS o FROM wall_sessions GROUP BY 1)
    SELECT project, CASE WHEN row_number() OVER (ORDER BY o) <= 4 THEN row_number() OVER (ORDER BY o) - 1
      ELSE -1 END AS slot FROM seen""",
)
def _(b):
    s = b.wall_sessions
    return tl.series_slots(s, s.filter("machine = 'box-1'"))


BAND = (date(2024, 1, 16), 840)


@query(
    "band_detail", ["wall_sessions"],
    f"""WITH {_segments_sql(WEEK)} SELECT session_id, project, primary_model, total_tokens,
      round(velocity, 6) AS velocity FROM segments WHERE day = DATE '{BAND[0]}'
      AND day_start_ms < 855 * 60000 AND day_end_ms > 840 * 60000""",
)
def _(b):
    active = tl.band_sessions(_segments(b), *BAND)
    return detail.band_detail(active).withColumn("velocity", F.round("velocity", 6))


@query(
    "band_summary", ["wall_sessions"],
    f"""WITH {_segments_sql(WEEK)} SELECT count(*) AS sessions, CAST(sum(total_tokens) AS BIGINT) AS tokens,
      CAST(sum(micro_velocity) AS DOUBLE) / 1000000.0::DOUBLE AS velocity
      FROM segments WHERE day = DATE '{BAND[0]}' AND day_start_ms < 855 * 60000 AND day_end_ms > 840 * 60000""",
)
def _(b):
    return detail.band_summary(tl.band_sessions(_segments(b), *BAND))
