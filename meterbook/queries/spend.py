"""Spend and usage marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeparts import DAY_MS
from ..plans import sessions as ps
from ..plans import spend, tokens
from ..plans.sessions import Period
from .bridge import NOW_MS, ZONE, sql_day
from .registry import query

DAYS = 30
NOW = Period.at(NOW_MS, DAYS)
START_MS = NOW_MS - DAYS * DAY_MS
IN_30 = f"t_ms BETWEEN {START_MS} AND {NOW_MS}"
PREV_30 = f"t_ms BETWEEN {START_MS - DAYS * DAY_MS} AND {START_MS}"
LAST_DAY = sql_day(str(NOW_MS))


def sql_change(cur: str, prev: str) -> tuple[str, str]:
    """Kind and value of a period change."""
    pct = f"(({cur} - {prev}) / abs({prev}) * 100.0)"
    size = (
        f"CASE WHEN abs({pct}) < 10 THEN floor(abs({pct}) * 10.0 + 0.5) / 10.0 "
        f"ELSE floor(abs({pct}) + 0.5) END"
    )
    kind = (
        f"CASE WHEN {prev} = 0 THEN 'none' WHEN {cur} / abs({prev}) >= 10 THEN 'ratio' "
        "ELSE 'percent' END"
    )
    value = (
        f"CASE WHEN {prev} = 0 THEN NULL WHEN {cur} / abs({prev}) >= 10 THEN {cur} / abs({prev}) "
        f"WHEN {pct} < 0 THEN -({size}) ELSE {size} END"
    )
    return kind, value


def sql_sums(where: str = "true") -> str:
    f = f"FILTER (WHERE {where})"
    return (
        f"coalesce(CAST(sum(cost) {f} AS DOUBLE), 0) AS cost, count(*) {f} AS sessions, "
        f"coalesce(CAST(sum(total_tokens) {f} AS BIGINT), 0) AS tokens, "
        + ", ".join(
            f"coalesce(CAST(sum({c}) {f} AS BIGINT), 0) AS {c}"
            for c in ("input", "output", "cache_write", "cache_read")
        )
    )


RATIOS = (
    "CASE WHEN sessions <> 0 THEN cost / sessions ELSE 0 END AS avg_cost, "
    "CASE WHEN tokens <> 0 THEN CAST(cache_read AS DOUBLE) / tokens ELSE 0 END AS cache_ratio"
)


@query(
    "usage_summary", ["sessions"],
    f"SELECT *, {RATIOS} FROM (SELECT {sql_sums()} FROM sessions)",
)
def _(b):
    return spend.usage_summary(b.sessions)


@query(
    "period_filter", ["sessions"],
    """SELECT session_id, t_ms, CAST(cost AS DOUBLE) AS cost FROM sessions
    WHERE t_ms BETWEEN (SELECT max(t_ms) FROM sessions) - 90 * CAST(86400000 AS BIGINT)
      AND (SELECT max(t_ms) FROM sessions)""",
)
def _(b):
    period = Period.of(b.stored_sessions, "90d")
    return ps.period_filter(b.stored_sessions, period).select("session_id", "t_ms", "cost")


@query(
    "previous_period", ["sessions"],
    f"SELECT session_id, t_ms, CAST(cost AS DOUBLE) AS cost FROM sessions WHERE {PREV_30}",
)
def _(b):
    return ps.previous_period(b.sessions, NOW).select("session_id", "t_ms", "cost")


def _comparison_sql() -> str:
    def side(p, where):
        return f"SELECT *, {RATIOS} FROM (SELECT {sql_sums(where)} FROM sessions)"

    names = ["cost", "sessions", "tokens", "input", "output", "cache_write", "cache_read",
             "avg_cost", "cache_ratio"]
    cols = [f"c.{n} AS cur_{n}, p.{n} AS prev_{n}" for n in names]
    for n in ("cost", "sessions", "tokens", "avg_cost"):
        kind, value = sql_change(f"CAST(c.{n} AS DOUBLE)", f"CAST(p.{n} AS DOUBLE)")
        cols.append(f"{kind} AS {n}_kind, {value} AS {n}_change")
    return (
        f"SELECT {', '.join(cols)} FROM ({side('cur', IN_30)}) c, ({side('prev', PREV_30)}) p"
    )


@query("period_comparison", ["sessions"], _comparison_sql())
def _(b):
    return spend.period_comparison(b.sessions, NOW)


@query(
    "snapshot_meta", ["sessions"],
    """SELECT count(*) AS sessions, count(DISTINCT project) AS projects,
    count(DISTINCT machine) AS machines, CAST(CAST(sum(cost) AS DECIMAL(28,2)) AS DOUBLE) AS total_cost,
    min(start_ms) AS from_ms, max(start_ms) AS to_ms FROM sessions""",
)
def _(b):
    return ps.snapshot_meta(b.sessions)


SPAN = DAYS * DAY_MS


def _buckets_sql(n: int, where: str = "true") -> str:
    width = f"({SPAN} / {n}.0::DOUBLE)"
    return f"""SELECT g.i, {START_MS} + g.i * {width} AS start_ms,
    {START_MS} + (g.i + 1) * {width} AS end_ms, coalesce(CAST(cost AS DOUBLE), 0) AS cost,
    coalesce(sessions, 0) AS sessions, coalesce(tokens, 0) AS tokens
    FROM (SELECT unnest(range({n})) AS i) g LEFT JOIN (
      SELECT least(greatest(floor((t_ms - {START_MS}) / {width}), 0), {n - 1}) AS i,
        sum(cost) AS cost, count(*) AS sessions, CAST(sum(total_tokens) AS BIGINT) AS tokens
      FROM sessions WHERE {where} GROUP BY 1) s ON s.i = g.i"""


@query("interval_buckets", ["sessions"], _buckets_sql(24))
def _(b):
    # Sessions outside the period fall into the first and last slice.
    return spend.interval_buckets(b.sessions, NOW, 24)


@query(
    "interval_families", ["sessions"],
    f"""SELECT CAST(least(greatest(floor((t_ms - {START_MS}) / ({SPAN} / 24.0::DOUBLE)), 0), 23) AS BIGINT) AS i,
    family, CAST(sum(cost) AS DOUBLE) AS cost FROM sessions WHERE {IN_30} GROUP BY ALL""",
)
def _(b):
    return spend.interval_families(ps.period_filter(b.sessions, NOW), NOW, 24)


@query(
    "cadence", ["sessions"],
    f"""SELECT *, CAST(sessions AS DOUBLE) / greatest(1, max(sessions) OVER ()) AS activity,
    sessions = greatest(1, max(sessions) OVER ()) AS hot FROM (
    {_buckets_sql(30, IN_30)})""",
)
def _(b):
    return spend.cadence(b.sessions, NOW)


def _days_sql(count: int, where: str = "true") -> str:
    return f"""SELECT strftime(g.day, '%Y-%m-%d') AS day, coalesce(s.cost, 0) AS cost,
      coalesce(s.sessions, 0) AS sessions, coalesce(s.tokens, 0) AS tokens,
      coalesce(s.input, 0) AS input, coalesce(s.output, 0) AS output,
      coalesce(s.cache_write, 0) AS cache_write, coalesce(s.cache_read, 0) AS cache_read
    FROM (SELECT CAST(unnest(generate_series({LAST_DAY} - INTERVAL {count - 1} DAY, {LAST_DAY}::TIMESTAMP,
      INTERVAL 1 DAY)) AS DATE) AS day) g
    LEFT JOIN (SELECT {sql_day('t_ms')} AS day, {sql_sums()} FROM sessions WHERE {where} GROUP BY 1) s
      ON s.day = g.day"""


@query("calendar_days", ["sessions"], _days_sql(45))
def _(b):
    return spend.calendar_days(b.sessions, F.lit(NOW_MS), 45, ZONE)


@query("daily_usage", ["sessions"], _days_sql(30, IN_30))
def _(b):
    return spend.daily_usage(b.sessions, NOW, ZONE)


def _heat_sql() -> str:
    first = f"({LAST_DAY} - 29)"
    age = f"greatest(365, date_diff('day', (SELECT {sql_day('min(t_ms)')} FROM sessions), {LAST_DAY}) + 1)"
    return f"""WITH days AS (SELECT g.day, coalesce(s.cost, 0) AS cost, coalesce(s.sessions, 0) AS sessions
      FROM (SELECT {LAST_DAY} - CAST(unnest(range({age})) AS INTEGER) AS day) g
      LEFT JOIN (SELECT {sql_day('t_ms')} AS day, sum(cost) AS cost, count(*) AS sessions
        FROM sessions GROUP BY 1) s ON s.day = g.day),
    heat AS (SELECT day, CAST(cost AS DOUBLE) AS cost, sessions,
      CASE WHEN cost = 0 THEN 0 WHEN r < 0.18 THEN 1 WHEN r < 0.4 THEN 2 WHEN r < 0.7 THEN 3 ELSE 4 END AS level,
      CASE WHEN day >= {first} THEN 'current' WHEN day >= {first} - 30 THEN 'prior' ELSE 'outside' END AS tag,
      top > 0 AND day = min(CASE WHEN cost = top THEN day END) OVER () AS peak
      FROM (SELECT *, CAST(cost AS DOUBLE) / greatest(1.0::DOUBLE, CAST(max(cost) OVER () AS DOUBLE)) AS r,
        max(cost) OVER () AS top FROM days))"""


@query(
    "spend_heatmap", ["sessions"],
    _heat_sql() + " SELECT * REPLACE (strftime(day, '%Y-%m-%d') AS day) FROM heat",
)
def _(b):
    return spend.spend_heatmap(b.stored_sessions, NOW, DAYS, ZONE)


@query(
    "heatmap_summary", ["sessions"],
    _heat_sql() + """, sides AS (SELECT
      CAST(coalesce(sum(CAST(cost AS DECIMAL(28,6))) FILTER (WHERE tag = 'current'), 0) AS DOUBLE) AS current_cost,
      CAST(coalesce(sum(CAST(cost AS DECIMAL(28,6))) FILTER (WHERE tag = 'prior'), 0) AS DOUBLE) AS prior_cost
      FROM heat)
    SELECT *, CASE WHEN prior_cost <> 0 THEN (current_cost - prior_cost) / prior_cost END AS change FROM sides""",
)
def _(b):
    return spend.heatmap_summary(spend.spend_heatmap(b.stored_sessions, NOW, DAYS, ZONE))


@query(
    "spend_by_day_family", ["sessions"],
    f"""WITH cells AS (SELECT {sql_day('t_ms')} AS day, family, sum(cost) AS cost,
      min(struct_pack(s := start_ms, i := session_id)) AS seen FROM sessions
      WHERE {IN_30} AND {sql_day('t_ms')} BETWEEN {LAST_DAY} - 29 AND {LAST_DAY} GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (ORDER BY total DESC, seen) AS rnk, count(*) OVER () AS n FROM (
      SELECT family, sum(cost) AS total, min(struct_pack(d := day, o := seen)) AS seen FROM cells GROUP BY 1))
    SELECT strftime(day, '%Y-%m-%d') AS day,
      CASE WHEN n <= 7 OR rnk <= 7 THEN family ELSE 'Other' END AS family, CAST(sum(cost) AS DOUBLE) AS cost
    FROM cells JOIN ranked USING (family) GROUP BY 1, 2 HAVING sum(cost) <> 0""",
)
def _(b):
    return spend.spend_by_day_family(b.sessions, NOW, DAYS, ZONE)


@query(
    "cumulative_spend", ["sessions"],
    f"""SELECT day, cost, CAST(sum(CAST(cost AS DECIMAL(28,6))) OVER (ORDER BY day) AS DOUBLE) AS running,
      CASE WHEN day = max(day) OVER () THEN 'end' WHEN day = min(day) OVER () THEN 'start'
        WHEN dayofweek(CAST(day AS DATE)) = 1 THEN 'week' END AS mark
    FROM ({_days_sql(30, IN_30)})""",
)
def _(b):
    return spend.cumulative_spend(b.sessions, NOW, DAYS, ZONE)


FAMILY_RANKS = """ranks AS (SELECT family, cost, row_number() OVER (ORDER BY cost DESC, seen) AS rnk,
  count(*) OVER () AS n FROM (SELECT family, sum(cost) AS cost,
  min(struct_pack(s := start_ms, i := session_id)) AS seen FROM sessions GROUP BY 1))"""


@query(
    "family_mix", ["sessions"],
    f"""WITH {FAMILY_RANKS}
    SELECT rank, family, CAST(cost AS DOUBLE) AS cost,
      CAST(cost AS DOUBLE) / greatest(1.0::DOUBLE, CAST(sum(cost) OVER () AS DOUBLE)) AS share
    FROM (SELECT CASE WHEN n > 4 AND rnk > 3 THEN 4 ELSE rnk END AS rank,
      CASE WHEN n > 4 AND rnk > 3 THEN 'Other' ELSE family END AS family, sum(cost) AS cost
      FROM ranks GROUP BY 1, 2)""",
)
def _(b):
    return spend.family_mix(b.sessions)


for _key, _name in (("machine", "cost"), ("provider", None), ("machine", None), ("family", "cost")):
    _value = "CAST(sum(cost) AS DOUBLE)" if _name else "count(*)"

    @query(
        f"group_totals_{_key}_{_name or 'sessions'}", ["sessions"],
        f"SELECT {_key} AS key, {_value} AS value FROM sessions GROUP BY 1",
    )
    def _(b, key=_key, name=_name):
        return spend.group_totals(b.sessions, key, F.col(name) if name else None)


@query(
    "spend_kpis", ["sessions"],
    f"""SELECT cost, sessions, cost / sessions AS avg_cost, active_days,
      cost / greatest(1, active_days) AS per_active_day, top.i AS top_session, top.p AS top_project,
      CAST(top.c AS DOUBLE) AS top_cost FROM (
    SELECT CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS sessions,
      count(DISTINCT {sql_day('t_ms')}) AS active_days,
      (SELECT struct_pack(i := session_id, p := project, c := cost) FROM sessions WHERE {IN_30}
       ORDER BY cost DESC, start_ms, session_id LIMIT 1) AS top
    FROM sessions WHERE {IN_30})""",
)
def _(b):
    return spend.spend_kpis(ps.period_filter(b.sessions, NOW), ZONE)


@query(
    "token_kpis", ["sessions"],
    f"""SELECT tokens, output, CAST(output AS DOUBLE) / greatest(1, tokens) AS output_share, cache_read,
      cache_ratio, tokens / cost AS tokens_per_dollar
    FROM (SELECT *, {RATIOS} FROM (SELECT {sql_sums()} FROM sessions))""",
)
def _(b):
    return tokens.token_kpis(b.sessions)


@query(
    "token_mix", ["sessions"],
    f"""SELECT kind, value, CAST(value AS DOUBLE) / greatest(1, tokens) AS share FROM (
    UNPIVOT (SELECT tokens, input, output, cache_write, cache_read FROM (SELECT {sql_sums()} FROM sessions))
    ON input, output, cache_write, cache_read INTO NAME kind VALUE value)""",
)
def _(b):
    return tokens.token_mix(b.sessions)


@query(
    "cache_by_day", ["sessions"],
    f"""SELECT day, cache_read, CAST(cache_read AS DOUBLE) / tokens AS share
    FROM ({_days_sql(30, IN_30)}) WHERE tokens > 0 ORDER BY day DESC LIMIT 10""",
)
def _(b):
    return tokens.cache_by_day(b.sessions, NOW, ZONE)


# Turns of every seventh line are left out, so some sessions fall back.
def _traffic(b, period):
    b.share_priced()
    some = b.stored_turns.filter(~F.col("turn_id").endswith("-7"))
    return tokens.token_traffic(b.stored_sessions, some, period)


def _traffic_sql(days: int, step: int) -> str:
    start = NOW_MS - days * DAY_MS
    fields = ["input", "output", "cache_write", "cache_read", "total_tokens"]
    same = " AND ".join(f"s.{f} = t.{f}" for f in fields)
    sums = ", ".join(f"CAST(sum({f}) AS BIGINT) AS {f}" for f in fields)
    cols = ", ".join(fields)
    zero = ", ".join(f"coalesce(f.{f}, 0) AS {f}" for f in [*fields, "turns", "sessions"])
    at = f"(greatest({start}, least({NOW_MS} - 1, at_ms)) // {step}) * {step}"
    return f"""WITH part_turns AS (SELECT * FROM turns WHERE turn_id NOT LIKE '%-7'),
    cur AS (SELECT * FROM sessions WHERE t_ms BETWEEN {start} AND {NOW_MS}),
    whole AS (SELECT s.session_id FROM cur s JOIN (SELECT session_id, {sums} FROM part_turns GROUP BY 1) t
      ON s.session_id = t.session_id AND {same}),
    ev AS (SELECT end_ms AS at_ms, {cols}, 1 AS turns, 0 AS sessions FROM part_turns
        WHERE session_id IN (SELECT session_id FROM whole)
      UNION ALL SELECT t_ms, {cols}, 0, 1 FROM cur
        WHERE session_id NOT IN (SELECT session_id FROM whole)),
    filled AS (SELECT {at} AS start_ms, {sums}, CAST(sum(turns) AS BIGINT) AS turns,
      CAST(sum(sessions) AS BIGINT) AS sessions FROM ev GROUP BY 1),
    traffic AS (SELECT g.start_ms, {zero} FROM (SELECT unnest(generate_series(
      CAST({start // step * step} AS BIGINT), CAST({(-(-NOW_MS // step) - 1) * step} AS BIGINT), CAST({step} AS BIGINT))) AS start_ms) g
      LEFT JOIN filled f ON f.start_ms = g.start_ms)"""


TURN_NEEDS = ["sessions", "turns"]


@query("token_traffic", TURN_NEEDS, _traffic_sql(30, 3_600_000) + " SELECT * FROM traffic")
def _(b):
    return _traffic(b, NOW)


@query("token_traffic_fine", TURN_NEEDS, _traffic_sql(14, 900_000) + " SELECT * FROM traffic")
def _(b):
    return _traffic(b, Period.at(NOW_MS, 14))


@query(
    "traffic_summary", TURN_NEEDS,
    _traffic_sql(30, 3_600_000) + """ SELECT CAST(sum(total_tokens) AS BIGINT) AS tokens,
    count(*) FILTER (WHERE total_tokens > 0) AS active,
    (SELECT start_ms FROM traffic ORDER BY total_tokens DESC, start_ms LIMIT 1) AS peak_ms,
    max(total_tokens) AS peak_tokens, CAST(sum(turns) AS BIGINT) AS turns,
    CAST(sum(sessions) AS BIGINT) AS sessions FROM traffic""",
)
def _(b):
    return tokens.traffic_summary(_traffic(b, NOW))


def sql_nice(v: str) -> str:
    p = f"pow(10.0, floor(log10({v})))"
    return (
        f"CASE WHEN {v} <= 0 THEN 1.0::DOUBLE ELSE (CASE WHEN {v}/{p} <= 1 THEN 1.0::DOUBLE "
        f"WHEN {v}/{p} <= 2 THEN 2 WHEN {v}/{p} <= 2.5 THEN 2.5 WHEN {v}/{p} <= 5 THEN 5 "
        f"WHEN {v}/{p} <= 7.5 THEN 7.5 ELSE 10 END) * {p} END"
    )


@query(
    "robust_scale", TURN_NEEDS,
    _traffic_sql(30, 3_600_000) + f""", v AS (SELECT CAST(total_tokens AS DOUBLE) AS v FROM traffic),
    s AS (SELECT greatest(1.0, max(v)) AS raw, count(*) FILTER (WHERE v > 0) AS n,
      quantile_cont(v, 0.25) FILTER (WHERE v > 0) AS q1, quantile_cont(v, 0.75) FILTER (WHERE v > 0) AS q3 FROM v),
    m AS (SELECT s.*, greatest(1.0, (SELECT max(v) FROM v WHERE v > 0 AND v <= q3 + 1.5 * (q3 - q1))) AS most FROM s),
    c AS (SELECT *, {sql_nice('most')} AS ceil_, q3 + 1.5 * (q3 - q1) AS fence FROM m),
    d AS (SELECT *, n >= 4 AND raw > fence AND raw > ceil_ * 1.5 AS broken FROM c)
    SELECT CASE WHEN broken THEN ceil_ ELSE {sql_nice('raw')} END AS max, raw AS raw_max, broken,
      CASE WHEN broken THEN (SELECT count(*) FROM v WHERE v > ceil_) ELSE 0 END AS outliers FROM d""",
)
def _(b):
    return tokens.robust_scale(_traffic(b, NOW), "total_tokens")
