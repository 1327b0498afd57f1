"""Project, session and detail marts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators.ledger import vendor_split
from ..plans import detail, projects, sessions as ps
from .bridge import ZONE, sql_day, sql_vendor
from .registry import query
from .spend import IN_30, NOW, sql_sums, RATIOS

SEEN = "min(struct_pack(s := start_ms, i := session_id))"
SUMMARY = f"""pf AS (SELECT project, family, sum(cost) AS cost, {SEEN} AS seen FROM sessions GROUP BY 1, 2),
dom AS (SELECT project, family FROM (SELECT *, row_number() OVER (PARTITION BY project
  ORDER BY cost DESC, seen) AS rn FROM pf) WHERE rn = 1),
projects AS (SELECT p.*, dom.family, CAST(cost AS DOUBLE) / greatest(1, sessions) AS avg_cost FROM (
  SELECT project, count(*) AS sessions, sum(cost) AS cost, CAST(sum(total_tokens) AS BIGINT) AS tokens,
    CAST(sum(dur_sec) AS BIGINT) AS dur_sec, max(t_ms) AS last_ms, count(DISTINCT machine) AS machines,
    {SEEN} AS seen FROM sessions GROUP BY 1) p JOIN dom USING (project))"""


@query(
    "project_summary", ["sessions"],
    f"WITH {SUMMARY} SELECT project, sessions, CAST(cost AS DOUBLE) AS cost, tokens, dur_sec, last_ms, "
    "family, machines, avg_cost FROM projects",
)
def _(b):
    return projects.project_summary(b.stored_sessions).drop("seen")


@query(
    "project_kpis", ["sessions"],
    f"""WITH {SUMMARY}, a AS (SELECT project, cost FROM projects ORDER BY cost DESC, seen LIMIT 1),
    z AS (SELECT project, sessions FROM projects ORDER BY sessions DESC, seen LIMIT 1)
    SELECT (SELECT count(*) FROM projects) AS projects, a.project AS top_project,
      CAST(a.cost AS DOUBLE) AS top_cost, z.project AS busiest_project, z.sessions AS busiest_sessions,
      (SELECT CAST(sum(cost) AS DOUBLE) / greatest(1, count(*)) FROM projects) AS avg_cost FROM a, z""",
)
def _(b):
    return projects.project_kpis(projects.project_summary(b.stored_sessions))


for _by, _k in (("cost", 5), ("cost", 10), ("tokens", 10)):

    @query(
        f"top_projects_{_by}_{_k}", ["sessions"],
        f"""WITH {SUMMARY} SELECT row_number() OVER (ORDER BY {_by} DESC, seen) AS rank, project, family,
        CAST({_by} AS {'DOUBLE' if _by == 'cost' else 'BIGINT'}) AS value,
        CAST({_by} AS DOUBLE) / CAST(max({_by}) OVER () AS DOUBLE) AS share_of_top
        FROM projects ORDER BY {_by} DESC, seen LIMIT {_k}""",
    )
    def _(b, by=_by, k=_k):
        return projects.top_projects(projects.project_summary(b.stored_sessions), by, k)


@query(
    "top_sessions", ["sessions"],
    f"""SELECT session_id, project, slug, primary_model, CAST(cost AS DOUBLE) AS cost FROM sessions
    WHERE {IN_30} ORDER BY sessions.cost DESC, start_ms, session_id LIMIT 10""",
)
def _(b):
    return projects.top_sessions(ps.period_filter(b.sessions, NOW))


@query(
    "concentration", ["sessions"],
    f"""WITH {SUMMARY}, r AS (SELECT *, row_number() OVER (ORDER BY cost DESC, seen) AS rank FROM projects),
    t AS (SELECT sum(cost) AS total, count(*) AS n FROM projects)
    SELECT rank, project, family, 1 AS projects, CAST(cost AS DOUBLE) AS cost,
      CAST(cost AS DOUBLE) / CAST(total AS DOUBLE) AS share FROM r, t WHERE rank <= 3
    UNION ALL SELECT 4, 'Other projects', NULL, count(*), coalesce(CAST(sum(cost) AS DOUBLE), 0),
      coalesce(CAST(sum(cost) AS DOUBLE), 0) / (SELECT CAST(total AS DOUBLE) FROM t) FROM r WHERE rank > 3""",
)
def _(b):
    return projects.concentration(projects.project_summary(b.stored_sessions))


@query(
    "project_family_matrix", ["sessions"],
    f"""WITH {SUMMARY}, fam AS (SELECT family, cost, CASE WHEN n > 4 AND rnk > 3 THEN 'Other' ELSE family END AS series
      FROM (SELECT *, row_number() OVER (ORDER BY cost DESC, seen) AS rnk, count(*) OVER () AS n FROM (
      SELECT family, sum(cost) AS cost, {SEEN} AS seen FROM sessions GROUP BY 1))),
    feet AS (SELECT series, CAST(sum(cost) AS DOUBLE) / greatest(1.0::DOUBLE,
      (SELECT CAST(sum(cost) AS DOUBLE) FROM fam)) AS family_share FROM fam GROUP BY 1),
    top AS (SELECT project, cost AS project_cost, family AS dominant FROM projects ORDER BY cost DESC, seen LIMIT 7),
    cells AS (SELECT project, series, project_cost, dominant, sum(pf.cost) AS cost
      FROM pf JOIN top USING (project) JOIN fam USING (family) GROUP BY ALL)
    SELECT project, series AS family, CAST(project_cost AS DOUBLE) AS project_cost, dominant,
      CAST(cost AS DOUBLE) AS cost, family_share,
      CAST(cost AS DOUBLE) / greatest(1.0::DOUBLE, CAST(max(cost) OVER () AS DOUBLE)) AS cell_share
    FROM cells JOIN feet USING (series) QUALIFY cost <> 0""",
)
def _(b):
    return projects.project_family_matrix(b.stored_sessions)


@query(
    "project_table", ["sessions"],
    f"WITH {SUMMARY} SELECT project, sessions, CAST(cost AS DOUBLE) AS cost, tokens, avg_cost, dur_sec, "
    "family, machines, last_ms FROM projects",
)
def _(b):
    return projects.project_table(projects.project_summary(b.stored_sessions), "avg_cost", False)


MATCH = """(contains(lower(slug), 'sol') OR contains(lower(session_id), 'sol') OR contains(lower(project), 'sol')
  OR contains(lower(machine), 'sol') OR contains(lower(provider), 'sol')
  OR len(list_filter(models, lambda m: contains(lower(m), 'sol'))) > 0)"""


@query(
    "session_search", ["sessions"],
    f"SELECT session_id, primary_model FROM sessions WHERE {MATCH}",
)
def _(b):
    return ps.session_search(b.sessions, " SOL ").select("session_id", "primary_model")


@query(
    "session_table", ["sessions"],
    f"""SELECT session_id, slug, project, machine, primary_model, start_ms, dur_sec, total_tokens,
    CAST(cost AS DOUBLE) AS cost FROM sessions WHERE {IN_30} AND {MATCH}""",
)
def _(b):
    return projects.session_table(ps.period_filter(b.sessions, NOW), "cost", True, "sol")


@query(
    "session_table_count", ["sessions"],
    f"""SELECT count(*) FILTER (WHERE {MATCH}) AS shown, count(*) AS "of",
    coalesce(CAST(sum(cost) FILTER (WHERE {MATCH}) AS DOUBLE), 0) AS cost FROM sessions WHERE {IN_30}""",
)
def _(b):
    return projects.session_table_count(ps.period_filter(b.stored_sessions, NOW), "sol")


# Sessions without a recorded end stand for old records without breakdowns.
VENDORS = f"""exact AS (SELECT provider, session_id, {sql_vendor('model')} AS vendor,
    CAST(sum(b.cost) AS DOUBLE) AS cost, CAST(sum(b.total_tokens) AS DOUBLE) AS tokens
  FROM breakdown b SEMI JOIN (SELECT * FROM sessions WHERE end_ms IS NOT NULL) s USING (session_id) GROUP BY ALL),
old AS (SELECT provider, session_id, unnest(vs) AS vendor, CAST(cost AS DOUBLE) / len(vs) AS cost,
    CAST(total_tokens AS DOUBLE) / len(vs) AS tokens
  FROM (SELECT *, list_distinct(list_transform(models, lambda m: {sql_vendor('m')})) AS vs
    FROM sessions WHERE end_ms IS NULL)),
vendors AS (SELECT * FROM exact UNION ALL SELECT * FROM old)"""


def _vendors(b):
    old = F.col("end_ms").isNull()
    kept = F.when(~old, F.col("model_breakdowns"))
    return vendor_split(b.stored_records.withColumn("model_breakdowns", kept))


@query("vendor_split", ["sessions", "breakdown"], f"WITH {VENDORS} SELECT * FROM vendors")
def _(b):
    return _vendors(b)


def _rollup_sql(where: str) -> str:
    arms = [f"SELECT 'all' AS section, 'all' AS key, cost, CAST(tokens AS DOUBLE) AS tokens, sessions "
            f"FROM (SELECT {sql_sums()} FROM part)"]
    for dim in ("project", "family", "provider"):
        arms.append(
            f"SELECT '{dim}', {dim}, cost, CAST(tokens AS DOUBLE), sessions "
            f"FROM (SELECT {dim}, {sql_sums()} FROM part GROUP BY 1)"
        )
    arms.append(
        "SELECT 'vendor', vendor, round(sum(v.cost), 6), round(sum(v.tokens), 3), count(*) "
        "FROM vendors v SEMI JOIN part USING (session_id) GROUP BY 2"
    )
    return f"WITH {VENDORS}, part AS (SELECT * FROM sessions WHERE {where}) " + " UNION ALL ".join(arms)


def _rounded(df):
    """Vendor shares are doubles; their sums agree to the stored places."""
    vendor = F.col("section") == "vendor"
    return df.withColumns(
        {
            "cost": F.when(vendor, F.round("cost", 6)).otherwise(F.col("cost")),
            "tokens": F.when(vendor, F.round("tokens", 3)).otherwise(F.col("tokens")),
        }
    )


@query("detail_rollup", ["sessions", "breakdown"], _rollup_sql("project = 'proj-3'"))
def _(b):
    part = detail.slice_project(b.stored_records, "proj-3")
    return _rounded(detail.detail_rollup(part, _vendors(b)))


SLICES = {
    "day": f"{sql_day('t_ms')} = DATE '2001-10-20'",
    "project": "project = 'proj-7'",
    "family": "family = 'Opus'",
    "cell": "project = 'proj-7' AND family = 'Opus'",
    "other": "project = 'proj-7' AND family NOT IN (SELECT family FROM sessions GROUP BY 1 "
             "ORDER BY sum(cost) DESC LIMIT 3)",
    "session": "session_id = 's-77'",
    "ids": "session_id IN (SELECT 's-' || o_orderkey FROM orders WHERE o_orderstatus = 'P')",
}


def _slice(b, kind):
    s = b.stored_sessions if kind == "other" else b.sessions
    if kind == "day":
        return detail.slice_day(s, date(2001, 10, 20), ZONE)
    if kind == "project":
        return detail.slice_project(s, "proj-7")
    if kind == "family":
        return detail.slice_family(s, "Opus")
    if kind in ("cell", "other"):
        return detail.slice_cell(s, "proj-7", "Opus" if kind == "cell" else "Other")
    if kind == "session":
        return detail.slice_session(s, "s-77")
    ids = b.table("orders").filter("o_orderstatus = 'P'").select(
        F.concat(F.lit("s-"), "o_orderkey").alias("session_id")
    )
    return detail.slice_ids(s, ids)


for _kind, _where in SLICES.items():

    @query(
        f"detail_slice_{_kind}", ["sessions"],
        f"SELECT session_id, t_ms, CAST(cost AS DOUBLE) AS cost FROM sessions WHERE {_where}",
    )
    def _(b, kind=_kind):
        return _slice(b, kind).select("session_id", "t_ms", "cost")


@query(
    "detail_day_summary", ["sessions"],
    f"SELECT *, {RATIOS} FROM (SELECT {sql_sums()} FROM sessions WHERE {SLICES['day']})",
)
def _(b):
    from ..plans.spend import usage_summary

    return usage_summary(_slice(b, "day"))


@query(
    "detail_recent", ["sessions"],
    f"""SELECT t_ms, session_id, primary_model, CAST(cost AS DOUBLE) AS cost FROM sessions
    WHERE {SLICES['cell']} ORDER BY t_ms DESC, start_ms, session_id LIMIT 6""",
)
def _(b):
    return detail.recent_sessions(_slice(b, "cell"))


@query(
    "detail_top_projects", ["sessions"],
    f"""SELECT key, CAST(value AS DOUBLE) AS value FROM (SELECT project AS key, sum(cost) AS value, {SEEN} AS seen
    FROM sessions WHERE {SLICES['family']} GROUP BY 1 ORDER BY 2 DESC, seen LIMIT 6)""",
)
def _(b):
    return detail.top_projects_of(_slice(b, "family"))
