"""Reconciliation and data-quality queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import quality as qc
from ..operators import reconcile as rc
from ..operators.providers import union_shapes
from .bridge import NOW_MS, sql_normalize_for
from .ledger import KEY, VERSIONS, _key, _new, _old
from .registry import query


# Several transcripts per session: one per line item of an order.
def _found(b):
    return b.raw_responses.select(
        "provider", "session_id",
        F.concat(F.lit("/data/"), "response_id", F.lit("/"), "model_raw", F.lit(".jsonl")).alias("transcript_path"),
        F.concat_ws("/", F.lit("home"), "model_raw").alias("project_path"),
        F.col("ts_ms").alias("mtime_ms"),
        F.col("input").alias("size"),
    )


FOUND = """found AS (SELECT provider, session_id, '/data/' || response_id || '/' || model_raw || '.jsonl' AS transcript_path,
  'home/' || model_raw AS project_path, ts_ms AS mtime_ms, input AS size FROM raw_responses)"""


@query(
    "newest_per_session", ["raw_responses"],
    f"""WITH {FOUND} SELECT provider, session_id, transcript_path, mtime_ms FROM (SELECT *, row_number() OVER (
      PARTITION BY provider, session_id ORDER BY mtime_ms DESC, transcript_path DESC, project_path DESC, size DESC) AS rn FROM found) WHERE rn = 1""",
)
def _(b):
    return rc.newest_per_session(_found(b)).select(
        "provider", "session_id", "transcript_path", "mtime_ms"
    )


for _name, _text, _where in (
    ("prefix", "s-12", "session_id LIKE 's-12%'"),
    ("path", "GPT-5.6-sol",
     "provider IN ('codex', 'copilot') AND contains(lower(transcript_path), 'gpt-5.6-sol') "
     "OR provider = 'opencode' AND contains(lower(project_path), 'gpt-5.6-sol')"),
    ("newest", None, "true"),
):

    @query(
        f"find_session_{_name}", ["raw_responses"],
        f"WITH {FOUND} SELECT provider, session_id, mtime_ms FROM found WHERE {_where} "
        "ORDER BY mtime_ms DESC, provider, session_id LIMIT 1",
    )
    def _(b, text=_text):
        return rc.find_session(_found(b), text).select("provider", "session_id", "mtime_ms")


@query(
    "needs_sync", ["ledger"],
    f"""WITH {VERSIONS}, src AS (SELECT provider, session_id, total_tokens || ':' || start_ms || CASE WHEN {KEY} % 4 = 0 THEN 'x' ELSE '' END AS fingerprint FROM ledger)
    SELECT s.* FROM src s WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.session_id = s.session_id
      AND o.provider = s.provider AND o.source_fingerprint = s.fingerprint)""",
)
def _(b):
    tail = F.when(F.pmod(_key(), F.lit(4)) == 0, "x").otherwise("")
    found = b.stored_ledger.select(
        "provider", "session_id", F.concat("source_fingerprint", tail).alias("fingerprint")
    )
    return rc.needs_sync(found, _old(b))


@query(
    "backfill_candidates", ["ledger"],
    f"""WITH {VERSIONS} SELECT session_id, completed_ms AS mtime_ms FROM ledger l WHERE {NOW_MS - 86400000 * 30} - completed_ms > 120000
      AND session_id <> 's-5' AND NOT EXISTS (SELECT 1 FROM old o WHERE o.session_id = l.session_id)""",
)
def _(b):
    found = b.stored_ledger.select("session_id", F.col("completed_ms").alias("mtime_ms"))
    return rc.backfill_candidates(found, _old(b), NOW_MS - 86_400_000 * 30, "s-5")


# Orders are files: some unchanged, changed, broken, new or deleted.
def _listing(b):
    k = F.col("o_orderkey")
    return b.table("orders").select(
        k, F.concat(F.lit("f"), k).alias("file"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("size"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("mtime_ms"),
    )


def _reused(b):
    rows = _listing(b)
    k = F.col("o_orderkey")
    prior = rows.filter(k % 6 != 0).select(
        "file", (F.col("size") + F.when(k % 4 == 0, 1).otherwise(0)).alias("size"), "mtime_ms",
        F.struct(k.alias("v"), F.lit("old").alias("side")).alias("record"),
    )
    files = rows.filter(k % 9 != 0)
    changed = rc.changed_files(files, prior)
    read = changed.select(
        "file", F.when(k % 5 != 0, F.struct(k.alias("v"), F.lit("new").alias("side"))).alias("record")
    )
    return rc.reuse_snapshot(files.drop("o_orderkey"), read, prior)


@query(
    "reuse_snapshot", [],
    """WITH f AS (SELECT o_orderkey AS k, 'f' || o_orderkey AS file, CAST(round(o_totalprice * 100) AS BIGINT) AS size FROM orders),
    s AS (SELECT *, k % 6 <> 0 AS had, k % 4 = 0 AS moved, k % 5 <> 0 AS ok FROM f WHERE k % 9 <> 0)
    SELECT file, CASE WHEN had AND NOT moved THEN 'reused' WHEN ok THEN 'parsed' ELSE 'failed' END AS status,
      size + CASE WHEN had AND moved AND NOT ok THEN 1 ELSE 0 END AS size,
      CASE WHEN (had AND NOT moved) OR NOT ok THEN 'old' ELSE 'new' END AS side
    FROM s WHERE (had AND NOT moved) OR ok OR had""",
)
def _(b):
    return _reused(b).select("file", "status", "size", F.col("record.side").alias("side"))


@query(
    "source_fingerprint", ["responses"],
    """WITH p AS (SELECT session_id, input || ':' || sha256(response_id || model_raw) AS part FROM responses),
    c AS (SELECT session_id, left(sha256(part), 3) AS cell, count(*) AS n, sha256(string_agg(part, chr(10) ORDER BY part)) AS h FROM p GROUP BY 1, 2)
    SELECT session_id, 'claude-usage:v1:' || CAST(sum(n) AS BIGINT) || ':' || sha256(string_agg(cell || ':' || h, chr(10) ORDER BY cell || ':' || h)) AS fingerprint
    FROM c GROUP BY 1""",
)
def _(b):
    part = F.concat_ws(":", "input", F.sha2(F.concat("response_id", "model_raw"), 256))
    parts = b.responses.select("session_id", part.alias("part"))
    return rc.fingerprint_sessions(parts, "claude-usage", "v1", ["session_id"])


@query(
    "row_fingerprint", ["responses"],
    """SELECT session_id, 'rows:v1:' || sha256(count(*) || ',' || CAST(sum(input) AS BIGINT) || ',' || CAST(sum(output) AS BIGINT) || ',' || max(ts_ms)) AS fingerprint
    FROM responses GROUP BY 1""",
)
def _(b):
    return rc.fingerprint_rows(b.responses, ["session_id"], ["input", "output"], ["ts_ms"], "rows", "v1")


@query(
    "union_providers", ["usage"],
    """SELECT provider, count(*) AS sessions, CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS DOUBLE) AS cost
    FROM usage GROUP BY 1""",
)
def _(b):
    # Each host's sessions on their own, two without a column, put together again.
    hosts = [b.usage.filter(F.col("provider") == p) for p in ("codex", "opencode", "claude", "copilot")]
    hosts[1] = hosts[1].drop("model_breakdowns")
    return union_shapes(hosts).groupBy("provider").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("total_tokens").alias("tokens"),
        F.sum("cost").alias("cost"),
    )


# Every tenth session loses its cost and every sixteenth its arithmetic.
def _worn(b):
    k = _key()
    return b.stored_sessions.withColumns(
        {
            "cost": F.when(k % 10 == 0, F.lit(0).cast("decimal(18,6)")).otherwise(F.col("cost")),
            "total_tokens": F.col("total_tokens") + F.when(k % 16 == 0, 1).otherwise(0),
        }
    )


WORN = f"""worn AS (SELECT * REPLACE (CASE WHEN {KEY} % 10 = 0 THEN 0 ELSE cost END AS cost,
  total_tokens + CASE WHEN {KEY} % 16 = 0 THEN 1 ELSE 0 END AS total_tokens) FROM sessions)"""
ZERO = """SELECT 'zero_cost' AS "check", 'yellow' AS severity, session_id AS subject, total_tokens AS n FROM worn
  WHERE total_tokens > 0 AND NOT coalesce(cost > 0, false)
  AND left(session_id, 8) NOT IN (SELECT 's-' || o_orderkey FROM orders WHERE o_orderkey % 100 = 0)"""
UNPRICED = f"""SELECT 'unpriced_model', 'yellow', provider || ':' || raw, 1 FROM (SELECT DISTINCT provider, raw FROM (
  SELECT provider, unnest(models) AS raw FROM sessions)) u WHERE NOT EXISTS (SELECT 1 FROM priced p
  WHERE p.provider = u.provider AND p.model = {sql_normalize_for('u.provider', 'u.raw')} AND p.priced)"""
QUIET = """SELECT 'quiet_machine', 'yellow', machine, date_diff('day', last, DATE '2001-11-20') FROM (
  SELECT machine, max(CAST(make_timestamp(end_ms * 1000) AS DATE)) AS last FROM sessions GROUP BY 1)
  WHERE date_diff('day', last, DATE '2001-11-20') > 14"""
SUMS = """SELECT 'token_arithmetic', 'yellow', 'ledger', count(*) FROM worn
  WHERE input + output + cache_write + cache_read <> total_tokens HAVING count(*) > 0"""
FORKED = f"""SELECT 'forked_ledger', 'red', session_id, 1 FROM sessions WHERE {KEY} % 7 = 0 AND {KEY} % 5 = 0"""
NEEDS = ["sessions", "priced"]


def _zero(b):
    k = F.col("o_orderkey")
    known = b.table("orders").filter(k % 100 == 0).select(F.concat(F.lit("s-"), k).alias("prefix"))
    return qc.check_zero_cost(_worn(b), known)


def _forked(b):
    k = _key()
    return qc.check_forked_ledgers(
        b.stored_sessions.filter(F.pmod(k, F.lit(5)) != 0), b.stored_sessions.filter(F.pmod(k, F.lit(7)) == 0)
    )


TODAY = date(2001, 11, 20)
CHECKS = {
    "check_zero_cost": (ZERO, _zero),
    "check_unpriced_models": (UNPRICED, lambda b: qc.check_unpriced_models(b.stored_sessions, b.dim_price)),
    "check_machine_recency": (QUIET, lambda b: qc.check_machine_recency(b.stored_sessions, TODAY)),
    "check_token_arithmetic": (SUMS, lambda b: qc.check_token_arithmetic(_worn(b))),
    "check_forked_ledgers": (FORKED, _forked),
}


def _columns(sql: str) -> str:
    return f'WITH {WORN}, f("check", severity, subject, n) AS ({sql}) SELECT * FROM f'


for _check, (_sql, _fn) in CHECKS.items():

    @query(_check, NEEDS, _columns(_sql))
    def _(b, fn=_fn):
        return fn(b)


ALL = " UNION ALL ".join(sql for sql, _ in CHECKS.values())


@query("health_report", NEEDS, _columns(ALL))
def _(b):
    return qc.health_report(*[fn(b) for _, fn in CHECKS.values()])


@query(
    "severity_counts", NEEDS,
    f'WITH {WORN}, f("check", severity, subject, n) AS ({ALL}) SELECT severity, count(*) AS findings FROM f GROUP BY 1',
)
def _(b):
    return qc.severity_counts(qc.health_report(*[fn(b) for _, fn in CHECKS.values()]))
