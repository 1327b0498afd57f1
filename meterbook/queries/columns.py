"""Column expressions over strings and numbers built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce as cf
from ..functions import models as mf
from ..functions import money as my
from ..functions import projects as pf
from ..functions import text as xf
from ..functions import timeparts as tp
from ..operators import responses as rs
from .bridge import (
    PROVIDERS, ZONE, sql_codex, sql_family, sql_local, sql_normalize, sql_normalize_for, sql_vendor,
)
from .registry import query
from .spend import sql_change, sql_nice

BASES = [
    "claude-opus-4.8", "claude-sonnet-4-5", "claude-haiku-4-5", "gpt-5.6-sol", "gpt-5.6", "gpt-5.4-mini",
    "codex-auto-review", "claude-fable-5", "claude-3-7-sonnet", "claude-zeta-9", "gpt-6-pro", "Claude-Opus-5",
    "o4-mini", "gpt-7.1-terra", "claude-opus-4-0",
]
ENDS = ["", "-20250929", "-2026-03-05", "[1m]", "-20251001[1m]"]


def _names(b):
    """Model names with every kind of suffix, one per part."""
    base = F.element_at(F.array(*[F.lit(x) for x in BASES]), (F.col("p_partkey") % 15 + 1).cast("int"))
    end = F.element_at(F.array(*[F.lit(x) for x in ENDS]), (F.col("p_size") % 5 + 1).cast("int"))
    host = F.element_at(F.array(*[F.lit(x) for x in PROVIDERS]), (F.floor(F.col("p_partkey") / 15) % 4 + 1).cast("int"))
    own = F.when(F.col("p_partkey") % 17 == 0, F.concat_ws("-", F.lit("claude"), F.lower("p_brand"), "p_size"))
    return b.table("part").select(
        "p_partkey", host.alias("provider"), F.coalesce(own, F.concat(base, end)).alias("m")
    )


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


NAMES = f"""names AS (SELECT p_partkey, {_list(PROVIDERS)}[CAST(p_partkey // 15 % 4 AS INTEGER) + 1] AS provider,
  CASE WHEN p_partkey % 17 = 0 THEN 'claude-' || lower(p_brand) || '-' || p_size
    ELSE {_list(BASES)}[CAST(p_partkey % 15 AS INTEGER) + 1] || {_list(ENDS)}[p_size % 5 + 1] END AS m FROM part)"""


@query("normalize_model", [], f"WITH {NAMES} SELECT p_partkey, m, {sql_normalize('m')} AS model FROM names")
def _(b):
    return _names(b).select("p_partkey", "m", mf.normalize_model(F.col("m")).alias("model"))


@query(
    "normalize_model_for", [],
    f"WITH {NAMES} SELECT p_partkey, provider, m, {sql_normalize_for('provider', 'm')} AS model FROM names",
)
def _(b):
    model = mf.normalize_model_for(F.col("provider"), F.col("m"))
    return _names(b).select("p_partkey", "provider", "m", model.alias("model"))


@query("model_vendor", [], f"WITH {NAMES} SELECT p_partkey, {sql_vendor('m')} AS vendor FROM names")
def _(b):
    return _names(b).select("p_partkey", mf.model_vendor(F.col("m")).alias("vendor"))


@query("model_family", [], f"WITH {NAMES} SELECT p_partkey, {sql_family('m')} AS family FROM names")
def _(b):
    return _names(b).select("p_partkey", mf.model_family(F.col("m")).alias("family"))


def _label_sql() -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mf.DISPLAY_NAMES.items())
    words = ", ".join(f"'{w}'" for w in mf.LABEL_WORDS)
    body = (
        "regexp_replace(regexp_replace(array_to_string(rest, '-'), '(\\d)-(\\d)', '\\1.\\2', 'g'), "
        "'(\\d)-(\\d)', '\\1.\\2', 'g')"
    )
    return f"""parts AS (SELECT p_partkey, m, n, list_filter(string_split(n, '-'), lambda x: x <> '') AS ps
      FROM (SELECT *, {sql_normalize('m')} AS n FROM names)),
    labels_ AS (SELECT *, ps[2:] AS rest, CASE ps[1] WHEN 'claude' THEN 'Claude' WHEN 'gpt' THEN 'GPT' END AS host FROM parts)
    SELECT p_partkey, coalesce(CASE n {arms} END, CASE WHEN host IS NOT NULL AND len(ps) >= 2
      AND len(list_filter(rest, lambda x: NOT (regexp_full_match(x, '\\d+') OR x IN ({words})))) = 0
      THEN host || ' ' || array_to_string(list_transform(string_split(replace({body}, '-', ' '), ' '),
        lambda x: upper(x[1]) || x[2:]), ' ') END, m) AS label FROM labels_"""


@query("model_label", [], f"WITH {NAMES}, {_label_sql()}")
def _(b):
    return _names(b).select("p_partkey", mf.model_label(F.col("m")).alias("label"))


@query(
    "short_model", [],
    f"""WITH {NAMES}, v AS (SELECT p_partkey, regexp_replace(m, '\\[.*\\]$', '') AS v FROM names),
    c AS (SELECT *, string_split(regexp_replace(v, '^claude-', '', 'i'), '-') AS ps FROM v)
    SELECT p_partkey, CASE WHEN regexp_matches(v, '^gpt-([\\d.]+)-(sol|terra|luna|codex)$', 'i')
      THEN regexp_extract(v, '^gpt-([\\d.]+)-', 1) || ' ' || upper(regexp_extract(v, '-([a-z]+)$', 1))
      WHEN regexp_matches(v, '^gpt-', 'i') THEN upper(regexp_replace(v, '^gpt-', 'GPT ', 'i'))
      WHEN v = 'codex-auto-review' THEN 'AUTO REVIEW'
      ELSE upper(ps[1]) || CASE WHEN len(ps) > 1 THEN ' ' || array_to_string(ps[2:], '.') ELSE '' END END AS short FROM c""",
)
def _(b):
    return _names(b).select("p_partkey", mf.short_model(F.col("m")).alias("short"))


# Working directories of several layouts, one per order.
def _paths(b):
    k = F.col("o_orderkey")
    name, tree = F.concat(F.lit("proj-"), k % 23), F.concat(F.lit("wt-"), k % 7)
    path = (
        F.when(k % 8 == 0, F.concat(F.lit("/w/"), name, F.lit("/.claude/worktrees/"), tree))
        .when(k % 8 == 1, F.concat(F.lit("/home/u/.T3/Worktrees/"), name, F.lit("/"), tree))
        .when(k % 8 == 2, F.concat(F.lit("C:\\work\\"), name, F.lit("\\.claude\\worktrees\\"), tree, F.lit("\\src")))
        .when(k % 8 == 3, F.concat(F.lit("/home/u/.codex/worktrees/"), k % 9, F.lit("/"), name, F.lit("/")))
        .when(k % 8 == 4, F.lit(".claude/worktrees"))
        .when(k % 8 == 5, F.concat(F.lit("/h/.t3/worktrees/a/b/.claude/worktrees/"), tree))
        .when(k % 8 == 6, F.lit(""))
        .otherwise(F.concat(F.lit("/w//x/"), name))
    )
    return b.table("orders").select(k, path.alias("cwd"))


PATHS = """paths AS (SELECT o_orderkey, CASE o_orderkey % 8
    WHEN 0 THEN '/w/' || p || '/.claude/worktrees/' || t WHEN 1 THEN '/home/u/.T3/Worktrees/' || p || '/' || t
    WHEN 2 THEN 'C:\\work\\' || p || '\\.claude\\worktrees\\' || t || '\\src'
    WHEN 3 THEN '/home/u/.codex/worktrees/' || o_orderkey % 9 || '/' || p || '/' WHEN 4 THEN '.claude/worktrees'
    WHEN 5 THEN '/h/.t3/worktrees/a/b/.claude/worktrees/' || t WHEN 6 THEN '' ELSE '/w//x/' || p END AS cwd
  FROM (SELECT o_orderkey, 'proj-' || o_orderkey % 23 AS p, 'wt-' || o_orderkey % 7 AS t FROM orders))"""


@query(
    "project_from_cwd", [],
    f"""WITH {PATHS}, s AS (SELECT *, list_filter(regexp_split_to_array(cwd, '[\\\\/]+'), lambda x: x <> '') AS ps FROM paths),
    h AS (SELECT *, list_max(list_filter(range(2, len(ps) + 1), lambda i: lower(ps[i]) = 'worktrees'
      AND lower(ps[i - 1]) IN ('.claude', '.t3'))) AS i FROM s),
    w AS (SELECT *, CASE WHEN lower(ps[i - 1]) = '.claude' THEN CASE WHEN i > 2 THEN ps[i - 2] END ELSE ps[i + 1] END AS tree FROM h)
    SELECT o_orderkey, cwd, coalesce(CASE WHEN i IS NOT NULL THEN tree END, ps[-1], '') AS project,
      coalesce(CASE WHEN i IS NOT NULL THEN tree END, 'kept') AS recorded FROM w""",
)
def _(b):
    cwd = F.col("cwd")
    return _paths(b).select(
        "o_orderkey", "cwd", pf.project_from_cwd(cwd).alias("project"),
        pf.recorded_project(cwd, F.lit(" kept ")).alias("recorded"),
    )


@query(
    "ledger_key", [],
    """SELECT page_id, regexp_replace(CASE WHEN page_id % 3 > 0 THEN url
      ELSE CASE WHEN page_id % 2 = 0 THEN 'session' ELSE 'my page ' || page_id END || '-' || '2026-07-02T04:49:59Z' END,
      '[^A-Za-z0-9._-]', '_', 'g') AS key FROM pages""",
)
def _(b):
    k = F.col("page_id")
    return b.table("pages").select(
        k,
        xf.ledger_key(
            F.when(k % 3 > 0, F.col("url")).otherwise(""),
            F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("my page "), k)),
            F.lit("2026-07-02T04:49:59Z"),
        ).alias("key"),
    )


HOST = f"{_list(PROVIDERS)}[CAST((conv_id + turn) % 4 AS INTEGER) + 1]"


@query(
    "prompt_slug", [],
    f"""WITH t AS (SELECT conv_id, turn, {HOST} AS provider, lower(text) AS x, 'conv-' || conv_id || '-id' AS sid FROM conversations),
    p AS (SELECT *, array_to_string(list_filter(string_split(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')[1:6], '-') AS six,
      left(regexp_replace(regexp_replace(x, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 48) AS cut FROM t)
    SELECT conv_id, turn, provider, CASE WHEN provider = 'codex' THEN CASE WHEN six <> '' THEN six ELSE left(sid, 8) END
      WHEN cut <> '' THEN cut ELSE left(sid, 8) END AS slug FROM p""",
)
def _(b):
    host = F.element_at(
        F.array(*[F.lit(p) for p in PROVIDERS]), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int")
    )
    sid = F.concat(F.lit("conv-"), "conv_id", F.lit("-id"))
    return b.table("conversations").select(
        "conv_id", "turn", host.alias("provider"), xf.prompt_slug(host, F.col("text"), sid).alias("slug")
    )


@query(
    "prompt_preview", [],
    """SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' THEN 'No prompt available' WHEN length(text) <= 100 THEN text
      ELSE regexp_replace(left(text, 100), '^\\s+|\\s+$', '', 'g') || '...' END AS preview FROM conversations""",
)
def _(b):
    # The text goes through JSON as a message body does.
    body = F.try_parse_json(F.to_json(F.struct(F.col("text").alias("content"))))
    content = F.try_variant_get(body, "$.content", "variant")
    return b.table("conversations").select(
        "conv_id", "turn", xf.prompt_preview(xf.content_text(content)).alias("preview")
    )


@query(
    "drop_malformed", [],
    """SELECT conv_id, turn FROM conversations WHERE turn % 3 > 0""",
)
def _(b):
    # Every third line loses its last character and with it its meaning.
    line = F.to_json(F.struct("role", "text"))
    cut = F.when(F.col("turn") % 3 == 0, F.left(line, F.length(line) - 1)).otherwise(line)
    rows = b.table("conversations").select("conv_id", "turn", cut.alias("value"))
    return rs.drop_malformed(rows).select("conv_id", "turn")


RAW_NUMBERS = """raw AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN '  ' || CAST(round(o_totalprice * 100) AS BIGINT) || ' '
    WHEN 1 THEN 'abc' WHEN 2 THEN '' WHEN 3 THEN 'NaN' WHEN 4 THEN 'Infinity' WHEN 5 THEN '1e3' WHEN 6 THEN '-' || o_custkey || '.5'
    ELSE NULL END AS v FROM orders)"""


@query(
    "to_number", [],
    f"""WITH {RAW_NUMBERS} SELECT o_orderkey, CASE WHEN isfinite(coalesce(TRY_CAST(trim(v) AS DOUBLE), 0)) THEN coalesce(TRY_CAST(trim(v) AS DOUBLE), 0)
      ELSE 0 END AS n FROM raw""",
)
def _(b):
    k = F.col("o_orderkey")
    v = (
        F.when(k % 8 == 0, F.concat(F.lit("  "), F.round(F.col("o_totalprice") * 100).cast("bigint"), F.lit(" ")))
        .when(k % 8 == 1, "abc").when(k % 8 == 2, "").when(k % 8 == 3, "NaN").when(k % 8 == 4, "Infinity")
        .when(k % 8 == 5, "1e3").when(k % 8 == 6, F.concat(F.lit("-"), "o_custkey", F.lit(".5")))
    )
    return b.table("orders").select(k, cf.to_number(v).alias("n"))


@query(
    "to_models", [],
    f"""WITH {NAMES}, j AS (SELECT p_partkey, m || '; ' || m || ',, x' || CASE WHEN p_partkey % 2 = 0 THEN ';' ELSE '' END AS v FROM names)
    SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(v, '[;,]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS models FROM j""",
)
def _(b):
    tail = F.when(F.col("p_partkey") % 2 == 0, ";").otherwise("")
    v = F.concat("m", F.lit("; "), "m", F.lit(",, x"), tail)
    return _names(b).select("p_partkey", F.array_join(cf.to_models(v), "|").alias("models"))


@query(
    "duration", ["wall_sessions"],
    """SELECT session_id, d AS seconds, CASE WHEN d >= 3600 THEN (d // 3600) || 'h ' || (d // 60 % 60) || 'm'
      WHEN d >= 60 THEN (d // 60) || 'm ' || (d % 60) || 's' ELSE d || 's' END AS text
    FROM (SELECT session_id, greatest(0, (end_ms - start_ms - 40000000) // 1000) AS d FROM wall_sessions)""",
)
def _(b):
    seconds = xf.duration_seconds(F.col("start_ms") + 40_000_000, F.col("end_ms"))
    return b.wall_sessions.select(
        "session_id", seconds.alias("seconds"), xf.duration_text(seconds).alias("text")
    )


MS = "epoch_us(ts) // 1000"


@query(
    "local_parts", [],
    f"""SELECT event_id, strftime({sql_local(MS)}, '%Y-%m-%d') AS day, hour({sql_local(MS)}) AS hour,
      CAST((hour({sql_local(MS)}) * 3600 + minute({sql_local(MS)}) * 60 + second({sql_local(MS)})) * 1000 AS DOUBLE) / 60000.0::DOUBLE AS minute
    FROM events""",
)
def _(b):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return b.table("events").select(
        "event_id", tp.local_day(ms, ZONE).alias("day"), tp.local_hour(ms, ZONE).alias("hour"),
        tp.local_minute(ms, ZONE).alias("minute"),
    )


@query(
    "nice_max", [],
    f"SELECT o_orderkey, {sql_nice('v')} AS top FROM (SELECT o_orderkey, o_totalprice * (o_orderkey % 5) / 7 AS v FROM orders)",
)
def _(b):
    v = F.col("o_totalprice") * (F.col("o_orderkey") % 5) / 7
    return b.table("orders").select("o_orderkey", my.nice_max(v).alias("top"))


_KIND, _VALUE = sql_change("cur", "prev")


@query(
    "period_change", [],
    f"""SELECT o_orderkey, {_KIND} AS kind, {_VALUE} AS value FROM (SELECT o_orderkey,
      o_totalprice AS cur, CASE WHEN o_orderkey % 4 = 0 THEN 0.0::DOUBLE ELSE CAST(o_custkey * 400 + 1 AS DOUBLE) END AS prev FROM orders)""",
)
def _(b):
    prev = F.when(F.col("o_orderkey") % 4 == 0, 0.0).otherwise(
        (F.col("o_custkey") * 400 + 1).cast("double")
    )
    change = my.period_change(F.col("o_totalprice"), prev)
    return b.table("orders").select(
        "o_orderkey", change["kind"].alias("kind"), change["value"].alias("value")
    )


@query(
    "session_metadata", [],
    """WITH u AS (SELECT conv_id, min(turn) FILTER (WHERE role = 'user') AS first_user FROM conversations GROUP BY 1),
    f AS (SELECT c.conv_id, any_value(CASE WHEN length(text) <= 100 THEN text ELSE regexp_replace(left(text, 100), '^\\s+|\\s+$', '', 'g') || '...' END) AS first_prompt
      FROM conversations c JOIN u ON u.conv_id = c.conv_id AND u.first_user = c.turn GROUP BY 1)
    SELECT 'v-' || conv_id AS session_id, 1700000000000 + min(turn) * 60000 AS start_ms, 1700000000000 + max(turn) * 60000 AS end_ms,
      count(*) FILTER (WHERE role = 'user') AS user_messages, count(*) FILTER (WHERE role = 'assistant') AS assistant_messages,
      count(*) AS total_messages, coalesce(any_value(f.first_prompt), 'No prompt available') AS first_prompt
    FROM conversations LEFT JOIN f USING (conv_id) GROUP BY conv_id""",
)
def _(b):
    from ..operators.claude import claude_metadata

    at = F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("turn") * 60_000)
    body = F.try_parse_json(F.to_json(F.struct(F.col("text").alias("content"))))
    records = b.table("conversations").select(
        F.lit("claude").alias("provider"),
        F.concat(F.lit("v-"), "conv_id").alias("session_id"),
        F.lit(True).alias("is_main"),
        F.col("role").alias("type"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit("").alias("slug"), F.lit("").alias("cwd"), F.lit("").alias("gitBranch"),
        F.struct(F.try_variant_get(body, "$.content", "variant").alias("content")).alias("message"),
        F.struct("turn").alias("ord"),
    )
    return claude_metadata(records).select(
        "session_id", "start_ms", "end_ms", "user_messages", "assistant_messages",
        "total_messages", "first_prompt",
    )
