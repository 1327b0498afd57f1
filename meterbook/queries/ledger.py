"""Pricing, folding and ledger queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import codex as cx
from ..operators import ledger as lg
from ..operators import opencode as oc
from ..operators import pricing as pr
from ..operators import responses as rs
from ..operators.breakdown import model_breakdown, session_usage, turn_models
from ..session import checkpoint_root, staged
from ..sources.feed import rates_from_entries
from .bridge import RESPONSE_ORDER, sql_codex, sql_normalize, sql_normalize_for, sql_usd, sql_vendor
from .registry import query

COUNTS = "input, output, cache_write, cache_read"


@query(
    "claude_responses", ["responses"],
    f"SELECT provider, session_id, response_id, ts_ms, model, {COUNTS} FROM responses",
)
def _(b):
    return b.responses.select(
        "provider", "session_id", "response_id", "ts_ms", "model", *rs.COUNTS
    )


@query(
    "price_responses", ["priced"],
    "SELECT session_id, response_id, model, is_long, speed_x10, priced, CAST(cost_units AS DOUBLE) AS cost_units FROM priced",
)
def _(b):
    return b.priced.select(
        "session_id", "response_id", "model", "is_long", "speed_x10", "priced",
        F.col("cost_units").cast("double").alias("cost_units"),
    )


@query(
    "long_context_rates", ["priced"],
    f"""SELECT provider, model, count(*) FILTER (WHERE is_long) AS long_requests, count(*) AS requests,
    CAST({sql_usd('sum(CASE WHEN is_long THEN cost_units ELSE 0 END)')} AS DOUBLE) AS long_cost
    FROM priced GROUP BY 1, 2""",
)
def _(b):
    from ..functions.money import to_usd, units_sum

    long = F.when(F.col("is_long"), F.col("cost_units")).otherwise(0)
    return b.priced.groupBy("provider", "model").agg(
        F.count_if("is_long").alias("long_requests"), F.count(F.lit(1)).alias("requests"),
        to_usd(units_sum(long)).alias("long_cost"),
    )


@query(
    "speed_multiplier", ["priced"],
    f"""SELECT provider, model, speed, speed_x10, count(*) AS requests,
    CAST({sql_usd('sum(cost_units)')} AS DOUBLE) AS cost FROM priced GROUP BY ALL""",
)
def _(b):
    from ..functions.money import to_usd, units_sum

    return b.priced.groupBy("provider", "model", "speed", "speed_x10").agg(
        F.count(F.lit(1)).alias("requests"), to_usd(units_sum(F.col("cost_units"))).alias("cost")
    )


@query(
    "unknown_models", ["priced"],
    "SELECT DISTINCT provider, model FROM priced WHERE NOT priced",
)
def _(b):
    return pr.unknown_models(b.responses, b.dim_price)


# A feed built from the part table: every brand and size names a model.
FEED_KEYS = "CASE WHEN p_size % 10 = 0 THEN 'x/' ELSE '' END || CASE p_partkey % 4 WHEN 0 THEN 'claude-nova-' WHEN 1 THEN 'gpt-' WHEN 2 THEN 'claude-opus-' ELSE 'Tide-' END || p_size"


def _feed_entries(b):
    part = b.table("part")
    size, key = F.col("p_size"), F.col("p_partkey")
    name = F.concat(
        F.when(size % 10 == 0, "x/").otherwise(""),
        F.element_at(
            F.array(F.lit("claude-nova-"), F.lit("gpt-"), F.lit("claude-opus-"), F.lit("Tide-")),
            (key % 4 + 1).cast("int"),
        ),
        size,
    )
    price = F.col("p_retailprice")
    entry = F.struct(
        F.when(key % 5 == 0, "bedrock").when(key % 2 == 0, "anthropic").otherwise("openai")
        .alias("litellm_provider"),
        F.when(key % 7 == 0, "image").otherwise("chat").alias("mode"),
        F.format_string("%.0fe-8", price).alias("input_cost_per_token"),
        F.when(key % 11 != 0, F.format_string("%.0fe-7", price)).alias("output_cost_per_token"),
        F.when(key % 3 == 0, F.format_string("%.0fe-9", price)).alias("cache_creation_input_token_cost"),
        F.when(key % 3 == 1, F.lit("-1")).alias("cache_read_input_token_cost"),
    )
    return part.select(F.concat_ws("-2025-01-", name, F.lpad(size.cast("string"), 2, "0")).alias("key"), entry.alias("e"), key)


FEED_SQL = f"""feed_raw AS (SELECT {FEED_KEYS} || '-2025-01-' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS key, p_partkey AS k,
    CASE WHEN p_partkey % 5 = 0 THEN 'bedrock' WHEN p_partkey % 2 = 0 THEN 'anthropic' ELSE 'openai' END AS host,
    CAST(round(p_retailprice) AS DECIMAL(18,6)) AS price FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0),
  feed_ok AS (SELECT {sql_normalize('lower(key)')} AS model, key, price / 100 AS input, price / 10 AS output,
    CASE WHEN k % 3 = 0 THEN price / 1000 WHEN host = 'anthropic' THEN price / 100 * 1.25 ELSE price / 100 END AS w,
    CASE WHEN host = 'anthropic' THEN price / 1000 ELSE price / 100 END AS r
    FROM feed_raw WHERE host <> 'bedrock' AND NOT contains(key, '/')),
  feed AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY key, input, output, w, r) AS rn FROM feed_ok) WHERE rn = 1)"""


@query(
    "scan_price_feed", [],
    f"""WITH {FEED_SQL} SELECT model, round(CAST(input AS DOUBLE), 6) AS input, round(CAST(output AS DOUBLE), 6) AS output,
    round(CAST(w AS DOUBLE), 6) AS cache_write, round(CAST(r AS DOUBLE), 6) AS cache_read FROM feed""",
)
def _(b):
    feed = rates_from_entries(_feed_entries(b))
    return feed.select(
        "model",
        *[F.round(F.col(c).cast("double"), 6).alias(c)
          for c in ("input", "output", "cache_write", "cache_read")],
    )


@query(
    "build_dim_price", ["dim_price"],
    f"""WITH {FEED_SQL}, extra AS (SELECT unnest(['shared', 'openai']) AS view, model, 'feed' AS origin,
      CAST(round(CAST(input AS DOUBLE) * 1000000) AS BIGINT) AS rate_input,
      CAST(round(CAST(output AS DOUBLE) * 1000000) AS BIGINT) AS rate_output,
      CAST(round(CAST(w AS DOUBLE) * 1000000) AS BIGINT) AS rate_write,
      CAST(round(CAST(r AS DOUBLE) * 1000000) AS BIGINT) AS rate_read, 10 AS fast_x10 FROM feed)
    SELECT view, model, origin, rate_input, rate_output, rate_write, rate_read, fast_x10 FROM dim_price
    UNION ALL SELECT * FROM extra e WHERE NOT EXISTS (SELECT 1 FROM dim_price d WHERE d.view = e.view AND d.model = e.model)""",
)
def _(b):
    dim = pr.build_dim_price(b.spark, rates_from_entries(_feed_entries(b)))
    return dim.select(
        "view", "model", "origin", "rate_input", "rate_output", "rate_write", "rate_read", "fast_x10"
    )


# The price list with the feed of the part table, its aliases and its threshold.
@query(
    "price_version", ["dim_price"],
    f"""WITH {FEED_SQL}, extra AS (SELECT unnest(['shared', 'openai']) AS view, model,
      CAST(round(CAST(input AS DOUBLE) * 1000000) AS BIGINT) AS rate_input,
      CAST(round(CAST(output AS DOUBLE) * 1000000) AS BIGINT) AS rate_output,
      CAST(round(CAST(w AS DOUBLE) * 1000000) AS BIGINT) AS rate_write,
      CAST(round(CAST(r AS DOUBLE) * 1000000) AS BIGINT) AS rate_read FROM feed),
    e AS (SELECT concat_ws(':', view, model, """
    + ", ".join(f"coalesce(CAST({k}_{r} AS VARCHAR), '-')" for k in ("rate", "long")
                for r in ("input", "output", "write", "read"))
    + f""", CAST(fast_x10 AS VARCHAR)) AS e FROM dim_price UNION ALL
      SELECT concat_ws(':', view, model, rate_input, rate_output, rate_write, rate_read, '-', '-', '-', '-', 10)
      FROM extra x WHERE NOT EXISTS (SELECT 1 FROM dim_price d WHERE d.view = x.view AND d.model = x.model)),
    c AS (SELECT left(sha256(e), 3) AS cell, sha256(string_agg(e, '|' ORDER BY e)) AS h FROM e GROUP BY 1)
    SELECT left(sha256('{pr.rule_text()}' || '|' || string_agg(cell || ':' || h, '|' ORDER BY cell)), 16) AS price_version FROM c""",
)
def _(b):
    return pr.price_version(pr.build_dim_price(b.spark, rates_from_entries(_feed_entries(b))))


# Host-reported costs: credits for copilot, dollars for opencode.
@query(
    "native_cost", ["responses", "breakdown"],
    """SELECT session_id, model, CAST(coalesce(CASE provider
      WHEN 'copilot' THEN coalesce(CASE WHEN aiu > 0 THEN CAST(CAST(aiu AS DECIMAL(24,0)) * CAST(0.00000000001 AS DECIMAL(11,11)) AS DECIMAL(18,6)) END, CASE WHEN priced THEN cost END)
      WHEN 'opencode' THEN coalesce(CASE WHEN priced THEN cost END, CASE WHEN host > 0 THEN CAST(host AS DECIMAL(18,6)) END)
      ELSE CASE WHEN priced THEN cost END END, 0) AS DOUBLE) AS cost,
      CASE provider WHEN 'copilot' THEN NOT (aiu > 0 OR priced) WHEN 'opencode' THEN NOT (priced OR host > 0)
        ELSE NOT priced END AS unknown
    FROM breakdown JOIN (SELECT session_id, model, CAST(sum(CASE WHEN cache_write > 1000 THEN output * 1000 ELSE 0 END) AS BIGINT) AS aiu,
      CAST(sum(CASE WHEN cache_write > 2000 THEN input ELSE 0 END) AS DECIMAL(18,0)) / 1000 AS host
      FROM responses GROUP BY 1, 2) USING (session_id, model)""",
)
def _(b):
    host = b.responses.groupBy("session_id", "model").agg(
        F.sum(F.when(F.col("cache_write") > 1000, F.col("output") * 1000).otherwise(0))
        .alias("host_nano_aiu"),
        (F.sum(F.when(F.col("cache_write") > 2000, F.col("input")).otherwise(0)).cast("decimal(18,0)")
         / 1000).alias("host_cost"),
    )
    return pr.native_cost(b.breakdown.join(host, ["session_id", "model"])).select(
        "session_id", "model", "cost", "unknown"
    )


@query(
    "model_breakdown", ["breakdown"],
    f"SELECT session_id, model, {COUNTS}, total_tokens, CAST(cost AS DOUBLE) AS cost FROM breakdown",
)
def _(b):
    return b.breakdown.select("session_id", "model", *rs.COUNTS, "total_tokens", "cost")


@query(
    "session_usage", ["usage"],
    f"""SELECT provider, session_id, {COUNTS}, total_tokens, CAST(cost AS DOUBLE) AS cost,
    array_to_string(models, ';') AS models FROM usage""",
)
def _(b):
    return b.usage.select(
        "provider", "session_id", *rs.COUNTS, "total_tokens", "cost",
        F.array_join("models", ";").alias("models"),
    )


@query(
    "turn_usage", ["turns"],
    f"SELECT session_id, turn_id, start_ms, end_ms, {COUNTS}, total_tokens, CAST(cost AS DOUBLE) AS cost FROM turns",
)
def _(b):
    return b.turns.select(
        "session_id", "turn_id", "start_ms", "end_ms", *rs.COUNTS, "total_tokens", "cost"
    )


@query(
    "turn_models", ["priced"],
    f"""SELECT session_id, response_id AS turn_id, model, {sql_vendor('model')} AS vendor,
    CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output,
    CAST({sql_usd('sum(cost_units)')} AS DOUBLE) AS cost FROM priced GROUP BY ALL""",
)
def _(b):
    parts = turn_models(b.priced.withColumn("turn_id", F.col("response_id")))
    return parts.select("session_id", "turn_id", "model", "vendor", "input", "output", "cost")


@query(
    "drop_zero_usage", ["usage"],
    """SELECT session_id, total_tokens FROM usage WHERE CAST(substr(session_id, 3) AS BIGINT) % 5 <> 0""",
)
def _(b):
    # Every fifth session has billed responses without a single token.
    key = F.substr("session_id", F.lit(3)).cast("bigint")
    counts = [F.when(F.pmod(key, F.lit(5)) == 0, 0).otherwise(F.col(c)).alias(c) for c in (*rs.COUNTS, "cost_units")]
    rest = [c for c in b.priced.columns if c not in (*rs.COUNTS, "cost_units")]
    emptied = session_usage(model_breakdown(b.priced.select(*rest, *counts), ["ts_ms", "response_id"]))
    return rs.drop_zero_usage(emptied).select("session_id", "total_tokens")


ISO = "strftime(make_timestamp({} * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


@query(
    "ledger_row", ["usage", "sessions"],
    f"""SELECT provider, session_id, slug AS session_slug, project, branch, cwd, machine,
    {ISO.format('start_ms')} AS start_time, {ISO.format('last')} AS end_time, {ISO.format('last')} AS timestamp,
    (last - start_ms) // 1000 AS duration_seconds,
    CASE WHEN d >= 3600 THEN (d // 3600) || 'h ' || (d // 60 % 60) || 'm'
      WHEN d >= 60 THEN (d // 60) || 'm ' || (d % 60) || 's' ELSE d || 's' END AS duration_human,
    input AS input_tokens, output AS output_tokens, cache_write AS cache_creation_tokens,
    cache_read AS cache_read_tokens, total_tokens, CAST(cost AS DOUBLE) AS total_cost_usd,
    array_to_string(models, ';') AS models, total_tokens || ':f' AS source_fingerprint
    FROM (SELECT *, start_ms + dur_sec * 1000 AS last, dur_sec AS d FROM sessions)""",
)
def _(b):
    meta = b.sessions.select(
        "provider", "session_id", "slug", "cwd", "branch", "machine", "start_ms",
        (F.col("start_ms") + F.col("dur_sec") * 1000).alias("end_ms"),
        F.concat("total_tokens", F.lit(":f")).alias("source_fingerprint"),
    )
    return lg.ledger_row(b.usage, meta).drop("model_breakdowns").withColumn(
        "models", F.array_join("models", ";")
    )


KEY = "CAST(substr(session_id, 3) AS BIGINT)"


def _key():
    return F.substr("session_id", F.lit(3)).cast("bigint")


def _old(b):
    return b.stored_ledger.filter(F.pmod(_key(), F.lit(5)) != 0).drop("models")


def _new(b):
    k = _key()
    kind = F.pmod(k, F.lit(3))
    host = F.when(F.pmod(k, F.lit(11)) == 0, "claude").otherwise(F.col("provider"))
    shift = F.when(kind == 0, -100).when(kind == 2, 50).otherwise(0)
    price = F.when(kind == 1, F.lit("1").cast("decimal(18,6)")).when(
        kind == 2, F.lit("-0.001").cast("decimal(18,6)")
    ).otherwise(F.lit("0").cast("decimal(18,6)"))
    return (
        b.stored_ledger.filter(F.pmod(k, F.lit(7)) != 0)
        .drop("models")
        .withColumns(
            {
                "provider": host,
                "slug": F.concat(F.lit("n-"), "slug"),
                "input": F.col("input") + shift,
                "total_tokens": F.col("total_tokens") + shift,
                "cost": (F.col("cost") + price).cast("decimal(18,6)"),
                "source_fingerprint": F.concat(F.lit("n:"), "source_fingerprint"),
            }
        )
    )


VERSIONS = f"""old AS (SELECT * EXCLUDE (models) FROM ledger WHERE {KEY} % 5 <> 0),
new AS (SELECT * EXCLUDE (models) REPLACE (CASE WHEN k % 11 = 0 THEN 'claude' ELSE provider END AS provider,
  'n-' || slug AS slug, input + sh AS input, total_tokens + sh AS total_tokens,
  CAST(cost + p AS DECIMAL(18,6)) AS cost, 'n:' || source_fingerprint AS source_fingerprint) FROM (
  SELECT *, {KEY} AS k, CASE {KEY} % 3 WHEN 0 THEN -100 WHEN 2 THEN 50 ELSE 0 END AS sh,
    CASE {KEY} % 3 WHEN 1 THEN 1.0 WHEN 2 THEN -0.001 ELSE 0.0 END AS p FROM ledger WHERE {KEY} % 7 <> 0))"""
MERGED = VERSIONS + """,
merged AS (SELECT coalesce(n.session_id, o.session_id) AS session_id,
  CASE WHEN n.session_id IS NULL THEN 'untouched' WHEN o.session_id IS NULL THEN 'insert'
    WHEN n.provider = o.provider AND (n.total_tokens < o.total_tokens OR n.cost < o.cost) THEN 'preserve'
    ELSE 'replace' END AS action, o, n FROM old o FULL JOIN new n ON o.session_id = n.session_id)"""


def _merged_cols() -> str:
    def pick(c, keep):
        tests = " OR ".join(f"action = '{k}'" for k in keep)
        return f"CASE WHEN {tests} THEN o.{c} ELSE n.{c} END"

    usage, meta = ("untouched", "preserve"), ("untouched",)
    return ", ".join(
        [f"{pick(c, meta)} AS {c}" for c in ("provider", "slug", "completed_ms", "source_fingerprint")]
        + [f"{pick(c, usage)} AS {c}" for c in ("input", "output", "total_tokens")]
        + [f"CAST({pick('cost', usage)} AS DOUBLE) AS cost"]
    )


@query(
    "merge_ledger", ["ledger"],
    f"WITH {MERGED} SELECT session_id, action, {_merged_cols()} FROM merged",
)
def _(b):
    return lg.merge_ledger(_old(b), _new(b)).select(
        "session_id", "action", "provider", "slug", "completed_ms", "source_fingerprint",
        "input", "output", "total_tokens", "cost",
    )


@query(
    "merge_ledger_turns", ["ledger", "turns"],
    f"""WITH {MERGED} SELECT session_id, turn_id, t.start_ms, 'old' AS side FROM turns t JOIN merged USING (session_id)
    WHERE action IN ('untouched', 'preserve') UNION ALL
    SELECT session_id, turn_id, t.start_ms + 1, 'new' FROM turns t JOIN merged USING (session_id)
    WHERE action IN ('insert', 'replace')""",
)
def _(b):
    rows = b.stored_turns.select("session_id", "turn_id", "start_ms")
    old = rows.withColumn("side", F.lit("old"))
    new = rows.withColumns({"side": F.lit("new"), "start_ms": F.col("start_ms") + 1})
    return lg.merge_turns(old, new, lg.merge_ledger(_old(b), _new(b)))


COMBINED = VERSIONS + """, both_ AS (SELECT coalesce(s.session_id, d.session_id) AS session_id,
  CASE WHEN s.provider <> d.provider THEN 'conflict' WHEN s.session_id IS NULL THEN 'untouched' WHEN d.session_id IS NOT NULL
    AND (s.total_tokens < d.total_tokens OR s.cost < d.cost) THEN 'retained' ELSE 'copied' END AS action, s, d
  FROM new s FULL JOIN old d ON s.session_id = d.session_id)"""


def _combined(b):
    return lg.combine_ledgers(_new(b), _old(b), report_conflicts=True)


@query(
    "combine_ledgers", ["ledger"],
    f"""WITH {COMBINED} SELECT session_id, action,
      CASE WHEN action = 'copied' THEN s.slug ELSE d.slug END AS slug,
      CASE WHEN action = 'copied' THEN s.total_tokens ELSE d.total_tokens END AS total_tokens,
      CAST(CASE WHEN action = 'copied' THEN s.cost ELSE d.cost END AS DOUBLE) AS cost FROM both_""",
)
def _(b):
    return _combined(b).select("session_id", "action", "slug", "total_tokens", "cost")


@query(
    "combine_counts", ["ledger"],
    f"WITH {COMBINED} SELECT action, count(*) AS sessions FROM both_ GROUP BY 1",
)
def _(b):
    return lg.action_counts(_combined(b))


# Order rows stand for legacy CSV lines; several share a key, some have no id.
LEGACY = """csv AS (SELECT o_orderkey AS line, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 's-' || o_orderkey // 2 END AS session_id,
    'c ' || o_orderkey % 9 AS slug, strftime(o_orderdate, '%Y-%m-%d') AS end_time,
    CAST(round(o_totalprice * 100) AS BIGINT) AS total_tokens FROM orders WHERE o_orderstatus <> 'P'),
  keyed AS (SELECT *, regexp_replace(CASE WHEN session_id <> '' THEN session_id ELSE slug || '-' || end_time END,
    '[^A-Za-z0-9._-]', '_', 'g') AS key FROM csv),
  have AS (SELECT session_id AS key FROM ledger WHERE CAST(substr(session_id, 3) AS BIGINT) % 5 <> 0),
  added AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY line) AS rn FROM keyed)
    WHERE rn = 1 AND key NOT IN (SELECT key FROM have))"""


def _csv(b):
    k = F.col("o_orderkey")
    return b.table("orders").filter("o_orderstatus <> 'P'").select(
        k.alias("line"),
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("s-"), F.floor(k / 2).cast("bigint")))
        .alias("session_id"),
        F.concat(F.lit("c "), k % 9).alias("slug"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("end_time"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total_tokens"),
    )


def _have(b):
    return _old(b).withColumn("end_time", F.lit(""))


@query("import_legacy", ["ledger"], f"WITH {LEGACY} SELECT key, line, total_tokens FROM added")
def _(b):
    return lg.import_legacy(_csv(b), _have(b)).select("key", "line", "total_tokens")


@query(
    "import_counts", ["ledger"],
    f"""WITH {LEGACY} SELECT (SELECT count(*) FROM added) AS migrated,
    (SELECT count(*) FROM csv) - (SELECT count(*) FROM added) AS superseded, 0 AS malformed,
    (SELECT count(*) FROM csv WHERE session_id = '') AS without_id""",
)
def _(b):
    return lg.import_counts(_csv(b), _have(b))


@query(
    "import_check", ["ledger"],
    f"""WITH {LEGACY}, b AS (SELECT * FROM ledger WHERE CAST(substr(session_id, 3) AS BIGINT) % 5 <> 0),
    t AS (SELECT (SELECT count(*) FROM b) + (SELECT count(*) FROM added) AS n,
      CAST((SELECT sum(total_tokens) FROM b) + (SELECT sum(total_tokens) FROM added) AS BIGINT) AS total)
    SELECT n AS expected_sessions, total AS expected_total, n AS found_sessions, total AS found_total, true AS agrees FROM t""",
)
def _(b):
    """The total after an import that went through storage."""
    root = f"{checkpoint_root(b.spark).rstrip('/')}/meterbook-import/{uuid.uuid4().hex}"
    columns = ["session_id", "slug", "end_time", "total_tokens"]
    before = _have(b).select(*columns)
    before.write.parquet(root)
    lg.import_legacy(_csv(b), before).select(*columns).write.mode("append").parquet(root)
    return lg.import_check(_csv(b), before, b.spark.read.parquet(root), "total_tokens")


@query(
    "dedupe_ledger_rows", [],
    """SELECT session_id, file, total_tokens FROM (SELECT *, row_number() OVER (PARTITION BY session_id
      ORDER BY file DESC) AS rn FROM (SELECT CASE WHEN o_custkey % 10 = 0 THEN '' ELSE 's-' || o_custkey END AS session_id,
        'f' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '.json' AS file,
        CAST(round(o_totalprice * 100) AS BIGINT) AS total_tokens FROM orders))
    WHERE rn = 1 OR session_id = ''""",
)
def _(b):
    rows = b.table("orders").select(
        F.when(F.col("o_custkey") % 10 == 0, "").otherwise(F.concat(F.lit("s-"), "o_custkey"))
        .alias("session_id"),
        F.concat(F.lit("f"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(".json"))
        .alias("file"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total_tokens"),
    )
    return lg.dedupe_ledger_rows(rows)


@query(
    "branch_fill", ["sessions"],
    """WITH cur AS (SELECT '/work/proj-' || c_custkey AS cwd, 'b-' || min(c_nationkey) AS branch
      FROM customer WHERE c_custkey < 40 AND c_custkey % 3 > 0 GROUP BY 1)
    SELECT session_id, cwd, CASE WHEN s.branch IN ('', 'HEAD') AND cur.branch IS NOT NULL THEN cur.branch
      ELSE s.branch END AS branch FROM sessions s LEFT JOIN cur USING (cwd)""",
)
def _(b):
    cur = b.table("customer").filter("c_custkey < 40 AND c_custkey % 3 > 0").groupBy(
        F.concat(F.lit("/work/proj-"), "c_custkey").alias("cwd")
    ).agg(F.concat(F.lit("b-"), F.min("c_nationkey")).alias("branch"))
    return lg.branch_fill(b.sessions.select("session_id", "cwd", "branch"), cur)


# Codex-shaped events: line items of a supplier form one session.
def _codex_events(b):
    ret = F.col("l_returnflag")
    whole = lambda c: F.round(c).cast("bigint")
    usage = F.struct(
        whole(F.col("l_quantity")).alias("input_tokens"),
        F.col("l_linenumber").cast("bigint").alias("cached_input_tokens"),
        whole(F.col("l_discount") * 100).alias("cache_write_tokens"),
        F.lit(None).cast("bigint").alias("output_tokens"),
        F.lit(None).cast("bigint").alias("reasoning_output_tokens"),
        F.lit(None).cast("bigint").alias("total_tokens"),
    )
    return b.table("lineitem").select(
        F.lit("codex").alias("provider"),
        F.concat(F.lit("c-"), "l_suppkey").alias("session_id"),
        rs.usage_key(F.when(ret != "N", usage)).alias("usage_key"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts_ms"),
        "l_orderkey", "l_partkey", "l_linenumber",
        whole(F.col("l_extendedprice") * 100).alias("price"),
    )


@query(
    "codex_dedupe", [],
    """WITH ev AS (SELECT 'c-' || l_suppkey AS session_id, CASE WHEN l_returnflag <> 'N' THEN
      CAST(round(l_quantity) AS BIGINT) || ':' || l_linenumber || ':' || CAST(round(l_discount * 100) AS BIGINT) || ':0:0:0' END AS usage_key,
      epoch_ms(l_shipdate) AS ts_ms, l_orderkey, l_partkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS price FROM lineitem)
    SELECT session_id, usage_key, ts_ms, l_orderkey, price FROM (SELECT *, row_number() OVER (PARTITION BY session_id, usage_key
      ORDER BY ts_ms, l_orderkey, l_partkey, l_linenumber, price) AS rn FROM ev) WHERE rn = 1 OR usage_key IS NULL""",
)
def _(b):
    order = ["ts_ms", "l_orderkey", "l_partkey", "l_linenumber", "price"]
    return rs.dedupe_codex(_codex_events(b), order).select(
        "session_id", "usage_key", "ts_ms", "l_orderkey", "price"
    )


@query(
    "codex_token_split", [],
    """SELECT a, c, w, CAST(count(*) AS BIGINT) AS n, CAST(sum(t - least(t, greatest(0, c)) - least(t - least(t, greatest(0, c)), greatest(0, w))) AS BIGINT) AS input,
      CAST(sum(least(t - least(t, greatest(0, c)), greatest(0, w))) AS BIGINT) AS cache_write,
      CAST(sum(least(t, greatest(0, c))) AS BIGINT) AS cache_read
    FROM (SELECT *, greatest(0, a) AS t FROM (SELECT CAST(round(l_quantity * 100) AS BIGINT) - 500 AS a,
      l_partkey % 60 * 100 - 1000 AS c, l_suppkey % 20 * 100 - 300 AS w FROM lineitem)) GROUP BY 1, 2, 3""",
)
def _(b):
    rows = b.table("lineitem").select(
        (F.round(F.col("l_quantity") * 100).cast("bigint") - 500).alias("a"),
        (F.col("l_partkey") % 60 * 100 - 1000).alias("c"),
        (F.col("l_suppkey") % 20 * 100 - 300).alias("w"),
    )
    split = rs.codex_token_split(F.col("a"), F.col("c"), F.col("w"))
    return rows.withColumns(split).groupBy("a", "c", "w").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in split]
    )


# Rollout lines: each supplier is a session, line numbers pick the record kind.
ORDER = ["ts_ms", "l_orderkey", "l_partkey", "l_linenumber", "price"]


def _rollout(b):
    n = F.col("l_linenumber")
    at = F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd")
    model = F.concat(F.lit("m-"), F.col("l_partkey") % 6)
    flags = b.table("lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"),
        F.concat(F.lit("c-"), "l_suppkey").alias("session_id"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts_ms"),
        F.when(n == 1, "context").when(n == 2, "settings").when(n == 3, "meta")
        .when(n == 4, "other").otherwise("usage").alias("kind"),
        F.when((n <= 2) & (F.col("l_partkey") % 2 == 0), model).alias("declared"),
        F.when((n == 2) & (F.col("l_partkey") % 3 == 0), F.when(F.col("l_partkey") % 2 == 0, "fast").otherwise("flex"))
        .alias("tier_set"),
        F.when((n == 1) & (F.col("l_partkey") % 4 > 0), F.concat(F.lit("t-"), F.col("l_orderkey") % 50))
        .alias("context_id"),
        F.when(F.col("l_returnflag") != "A", at).alias("at"),
        F.round(F.col("l_quantity")).cast("bigint").alias("tokens"),
    )
    return flags.dropDuplicates(ORDER + ["session_id"]).withColumn(
        "chunk", F.date_format(F.timestamp_millis("ts_ms"), "yyyy")
    )


ROLLOUT = """roll AS (SELECT DISTINCT ON (session_id, ts_ms, l_orderkey, l_partkey, l_linenumber, price) * FROM (
  SELECT l_orderkey, l_partkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
    'c-' || l_suppkey AS session_id, epoch_ms(l_shipdate) AS ts_ms,
    CASE l_linenumber WHEN 1 THEN 'context' WHEN 2 THEN 'settings' WHEN 3 THEN 'meta' WHEN 4 THEN 'other' ELSE 'usage' END AS kind,
    CASE WHEN l_linenumber <= 2 AND l_partkey % 2 = 0 THEN 'm-' || l_partkey % 6 END AS declared,
    CASE WHEN l_linenumber = 2 AND l_partkey % 3 = 0 THEN CASE WHEN l_partkey % 2 = 0 THEN 'fast' ELSE 'flex' END END AS tier_set,
    CASE WHEN l_linenumber = 1 AND l_partkey % 4 > 0 THEN 't-' || l_orderkey % 50 END AS context_id,
    CASE WHEN l_returnflag <> 'A' THEN strftime(l_shipdate, '%Y-%m-%d') END AS stamp,
    CAST(round(l_quantity) AS BIGINT) AS tokens FROM lineitem)),
state AS (SELECT *, coalesce(last_value(declared IGNORE NULLS) OVER w, first_value(declared IGNORE NULLS) OVER a, 'unknown') AS model,
    coalesce(last_value(tier_set IGNORE NULLS) OVER w, 'default') AS tier, row_number() OVER w AS pos
  FROM roll WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, l_orderkey, l_partkey, l_linenumber, price
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY session_id ORDER BY ts_ms, l_orderkey, l_partkey, l_linenumber, price
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
# Turns in SQL: an explicit id counts once, where it first opens.
TURNS = ROLLOUT + """,
opens AS (SELECT session_id, pos, context_id, stamp, context_id IS NULL OR row_number() OVER (
    PARTITION BY session_id, context_id ORDER BY pos) = 1 AS fresh FROM state WHERE kind = 'context'),
lead_ AS (SELECT session_id, min(pos) FILTER (WHERE kind = 'usage') AS u, min(pos) FILTER (WHERE kind = 'context') AS c,
    arg_min(stamp, pos) FILTER (WHERE kind = 'usage') AS dummy FROM state GROUP BY 1),
imp AS (SELECT l.session_id, l.u, s.stamp FROM lead_ l JOIN state s ON s.session_id = l.session_id AND s.pos = l.u
    WHERE l.u IS NOT NULL AND (l.c IS NULL OR l.u < l.c)),
named AS (SELECT o.session_id, o.pos, coalesce(context_id, 'turn-' || (sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (
    PARTITION BY o.session_id ORDER BY o.pos) + CASE WHEN imp.u IS NOT NULL THEN 1 ELSE 0 END)) AS turn_id, o.stamp, fresh
  FROM opens o LEFT JOIN imp ON imp.session_id = o.session_id
  UNION ALL SELECT session_id, u, 'turn-1', stamp, true FROM imp),
lined AS (SELECT s.*, last_value(n.turn_id IGNORE NULLS) OVER (PARTITION BY s.session_id ORDER BY s.pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn_id
  FROM state s LEFT JOIN named n ON n.session_id = s.session_id AND n.pos = s.pos)"""


@query(
    "codex_model_carry", [],
    f"WITH {ROLLOUT} SELECT session_id, ts_ms, l_orderkey, l_linenumber, price, model FROM state",
)
def _(b):
    return cx.codex_state(_rollout(b), ORDER).select(
        "session_id", "ts_ms", "l_orderkey", "l_linenumber", "price", "model"
    )


@query(
    "codex_tier_carry", [],
    f"""WITH {ROLLOUT} SELECT session_id, tier, count(*) AS lines, CAST(sum(tokens) AS BIGINT) AS tokens
    FROM state GROUP BY 1, 2""",
)
def _(b):
    return cx.codex_state(_rollout(b), ORDER).groupBy("session_id", "tier").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("tokens").alias("tokens")
    )


@query(
    "codex_turns", [],
    f"""WITH {TURNS},
    starts AS (SELECT session_id, turn_id, arg_min(at_, pos) AS start FROM (SELECT *, coalesce(stamp, '') AS at_ FROM named WHERE fresh) GROUP BY 1, 2),
    ends AS (SELECT session_id, turn_id, arg_max(stamp, pos) AS fin FROM lined
      WHERE kind IN ('usage', 'other') AND turn_id IS NOT NULL AND stamp IS NOT NULL GROUP BY 1, 2),
    sums AS (SELECT session_id, turn_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM lined WHERE kind = 'usage' GROUP BY 1, 2)
    SELECT session_id, turn_id, nullif(start, '') AS start, coalesce(fin, nullif(start, '')) AS "end", tokens
    FROM starts JOIN sums USING (session_id, turn_id) LEFT JOIN ends USING (session_id, turn_id)""",
)
def _(b):
    lines = staged(_rollout(b))
    names = staged(cx.codex_turn_names(lines, ORDER))
    turned = cx.with_turns(cx.codex_state(lines, ORDER), names, ORDER)
    spans = cx.codex_turn_spans(turned, names, ORDER)
    sums = turned.filter("kind = 'usage'").groupBy("session_id", "turn_id").agg(
        F.sum("tokens").alias("tokens")
    )
    return spans.join(sums, ["session_id", "turn_id"])


# Customers form trees by halving; every hundredth lies on a cycle.
@query(
    "opencode_tree", [],
    """WITH RECURSIVE s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 100 = 99 THEN c_custkey - 1
        WHEN c_custkey % 100 = 98 THEN c_custkey + 1 WHEN c_custkey < 8 THEN NULL ELSE c_custkey // 2 END AS parent FROM customer),
    t AS (SELECT id AS root, id FROM s WHERE parent IS NULL UNION SELECT t.root, s.id FROM s JOIN t ON s.parent = t.id)
    SELECT root, id AS session_id FROM t""",
)
def _(b):
    k = F.col("c_custkey")
    parent = (
        F.when(k % 100 == 99, k - 1).when(k % 100 == 98, k + 1)
        .when(k >= 8, F.floor(k / 2).cast("bigint"))
    )
    return oc.session_tree(b.table("customer").select(k.alias("id"), parent.alias("parent_id")))
