"""Queries over JSON, CSV and log lines that are written out from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import copilot as cp
from ..operators import ledger as lg
from ..operators import opencode as oc
from ..operators import quality as qc
from ..operators import reconcile as rc
from ..operators import responses as rs
from ..operators import sync
from ..operators.fold import fold_checkpoints
from ..operators.providers import Claude
from ..session import checkpoint_root
from ..sources import capture as sc
from ..sources import ledger as sl
from .bridge import sql_codex, sql_normalize, sql_normalize_for, sql_usd
from .files import _lay_out
from .registry import query


def _struct_of(schema: str) -> str:
    from ..sources.transcripts import _as_struct

    return f"struct<{_as_struct(schema)}>"


def _written(df: DataFrame, what: str) -> str:
    """Folder of the one text column ``value``, written as lines in the shared folder."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/meterbook-{what}/{uuid.uuid4().hex}"
    df.write.text(path)
    return path


# Transcript lines of two hosts


@query(
    "billable_claude", ["raw_responses"],
    """SELECT response_id, model_raw, input, output FROM raw_responses
    WHERE input % 7 <> 0 AND output % 5 <> 0 AND cache_write <> 1000""",
)
def _(b):
    usage = F.struct(F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"))
    message = F.struct(
        F.col("response_id").alias("id"),
        F.when(F.col("output") % 5 == 0, F.element_at(F.array(F.lit(""), F.lit("<synthetic>")), (F.col("output") % 2 + 1).cast("int")))
        .otherwise(F.col("model_raw")).alias("model"),
        F.when(F.col("cache_write") != 1000, usage).alias("usage"),
    )
    kind = F.when(F.col("input") % 7 == 0, "user").otherwise("assistant")
    lines = b.raw_responses.select(F.to_json(F.struct(kind.alias("type"), message.alias("message"))).alias("value"))
    read = rs.drop_malformed(lines).select(F.from_json("value", _struct_of(schemas.CLAUDE)).alias("r")).select("r.*")
    found = read.filter(rs.billable_claude())
    usage = F.col("message.usage")
    return found.select(
        F.col("message.id").alias("response_id"), F.col("message.model").alias("model_raw"),
        usage["input_tokens"].alias("input"), usage["output_tokens"].alias("output"),
    )


@query(
    "billable_codex", ["raw_responses"],
    """SELECT response_id, input, cache_read FROM raw_responses
    WHERE input % 7 <> 0 AND output % 5 <> 0 AND cache_write <> 1000""",
)
def _(b):
    last = F.struct(F.col("input").alias("input_tokens"), F.col("cache_read").alias("cached_input_tokens"))
    info = F.struct(F.when(F.col("cache_write") != 1000, last).alias("last_token_usage"))
    payload = F.struct(
        F.when(F.col("output") % 5 == 0, "agent_message").otherwise("token_count").alias("type"),
        F.col("response_id").alias("turn_id"), info.alias("info"),
    )
    kind = F.when(F.col("input") % 7 == 0, "response_item").otherwise("event_msg")
    lines = b.raw_responses.select(F.to_json(F.struct(kind.alias("type"), payload.alias("payload"))).alias("value"))
    read = lines.select(F.from_json("value", _struct_of(schemas.CODEX)).alias("r")).select("r.*")
    usage = F.col("payload.info.last_token_usage")
    return read.filter(rs.billable_codex()).select(
        F.col("payload.turn_id").alias("response_id"),
        usage["input_tokens"].alias("input"), usage["cached_input_tokens"].alias("cache_read"),
    )


# Hosts that report their own cost


COPILOT_LINE = """line AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY response_id DESC) AS back
    FROM responses WHERE provider = 'copilot'),
  last AS (SELECT * EXCLUDE (back) FROM line WHERE back = 1)"""


@query(
    "copilot_breakdown", ["responses", "dim_price"],
    f"""WITH {COPILOT_LINE}, m AS (SELECT *, {sql_normalize_for("'copilot'", "model_raw")} AS name FROM last),
    c AS (SELECT session_id, name, CASE WHEN input % 2 = 0 THEN input ELSE greatest(0, input + 5 - cache_write - cache_read) END AS input,
      output, cache_write, cache_read, CASE WHEN output % 3 = 0 THEN output * 1000000 END AS aiu FROM m)
    SELECT session_id, c.name AS model, c.input, c.output, c.cache_write, c.cache_read,
      coalesce(CAST(CASE WHEN aiu > 0 THEN round(aiu * 0.00000000001, 6) ELSE CASE WHEN d.model IS NOT NULL THEN
        {sql_usd('(c.input * rate_input + c.output * rate_output + c.cache_write * rate_write + c.cache_read * rate_read) * 10')} END END AS DOUBLE), 0) AS cost
    FROM c LEFT JOIN dim_price d ON d.view = 'shared' AND d.model = {sql_codex(sql_normalize('c.name'))}""",
)
def _(b):
    rows = b.responses.filter("provider = 'copilot'")
    counted = lambda c: F.struct(F.col(c).alias("tokenCount"))
    details = F.struct(
        F.when(F.col("input") % 2 == 0, counted("input")).alias("input"), counted("output").alias("output"),
        counted("cache_read").alias("cache_read"), counted("cache_write").alias("cache_write"),
    )
    metric = F.struct(
        F.when(F.col("output") % 3 == 0, (F.col("output") * 1_000_000).cast("double")).alias("totalNanoAiu"),
        F.struct((F.col("input") + 5).alias("inputTokens"), F.lit(0).alias("outputTokens")).alias("usage"),
        details.alias("tokenDetails"),
    )
    body = F.to_json(F.struct(
        F.lit("session.shutdown").alias("type"),
        F.struct(F.create_map(F.col("model_raw"), metric).alias("modelMetrics")).alias("data"),
    ))
    read = rows.select("provider", "session_id", F.col("response_id").alias("ord"), body.alias("value"))
    record = F.from_json("value", _struct_of(schemas.COPILOT))
    records = read.select("provider", "session_id", "ord", record.alias("r")).select("provider", "session_id", "ord", "r.*")
    return cp.copilot_breakdown(records, b.dim_price).select(
        "session_id", "model", "input", "output", "cache_write", "cache_read", "cost"
    )


def _opencode(b):
    """Messages and parts of conversations: every conversation is a root."""
    rows = b.table("conversations").select(
        F.concat(F.lit("c-"), "conv_id").alias("session_id"), "conv_id", "turn", "text",
        F.concat_ws("-", F.lit("m"), "conv_id", F.lpad(F.col("turn").cast("string"), 6, "0")).alias("id"),
        F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("role"),
    )
    tokens = F.struct(
        F.length("text").cast("bigint").alias("input"), F.col("turn").alias("output"), F.lit(3).alias("reasoning"),
        F.struct((F.col("conv_id") % 5).alias("read"), F.lit(0).alias("write")).alias("cache"),
    )
    model = F.when(F.col("conv_id") % 3 == 0, "Claude-Opus-5").when(F.col("conv_id") % 3 == 1, "house-model").otherwise("")
    data = F.to_json(F.struct("role", model.alias("modelID"), (F.col("turn") / 4).alias("cost"), tokens.alias("tokens")))
    messages = rows.select("id", "session_id", F.col("turn").alias("time_created"), F.col("turn").alias("time_updated"), data.alias("data"))
    tree = rows.select("session_id").distinct().withColumn("root", F.col("session_id"))
    said = F.when(F.col("conv_id") % 4 == 0, "  ").otherwise(F.col("text"))
    two = F.array(
        F.struct(F.lit("p1").alias("p"), F.lit("tool").alias("type"), F.lit("x").alias("text")),
        F.struct(F.lit("p2").alias("p"), F.lit("text").alias("type"), said.alias("text")),
        F.struct(F.lit("p3").alias("p"), F.lit("text").alias("type"), F.lit("third").alias("text")),
    )
    parts = rows.select("id", "session_id", F.explode(two).alias("t")).select(
        F.concat_ws("-", "id", "t.p").alias("id"), F.col("id").alias("message_id"), "session_id",
        F.lit(0).cast("bigint").alias("time_created"), F.lit(0).cast("bigint").alias("time_updated"),
        F.to_json(F.struct("t.type", "t.text")).alias("data"),
    )
    return oc.opencode_messages(messages, tree), parts


@query(
    "opencode_breakdown", ["dim_price"],
    f"""WITH c AS (SELECT 'c-' || conv_id AS session_id, CASE conv_id % 3 WHEN 0 THEN 'claude-opus-5' ELSE 'house-model' END AS model,
      CAST(sum(length(text)) AS BIGINT) AS input, CAST(sum(turn + 3) AS BIGINT) AS output, 0 AS cache_write,
      CAST(sum(conv_id % 5) AS BIGINT) AS cache_read, sum(CASE WHEN turn > 0 THEN CAST(turn AS DECIMAL(18,2)) / 4 END) AS host
      FROM conversations WHERE turn % 2 = 1 AND conv_id % 3 < 2 GROUP BY ALL)
    SELECT session_id, c.model, input, output, cache_write, cache_read,
      coalesce(CAST(CASE WHEN d.model IS NOT NULL THEN {sql_usd('(input * rate_input + output * rate_output + cache_read * rate_read) * 10')} END AS DOUBLE), CAST(host AS DOUBLE), 0) AS cost
    FROM c LEFT JOIN dim_price d ON d.view = 'shared' AND d.model = c.model""",
)
def _(b):
    messages, _ = _opencode(b)
    return oc.opencode_breakdown(messages, b.dim_price).select(
        "session_id", "model", "input", "output", F.col("cache_write").cast("int").alias("cache_write"), "cache_read", "cost"
    )


@query(
    "opencode_first_prompt", [],
    """SELECT 'c-' || conv_id AS root, CASE WHEN conv_id % 4 = 0 OR trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN 'third'
      ELSE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) END AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn % 2 = 0) WHERE n = 1""",
)
def _(b):
    messages, parts = _opencode(b)
    return oc.opencode_first_prompt(messages.withColumnRenamed("session_id", "_s"), parts)


# Which host a file is, and which hooks count


TYPES = ["summary", "user", "turn_context", "session.start", "note"]


def _lines(b):
    """Lines of one file per conversation; the kind of each follows its numbers."""
    kind = F.element_at(F.array(*map(F.lit, TYPES)), ((F.col("conv_id") + F.col("turn") * F.col("turn")) % 5 + 1).cast("int"))
    entry = F.when((F.col("conv_id") + F.col("turn")) % 4 == 1, F.when(F.col("conv_id") % 2 == 0, "sdk-cli").otherwise("cli"))
    line = F.to_json(F.struct(kind.alias("type"), "text", entry.alias("entrypoint")))
    cut = F.when(F.col("turn") % 3 == 2, F.left(line, F.length(line) - 1)).otherwise(line)
    path = F.concat(F.when(F.col("conv_id") % 2 == 0, "/a/x/").otherwise("/b/"), "conv_id", F.lit(".jsonl"))
    return b.table("conversations").select(path.alias("path"), F.col("turn").alias("ord"), cut.alias("value"))


_TOLD = """told AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN '/a/x/' ELSE '/b/' END || conv_id || '.jsonl' AS path,
    CASE WHEN turn % 3 = 2 THEN NULL ELSE CASE (conv_id + turn * turn) % 5 WHEN 1 THEN 'claude' WHEN 2 THEN 'codex' WHEN 3 THEN 'copilot' END END AS host,
    CASE WHEN (conv_id + turn) % 4 = 1 THEN CASE WHEN conv_id % 2 = 0 THEN 'sdk-cli' ELSE 'cli' END END AS said FROM conversations)"""


@query(
    "detect_provider", [],
    f"""WITH {_TOLD} SELECT path, coalesce(arg_min(host, turn) FILTER (host IS NOT NULL),
      CASE WHEN path LIKE '/a/x/%' THEN 'codex' WHEN path LIKE '/a/%' THEN 'claude' END) AS provider FROM told GROUP BY path""",
)
def _(b):
    roots = b.spark.createDataFrame([("/a", "claude"), ("/a/x/", "codex")], "root string, provider string")
    return rc.detect_provider(_lines(b), roots)


@query(
    "automation_gate", [],
    f"""WITH {_TOLD}, s AS (SELECT path, arg_min(said, turn) FILTER (said IS NOT NULL) AS said FROM told GROUP BY path)
    SELECT transcript_path, hook_event_name, conv_id, turn FROM (SELECT path AS transcript_path, conv_id, turn,
      CASE turn % 3 WHEN 0 THEN 'Stop' WHEN 1 THEN 'SessionEnd' ELSE 'SubagentStop' END AS hook_event_name FROM told)
    JOIN s ON s.path = transcript_path WHERE hook_event_name = 'SubagentStop' OR coalesce(said, '') NOT LIKE 'sdk%'""",
)
def _(b):
    event = F.element_at(F.array(F.lit("Stop"), F.lit("SessionEnd"), F.lit("SubagentStop")), (F.col("turn") % 3 + 1).cast("int"))
    path = F.concat(F.when(F.col("conv_id") % 2 == 0, "/a/x/").otherwise("/b/"), "conv_id", F.lit(".jsonl"))
    hooks = b.table("conversations").select(path.alias("transcript_path"), event.alias("hook_event_name"), "conv_id", "turn")
    return rc.automation_gate(hooks, _lines(b))


@query(
    "check_unparseable", [],
    """SELECT 'unparseable' AS "check", 'red' AS severity, CASE WHEN conv_id % 2 = 0 THEN '/a/x/' ELSE '/b/' END || conv_id || '.jsonl' AS subject,
    CAST(1 AS BIGINT) AS n FROM conversations WHERE turn % 3 = 2""",
)
def _(b):
    bad = _lines(b).filter(F.try_parse_json("value").isNull())
    return qc.check_unparseable(bad.select(F.col("path").alias("file")))


# Logs and capture results


LOG = """log AS (SELECT event_id, epoch_us(ts) // 1000 AS at_ms, user_id % 5 AS k, user_id % 3 AS h,
    '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z] ' AS stamp FROM events),
  line AS (SELECT *, stamp || CASE WHEN k = 4 THEN 'done' ELSE 'pricing miss'
    || CASE WHEN h = 0 THEN ' provider=codex' ELSE '' END
    || CASE k WHEN 0 THEN ' models=gpt-5.6,ghost-1' WHEN 1 THEN ' models=claude-opus-5' WHEN 2 THEN ' models=<synthetic>' ELSE '' END || ' billed at $0' END AS line,
    CASE WHEN h = 0 THEN 'codex' ELSE 'claude' END AS provider FROM log)"""


def _log(b):
    ts = F.col("ts").cast("timestamp")
    k, host = F.col("user_id") % 5, F.when(F.col("user_id") % 3 == 0, " provider=codex").otherwise("")
    models = F.when(k == 0, " models=gpt-5.6,ghost-1").when(k == 1, " models=claude-opus-5").when(k == 2, " models=<synthetic>").otherwise("")
    text = F.when(k == 4, "done").otherwise(F.concat(F.lit("pricing miss"), host, models, F.lit(" billed at $0")))
    stamp = F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z] "))
    return sc.scan_hook_log(b.spark, _written(b.table("events").select(F.concat(stamp, text).alias("value")), "hook-log"))


@query(
    "scan_hook_log", [],
    f"""WITH {LOG} SELECT at_ms, line, provider, unnest(CASE k WHEN 0 THEN CASE WHEN h = 0 THEN ['gpt-5.6-sol', 'ghost-1'] ELSE ['gpt-5.6', 'ghost-1'] END
    WHEN 1 THEN ['claude-opus-5'] WHEN 2 THEN ['<synthetic>'] ELSE [NULL] END) AS model FROM line WHERE k < 4""",
)
def _(b):
    return _log(b).select("at_ms", "line", "provider", "model")


WEEK_END = 1_706_745_600_000


@query(
    "check_pricing_misses", [],
    f"""WITH {LOG} SELECT 'pricing_miss' AS "check", CASE WHEN k = 1 AND h <> 0 THEN 'yellow' ELSE 'red' END AS severity, line AS subject, CAST(1 AS BIGINT) AS n
    FROM line WHERE k IN (0, 1, 3) AND at_ms >= {WEEK_END - 7 * 86_400_000}""",
)
def _(b):
    return qc.check_pricing_misses(_log(b), b.dim_price, WEEK_END)


@query(
    "valid_capture_results", [],
    """SELECT 'capture-' || event_id AS capture_id FROM events WHERE length('capture-' || event_id) BETWEEN 8 AND 80 AND event_id % 10 <> 0
    AND CASE event_id % 4 WHEN 0 THEN value >= 20 WHEN 1 THEN event_id % 3 > 0 WHEN 2 THEN event_id % 5 > 0 ELSE false END""",
)
def _(b):
    i = F.col("event_id")
    of = lambda n: i % 4 == n
    record = F.struct(
        F.when(i % 10 != 0, 1).otherwise(2).alias("schema_version"), F.lit("run-1").alias("run_id"),
        F.concat(F.lit("capture-"), i).alias("capture_id"), F.col("ts").cast("string").alias("completed_at"),
        F.when(of(0), "recorded").when(of(1), "no_usage").when(of(2), "failed").otherwise("odd").alias("status"),
        F.lit("p").alias("project"), F.lit("x").alias("shard_path"), F.lit(5).alias("total_tokens"),
        (F.col("value") - 20).alias("total_cost_usd"),
        F.when(i % 3 == 0, "other").when(i % 3 == 1, "zero_tokens").otherwise("transcript_missing").alias("reason"),
        F.when(i % 5 != 0, "m").alias("message"),
    )
    path = _written(b.table("events").select(F.to_json(record).alias("value")), "captures")
    return b.spark.read.schema(schemas.CAPTURE_RESULT).json(path).filter(sc.valid_result()).select("capture_id")


# Stored records and old ledgers


def _records(b):
    k, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    turn = F.struct(
        F.concat(F.lit("t"), k).alias("turn_id"), F.concat(day, F.lit("T01:00:00Z")).alias("start_time"),
        F.when(k % 2 == 0, "bad").alias("end_time"), cents.alias("total_tokens"),
    )
    record = F.struct(
        F.concat(F.lit("s-"), k).alias("session_id"), F.when(k % 3 == 0, "").otherwise("slug").alias("session_slug"),
        F.lit(" box ").alias("machine"), F.concat(F.lit(" br"), k % 4).alias("branch"),
        F.when(k % 5 == 0, "never").otherwise(F.concat(day, F.lit("T00:00:00Z"))).alias("start_time"),
        F.when(k % 7 == 0, "later").otherwise(F.concat(day, F.lit("T02:00:00Z"))).alias("end_time"),
        cents.alias("total_tokens"), F.when(k % 11 == 0, "abc").otherwise(F.lit("5")).alias("input_tokens"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total_cost_usd"),
        F.when(k % 2 == 0, '["claude-opus-5"," gpt-5.4 ",""]').otherwise("claude-opus-5;gpt-5.4").alias("models"),
        F.array(turn).alias("turns"),
    )
    read = b.table("orders").select(F.from_json(F.to_json(record), schemas.LEDGER_JSON).alias("r")).select("r.*")
    return read.withColumn("file", F.lit("f"))


@query(
    "normalize_ledger", [],
    """SELECT 's-' || o_orderkey AS session_id, CASE WHEN o_orderkey % 3 = 0 THEN left('s-' || o_orderkey, 8) ELSE 'slug' END AS slug,
    'box' AS machine, 'br' || o_orderkey % 4 AS branch, epoch_ms(o_orderdate) AS start_ms,
    CASE WHEN o_orderkey % 7 <> 0 THEN epoch_ms(o_orderdate) + 7200000 END AS end_ms,
    CAST(round(o_totalprice * 100) AS BIGINT) AS total_tokens, CAST(CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 5 END AS BIGINT) AS input,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS cost, 'claude-opus-5,gpt-5.4' AS models, 'claude' AS provider
    FROM orders WHERE o_orderkey % 5 <> 0""",
)
def _(b):
    return lg.normalize_ledger(_records(b)).select(
        "session_id", "slug", "machine", "branch", "start_ms", "end_ms", "total_tokens", "input", "cost",
        F.array_join("models", ",").alias("models"), "provider",
    )


@query(
    "normalize_turns", [],
    """SELECT 's-' || o_orderkey AS session_id, 't' || o_orderkey AS turn_id, epoch_ms(o_orderdate) + 3600000 AS start_ms,
    epoch_ms(o_orderdate) + 3600000 AS end_ms, CAST(round(o_totalprice * 100) AS BIGINT) AS total_tokens
    FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 2 <> 0""",
)
def _(b):
    return lg.normalize_turns(_records(b)).select("session_id", "turn_id", "start_ms", "end_ms", "total_tokens")


@query(
    "valid_start", [],
    "SELECT 's-' || o_orderkey AS session_id FROM orders WHERE o_orderkey % 5 <> 0",
)
def _(b):
    return lg.normalize_ledger(_records(b)).select("session_id")


@query(
    "scan_legacy_csv", [],
    """SELECT 's-' || o_orderkey AS session_id, 'say "' || o_orderpriority || '", ok' AS project,
    CAST(round(o_totalprice * 100) AS BIGINT) AS total_tokens FROM orders WHERE o_orderkey % 9 <> 0""",
)
def _(b):
    k = F.col("o_orderkey")
    quoted = F.concat(F.lit('"say ""'), "o_orderpriority", F.lit('"", ok"'))
    line = F.when(k % 9 == 0, F.concat(F.lit("short-"), k)).otherwise(
        F.concat_ws(",", F.concat(F.lit("s-"), k), quoted, F.round(F.col("o_totalprice") * 100).cast("bigint"))
    )
    rows = b.table("orders").select(line.alias("value"))
    head = "session_id,project,total_tokens"

    def headed(batches):
        # Every part file begins with its own header.
        import pandas as pd

        yield pd.DataFrame({"value": [head]})
        yield from batches

    found = sl.scan_legacy_csv(b.spark, _written(rows.mapInPandas(headed, "value string"), "csv"))
    return sl.legacy_sessions(found).select("session_id", "project", "total_tokens")


# Folding any number of checkpoints of a session


CHECKS = """raw AS (SELECT 's-' || l_orderkey AS session_id, CASE WHEN l_suppkey % 20 = 0 THEN 'codex' ELSE 'claude' END AS provider,
    CAST((l_linenumber + 1) // 2 AS BIGINT) AS seq, CAST(round(l_quantity) AS BIGINT) AS total_tokens,
    CAST(l_extendedprice AS DECIMAL(18,6)) AS cost, l_returnflag AS slug FROM lineitem),
  once AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY session_id, seq
    ORDER BY total_tokens DESC, cost DESC, provider DESC, slug DESC) AS rn FROM raw) WHERE rn = 1),
  c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS k FROM once),
  f AS (SELECT * EXCLUDE (seq) FROM c WHERE k = 1 UNION ALL
    SELECT c.session_id, c.provider,
      CASE WHEN c.provider = f.provider AND (c.total_tokens < f.total_tokens OR c.cost < f.cost) THEN f.total_tokens ELSE c.total_tokens END,
      CASE WHEN c.provider = f.provider AND (c.total_tokens < f.total_tokens OR c.cost < f.cost) THEN f.cost ELSE c.cost END,
      c.slug, c.k FROM f JOIN c ON c.session_id = f.session_id AND c.k = f.k + 1)"""
FOLDED = f"""WITH RECURSIVE {CHECKS} SELECT session_id, arg_max(provider, k) AS provider, arg_max(total_tokens, k) AS total_tokens,
    CAST(arg_max(cost, k) AS DOUBLE) AS cost, arg_max(slug, k) AS slug FROM f GROUP BY session_id"""


def _checks(b):
    return b.table("lineitem").select(
        F.concat(F.lit("s-"), "l_orderkey").alias("session_id"),
        F.when(F.col("l_suppkey") % 20 == 0, "codex").otherwise("claude").alias("provider"),
        F.floor((F.col("l_linenumber") + 1) / 2).cast("bigint").alias("seq"),
        F.round("l_quantity").cast("bigint").alias("total_tokens"),
        F.col("l_extendedprice").cast("decimal(18,6)").alias("cost"),
        F.col("l_returnflag").alias("slug"),
    )


@query("fold_checkpoints", [], FOLDED)
def _(b):
    return fold_checkpoints(_checks(b)).select("session_id", "provider", "total_tokens", "cost", "slug")


@query("write_ledger", [], FOLDED)
def _(b):
    """Three merges into a stored ledger, the second of them delivered again."""
    root = f"{checkpoint_root(b.spark).rstrip('/')}/meterbook-ledger/{uuid.uuid4().hex}"
    store = sl.LedgerStore(b.spark, root, buckets=8)
    for low, high in ((0, 1), (2, 2), (2, 2), (3, 9)):
        store.merge(_checks(b).filter(F.col("seq").between(low, high)))
    return store.read().select("session_id", "provider", "total_tokens", "cost", "slug")


# Transcript files of one host, synced twice


SYNCED = """WITH l AS (SELECT format('{:08x}-0000-4000-8000-{:012x}', l_suppkey, l_suppkey) AS session_id, l_suppkey, l_linenumber,
      concat_ws('-', l_orderkey, l_linenumber, l_partkey, CAST(round(l_quantity) AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT)) AS id, CAST(round(l_quantity * 1000) AS BIGINT) AS input,
      CAST(round(l_extendedprice / 10) AS BIGINT) AS output FROM lineitem),
    k AS (SELECT DISTINCT * FROM l WHERE l_suppkey % 2 = 0 OR l_linenumber <= 3)
    SELECT session_id, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output,
      CAST(sum(input + output) AS BIGINT) AS total_tokens, count(*) AS turns,
      CASE WHEN session_id LIKE '%0' OR session_id LIKE '%2' OR session_id LIKE '%4' OR session_id LIKE '%6' OR session_id LIKE '%8'
        OR session_id LIKE '%a' OR session_id LIKE '%c' OR session_id LIKE '%e' THEN 'written' END AS second
    FROM k GROUP BY session_id"""


def _transcripts(b, root: str, first: bool):
    """A transcript per supplier, one record a line item; the second time only those that grew."""
    key = F.col("l_suppkey")
    usage = F.struct(
        F.round(F.col("l_quantity") * 1000).cast("bigint").alias("input_tokens"),
        F.round(F.col("l_extendedprice") / 10).cast("bigint").alias("output_tokens"),
    )
    exact = [F.round("l_quantity").cast("bigint"), F.round(F.col("l_extendedprice") * 100).cast("bigint")]
    id_ = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", *exact).alias("id")  # an order's line number may repeat
    message = F.struct(id_, F.lit("claude-opus-5").alias("model"), usage.alias("usage"))
    stamp = F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd'T'00:00:00'Z'")
    line = F.to_json(F.struct(F.lit("assistant").alias("type"), stamp.alias("timestamp"), message.alias("message")))
    rows = b.table("lineitem").filter(F.col("l_linenumber") <= 3 if first else key % 2 == 0)
    sid = F.format_string("%08x-0000-4000-8000-%012x", key.cast("bigint"), key.cast("bigint"))
    name = F.concat(F.lit("projects!demo!"), sid, F.lit(".jsonl")).alias("name")
    _lay_out(b, rows.select(name, id_.alias("ord"), line.alias("value")), f"{root}/in")


@query("sync_twice", [], SYNCED)
def _(b):
    """Sync, let some transcripts grow, sync again: ledger, turns and what the second sync wrote."""
    root = f"{checkpoint_root(b.spark).rstrip('/')}/meterbook-sync/{uuid.uuid4().hex}"
    store = sync.SyncStore(b.spark, f"{root}/store", buckets=8)
    for first in (True, False):
        _transcripts(b, root, first)
        told = sync.sync(Claude, b.spark, f"{root}/in", store, b.dim_price, "v1", "box")
    turns = store.turns().groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"))
    second = told.select("session_id", F.col("status").alias("second"))
    rows = store.ledger.read().join(turns, "session_id").join(second, "session_id", "left")
    return rows.select("session_id", "input", "output", "total_tokens", "turns", "second")
