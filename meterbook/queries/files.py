"""Queries over folders of files in the hosts' own layouts, written out from the tables."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import codex as cx
from ..operators import copilot as cp
from ..operators import opencode as oc
from ..operators import sync
from ..operators.providers import Claude, Opencode
from ..plans.sessions import snapshot_meta
from ..session import checkpoint_root
from ..sources import capture as sc
from ..sources import growing
from ..sources import ledger as sl
from ..sources import transcripts as ts
from ..sources.opencode import scan_opencode
from ..streaming import ingest
from .registry import query

#: Session id of a supplier, in Spark and in SQL.
SID = "format('{{:08x}}-0000-4000-8000-{{:012x}}', {0}, {0})"


def _sid(key: str) -> Column:
    return F.format_string("%08x-0000-4000-8000-%012x", F.col(key).cast("bigint"), F.col(key).cast("bigint"))


def _root(b, what: str) -> str:
    return f"{checkpoint_root(b.spark).rstrip('/')}/meterbook-{what}/{uuid.uuid4().hex}"


def _lay_out(b, rows: DataFrame, root: str) -> None:
    """Rows of (name, ord, value) as lines of the files they name below ``root``; ``!`` stands for a slash.

    No Spark writer names its files, so the tasks write them through Arrow's file systems. A file is
    one task's, which writes it again if the task is repeated.
    """
    path = b.spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(b.spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    root = fs.resolvePath(path).toString()
    # A file costs the same whatever its size, so few bytes are no reason for few tasks.
    parts = int(b.spark.conf.get("spark.sql.shuffle.partitions"))
    # The values of a null or empty name have a file as well, of the name Spark's writers give it.
    name = F.coalesce(F.nullif(F.translate("name", "!", "/"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    line = F.concat(F.coalesce("value", F.lit("")), F.lit("\n")).cast("binary")
    lines = rows.select(name.alias("name"), "ord", line.alias("line")).repartition(parts, "name")
    ordered = lines.sortWithinPartitions("name", "ord").select("name", "line")
    ordered.mapInArrow(partial(growing.write_files, root), "name string").write.format("noop").mode("overwrite").save()


def _items(b) -> DataFrame:
    """Line items with whole numbers, an id that may repeat, and the supplier's session."""
    whole = lambda c: F.round(c).cast("bigint")
    exact = [whole(F.col("l_quantity")), whole(F.col("l_extendedprice") * 100)]
    return b.table("lineitem").select(
        F.col("l_suppkey").alias("supp"), F.col("l_linenumber").cast("bigint").alias("line"),
        _sid("l_suppkey").alias("sid"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", *exact).alias("id"),
        whole(F.col("l_quantity") * 1000).alias("input"), whole(F.col("l_extendedprice") / 10).alias("output"),
        F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd'T'00:00:00'Z'").alias("stamp"),
    )


ITEMS = f"""i AS (SELECT l_suppkey AS supp, l_linenumber AS line, {SID.format("l_suppkey")} AS sid,
      concat_ws('-', l_orderkey, l_linenumber, l_partkey, CAST(round(l_quantity) AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT)) AS id,
      CAST(round(l_quantity * 1000) AS BIGINT) AS input, CAST(round(l_extendedprice / 10) AS BIGINT) AS output, l_shipdate FROM lineitem)"""


def _claude_line() -> Column:
    usage = F.struct(F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"))
    message = F.struct("id", F.lit("claude-opus-5").alias("model"), usage.alias("usage"))
    return F.to_json(F.struct(F.lit("assistant").alias("type"), F.col("stamp").alias("timestamp"), message.alias("message")))


def _claude_files(b, root: str) -> None:
    """A main file of the first three lines of an order, a subagent's file of the rest, every fifth line broken."""
    main = F.concat(F.lit("projects!demo!"), "sid", F.lit(".jsonl"))
    sub = F.concat(F.lit("projects!other!"), "sid", F.lit("!subagents!agent-"), F.col("line"), F.lit(".jsonl"))
    value = F.when(F.col("output") % 5 == 0, F.left(_claude_line(), F.lit(30))).otherwise(_claude_line())
    rows = _items(b).select(F.when(F.col("line") <= 3, main).otherwise(sub).alias("name"), F.col("id").alias("ord"), value.alias("value"))
    _lay_out(b, rows, root)


@query(
    "scan_claude", [],
    f"""WITH {ITEMS} SELECT sid AS session_id, line <= 3 AS is_main, count(*) AS records,
      CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output FROM i
    WHERE output % 5 <> 0 GROUP BY 1, 2""",
)
def _(b):
    """Session trees, with an older main file of the same session that must not count."""
    root = _root(b, "claude")
    old = F.concat(F.lit("projects!old!"), "sid", F.lit(".jsonl"))
    stale = _items(b).filter("line = 1").select(old.alias("name"), F.col("id").alias("ord"), _claude_line().alias("value"))
    _lay_out(b, stale, root)
    _claude_files(b, root)
    usage = F.col("message.usage")
    return ts.scan_claude(b.spark, root).groupBy("session_id", "is_main").agg(
        F.count(F.lit(1)).alias("records"), F.sum(usage["input_tokens"]).alias("input"), F.sum(usage["output_tokens"]).alias("output")
    )


@query(
    "fold_subagents", [],
    f"""WITH {ITEMS}, once AS (SELECT DISTINCT sid, id, input, output FROM i WHERE output % 5 <> 0)
    SELECT sid AS session_id, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, count(*) AS responses FROM once GROUP BY 1""",
)
def _(b):
    """Usage of a session with that of its subagents, each response once."""
    root = _root(b, "claude")
    _claude_files(b, root)
    from ..operators.claude import claude_responses

    return claude_responses(ts.scan_claude(b.spark, root)).groupBy("session_id").agg(
        F.sum("input").alias("input"), F.sum("output").alias("output"), F.count(F.lit(1)).alias("responses")
    )


# Codex rollouts: a meta line, a prompt, then usage; in either of two folders, an older copy beside some.


def _codex_files(b, root: str) -> None:
    items = _items(b)
    one = items.select("supp", "sid").distinct()
    said = F.concat(F.lit("Prompt of "), "supp")

    def line(kind: str, stamp, payload: Column) -> Column:
        return F.to_json(F.struct(stamp.alias("timestamp"), F.lit(kind).alias("type"), payload.alias("payload")))

    folder = F.when(F.col("supp") % 2 == 0, "archived_sessions!").otherwise("sessions!2026!07!01!")
    name = F.concat(folder, F.lit("rollout-"), "sid", F.lit(".jsonl")).alias("name")
    first, branch = F.lit("1990-01-01T00:00:00Z"), F.struct(F.concat(F.lit("b"), F.col("supp") % 3).alias("branch"))
    meta = F.struct(F.col("sid").alias("id"), F.concat(F.lit("/w/p"), F.col("supp") % 7).alias("cwd"), branch.alias("git"))
    usage = F.struct(F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"))
    spent = F.struct(F.lit("token_count").alias("type"), F.struct(usage.alias("last_token_usage")).alias("info"))
    asked = F.struct(F.lit("user_message").alias("type"), said.alias("message"))
    told = F.struct(F.lit("agent_message").alias("type"), F.lit("done").alias("message"))
    stale = one.filter("supp % 4 = 0").select(
        F.concat(F.lit("sessions!2025!rollout-"), "sid", F.lit(".jsonl")).alias("name"), F.lit("0").alias("ord"),
        line("session_meta", first, F.struct(F.lit("stale").alias("id"), F.lit("/stale").alias("cwd"))).alias("value"),
    )
    _lay_out(b, stale, root)
    rows = one.select(name, F.lit("0").alias("ord"), line("session_meta", first, meta).alias("value")).unionByName(
        one.select(name, F.lit("1").alias("ord"), line("event_msg", first, asked).alias("value"))
    ).unionByName(
        items.select(name, F.concat(F.lit("2"), "id").alias("ord"), line("event_msg", F.col("stamp"), spent).alias("value"))
    ).unionByName(one.select(name, F.lit("3").alias("ord"), line("event_msg", F.lit("2030-01-01T00:00:00Z"), told).alias("value")))
    _lay_out(b, rows, root)


@query(
    "scan_codex", [],
    f"""WITH {ITEMS} SELECT sid AS session_id, count(*) + 3 AS records, CAST(sum(input) AS BIGINT) AS input,
      CAST(sum(output) AS BIGINT) AS output FROM i GROUP BY 1""",
)
def _(b):
    root = _root(b, "codex")
    _codex_files(b, root)
    usage = F.col("payload.info.last_token_usage")
    return ts.scan_codex(b.spark, root).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("records"), F.sum(usage["input_tokens"]).alias("input"), F.sum(usage["output_tokens"]).alias("output")
    )


@query(
    "session_metadata_codex", [],
    f"""WITH {ITEMS} SELECT DISTINCT sid AS session_id, 631152000000 AS start_ms, 1893456000000 AS end_ms, '/w/p' || supp % 7 AS cwd,
      'b' || supp % 3 AS branch, 'Prompt of ' || supp AS first_prompt, 1 AS user_messages, 1 AS assistant_messages, 2 AS total_messages FROM i""",
)
def _(b):
    root = _root(b, "codex")
    _codex_files(b, root)
    return cx.codex_metadata(ts.scan_codex(b.spark, root)).drop("provider", "slug")


# Copilot folders: two of three sessions have ended.


def _copilot_files(b, root: str) -> None:
    items = _items(b)
    one = items.select("supp", "sid").distinct()
    name = F.concat(F.lit("session-state!"), "sid", F.lit("!events.jsonl")).alias("name")

    def line(kind: str, stamp, data: Column) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("type"), stamp.alias("timestamp"), data.alias("data")))

    where = F.struct(F.concat(F.lit("/w/p"), F.col("supp") % 7).alias("cwd"), F.lit("main").alias("branch"))
    opened = F.struct(F.col("sid").alias("sessionId"), F.lit("1990-01-01T00:00:00Z").alias("startTime"), where.alias("context"))
    asked, told = F.struct(F.concat(F.lit("Prompt of "), "id").alias("content")), F.struct(F.lit("ok").alias("content"))
    end = line("session.shutdown", F.lit("2030-01-01T00:00:00Z"), F.struct(F.lit(None).cast("string").alias("sessionId")))
    rows = one.select(name, F.lit("0").alias("ord"), line("session.start", F.lit("1990-01-01T00:00:00Z"), opened).alias("value"))
    rows = rows.unionByName(items.select(
        name, F.concat(F.lit("1"), "id").alias("ord"),
        F.when(F.col("line") <= 2, line("user.message", F.col("stamp"), asked)).otherwise(line("assistant.message", F.col("stamp"), told)).alias("value"),
    ))
    _lay_out(b, rows.unionByName(one.filter("supp % 3 <> 0").select(name, F.lit("2").alias("ord"), end.alias("value"))), root)


@query(
    "scan_copilot", [],
    f"""WITH {ITEMS} SELECT sid AS session_id, count(*) + 1 + max(CASE WHEN supp % 3 <> 0 THEN 1 ELSE 0 END) AS records,
      count(*) FILTER (WHERE line <= 2) AS prompts FROM i GROUP BY 1""",
)
def _(b):
    root = _root(b, "copilot")
    _copilot_files(b, root)
    return ts.scan_copilot(b.spark, root).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("type") == "user.message").alias("prompts")
    )


@query(
    "eligible_sessions", [],
    f"""WITH {ITEMS} SELECT DISTINCT 'copilot' AS provider, sid AS session_id FROM i WHERE supp % 3 <> 0
    UNION ALL SELECT 'opencode', 'o-' || o_orderkey FROM orders WHERE o_orderkey % 3 <> 0""",
)
def _(b):
    """Copilot sessions that ended, opencode sessions without a parent."""
    root = _root(b, "copilot")
    _copilot_files(b, root)
    found = ts.find_copilot(b.spark, root).select("provider", "session_id")
    return found.unionByName(Opencode(*_opencode_tables(b).values()).found().select("provider", "session_id"))


@query(
    "session_metadata_copilot", [],
    f"""WITH {ITEMS} SELECT sid AS session_id, 631152000000 AS start_ms, CASE WHEN supp % 3 <> 0 THEN 1893456000000
        ELSE epoch_ms(CAST(arg_max(l_shipdate, id) AS TIMESTAMP)) END AS end_ms,
      '/w/p' || supp % 7 AS cwd, 'main' AS branch, coalesce('Prompt of ' || min(id) FILTER (WHERE line <= 2), 'No prompt available') AS first_prompt,
      count(*) FILTER (WHERE line <= 2) AS user_messages, count(*) FILTER (WHERE line > 2) AS assistant_messages, count(*) AS total_messages
    FROM i GROUP BY sid, supp""",
)
def _(b):
    root = _root(b, "copilot")
    _copilot_files(b, root)
    return cp.copilot_metadata(ts.scan_copilot(b.spark, root)).drop("provider", "slug", "identity")


# Opencode tables: an order is a session, every third one a child of the one before it; text columns, and one too many.


def _opencode_tables(b) -> dict[str, DataFrame]:
    k = F.col("o_orderkey")
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    orders = b.table("orders")
    session = orders.select(
        F.concat(F.lit("o-"), k).alias("id"), F.when(k % 3 == 0, F.concat(F.lit("o-"), k - 1)).alias("parent_id"),
        F.concat(F.lit("/w/"), k % 5).alias("directory"), F.lit("").alias("slug"), F.concat(F.lit("Title "), k).alias("title"),
        *[F.lit("0").alias(c) for c in ("cost", "tokens_input", "tokens_output", "tokens_reasoning", "tokens_cache_read", "tokens_cache_write")],
        at.cast("string").alias("time_created"), (at + k).alias("time_updated"), F.lit("x").alias("extra"),
    )
    role = F.when(F.col("l_linenumber") % 2 == 1, "user").otherwise("assistant")
    message = b.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.lit(1).alias("one")).select(
        F.concat_ws("-", F.lit("m"), "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("o-"), "l_orderkey").alias("session_id"),
        F.col("l_linenumber").alias("time_created"), F.col("l_linenumber").alias("time_updated"),
        F.to_json(F.struct(role.alias("role"))).alias("data"),
    )
    said = F.struct(F.lit("text").alias("type"), F.concat(F.lit("Ask "), "session_id").alias("text"))
    part = message.filter("time_created = 1").select(
        F.concat(F.lit("p-"), "id").alias("id"), F.col("id").alias("message_id"), "session_id", "time_created", "time_updated",
        F.to_json(said).alias("data"),
    )
    root, out = _root(b, "opencode"), {}
    for name, df in {"session": session, "message": message, "part": part}.items():
        df.write.parquet(f"{root}/{name}")
        out[name] = b.spark.read.parquet(f"{root}/{name}")
    return scan_opencode(**out)


@query(
    "scan_opencode", [],
    """SELECT 'o-' || o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'o-' || o_orderkey - 1 END AS parent_id,
      '/w/' || o_orderkey % 5 AS directory, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS time_created,
      epoch_ms(CAST(o_orderdate AS TIMESTAMP)) + o_orderkey AS time_updated,
      (SELECT count(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) AS messages FROM orders""",
)
def _(b):
    tables = _opencode_tables(b)
    counts = tables["message"].groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("messages"))
    rows = tables["session"].join(counts, "id", "left")
    return rows.select("id", "parent_id", "directory", "time_created", "time_updated", F.coalesce("messages", F.lit(0)).alias("messages"))


@query(
    "session_metadata_opencode", [],
    """WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 AND EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey = o.o_orderkey - 1)
        THEN o_orderkey - 1 ELSE o_orderkey END AS root FROM orders o),
    m AS (SELECT root, l_orderkey, l_linenumber FROM s JOIN lineitem ON l_orderkey = k GROUP BY ALL),
    c AS (SELECT root, count(*) FILTER (WHERE l_linenumber % 2 = 1) AS u, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS a,
      min(struct_pack(n := l_linenumber, i := 'm-' || l_orderkey || '-' || l_linenumber, k := l_orderkey)) FILTER (WHERE l_linenumber % 2 = 1) AS f FROM m GROUP BY 1)
    SELECT 'o-' || o_orderkey AS session_id, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS start_ms,
      epoch_ms(CAST(o_orderdate AS TIMESTAMP)) + o_orderkey AS end_ms, '/w/' || o_orderkey % 5 AS cwd, CAST(NULL AS VARCHAR) AS branch,
      CASE WHEN f.n = 1 THEN 'Ask o-' || f.k ELSE 'Title ' || o_orderkey END AS first_prompt,
      coalesce(u, 0) AS user_messages, coalesce(a, 0) AS assistant_messages, coalesce(u, 0) + coalesce(a, 0) AS total_messages
    FROM orders LEFT JOIN c ON root = o_orderkey WHERE o_orderkey % 3 <> 0""",
)
def _(b):
    tables = _opencode_tables(b)
    messages = oc.opencode_messages(tables["message"], oc.session_tree(tables["session"]))
    return oc.opencode_metadata(tables["session"], messages, tables["part"]).drop("provider", "slug")


# Stored documents, capture runs, snapshots


@query(
    "scan_ledger_json", [],
    f"""SELECT {SID.format("s_suppkey")} || '.json' AS file, CASE WHEN s_suppkey % 7 <> 0 THEN {SID.format("s_suppkey")} END AS session_id,
      CASE WHEN s_suppkey % 7 <> 0 THEN CAST(CAST(round(s_acctbal * 100) AS BIGINT) AS VARCHAR) END AS total_tokens, s_suppkey % 7 = 0 AS broken FROM supplier""",
)
def _(b):
    """A document per supplier over several lines; every seventh ends too early."""
    root, key = _root(b, "ledger-json"), F.col("s_suppkey")
    cents = F.round(F.col("s_acctbal") * 100).cast("bigint")
    text = F.to_json(F.struct(_sid("s_suppkey").alias("session_id"), cents.alias("total_tokens")))
    text = F.when(key % 7 != 0, F.replace(text, F.lit(","), F.lit(",\n"))).otherwise(F.left(text, F.lit(40)))
    name = F.concat(_sid("s_suppkey"), F.lit(".json")).alias("name")
    _lay_out(b, b.table("supplier").select(name, F.lit(0).alias("ord"), text.alias("value")), root)
    return sl.scan_ledger_json(b.spark, root).select("file", "session_id", "total_tokens", "broken")


@query(
    "scan_capture_runs", [],
    """SELECT 'run-' || s_nationkey AS run_id, count(*) AS pending, count(*) FILTER (WHERE s_suppkey % 4 > 0 AND s_suppkey % 5 <> 0) AS results
    FROM supplier GROUP BY 1""",
)
def _(b):
    """A folder per nation: a pending file per supplier, a result for most; one in five names another run."""
    root, key = _root(b, "runs"), F.col("s_suppkey")
    run, capture = F.concat(F.lit("run-"), "s_nationkey"), F.concat(F.lit("capture-"), F.lpad(key.cast("string"), 8, "0"))
    record = F.struct(
        F.lit(1).alias("schema_version"), F.when(key % 5 != 0, run).otherwise("run-x").alias("run_id"), capture.alias("capture_id"),
        F.lit("2026-07-01T00:00:00Z").alias("completed_at"), F.lit("no_usage").alias("status"), F.lit("zero_tokens").alias("reason"),
    )
    of = lambda kind: F.concat(run, F.lit(f"!{kind}!"), capture, F.lit(".json")).alias("name")
    rows = b.table("supplier")
    _lay_out(b, rows.select(of("pending"), F.lit(0).alias("ord"), F.lit("{}").alias("value")), root)
    _lay_out(b, rows.filter(key % 4 > 0).select(of("results"), F.lit(0).alias("ord"), F.to_json(record).alias("value")), root)
    pending, results = sc.scan_capture_runs(b.spark, root)
    counts = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("results"))
    both = pending.groupBy("run_id").agg(F.count(F.lit(1)).alias("pending")).join(counts, "run_id", "left")
    return both.select("run_id", "pending", F.coalesce("results", F.lit(0)).alias("results"))


@query(
    "write_snapshot", ["sessions"],
    """SELECT strftime(epoch_ms(start_ms), '%Y-%m') AS start_month, count(*) AS sessions,
      CAST(sum(CAST(cost AS DECIMAL(28,6))) AS DOUBLE) AS cost, (SELECT count(*) FROM sessions) AS meta_sessions FROM sessions GROUP BY 1""",
)
def _(b):
    root = _root(b, "snapshot")
    sl.write_snapshot(b.stored_records, snapshot_meta(b.stored_records), root)
    rows = b.spark.read.parquet(f"{root}/sessions").groupBy(F.col("start_month").cast("string").alias("start_month")).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("cost").alias("cost")
    )
    return rows.withColumn("meta_sessions", b.spark.read.json(f"{root}/meta").select("sessions").scalar())


# Streams over growing transcripts


@query(
    "stream_responses", [],
    f"""WITH {ITEMS} SELECT DISTINCT sid AS session_id, id AS response_id, input, output FROM i WHERE output % 5 <> 0""",
)
def _(b):
    """Transcripts of the first lines, then whole ones: appended bytes only are read, each response is handed on once."""
    root, line = _root(b, "growing"), _claude_line()
    value = F.when(F.col("output") % 5 == 0, F.left(line, F.lit(30))).otherwise(line)
    # Order keys sort the later lines behind the earlier ones, so the second layout extends the first.
    rows = _items(b).select(
        F.concat(F.lit("projects!demo!"), "sid", F.lit(".jsonl")).alias("name"), "line",
        F.concat(F.when(F.col("line") <= 3, "a").otherwise("b"), F.col("id")).alias("ord"), value.alias("value"),
    )
    seen = ingest.SeenResponses(b.spark, f"{root}/seen")
    sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out/n={n}")
    for part in (rows.filter("line <= 3"), rows):
        _lay_out(b, part, f"{root}/in")
        ranges = growing.stream_growing(b.spark, f"{root}/in", f"{root}/index")
        found = ingest.stream_claude_responses(ingest.partial_tail(ranges), r"([^/.]+)\.jsonl$")
        ingest.stream_dedupe(found, seen, sink, f"{root}/checkpoint").awaitTermination()
    out = b.spark.read.schema(found.schema).parquet(f"{root}/out/n=*")
    return out.select("session_id", "response_id", "input", "output")


@query(
    "reprice", [],
    f"""WITH {ITEMS}, once AS (SELECT DISTINCT sid, id, input, output FROM i WHERE output % 5 <> 0)
    SELECT sid AS session_id, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, 'written' AS first,
      CAST(NULL AS VARCHAR) AS again FROM once GROUP BY 1""",
)
def _(b):
    """All sessions are of the old price version; after one run none is."""
    root = _root(b, "reprice")
    _claude_files(b, f"{root}/in")
    store = sync.SyncStore(b.spark, f"{root}/store", buckets=8)
    source = lambda: [sync.Files(Claude, f"{root}/in")]
    sync.sync_all(b.spark, store, source(), b.dim_price, "v1", "box")
    first = sync.reprice(b.spark, store, source(), b.dim_price, "v2", "box").select("session_id", F.col("status").alias("first"))
    again = sync.reprice(b.spark, store, source(), b.dim_price, "v2", "box").select("session_id", F.col("status").alias("again"))
    rows = store.ledger.read().join(first, "session_id", "left").join(again, "session_id", "left")
    return rows.select("session_id", "input", "output", "first", "again")
