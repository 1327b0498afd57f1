"""Usage tables derived from the driver's parquet tables.

The tables hold no transcripts, so every query reads responses, sessions and
events that one fixed rule derives from them. ``CTES`` states the same rule in
SQL for the check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models as mf
from ..functions import projects as pf
from ..functions import text as xf
from ..operators.breakdown import model_breakdown, session_usage, turn_usage
from ..operators.pricing import build_dim_price, price_responses
from ..operators.responses import dedupe_claude
from ..plans.sessions import derive
from ..session import configure, spread, staged

PROVIDERS = ["claude", "codex", "copilot", "opencode"]
MODELS = [
    "claude-opus-5",
    "claude-sonnet-4-5-20250929",
    "claude-haiku-4-5-20251001",
    "claude-opus-4-7[1m]",
    "gpt-5.6-sol",
    "gpt-5.6",
    "gpt-5.4-2026-03-05",
    "codex-auto-review",
    "claude-fable-5",
    "mystery-model-1",
]
RESPONSE_ORDER = [
    "ts_ms", "model_raw", "input", "output", "cache_write", "cache_read", "speed",
]
ZONE = "America/Chicago"
NOW_MS = 1_004_940_000_000  # 2001-11-05T06:00:00Z, after the last shipment
WALL_NOW_MS = 1_706_745_600_000  # 2024-02-01T00:00:00Z, after the last event


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class Bridge:
    """Derived tables of one data folder, each built lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def dim_price(self) -> DataFrame:
        return build_dim_price(self.spark)

    @cached_property
    def raw_responses(self) -> DataFrame:
        """One row per line item, repeats included."""
        key, line = F.col("l_orderkey"), F.col("l_linenumber")
        provider = _pick(PROVIDERS, F.pmod(key, F.lit(4)))
        model = _pick(MODELS, F.pmod(F.col("l_partkey"), F.lit(10)))
        minutes = line * 7 + F.pmod(F.col("l_suppkey"), F.lit(60))
        count = lambda c: F.round(c).cast("bigint")
        return spread(self.table("lineitem").select(
            provider.alias("provider"),
            F.concat(F.lit("s-"), key).alias("session_id"),
            F.concat_ws("-", key, line).alias("response_id"),
            (
                F.unix_millis(F.col("l_shipdate").cast("timestamp")) + minutes * 60_000
            ).alias("ts_ms"),
            model.alias("model_raw"),
            count(F.col("l_quantity") * 1000).alias("input"),
            count(F.col("l_extendedprice") / 10).alias("output"),
            (count(F.col("l_tax") * 100) * 500).alias("cache_write"),
            (count(F.col("l_discount") * 100) * 30_000).alias("cache_read"),
            F.when(F.col("l_returnflag") == "R", "fast").otherwise("standard").alias("speed"),
        ))

    @cached_property
    def responses(self) -> DataFrame:
        once = dedupe_claude(self.raw_responses, RESPONSE_ORDER)
        model = mf.normalize_model_for(F.col("provider"), F.col("model_raw"))
        return once.withColumn("model", model)

    @cached_property
    def priced(self) -> DataFrame:
        return price_responses(self.responses, self.dim_price)

    @cached_property
    def breakdown(self) -> DataFrame:
        return model_breakdown(self.priced, ["ts_ms", "response_id"])

    @cached_property
    def usage(self) -> DataFrame:
        return session_usage(self.breakdown)

    @cached_property
    def turns(self) -> DataFrame:
        return turn_usage(self.priced.withColumn("turn_id", F.col("response_id")))

    @cached_property
    def metadata(self) -> DataFrame:
        """Project, machine, path and branch of every session."""
        cust = F.col("o_custkey")
        name = F.concat(F.lit("proj-"), F.pmod(cust, F.lit(40)))
        tree = F.concat(F.lit("wt-"), F.pmod(F.col("o_orderkey"), F.lit(7)))
        cwd = (
            F.when(
                F.pmod(cust, F.lit(5)) == 0,
                F.concat(F.lit("/work/"), name, F.lit("/.claude/worktrees/"), tree),
            )
            .when(
                F.pmod(cust, F.lit(5)) == 1,
                F.concat(F.lit("/home/dev/.t3/worktrees/"), name, F.lit("/"), tree),
            )
            .otherwise(F.concat(F.lit("/work/"), name))
        )
        people = self.table("customer").join(
            self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )
        return (
            self.table("orders")
            .join(people, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.concat(F.lit("s-"), F.col("o_orderkey")).alias("session_id"),
                "o_orderkey",
                F.col("n_name").alias("machine"),
                cwd.alias("cwd"),
                _pick(["main", "HEAD", ""], F.pmod(F.col("o_orderkey"), F.lit(3))).alias("branch"),
                F.concat(F.lit("task-"), F.pmod(F.col("o_orderkey"), F.lit(97))).alias("slug"),
            )
        )

    @cached_property
    def sessions(self) -> DataFrame:
        """Ledger sessions; every fiftieth has no recorded end."""
        joined = self.usage.withColumnRenamed("first_ms", "start_ms").join(
            self.metadata, "session_id"
        )
        end = F.when(F.pmod(F.col("o_orderkey"), F.lit(50)) != 7, F.col("last_ms"))
        return derive(
            joined.withColumns(
                {
                    "end_ms": end,
                    "dur_sec": xf.duration_seconds(F.col("start_ms"), F.col("last_ms")),
                    "project": pf.project_from_cwd(F.col("cwd")),
                }
            ).drop("o_orderkey", "last_ms")
        )

    @cached_property
    def stored_sessions(self) -> DataFrame:
        """The sessions staged once, for queries that read them repeatedly."""
        return staged(self.sessions.drop("model_breakdowns"))

    @cached_property
    def stored_records(self) -> DataFrame:
        """The same with their per-model breakdowns."""
        return staged(self.sessions)

    def share_priced(self) -> None:
        """Stage the priced responses, for queries that fold them twice."""
        self.__dict__["priced"] = staged(self.priced)

    @cached_property
    def stored_turns(self) -> DataFrame:
        return staged(self.turns)

    @cached_property
    def stored_ledger(self) -> DataFrame:
        return staged(self.ledger)

    @cached_property
    def ledger(self) -> DataFrame:
        """The derived sessions in stored-ledger columns."""
        stamp = F.coalesce("end_ms", "start_ms")
        return self.sessions.withColumns(
            {
                "completed_ms": stamp,
                "source_fingerprint": F.concat_ws(":", "total_tokens", "start_ms"),
            }
        ).select(
            "provider", "session_id", "slug", "project", "machine", "start_ms", "end_ms",
            "completed_ms", "input", "output", "cache_write", "cache_read", "total_tokens",
            "cost", "models", "source_fingerprint",
        )

    @cached_property
    def wall_sessions(self) -> DataFrame:
        """One session per user and UTC day of the event table."""
        ts = F.col("ts").cast("timestamp")
        user, day = F.col("user_id"), F.date_format(ts, "yyyy-MM-dd")
        grouped = (
            self.table("events")
            .groupBy(user, day.alias("day"))
            .agg(
                F.min(F.unix_millis(ts)).alias("start_ms"),
                F.max(F.unix_millis(ts)).alias("end_ms"),
                (F.sum(F.round(F.col("value") * 100).cast("bigint")) * 10).alias("total_tokens"),
            )
        )
        return derive(
            grouped.select(
                _pick(PROVIDERS, F.pmod(user, F.lit(4))).alias("provider"),
                F.concat_ws("-", F.lit("w"), user, "day").alias("session_id"),
                F.concat(F.lit("proj-"), F.pmod(user, F.lit(8))).alias("project"),
                F.concat(F.lit("box-"), F.pmod(user, F.lit(3))).alias("machine"),
                "start_ms",
                "end_ms",
                xf.duration_seconds(F.col("start_ms"), F.col("end_ms")).alias("dur_sec"),
                "total_tokens",
                (F.col("total_tokens").cast("decimal(12,0)") * F.lit("0.00001").cast("decimal(5,5)"))
                .cast("decimal(18,6)").alias("cost"),
                F.array(_pick(MODELS, F.pmod(user, F.lit(10)))).alias("models"),
            )
        )

    @cached_property
    def health_events(self) -> DataFrame:
        """Hook checkpoints: one per event, keyed by provider."""
        kind = F.col("event_type")
        return self.table("events").select(
            "event_id",
            _pick(PROVIDERS, F.pmod(F.col("user_id"), F.lit(4))).alias("provider"),
            F.when(F.pmod(F.col("event_id"), F.lit(2)) == 0, "Stop")
            .otherwise("SessionEnd").alias("hook_event_name"),
            F.when(kind == "error", "failed").when(kind == "signup", "no_usage")
            .otherwise("recorded").alias("status"),
            F.when(F.pmod(F.col("event_id"), F.lit(3)) > 0, F.concat(F.lit("code "), F.pmod("user_id", F.lit(5))))
            .alias("message"),
            F.col("ts").cast("timestamp").alias("occurred_at"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("occurred_ms"),
            "user_id",
            F.round(F.col("value") * 1000).cast("bigint").alias("tokens"),
        )


def _sql_pick(values: list[str], index: str) -> str:
    listing = ", ".join("'" + v + "'" for v in values)
    return f"list_extract([{listing}], CAST({index} AS INTEGER) + 1)"


def sql_normalize(model: str) -> str:
    return (
        "regexp_replace(regexp_replace(regexp_replace("
        f"{model}, '\\[[^\\]]*\\]$', ''), '-\\d{{8}}$', ''), '-\\d{{4}}-\\d{{2}}-\\d{{2}}$', '')"
    )


def sql_codex(model: str) -> str:
    bare = f"regexp_replace({model}, '-\\d{{4}}-\\d{{2}}-\\d{{2}}$', '')"
    return (
        f"CASE {bare} WHEN 'codex-auto-review' THEN 'gpt-5.5' "
        f"WHEN 'gpt-5.6' THEN 'gpt-5.6-sol' ELSE {bare} END"
    )


def sql_normalize_for(provider: str, model: str) -> str:
    dotted = f"regexp_replace(lower(trim({model})), '^(claude-[a-z]+-\\d+)\\.(\\d+)', '\\1-\\2')"
    return (
        f"CASE {provider} WHEN 'codex' THEN {sql_codex(model)} "
        f"WHEN 'copilot' THEN {sql_normalize(dotted)} "
        f"WHEN 'opencode' THEN {sql_normalize(f'lower(trim({model}))')} "
        f"ELSE {sql_normalize(model)} END"
    )


def sql_family(model: str) -> str:
    arms = []
    for kind, text, family in mf.FAMILY_RULES:
        test = "contains" if kind == "contains" else "ends_with"
        arms.append(f"WHEN {test}(lower({model}), '{text}') THEN '{family}'")
    return "CASE " + " ".join(arms) + " ELSE 'Other' END"


def sql_vendor(model: str) -> str:
    return (
        f"CASE WHEN lower(trim({model})) LIKE 'claude%' THEN 'anthropic' "
        f"WHEN lower(trim({model})) LIKE 'gpt%' OR lower(trim({model})) LIKE 'codex%' "
        "THEN 'openai' ELSE 'unknown' END"
    )


def sql_usd(units: str) -> str:
    return (
        f"CAST(CAST({units} AS DECIMAL(24,0)) * CAST(0.0000000000001 AS DECIMAL(13,13)) "
        "AS DECIMAL(18,6))"
    )


def sql_local(ms: str) -> str:
    """Wall clock in the query zone as a plain timestamp."""
    return f"timezone('{ZONE}', to_timestamp({ms} / 1000.0))"


def sql_day(ms: str) -> str:
    return f"CAST({sql_local(ms)} AS DATE)"


def _sql_dim() -> str:
    from ..operators.pricing import baked_rows

    def lit(v):
        return "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v))

    rows = ", ".join("(" + ", ".join(map(lit, row)) + ")" for row in baked_rows())
    return (
        f"SELECT * FROM (VALUES {rows}) AS v(view, model, origin, rate_input, rate_output, "
        "rate_write, rate_read, long_input, long_output, long_write, long_read, fast_x10)"
    )


def _sql_cost() -> str:
    parts = []
    for rate, count in (
        ("input", "input"), ("output", "output"), ("write", "cache_write"), ("read", "cache_read"),
    ):
        parts.append(f"{count} * CASE WHEN is_long THEN long_{rate} ELSE rate_{rate} END")
    return "(" + " + ".join(parts) + ")"


# name: (needed tables, SQL)
CTES: dict[str, tuple[list[str], str]] = {
    "dim_price": ([], _sql_dim()),
    "raw_responses": (
        [],
        f"""SELECT *, {sql_normalize_for('provider', 'model_raw')} AS model FROM (
        SELECT {_sql_pick(PROVIDERS, 'l_orderkey % 4')} AS provider,
          's-' || l_orderkey AS session_id, l_orderkey || '-' || l_linenumber AS response_id,
          epoch_ms(l_shipdate) + (l_linenumber * 7 + l_suppkey % 60) * 60000 AS ts_ms,
          {_sql_pick(MODELS, 'l_partkey % 10')} AS model_raw,
          CAST(round(l_quantity * 1000) AS BIGINT) AS input,
          CAST(round(l_extendedprice / 10) AS BIGINT) AS output,
          CAST(round(l_tax * 100) AS BIGINT) * 500 AS cache_write,
          CAST(round(l_discount * 100) AS BIGINT) * 30000 AS cache_read,
          CASE WHEN l_returnflag = 'R' THEN 'fast' ELSE 'standard' END AS speed
        FROM lineitem)""",
    ),
    "responses": (
        ["raw_responses"],
        """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
        PARTITION BY provider, session_id, response_id ORDER BY ts_ms, model_raw, input,
        output, cache_write, cache_read, speed) AS rn FROM raw_responses) WHERE rn = 1""",
    ),
    "priced": (
        ["responses", "dim_price"],
        f"""SELECT *, coalesce({_sql_cost()} * speed_x10, 0) AS cost_units FROM (
        SELECT r.*, d.* EXCLUDE (view, model, origin, fast_x10), d.rate_input IS NOT NULL AS priced,
          coalesce(r.provider IN ('claude', 'codex') AND d.long_input IS NOT NULL
            AND r.input + r.cache_write + r.cache_read > 272000, false) AS is_long,
          CASE WHEN (r.provider = 'claude' AND r.speed = 'fast')
                 OR (r.provider = 'codex' AND r.speed IN ('priority', 'fast'))
               THEN coalesce(d.fast_x10, 10) ELSE 10 END AS speed_x10
        FROM responses r LEFT JOIN dim_price d
          ON d.view = CASE WHEN r.provider = 'codex' THEN 'openai' ELSE 'shared' END
         AND d.model = {sql_codex("CASE WHEN r.provider = 'codex' THEN r.model ELSE " + sql_normalize('r.model') + " END")})""",
    ),
    "breakdown": (
        ["priced"],
        f"""SELECT *, input + output + cache_write + cache_read AS total_tokens,
          {sql_usd('cost_units')} AS cost FROM (
        SELECT provider, session_id, model, CAST(sum(input) AS BIGINT) AS input,
          CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_write) AS BIGINT) AS cache_write,
          CAST(sum(cache_read) AS BIGINT) AS cache_read, sum(cost_units) AS cost_units,
          min(struct_pack(ts_ms := ts_ms, response_id := response_id)) AS first_ord,
          bool_and(priced) AS priced
        FROM priced GROUP BY ALL)""",
    ),
    "usage": (
        ["breakdown"],
        f"""SELECT *, input + output + cache_write + cache_read AS total_tokens,
          {sql_usd('cost_units')} AS cost FROM (
        SELECT provider, session_id, CAST(sum(input) AS BIGINT) AS input,
          CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_write) AS BIGINT) AS cache_write,
          CAST(sum(cache_read) AS BIGINT) AS cache_read, sum(cost_units) AS cost_units,
          list(model ORDER BY cost_units DESC, first_ord) AS models
        FROM breakdown GROUP BY ALL)""",
    ),
    "turns": (
        ["priced"],
        f"""SELECT *, input + output + cache_write + cache_read AS total_tokens,
          {sql_usd('cost_units')} AS cost FROM (
        SELECT provider, session_id, response_id AS turn_id, min(ts_ms) AS start_ms,
          max(ts_ms) AS end_ms, CAST(sum(input) AS BIGINT) AS input,
          CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_write) AS BIGINT) AS cache_write,
          CAST(sum(cache_read) AS BIGINT) AS cache_read, sum(cost_units) AS cost_units
        FROM priced GROUP BY ALL)""",
    ),
    "metadata": (
        [],
        """SELECT 's-' || o_orderkey AS session_id, o_orderkey, n_name AS machine,
          CASE o_custkey % 5 WHEN 0 THEN '/work/' || p || '/.claude/worktrees/' || w
            WHEN 1 THEN '/home/dev/.t3/worktrees/' || p || '/' || w ELSE '/work/' || p END AS cwd,
          p AS project, CASE o_orderkey % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'HEAD' ELSE '' END AS branch,
          'task-' || o_orderkey % 97 AS slug
        FROM (SELECT *, 'proj-' || o_custkey % 40 AS p, 'wt-' || o_orderkey % 7 AS w FROM orders)
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "sessions": (
        ["usage", "responses", "metadata"],
        f"""SELECT *, coalesce(end_ms, start_ms) AS t_ms, models[1] AS primary_model,
          {sql_family('models[1]')} AS family FROM (
        SELECT u.* EXCLUDE (cost_units), sp.start_ms,
          CASE WHEN m.o_orderkey % 50 <> 7 THEN sp.last_ms END AS end_ms,
          greatest(0, (sp.last_ms - sp.start_ms) // 1000) AS dur_sec,
          m.machine, m.cwd, m.project, m.branch, m.slug
        FROM usage u JOIN (SELECT provider, session_id, min(ts_ms) AS start_ms,
          max(ts_ms) AS last_ms FROM responses GROUP BY ALL) sp USING (provider, session_id)
        JOIN metadata m USING (session_id))""",
    ),
    "ledger": (
        ["sessions"],
        """SELECT provider, session_id, slug, project, machine, start_ms, end_ms,
          t_ms AS completed_ms, input, output, cache_write, cache_read, total_tokens, cost, models,
          total_tokens || ':' || start_ms AS source_fingerprint FROM sessions""",
    ),
    "wall_sessions": (
        [],
        f"""SELECT *, end_ms AS t_ms, models[1] AS primary_model, {sql_family('models[1]')} AS family
        FROM (SELECT {_sql_pick(PROVIDERS, 'user_id % 4')} AS provider,
          'w-' || user_id || '-' || day AS session_id, 'proj-' || user_id % 8 AS project,
          'box-' || user_id % 3 AS machine, start_ms, end_ms,
          (end_ms - start_ms) // 1000 AS dur_sec, total_tokens,
          CAST(CAST(total_tokens AS DECIMAL(12,0)) * CAST(0.00001 AS DECIMAL(5,5)) AS DECIMAL(18,6)) AS cost,
          [{_sql_pick(MODELS, 'user_id % 10')}] AS models
        FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, min(epoch_us(ts) // 1000) AS start_ms,
          max(epoch_us(ts) // 1000) AS end_ms,
          CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) * 10 AS total_tokens
          FROM events GROUP BY ALL))""",
    ),
    "health_events": (
        [],
        f"""SELECT event_id, {_sql_pick(PROVIDERS, 'user_id % 4')} AS provider,
          CASE WHEN event_id % 2 = 0 THEN 'Stop' ELSE 'SessionEnd' END AS hook_event_name,
          CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'no_usage'
            ELSE 'recorded' END AS status,
          CASE WHEN event_id % 3 > 0 THEN 'code ' || user_id % 5 END AS message,
          epoch_us(ts) // 1000 AS occurred_ms, user_id, CAST(round(value * 1000) AS BIGINT) AS tokens
        FROM events""",
    ),
}


def with_ctes(needs: list[str], body: str) -> str:
    """SQL text with the needed derived tables, and theirs, up front."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            add(dep)
        order.append(name)

    for name in needs:
        add(name)
    if not order:
        return body
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    for word in ("WITH RECURSIVE ", "WITH "):
        if body.lstrip().startswith(word):
            return f"{word}{head},\n{body.lstrip()[len(word):]}"
    return f"WITH {head}\n{body}"
