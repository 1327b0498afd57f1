"""Codex rollouts: values in force, turns, billed events and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as cf
from ..functions import models as mf
from ..functions import text as xf
from ..functions.money import to_usd, units_sum
from .breakdown import total_tokens
from .carry import carry_forward, running_total
from .responses import (
    COUNTS,
    billable_codex,
    codex_token_split,
    dedupe_codex,
    non_negative,
    usage_key,
)

KEY = ["session_id"]


def _settings() -> Column:
    return (F.col("type") == "event_msg") & (F.col("payload.type") == "thread_settings_applied")


def codex_lines(records: DataFrame) -> DataFrame:
    """Rollout records as flat lines of one kind each."""
    declared = F.when(F.col("type") == "turn_context", F.col("payload.model")).when(
        _settings(), F.col("payload.thread_settings.model")
    )
    kind = (
        F.when(F.col("type") == "session_meta", "meta")
        .when(_settings(), "settings")
        .when(F.col("type") == "turn_context", "context")
        .when(billable_codex(), "usage")
        .otherwise("other")
    )
    return records.select(
        "*",
        kind.alias("kind"),
        mf.codex_model(F.nullif(declared, F.lit(""))).alias("declared"),
        F.when(_settings(), F.col("payload.thread_settings.service_tier")).alias("tier_set"),
        F.nullif(F.when(F.col("type") == "turn_context", F.col("payload.turn_id")), F.lit(""))
        .alias("context_id"),
        F.nullif("timestamp", F.lit("")).alias("at"),
    )


def codex_state(lines: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Model, tier and turn opener in force on each line.

    Before any declaration the session's first declared model holds. Needs
    session_id, chunk, the order columns, kind, declared and tier_set.
    """
    order = order or ["ord"]
    opener = F.when(F.col("kind") == "context", F.struct(*order))
    return carry_forward(
        lines,
        KEY,
        "chunk",
        order,
        {"model_now": F.col("declared"), "tier_now": F.col("tier_set"), "opener": opener},
        {"model_first": F.col("declared")},
    ).withColumns(
        {
            "model": F.coalesce("model_now", "model_first", F.lit("unknown")),
            "tier": F.coalesce("tier_now", F.lit("default")),
        }
    ).drop("model_now", "model_first", "tier_now")


def codex_turn_names(lines: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Turn name and start of each opener, one row per turn-opening line.

    An opener without an id is named after the number of turns so far. Usage
    before any opener makes an implicit first turn, whose opener is null.
    """
    order = order or ["ord"]
    at = F.struct(*order)
    firsts = lines.filter(F.col("kind").isin("context", "usage")).groupBy(*KEY).agg(
        F.min(F.when(F.col("kind") == "usage", at)).alias("first_usage"),
        F.min(F.when(F.col("kind") == "context", at)).alias("first_context"),
        F.min_by("at", F.when(F.col("kind") == "usage", at)).alias("usage_at"),
    )
    early = F.col("first_usage").isNotNull() & (
        F.col("first_context").isNull() | (F.col("first_usage") < F.col("first_context"))
    )
    implicit = firsts.filter(early).select(*KEY, "first_usage", "usage_at")

    context = lines.filter("kind = 'context'").select(
        *KEY, "chunk", at.alias("opener"), "at", "context_id"
    )
    named = context.filter("context_id IS NOT NULL").groupBy(*KEY, "context_id").agg(
        F.min(F.struct("opener", "chunk", "at")).alias("made")
    )
    made = named.select(
        *KEY, "made.chunk", "made.opener", F.col("made.at").alias("at"), "context_id"
    ).unionByName(context.filter("context_id IS NULL"))
    numbered = running_total(made, KEY, "chunk", ["opener"], sums={"n": F.lit(1)}).join(
        implicit.select(*KEY, F.lit(1).alias("extra")), KEY, "left"
    )
    number = F.col("n") + F.coalesce("extra", F.lit(0))
    made_names = numbered.select(
        *KEY,
        F.coalesce("context_id", F.concat(F.lit("turn-"), number)).alias("turn_id"),
        F.col("opener").alias("made_by"),
        F.col("at").alias("start"),
        "context_id",
    )
    # A repeated id leads back to the line that made it.
    by_id = made_names.filter("context_id IS NOT NULL").select(*KEY, "context_id", "turn_id", "start")
    reopened = context.filter("context_id IS NOT NULL").select(*KEY, "opener", "context_id").join(
        by_id, [*KEY, "context_id"]
    ).select(*KEY, "opener", "turn_id", "start")
    plain = made_names.filter("context_id IS NULL").select(
        *KEY, F.col("made_by").alias("opener"), "turn_id", "start"
    )
    first = implicit.select(
        *KEY,
        F.col("first_usage").alias("opener"),
        F.lit("turn-1").alias("turn_id"),
        F.col("usage_at").alias("start"),
    )
    return reopened.unionByName(plain).unionByName(first)


def with_turns(state: DataFrame, names: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Attach turn_id to lines; lines before any turn keep a null."""
    order = order or ["ord"]
    implicit = names.filter("turn_id = 'turn-1'").groupBy(*KEY).agg(
        F.min("opener").alias("_first")
    )
    opened = state.join(implicit, KEY, "left").withColumn(
        "opener",
        F.coalesce("opener", F.when(F.struct(*order) >= F.col("_first"), F.col("_first"))),
    ).drop("_first")
    return opened.join(names.select(*KEY, "opener", "turn_id"), [*KEY, "opener"], "left")


def codex_turn_spans(lines: DataFrame, names: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Start and end of each turn.

    The end is the time of the last record in the turn that is neither
    metadata nor settings nor an opener.
    """
    order = order or ["ord"]
    at = F.struct(*order)
    inside = lines.filter(F.col("kind").isin("usage", "other") & F.col("turn_id").isNotNull())
    ends = inside.groupBy(*KEY, "turn_id").agg(
        F.max_by("at", F.when(F.col("at").isNotNull(), at)).alias("end")
    )
    starts = names.groupBy(*KEY, "turn_id").agg(F.min_by("start", "opener").alias("start"))
    return starts.join(ends, [*KEY, "turn_id"], "left").select(
        *KEY, "turn_id", "start", F.coalesce("end", "start").alias("end")
    )


def codex_responses(lines: DataFrame) -> DataFrame:
    """Billed events with the model, tier and turn in force, each once."""
    usage = F.col("payload.info.last_token_usage")
    split = codex_token_split(
        usage["input_tokens"], usage["cached_input_tokens"], usage["cache_write_tokens"]
    )
    rows = lines.filter("kind = 'usage'").select(
        "provider",
        "session_id",
        usage_key(F.col("payload.info.total_token_usage")).alias("usage_key"),
        "turn_id",
        F.col("timestamp").alias("ts"),
        cf.instant_ms(F.col("timestamp")).alias("ts_ms"),
        F.col("model").alias("model_raw"),
        mf.codex_model(F.col("model")).alias("model"),
        split["input"].alias("input"),
        non_negative(usage["output_tokens"]).alias("output"),
        split["cache_write"].alias("cache_write"),
        split["cache_read"].alias("cache_read"),
        F.col("tier").alias("speed"),
        "ord",
    )
    return dedupe_codex(rows, ["ord"]).withColumnRenamed("usage_key", "response_id")


def codex_turn_usage(priced: DataFrame, spans: DataFrame) -> DataFrame:
    """Turns with their usage; turns without tokens are dropped."""
    sums = priced.groupBy("provider", "session_id", "turn_id").agg(
        *[F.sum(c).alias(c) for c in COUNTS], units_sum(F.col("cost_units")).alias("cost_units")
    )
    return (
        sums.withColumns({"total_tokens": total_tokens(), "cost": to_usd(F.col("cost_units"))})
        .filter("total_tokens > 0")
        .join(spans, ["session_id", "turn_id"], "left")
        .withColumns(
            {
                "start_ms": cf.instant_ms(F.col("start")),
                "end_ms": cf.instant_ms(F.col("end")),
            }
        )
        .drop("cost_units", "start", "end")
    )


def codex_identity(records: DataFrame) -> DataFrame:
    """The id a session gives itself: the first session_meta decides."""
    first = records.filter("type = 'session_meta'").groupBy("session_id").agg(
        F.min_by(
            F.struct(F.col("payload.id").alias("a"), F.col("payload.session_id").alias("b")), "ord"
        ).alias("m")
    )
    own = F.coalesce(F.nullif("m.a", F.lit("")), F.nullif("m.b", F.lit("")), "session_id")
    return first.select("session_id", own.alias("identity"))


def codex_metadata(records: DataFrame) -> DataFrame:
    """Session metadata; the path of the last turn beats the session's own."""
    at = F.col("ord")
    payload = F.col("payload.type")
    meta, context = F.col("type") == "session_meta", F.col("type") == "turn_context"
    event = F.col("type") == "event_msg"
    user = event & (payload == "user_message")
    dated = F.nullif("timestamp", F.lit(""))
    cwd, branch = F.nullif("payload.cwd", F.lit("")), F.nullif("payload.git.branch", F.lit(""))
    said = xf.clip(xf.strip(F.col("payload.message")))
    item = (
        (F.col("type") == "response_item")
        & (payload == "message")
        & (F.col("payload.role") == "user")
    )
    parts = F.filter(
        "payload.content",
        lambda p: (p["type"] == "input_text") & (F.coalesce(p["text"], F.lit("")) != ""),
    )
    listed = F.array_join(F.transform(parts, lambda p: p["text"]), " ")
    spare = F.when(item & (F.coalesce(listed, F.lit("")) != ""), xf.clip(xf.strip(listed)))
    rows = records.withColumns(
        {"_at": dated, "_cwd": cwd, "_branch": branch, "_said": said, "_spare": spare}
    )

    def pick(fn, name, when):
        return fn(name, F.when(when & F.col(name).isNotNull(), at))

    found = rows.groupBy("provider", "session_id").agg(
        pick(F.min_by, "_at", F.lit(True)).alias("start"),
        pick(F.max_by, "_at", F.lit(True)).alias("end"),
        pick(F.max_by, "_cwd", context).alias("context_cwd"),
        pick(F.min_by, "_cwd", meta).alias("meta_cwd"),
        pick(F.min_by, "_branch", meta).alias("branch"),
        pick(F.min_by, "_said", user & (F.col("_said") != "")).alias("said"),
        pick(F.min_by, "_spare", F.lit(True)).alias("spare"),
        F.count_if(user).alias("user_messages"),
        F.count_if(event & (payload == "agent_message")).alias("assistant_messages"),
    )
    prompt = F.coalesce("said", "spare", F.lit(xf.NO_PROMPT))
    return found.select(
        "provider",
        "session_id",
        cf.instant_ms(F.col("start")).alias("start_ms"),
        cf.instant_ms(F.col("end")).alias("end_ms"),
        F.coalesce("context_cwd", "meta_cwd").alias("cwd"),
        "branch",
        xf.prompt_slug(F.lit("codex"), prompt, F.col("session_id")).alias("slug"),
        prompt.alias("first_prompt"),
        "user_messages",
        "assistant_messages",
        (F.col("user_messages") + F.col("assistant_messages")).alias("total_messages"),
    )
