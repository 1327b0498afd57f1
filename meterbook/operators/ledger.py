"""The ledger: assembling records, merging versions, reading old shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as cf
from ..functions import models as mf
from ..functions import projects as pf
from ..functions import text as xf
from ..functions.money import USD
from .responses import COUNTS, first_by

# Fields that travel together when recorded usage is kept.
USAGE = [*COUNTS, "total_tokens", "cost", "models", "model_breakdowns", "turns_key"]


def iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def ledger_row(usage: DataFrame, metadata: DataFrame) -> DataFrame:
    """Stored record of each session, in its published field names.

    Turns stay in their own long table: one session may have any number.
    """
    rows = usage.join(metadata, ["provider", "session_id"])
    seconds = xf.duration_seconds(F.col("start_ms"), F.col("end_ms"))
    return rows.select(
        iso(F.col("end_ms")).alias("timestamp"),
        F.coalesce("slug", F.lit("")).alias("session_slug"),
        "session_id",
        pf.project_from_cwd(F.col("cwd")).alias("project"),
        F.coalesce("branch", F.lit("")).alias("branch"),
        F.coalesce("cwd", F.lit("")).alias("cwd"),
        "machine",
        iso(F.col("start_ms")).alias("start_time"),
        iso(F.col("end_ms")).alias("end_time"),
        seconds.alias("duration_seconds"),
        xf.duration_text(seconds).alias("duration_human"),
        F.col("input").alias("input_tokens"),
        F.col("output").alias("output_tokens"),
        F.col("cache_write").alias("cache_creation_tokens"),
        F.col("cache_read").alias("cache_read_tokens"),
        "total_tokens",
        F.col("cost").cast(USD).alias("total_cost_usd"),
        "models",
        "model_breakdowns",
        "source_fingerprint",
        "provider",
    )


def _host(side: str) -> Column:
    provider = F.col(f"{side}.provider")
    return F.when(F.coalesce(provider, F.lit("")) == "", "claude").otherwise(provider)


def _paired(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Full outer join on the session id with each side as one struct."""
    def packed(df, name):
        rest = [c for c in df.columns if c != "session_id"]
        return df.select("session_id", F.struct(*rest).alias(name))

    return packed(left, names[0]).join(packed(right, names[1]), "session_id", "full_outer")


def _regresses(new: str, old: str) -> Column:
    """Fewer tokens or a lower cost than already recorded."""
    return (F.col(f"{new}.total_tokens") < F.col(f"{old}.total_tokens")) | (
        F.col(f"{new}.cost") < F.col(f"{old}.cost")
    )


def merge_ledger(existing: DataFrame, nxt: DataFrame) -> DataFrame:
    """One merge step: new snapshots never lower recorded usage.

    A snapshot of the same session and host that regresses keeps the recorded
    usage fields and takes the new metadata and fingerprint. ``action`` says
    insert, replace, preserve or untouched.
    """
    both = _paired(existing, nxt, ("e", "n"))
    preserve = (
        F.col("e").isNotNull() & F.col("n").isNotNull()
        & (_host("e") == _host("n")) & _regresses("n", "e")
    )
    action = (
        F.when(F.col("n").isNull(), "untouched")
        .when(F.col("e").isNull(), "insert")
        .when(preserve, "preserve")
        .otherwise("replace")
    )
    out = []
    for c in existing.columns:
        if c == "session_id":
            out.append(F.col(c))
            continue
        keep = ["untouched", "preserve"] if c in USAGE else ["untouched"]
        out.append(
            F.when(F.col("action").isin(keep), F.col(f"e.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
        )
    return both.withColumn("action", action).select(*out, "action")


def merge_turns(existing: DataFrame, nxt: DataFrame, merged: DataFrame) -> DataFrame:
    """Turns that belong to the usage each merged session holds."""
    keep = merged.filter(F.col("action").isin("untouched", "preserve")).select("session_id")
    take = merged.filter(F.col("action").isin("insert", "replace")).select("session_id")
    return existing.join(keep, "session_id", "left_semi").unionByName(
        nxt.join(take, "session_id", "left_semi")
    )


def combine_ledgers(
    source: DataFrame, destination: DataFrame, report_conflicts: bool = False
) -> DataFrame:
    """Union of two ledgers; a regressing source row loses to the destination.

    The same session under two hosts is a conflict. It fails the job, or with
    ``report_conflicts`` stays as the destination has it, marked ``conflict``.
    """
    both = _paired(source, destination, ("s", "d"))
    matched = F.col("s").isNotNull() & F.col("d").isNotNull()
    clash = matched & (_host("s") != _host("d"))
    fail = F.raise_error(F.concat(F.lit("conflicting ledger row: "), "session_id"))
    action = (
        F.when(clash, F.lit("conflict") if report_conflicts else fail)
        .when(F.col("s").isNull(), "untouched")
        .when(matched & _regresses("s", "d"), "retained")
        .otherwise("copied")
    )
    from_d = F.col("action").isin("untouched", "retained", "conflict")
    rest = [c for c in destination.columns if c != "session_id"]
    return both.withColumn("action", action).select(
        "session_id",
        *[F.when(from_d, F.col(f"d.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in rest],
        "action",
    )


def action_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("action").agg(F.count(F.lit(1)).alias("sessions"))


def import_legacy(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Legacy rows to add: first row per key, none the ledger already has.

    ``rows`` needs ``line`` and the ledger fields; both sides get their
    storage key.
    """
    keyed = _with_key(rows)
    first = first_by(keyed, ["key"], ["line"])
    return first.join(_with_key(ledger).select("key"), "key", "left_anti")


def _with_key(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "key", xf.ledger_key(F.col("session_id"), F.col("slug"), F.col("end_time"))
    )


def import_counts(
    rows: DataFrame, ledger: DataFrame, malformed: DataFrame | None = None
) -> DataFrame:
    """How many legacy rows were migrated, superseded, malformed or had no id."""
    migrated = import_legacy(rows, ledger).agg(F.count(F.lit(1))).scalar()
    bad = F.lit(0) if malformed is None else malformed.agg(F.count(F.lit(1))).scalar()
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce("session_id", F.lit("")) == "").alias("without_id"),
    ).select(
        migrated.alias("migrated"),
        (F.col("rows") - migrated).alias("superseded"),
        bad.alias("malformed"),
        "without_id",
    )


def import_anomalies(raw: DataFrame) -> DataFrame:
    """(line, kind, detail) of legacy lines to look at: too few fields, or a start that is no time.

    Lines with too few fields are not imported; the others are, as they stand.
    """
    start = F.coalesce("start_time", F.lit(""))
    kind = F.when(F.col("malformed"), "fields").when(cf.instant_ms(start).isNull(), "start_time")
    return raw.select(
        "line", kind.alias("kind"), F.when(F.col("malformed"), F.col("raw")).otherwise(start).alias("detail")
    ).filter("kind IS NOT NULL")


def import_check(rows: DataFrame, before: DataFrame, after: DataFrame, amount: str = "cost") -> DataFrame:
    """One row: sessions and total that the import should have left, those it left, and whether they agree.

    What should be there is the ledger as it was with the first legacy row of each new key.
    """
    def totals(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(f"{name}_sessions"), F.coalesce(F.sum(amount), F.lit(0)).alias(f"{name}_total"))

    wanted = before.select(amount).unionByName(import_legacy(rows, before).select(amount))
    left, right = totals(wanted, "expected"), totals(after, "found")
    names = [*left.columns, *right.columns]
    one = left.select("*", *[right.select(c).scalar().alias(c) for c in right.columns])
    same = (F.col("expected_sessions") == F.col("found_sessions")) & (F.col("expected_total") == F.col("found_total"))
    return one.select(*names, same.alias("agrees"))


def dedupe_ledger_rows(rows: DataFrame) -> DataFrame:
    """Last file in name order wins per session id; rows without an id stay."""
    named = rows.filter(F.coalesce("session_id", F.lit("")) != "")
    rest = rows.filter(F.coalesce("session_id", F.lit("")) == "")
    others = [c for c in rows.columns if c not in ("session_id", "file")]
    last = named.groupBy("session_id").agg(
        F.max_by(F.struct("file", *others), "file").alias("_row")
    )
    return last.select("session_id", "_row.*").select(*rows.columns).unionByName(rest)


def branch_fill(metadata: DataFrame, current: DataFrame) -> DataFrame:
    """Replace a missing or detached branch by the current one of its path."""
    known = current.select("cwd", F.col("branch").alias("_current"))
    joined = metadata.join(known, "cwd", "left")
    missing = F.coalesce("branch", F.lit("")).isin("", "HEAD") & (F.coalesce("cwd", F.lit("")) != "")
    found = F.nullif("_current", F.lit(""))
    return joined.withColumn(
        "branch", F.when(missing & found.isNotNull(), found).otherwise(F.col("branch"))
    ).drop("_current")


def _text_list(value: Column) -> Column:
    """Models of a stored record: a JSON array or a separated string."""
    listed = F.from_json(value, "array<string>")
    trimmed = F.filter(F.transform(listed, lambda m: F.trim(m)), lambda m: m != "")
    return F.when(F.trim(value).startswith("["), trimmed).otherwise(cf.to_models(value))


def _filled(name: str) -> Column:
    return F.nullif(name, F.lit(""))


def normalize_ledger(raw: DataFrame) -> DataFrame:
    """Sessions from stored records of any age; see the JSON ledger scan.

    Every scalar arrives as text. Records without a readable start are dropped
    and an unreadable end counts as none.
    """
    start = cf.instant_ms(F.col("start_time"))
    entry = F.transform(
        "model_breakdowns",
        lambda p: F.struct(
            F.coalesce(p["model"], F.lit("")).alias("model"),
            F.coalesce(
                F.nullif(p["vendor"], F.lit("")), mf.model_vendor(F.coalesce(p["model"], F.lit("")))
            ).alias("vendor"),
            cf.to_count(p["total_tokens"]).alias("total_tokens"),
            cf.to_number(p["total_cost_usd"]).cast(USD).alias("cost"),
        ),
    )
    listed = F.trim(F.coalesce("models", F.lit(""))).startswith("[")
    return (
        raw.filter(start.isNotNull())
        .select(
            F.coalesce(
                _filled("session_slug"), F.nullif(F.left("session_id", F.lit(8)), F.lit("")), F.lit("-")
            ).alias("slug"),
            F.coalesce("session_id", F.lit("")).alias("session_id"),
            pf.recorded_project(F.col("cwd"), _filled("project")).alias("project"),
            F.trim(F.coalesce("branch", F.lit(""))).alias("branch"),
            F.coalesce("cwd", F.lit("")).alias("cwd"),
            F.trim(F.coalesce(_filled("machine"), F.lit("-"))).alias("machine"),
            start.alias("start_ms"),
            cf.instant_ms(_filled("end_time")).alias("end_ms"),
            cf.to_count(F.col("duration_seconds")).alias("dur_sec"),
            F.coalesce("duration_human", F.lit("")).alias("dur_human"),
            cf.to_count(F.col("input_tokens")).alias("input"),
            cf.to_count(F.col("output_tokens")).alias("output"),
            cf.to_count(F.col("cache_creation_tokens")).alias("cache_write"),
            cf.to_count(F.col("cache_read_tokens")).alias("cache_read"),
            cf.to_count(F.col("total_tokens")).alias("total_tokens"),
            cf.to_number(F.col("total_cost_usd")).cast(USD).alias("cost"),
            _text_list(F.col("models")).alias("models"),
            listed.alias("models_listed"),
            entry.alias("model_breakdowns"),
            F.coalesce(_filled("provider"), F.lit("claude")).alias("provider"),
            "file",
        )
    )


def normalize_turns(raw: DataFrame) -> DataFrame:
    """Turns of stored records in long form; an end defaults to the start."""
    turn = raw.filter(cf.instant_ms(F.col("start_time")).isNotNull()).select(
        F.coalesce(_filled("provider"), F.lit("claude")).alias("provider"),
        F.coalesce("session_id", F.lit("")).alias("session_id"),
        F.explode("turns").alias("t"),
    )
    end = F.coalesce(F.nullif(F.col("t.end_time"), F.lit("")), F.col("t.start_time"))
    dated = turn.select(
        "provider",
        "session_id",
        F.coalesce("t.turn_id", F.lit("")).alias("turn_id"),
        cf.instant_ms(F.col("t.start_time")).alias("start_ms"),
        cf.instant_ms(end).alias("end_ms"),
        cf.to_count(F.col("t.input_tokens")).alias("input"),
        cf.to_count(F.col("t.output_tokens")).alias("output"),
        cf.to_count(F.col("t.cache_creation_tokens")).alias("cache_write"),
        cf.to_count(F.col("t.cache_read_tokens")).alias("cache_read"),
        cf.to_count(F.col("t.total_tokens")).alias("total_tokens"),
        cf.to_number(F.col("t.total_cost_usd")).cast(USD).alias("cost"),
    )
    return dated.filter("start_ms IS NOT NULL AND end_ms IS NOT NULL")


def vendor_split(ledger: DataFrame) -> DataFrame:
    """Cost and tokens of each session per model maker, in long form.

    Exact where the record has breakdowns. Older records split equally over
    the distinct makers of their model list; a list kept as one string names
    no maker. Runs row by row, without a shuffle.
    """
    exact = F.coalesce(F.size("model_breakdowns"), F.lit(0)) > 0
    parts = F.col("model_breakdowns")
    listed = F.col("models_listed") if "models_listed" in ledger.columns else F.lit(True)
    models = F.when(listed, F.col("models")).otherwise(F.array().cast("array<string>"))
    makers = F.array_distinct(F.transform(models, mf.model_vendor))
    some = F.coalesce(F.size(makers), F.lit(0)) > 0
    old = F.when(some, makers).otherwise(F.array(F.lit("unknown")))
    vendors = F.when(exact, F.array_distinct(F.transform(parts, lambda p: p["vendor"]))).otherwise(old)
    rows = ledger.select(
        "provider", "session_id", "cost", "total_tokens", exact.alias("exact"),
        parts.alias("parts"), F.size(vendors).alias("shares"), F.explode(vendors).alias("vendor"),
    )

    def own(field, kind):
        mine = F.filter("parts", lambda p: p["vendor"] == F.col("vendor"))
        zero = F.lit(0).cast(kind)
        return F.aggregate(mine, zero, lambda acc, p: (acc + p[field]).cast(kind))

    return rows.select(
        "provider",
        "session_id",
        "vendor",
        F.when(F.col("exact"), own("cost", "decimal(28,6)").cast("double"))
        .otherwise(F.col("cost").cast("double") / F.col("shares")).alias("cost"),
        F.when(F.col("exact"), own("total_tokens", "bigint").cast("double"))
        .otherwise(F.col("total_tokens").cast("double") / F.col("shares")).alias("tokens"),
    )
