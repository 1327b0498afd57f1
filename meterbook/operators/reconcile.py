"""What to re-derive, reuse or drop when sources and ledger differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_AGE_MS = 120_000


def newest_per_session(found: DataFrame) -> DataFrame:
    """One transcript per provider and session id, the one changed last."""
    keys = ["provider", "session_id"]
    rest = [c for c in found.columns if c not in keys]
    order = F.struct("mtime_ms", *[c for c in rest if c != "mtime_ms"])
    return (
        found.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), order).alias("_row"))
        .select(*keys, "_row.*")
        .select(*found.columns)
    )


def needs_sync(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Sources the ledger has not recorded in exactly this state."""
    provider = F.when(F.coalesce("provider", F.lit("")) == "", "claude").otherwise(F.col("provider"))
    known = ledger.select(
        "session_id", provider.alias("provider"), F.col("source_fingerprint").alias("fingerprint")
    )
    return found.join(known, ["session_id", "provider", "fingerprint"], "left_anti")


def backfill_candidates(
    found: DataFrame, ledger: DataFrame, now_ms: int, current_session: str | None = None
) -> DataFrame:
    """Settled transcripts without a ledger row, oldest first."""
    ready = found.filter(F.lit(now_ms) - F.col("mtime_ms") > MIN_AGE_MS)
    if current_session is not None:
        ready = ready.filter(F.col("session_id") != current_session)
    return ready.join(ledger.select("session_id"), "session_id", "left_anti").orderBy(
        "mtime_ms", "session_id"
    )


def changed_files(files: DataFrame, prior: DataFrame) -> DataFrame:
    """Files to read again: new ones and those whose size or time moved."""
    return files.join(
        prior.select("file", "size", "mtime_ms"), ["file", "size", "mtime_ms"], "left_anti"
    )


def reuse_snapshot(files: DataFrame, read: DataFrame, prior: DataFrame) -> DataFrame:
    """Next snapshot from the listing, the files just read and the last one.

    ``files`` lists (file, size, mtime_ms); ``read`` has (file, record) of the
    changed files, a null record where unreadable; ``prior`` has (file, size,
    mtime_ms, record). Unchanged files keep their row, broken ones their old
    one, deleted ones go. ``status`` is reused, parsed or failed.
    """
    old = prior.select("file", F.struct("size", "mtime_ms", "record").alias("p"))
    new = read.select("file", F.struct("record").alias("r"))
    same = (F.col("p.size") == F.col("size")) & (F.col("p.mtime_ms") == F.col("mtime_ms"))
    status = (
        F.when(F.coalesce(same, F.lit(False)), "reused")
        .when(F.col("r.record").isNotNull(), "parsed")
        .otherwise("failed")
    )
    kept = F.col("status") != "parsed"
    return (
        files.join(old, "file", "left")
        .join(new, "file", "left")
        .withColumn("status", status)
        .filter(~kept | F.col("p").isNotNull())
        .select(
            "file",
            F.when(kept, F.col("p.size")).otherwise(F.col("size")).alias("size"),
            F.when(kept, F.col("p.mtime_ms")).otherwise(F.col("mtime_ms")).alias("mtime_ms"),
            F.when(kept, F.col("p.record")).otherwise(F.col("r.record")).alias("record"),
            "status",
        )
    )


def find_session(found: DataFrame, text: str | None = None) -> DataFrame:
    """The newest session a query names, over every provider.

    A query matches the start of an id; for codex and copilot also any part of
    the transcript path, for opencode any part of the project path.
    """
    if text:
        needle = text.lower()

        def within(name: str) -> Column:
            return F.lower(F.coalesce(F.col(name), F.lit(""))).contains(needle)

        hit = (
            F.col("session_id").startswith(text)
            | (F.col("provider").isin("codex", "copilot") & within("transcript_path"))
            | ((F.col("provider") == "opencode") & within("project_path"))
        )
        found = found.filter(hit)
    return found.orderBy(F.desc("mtime_ms"), "provider", "session_id").limit(1)


# Record types that identify a provider's transcript.
RECORD_TYPES = {
    "user": "claude",
    "assistant": "claude",
    "session_meta": "codex",
    "turn_context": "codex",
    "session.start": "copilot",
}


def detect_provider(lines: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Provider of each file by its first telling record, else by its root.

    ``lines`` has (path, ord, value); ``roots`` has (root, provider). Files
    that neither names get a null provider. The first telling record counts
    wherever it stands, whatever the size of what precedes it.
    """
    kind = F.try_variant_get(F.try_parse_json("value"), "$.type", "string")
    table = F.create_map(*[F.lit(x) for pair in RECORD_TYPES.items() for x in pair])
    told = lines.select("path", "ord", F.try_element_at(table, kind).alias("host"))
    by_type = told.groupBy("path").agg(
        F.min_by("host", F.when(F.col("host").isNotNull(), F.col("ord"))).alias("by_type")
    )
    if roots is None:
        return by_type.withColumnRenamed("by_type", "provider")
    # A path is inside a root when one of its own parent folders is that root,
    # so the containment test is an equality join on those folders.
    steps = F.split("path", "/")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(steps) - 1)),
        lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"),
    )
    table = roots.select(F.rtrim(F.col("root"), F.lit("/")).alias("root"), F.col("provider").alias("by_root"))
    rooted = (
        by_type.filter("by_type IS NULL")
        .select("path", F.explode(parents).alias("root"))
        .join(table, "root")
        .groupBy("path")
        .agg(F.max_by("by_root", F.length("root")).alias("by_root"))
    )
    return by_type.join(rooted, "path", "left").select(
        "path", F.coalesce("by_type", "by_root").alias("provider")
    )


def automation_gate(hooks: DataFrame, lines: DataFrame, keep_all: bool = False) -> DataFrame:
    """Drop end-of-session hooks of headless runs; unknown ones stay.

    ``hooks`` has (hook_event_name, transcript_path); ``lines`` has
    (path, ord, value).
    """
    if keep_all:
        return hooks
    pattern = r'"entrypoint"\s*:\s*"([^"]+)"'
    said = F.nullif(F.regexp_extract("value", pattern, 1), F.lit(""))
    head = (
        lines.filter(F.col("value").contains('"entrypoint"'))
        .select(F.col("path").alias("transcript_path"), "ord", said.alias("said"))
        .groupBy("transcript_path")
        .agg(F.min_by("said", F.when(F.col("said").isNotNull(), F.col("ord"))).alias("said"))
    )
    headless = F.col("hook_event_name").isin("Stop", "SessionEnd") & F.col("said").startswith("sdk")
    return (
        hooks.join(head, "transcript_path", "left")
        .filter(~F.coalesce(headless, F.lit(False)))
        .drop("said")
    )


def fingerprint_sessions(
    parts: DataFrame, algorithm: str, version: Column | str, keys: list[str]
) -> DataFrame:
    """Fingerprint of each session over its parts, whatever their order.

    ``part`` is ``size:hash`` of one file. Parts are hashed in 4,096 groups by
    a prefix of their own hash and the group hashes together, so a session of
    very many files never gathers them in one place.
    """
    stamp = version if isinstance(version, Column) else F.lit(version)
    rows = parts.select(*keys, "part", F.left(F.sha2("part", 256), F.lit(3)).alias("cell"))
    cells = rows.groupBy(*keys, "cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.sha2(F.array_join(F.sort_array(F.collect_list("part")), "\n"), 256).alias("h"),
    )
    whole = F.sha2(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "cell", "h"))), "\n"), 256
    )
    return cells.groupBy(*keys).agg(F.sum("n").alias("n"), whole.alias("h")).select(
        *keys,
        F.concat_ws(":", F.lit(algorithm), stamp, F.col("n"), F.col("h")).alias("fingerprint"),
    )


def fingerprint_rows(
    rows: DataFrame, keys: list[str], sums: list[str], maxima: list[str],
    algorithm: str, version: Column | str,
) -> DataFrame:
    """Fingerprint of row-set sources from their token columns alone."""
    stamp = version if isinstance(version, Column) else F.lit(version)
    totals = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_s_{c}") for c in sums],
        *[F.coalesce(F.max(c), F.lit(0)).alias(f"_m_{c}") for c in maxima],
    )
    listing = F.concat_ws(
        ",", "_n", *[f"_s_{c}" for c in sums], *[f"_m_{c}" for c in maxima]
    )
    return totals.select(
        *keys,
        F.concat_ws(":", F.lit(algorithm), stamp, F.sha2(listing, 256)).alias("fingerprint"),
    )
