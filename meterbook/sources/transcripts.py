"""Transcript files as DataFrames of lines, for any number of machines.

A text row has no line number. Its place in a file is (path, split offset, id
inside the scan); ``chunk`` is the split, which bounds how many rows share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as xf
from ..operators.reconcile import newest_per_session
from ..session import handed, many_files, staged
from .growing import range_hash

UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
CLAUDE_MAIN = rf"^.*/projects/([^/]+)/({UUID})\.jsonl$"
CLAUDE_SUBAGENT = r"^.*/projects/([^/]+)/([^/]+)/subagents/.+\.jsonl$"
CODEX_FILE = r"^.*/(sessions|archived_sessions)/(?:.*/)?[^/]*?([0-9a-fA-F]{8}-[0-9a-fA-F-]{27})\.jsonl$"
COPILOT_FILE = r"^.*/session-state/([^/]+)/events\.jsonl$"


def _load(spark: SparkSession, kind: str, paths: str | list[str]) -> DataFrame:
    reader = many_files(spark).read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    return handed(reader.format(kind).load(paths), spark)


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Path, size and change time of every transcript file; no content is read."""
    return (
        _load(spark, "binaryFile", paths)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("size"),
            F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"),
        )
    )


def with_place(lines: DataFrame) -> DataFrame:
    """Path, order and chunk of each text line, blank lines dropped."""
    placed = lines.select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return placed.filter(F.trim("value") != "").select(
        "value",
        "path",
        F.struct("path", "block", "row").alias("ord"),
        F.struct("path", "block").alias("chunk"),
    )


def scan_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return with_place(_load(spark, "text", paths))


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Readable lines with their record's fields; broken ones are skipped."""
    good = lines.filter(F.try_parse_json("value").isNotNull())
    record = F.from_json("value", f"struct<{_as_struct(schema)}>")
    return good.select("*", record.alias("_r")).select(*lines.columns, "_r.*").drop("value")


def _as_struct(schema: str) -> str:
    """Top-level ``name type`` pairs in the ``name: type`` form of a struct."""
    out, depth = [], 0
    for piece in schema.replace("\n", " ").split(","):
        if depth == 0:
            name, kind = piece.strip().split(" ", 1)
            piece = f"{name}: {kind.strip()}"
        depth += piece.count("<") - piece.count(">")
        out.append(piece)
    return ",".join(out)


def _found(files: DataFrame, provider: str, session: Column, project: Column) -> DataFrame:
    return files.select(
        F.lit(provider).alias("provider"),
        session.alias("session_id"),
        F.col("path").alias("transcript_path"),
        project.alias("project_path"),
        "mtime_ms",
        "size",
    ).filter("session_id <> ''")


def find_claude(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Main transcripts, the newest per session."""
    session = F.regexp_extract("path", CLAUDE_MAIN, 2)
    project = F.concat_ws("/", F.regexp_extract("path", CLAUDE_MAIN, 1), session)
    return newest_per_session(_found(list_files(spark, paths), "claude", session, project))


def find_codex(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    session = F.regexp_extract("path", CODEX_FILE, 2)
    project = F.regexp_extract("path", r"/(?:sessions|archived_sessions)/(.*)$", 1)
    return newest_per_session(_found(list_files(spark, paths), "codex", session, project))


def find_copilot(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Completed sessions: those with a shutdown record."""
    session = F.regexp_extract("path", COPILOT_FILE, 1)
    found = _found(list_files(spark, paths), "copilot", session, session)
    ended = (
        scan_copilot(spark, paths).filter("type = 'session.shutdown'").select("session_id").distinct()
    )
    return found.join(ended, "session_id", "left_semi")


def scan_claude(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of every session tree: the main file and its subagent files.

    Only the newest main file of a session counts; subagent files may lie
    under any project folder. The files that do not count are found first and
    stored, so that where they are few the lines need not be shuffled.
    """
    main = F.regexp_extract("path", CLAUDE_MAIN, 2)
    session = F.when(main != "", main).otherwise(F.regexp_extract("path", CLAUDE_SUBAGENT, 2))
    mine = {"session_id": session, "is_main": main != ""}
    lines = scan_lines(spark, paths).withColumns(mine).filter("session_id <> ''")
    files = staged(list_files(spark, paths).withColumns(mine).filter("session_id <> ''"))
    chosen = newest_per_session(_found(files.filter("is_main"), "claude", F.col("session_id"), F.lit("")))
    rest = staged(
        files.join(chosen.select("session_id", F.col("transcript_path").alias("_main")), "session_id", "left")
        .filter("_main IS NULL OR (is_main AND path <> _main)").select("path")
    )
    kept = lines.join(rest, "path", "left_anti").select(F.lit("claude").alias("provider"), "session_id", "is_main", *lines.columns[:-2])
    return _parsed(kept, schemas.CLAUDE)


def scan_codex(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of the newest rollout file per session."""
    lines = scan_lines(spark, paths).select(
        F.lit("codex").alias("provider"),
        F.regexp_extract("path", CODEX_FILE, 2).alias("session_id"),
        "*",
    )
    chosen = find_codex(spark, paths).select(F.col("transcript_path").alias("path"))
    return _parsed(lines.join(chosen, "path", "left_semi"), schemas.CODEX)


def scan_copilot(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    lines = scan_lines(spark, paths).select(
        F.lit("copilot").alias("provider"),
        F.regexp_extract("path", COPILOT_FILE, 1).alias("session_id"),
        "*",
    )
    return _parsed(lines.filter("session_id <> ''"), schemas.COPILOT)


TAIL_BYTES = 65_536
#: Files over this size are read by ranges, smaller ones as one value.
RANGED_BYTES = 64_000_000


def file_parts(
    spark: SparkSession, paths: str | list[str], tail_bytes: int | None = TAIL_BYTES, ranged_bytes: int = RANGED_BYTES
) -> DataFrame:
    """``size:hash`` of each file's last bytes, the part a fingerprint covers; None is the whole file.

    Of a file over ``ranged_bytes`` only the tail is read. Where the whole file counts, its
    ranges are hashed by different tasks and the hash is that of the list of their hashes.
    """
    tail = F.col("content")
    if tail_bytes is not None:
        # A start before the file begins would shorten the tail.
        tail = F.when(F.col("length") <= tail_bytes, tail).otherwise(F.substring("content", -tail_bytes, tail_bytes))
    small = (
        _load(spark, "binaryFile", paths)
        .filter(F.col("length") <= ranged_bytes)  # pushed down: larger files are not loaded
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.concat_ws(":", "length", F.sha2(tail, 256)).alias("part"),
        )
    )
    large = list_files(spark, paths).filter(F.col("size") > ranged_bytes).select("path", "size")
    return small.unionByName(_ranged_parts(large, tail_bytes, ranged_bytes))


def _ranged_parts(files: DataFrame, tail_bytes: int | None, ranged_bytes: int) -> DataFrame:
    if tail_bytes is not None:
        first = F.greatest(F.lit(0).cast("bigint"), F.col("size") - tail_bytes)
        ranges = files.select("path", "size", first.alias("start"), F.col("size").alias("end"))
    else:
        starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(ranged_bytes).cast("bigint")))
        ranges = files.select("path", "size", starts.alias("start")).repartition("path", "start").select(
            "*", F.least("size", F.col("start") + ranged_bytes).alias("end")
        )

    def hashed(frames):
        for frame in frames:
            frame["hash"] = [range_hash(r.path, r.start, r.end) for r in frame.itertuples()]
            yield frame[["path", "size", "start", "hash"]]

    found = ranges.mapInPandas(hashed, "path string, size bigint, start bigint, hash string")
    if tail_bytes is not None:
        return found.select("path", F.concat_ws(":", "size", "hash").alias("part"))
    # As many hashes as the file has ranges.
    listed = F.transform(F.array_sort(F.collect_list(F.struct("start", "hash"))), lambda r: r["hash"])
    whole = found.groupBy("path", "size").agg(F.sha2(F.array_join(listed, ","), 256).alias("hash"))
    return whole.select("path", F.concat_ws(":", "size", "hash").alias("part"))


def claude_parts(spark: SparkSession, paths: str | list[str], tail_bytes: int | None = TAIL_BYTES) -> DataFrame:
    """File parts of each claude session tree: newest main file and subagents."""
    main = F.regexp_extract("path", CLAUDE_MAIN, 2)
    sub = F.regexp_extract("path", CLAUDE_SUBAGENT, 2)
    parts = file_parts(spark, paths, tail_bytes).select(
        F.when(main != "", main).otherwise(sub).alias("session_id"),
        (main != "").alias("is_main"),
        "path",
        "part",
    )
    chosen = find_claude(spark, paths).select(
        "session_id", F.col("transcript_path").alias("_main")
    )
    return parts.join(chosen, "session_id").filter(
        ~F.col("is_main") | (F.col("path") == F.col("_main"))
    ).select("session_id", "part")


def preview(content: Column, part_types: list[str] | None = None) -> Column:
    return xf.prompt_preview(xf.content_text(content, part_types))
