"""One provider interface over the four hosts, and their union."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from ..sources import transcripts as ts
from . import claude as cl
from . import codex as cx
from . import copilot as cp
from . import opencode as oc
from .breakdown import model_breakdown, session_usage, turn_usage
from .pricing import price_responses
from .reconcile import fingerprint_sessions


@dataclass(frozen=True)
class Derived:
    """What one host's sources yield, all keyed by (provider, session_id)."""

    breakdown: DataFrame
    metadata: DataFrame
    turns: DataFrame | None

    @property
    def usage(self) -> DataFrame:
        return session_usage(self.breakdown)


class Provider(Protocol):
    """A host: four steps from its sources to ledger inputs."""

    name: str

    def found(self) -> DataFrame: ...

    def records(self) -> DataFrame: ...

    def derive(self, dim: DataFrame) -> Derived: ...

    def fingerprints(self, version: Column | str) -> DataFrame: ...


class _Files:
    """Shared parts of the hosts whose transcripts are files."""

    name = ""

    def __init__(self, spark: SparkSession, paths: str | list[str], tail_bytes: int | None = ts.TAIL_BYTES):
        self.spark, self.paths, self.tail_bytes = spark, paths, tail_bytes

    def readable_parts(self) -> DataFrame:
        """(path, part) of the files that can be derived."""
        return ts.file_parts(self.spark, self.paths, self.tail_bytes)

    @classmethod
    def prints(cls, index: DataFrame, version: Column | str) -> DataFrame:
        """(session_id, fingerprint) from an index of (path, session_id, mtime_ms, part), files unopened.

        Of a session's files the newest counts; without a part it is left out.
        """
        newest = index.groupBy("session_id").agg(F.max_by("part", F.struct("mtime_ms", "path")).alias("part"))
        stamp = version if isinstance(version, Column) else F.lit(version)
        return newest.filter("part IS NOT NULL").select(
            "session_id", F.concat_ws(":", F.lit(f"{cls.name}-usage"), stamp, "part").alias("fingerprint")
        )

    def _file_fingerprints(self, version: Column | str) -> DataFrame:
        """Sessions of one file each: the file's own size and tail hash."""
        parts = ts.file_parts(self.spark, self.paths, self.tail_bytes)
        stamp = version if isinstance(version, Column) else F.lit(version)
        mine = self.found().select("session_id", F.col("transcript_path").alias("path"))
        return parts.join(mine, "path").select(
            "session_id",
            F.concat_ws(":", F.lit(f"{self.name}-usage"), stamp, "part").alias("fingerprint"),
        )


class Claude(_Files):
    name = "claude"

    def found(self) -> DataFrame:
        return ts.find_claude(self.spark, self.paths)

    def records(self) -> DataFrame:
        return ts.scan_claude(self.spark, self.paths)

    def derive(self, dim: DataFrame) -> Derived:
        records = staged(self.records())
        priced = staged(price_responses(cl.claude_responses(records), dim))
        turns = turn_usage(priced)
        return Derived(model_breakdown(priced, ["ord"]), cl.claude_metadata(records), turns)

    def fingerprints(self, version: Column | str) -> DataFrame:
        parts = ts.claude_parts(self.spark, self.paths, self.tail_bytes)
        return fingerprint_sessions(parts, "claude-usage", version, ["session_id"])

    @classmethod
    def prints(cls, index: DataFrame, version: Column | str) -> DataFrame:
        """The newest main file and all subagent files of each session that has a main file."""
        main = F.regexp_extract("path", ts.CLAUDE_MAIN, 2) != ""
        rows = index.withColumn("is_main", main)
        newest = rows.filter("is_main").groupBy("session_id").agg(F.max_by("path", F.struct("mtime_ms", "path")).alias("_main"))
        kept = rows.join(newest, "session_id").filter("NOT is_main OR path = _main")
        whole = kept.groupBy("session_id").agg(F.every(F.col("part").isNotNull()).alias("whole")).filter("whole")
        return fingerprint_sessions(kept.join(whole, "session_id", "left_semi"), "claude-usage", version, ["session_id"])


class Codex(_Files):
    name = "codex"

    def found(self) -> DataFrame:
        return ts.find_codex(self.spark, self.paths)

    def records(self) -> DataFrame:
        return ts.scan_codex(self.spark, self.paths)

    def derive(self, dim: DataFrame) -> Derived:
        records = staged(self.records())
        lines = cx.codex_lines(records)
        names = staged(cx.codex_turn_names(lines))
        state = cx.with_turns(cx.codex_state(lines), names)
        priced = price_responses(cx.codex_responses(state), dim)
        turns = cx.codex_turn_usage(priced, cx.codex_turn_spans(state, names))
        identity = cx.codex_identity(records)

        def renamed(df: DataFrame) -> DataFrame:
            own = F.coalesce("identity", "session_id")
            return df.join(identity, "session_id", "left").withColumn("session_id", own).drop(
                "identity"
            )

        return Derived(
            renamed(model_breakdown(priced, ["ord"])),
            renamed(cx.codex_metadata(records)),
            renamed(turns),
        )

    def fingerprints(self, version: Column | str) -> DataFrame:
        return self._file_fingerprints(version)


class Copilot(_Files):
    name = "copilot"

    def readable_parts(self) -> DataFrame:
        """Of sessions that have ended."""
        parts = ts.file_parts(self.spark, self.paths, self.tail_bytes)
        return parts.join(self.found().select(F.col("transcript_path").alias("path")), "path", "left_semi")

    def found(self) -> DataFrame:
        return ts.find_copilot(self.spark, self.paths)

    def records(self) -> DataFrame:
        return ts.scan_copilot(self.spark, self.paths)

    def derive(self, dim: DataFrame) -> Derived:
        records = self.records()
        done = records.filter("type = 'session.shutdown'").select("session_id").distinct()
        meta = cp.copilot_metadata(records).join(done, "session_id", "left_semi")
        names = meta.select("session_id", "identity")
        parts = cp.copilot_breakdown(records, dim).join(names, "session_id", "left").withColumn(
            "session_id", F.coalesce("identity", "session_id")
        ).drop("identity")
        return Derived(
            _ranked(parts), meta.withColumn("session_id", F.col("identity")).drop("identity"), None
        )

    def fingerprints(self, version: Column | str) -> DataFrame:
        return self._file_fingerprints(version)


class Opencode:
    name = "opencode"

    def __init__(self, session: DataFrame, message: DataFrame, part: DataFrame):
        self.session, self.message, self.part = session, message, part

    def found(self) -> DataFrame:
        return self.session.filter("parent_id IS NULL").select(
            F.lit("opencode").alias("provider"),
            F.col("id").alias("session_id"),
            F.lit("").alias("transcript_path"),
            F.col("directory").alias("project_path"),
            F.coalesce(F.when(F.col("time_updated") > 0, F.col("time_updated")), "time_created")
            .alias("mtime_ms"),
            F.lit(0).cast("bigint").alias("size"),
        )

    def records(self) -> DataFrame:
        return oc.opencode_messages(self.message, oc.session_tree(self.session))

    def derive(self, dim: DataFrame) -> Derived:
        messages = staged(self.records())
        return Derived(
            _ranked(oc.opencode_breakdown(messages, dim)),
            oc.opencode_metadata(self.session, messages, self.part),
            None,
        )

    def fingerprints(self, version: Column | str) -> DataFrame:
        tree = oc.session_tree(self.session)
        return oc.opencode_fingerprint(self.session, self.message, tree, version)


def _ranked(parts: DataFrame) -> DataFrame:
    """Cost units for hosts whose cost is settled in dollars."""
    return parts.withColumn("cost_units", (F.col("cost") * 10_000_000_000_000).cast("decimal(38,0)"))


def union_shapes(frames: list[DataFrame]) -> DataFrame:
    """Rows of every host in one shape; a column a host lacks is null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def union_providers(derived: list[Derived]) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(usage, metadata, turns) of all hosts."""
    turns = [d.turns for d in derived if d.turns is not None]
    return (
        union_shapes([d.usage for d in derived]),
        union_shapes([d.metadata for d in derived]),
        union_shapes(turns) if turns else None,
    )
