"""Checkpoints of sessions into the ledger, and the other small streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.capture import capture_health
from ..sources.ledger import LedgerStore
from ..sources.log import CommitLog
from .state import Settlement, use_rocksdb


def stream_ledger(
    checkpoints: DataFrame, store: LedgerStore, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Merge every checkpoint of a session into the stored ledger.

    ``seq`` orders a session's checkpoints. Late and repeated ones never lower
    recorded usage, so a replayed batch changes nothing.
    """
    writer = (
        checkpoints.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, _: store.merge(batch))
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


class HealthStore:
    """Hook health, a row per key, after every batch seen; each batch is one logged commit.

    ``keys`` are text columns, by default the provider alone.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str] | None = None):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys or ["provider"]
        self.log = CommitLog(spark, self.root)

    def health(self) -> DataFrame | None:
        folder = self.log.last()[1].get("health")
        return None if folder is None else self.spark.read.parquet(folder)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Fold a batch into the stored rows; one that is there already is left."""
        number, entry = self.log.last()
        if entry.get("batch", -1) >= batch_id:
            return
        folder = f"{self.root}/health/{uuid.uuid4().hex}"
        capture_health(batch, self.keys, self.health()).write.parquet(folder)
        self.log.commit(number + 1, {"batch": batch_id, "health": folder})
        for old in self.log.forget(keep=2):
            self.log.remove(old["health"])


def stream_capture_health(
    events: DataFrame, store: HealthStore, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Hook health per key after each batch, in a store.

    A batch is folded as the batch operator does, in chunks of arrival order, so that a
    key with most of a fleet's events is no task's alone.
    """
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store.add)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_bursts(
    writes: DataFrame, keys: list[str], lateness: str,
    quiet: str = "1500 milliseconds",
) -> DataFrame:
    """Writes of one ledger within 1.5 s of each other as one refresh.

    ``keys`` names the ledger; write it in append mode. A burst is reported once
    ``lateness`` has passed, and a write later than that asks for no refresh of
    its own; ``coalesce_bursts`` over the stored writes counts every one.
    """
    timed = writes.withWatermark("at", lateness)
    bursts = timed.groupBy(*keys, F.session_window("at", quiet).alias("burst"))
    return bursts.agg(F.count(F.lit(1)).alias("writes")).select(
        *keys,
        F.col("burst.start").alias("first_at"),
        F.col("burst.end").alias("refresh_at"),
        "writes",
    )


def stream_settlement(
    events: DataFrame, lateness: str, quiet_ms: int = 1_000, timeout_ms: int = 15_000,
) -> DataFrame:
    """Outcome of each capture run once it settles or times out.

    ``events`` has (run_id, capture_id, kind, status, at); timers follow the
    watermark of ``at``, which stays ``lateness`` behind. Events later than that
    are not part of the outcome; ``settle_runs`` over the stored events is.
    """
    use_rocksdb(events.sparkSession)
    timed = events.withWatermark("at", lateness).withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("run_id").transformWithState(
        Settlement(quiet_ms, timeout_ms), Settlement.OUTPUT, "Append", "EventTime"
    )


def reconcile_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a stream over everything present, append it as Parquet, and stop."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
