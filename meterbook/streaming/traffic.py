"""Token traffic as tumbling windows over turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.spend import SUMS


def turn_windows(turns: DataFrame, interval: str = "15 minutes") -> DataFrame:
    """Tokens by kind and turn count per epoch-aligned window of ``at``."""
    return (
        turns.groupBy(F.window("at", interval).alias("w"))
        .agg(
            *[F.sum(c).alias(c) for c in [*SUMS, "total_tokens"]],
            F.count(F.lit(1)).alias("turns"),
        )
        .select(F.unix_millis("w.start").alias("start_ms"), *SUMS, "total_tokens", "turns")
    )


class TrafficStore:
    """Window sums of every batch; totals add them up, so no turn is ever too late."""

    SCHEMA = "start_ms bigint, " + "".join(f"{c} bigint, " for c in SUMS) + "total_tokens bigint, turns bigint"

    def __init__(self, spark: SparkSession, root: str, interval: str = "15 minutes"):
        self.spark, self.root, self.interval = spark, root.rstrip("/"), interval

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Replaces what the batch had written before."""
        turn_windows(batch, self.interval).write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")

    def totals(self) -> DataFrame:
        """Over the batches that are written as a whole; no row before the first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batch=*/_SUCCESS")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = [str(f.getPath().getParent()) for f in fs.globStatus(path) or []]
        rows = self.spark.read.schema(self.SCHEMA).parquet(*done) if done else self.spark.createDataFrame([], self.SCHEMA)
        return rows.groupBy("start_ms").agg(
            *[F.sum(c).alias(c) for c in [*SUMS, "total_tokens", "turns"]]
        )


def stream_traffic(
    turns: DataFrame, store: TrafficStore, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """The same over a stream: each batch's sums go to the store."""
    writer = turns.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store.add)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
