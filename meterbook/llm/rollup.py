"""Token counts by source, language and tokenizer version, kept by signed deltas.

A batch of changes holds inserts, deletes and revised counts. Each becomes a signed
addition, the batch is summed per key, and its sums are written once, under the
batch's name. Totals are the sum over all committed batches, so no earlier row is
ever read again to apply a change.

Defined cases: null source, language, tokenizer or count: null keys form keys of
their own, a null count is 0. A change that repeats counts as often as it occurs. An
unknown kind of change fails the batch. A batch without changes can be committed.
A batch name already committed is not applied again, whatever it holds. A batch that
died half written is written anew. Keys whose totals are all 0 are not listed.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, prepare

KEYS = ("source", "lang", "tokenizer")
_CHANGE = {"change": "string", **dict.fromkeys(KEYS, "string"), "tokens": "long", "old_tokens": "long"}
_TOTALS = "source string, lang string, tokenizer string, documents long, tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """Sums per key of (change, source, lang, tokenizer, tokens, old_tokens).

    ``insert`` adds a document of ``tokens``, ``delete`` takes one of ``tokens`` away,
    ``revise`` replaces ``old_tokens`` by ``tokens``.
    """
    rows = columns(changes, **_CHANGE)
    now, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("change", F.lit("null"))))
    kind = lambda a, b, c: F.when(F.col("change") == "insert", a).when(F.col("change") == "delete", b).when(F.col("change") == "revise", c)
    signed = rows.select(*KEYS, kind(1, -1, 0).otherwise(wrong.cast("int")).alias("documents"), kind(now, -now, now - old).alias("tokens"))
    return signed.groupBy(*KEYS).agg(F.sum("documents").cast("long").alias("documents"), F.sum("tokens").cast("long").alias("tokens"))


def changes_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """The changes that lead from one table of counts per document to another.

    Both hold (doc_id, source, lang, tokenizer, tokens), one row per doc_id and
    tokenizer. A document that moved to another source or language is deleted there
    and inserted here.
    """
    kinds = {"doc_id": "long", **dict.fromkeys(KEYS, "string"), "tokens": "long"}
    a, b = columns(before, **kinds).alias("a"), columns(after, **kinds).alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("doc_id", *KEYS)))
    met = a.withColumn("was", F.lit(True)).alias("a").join(b.withColumn("now", F.lit(True)).alias("b"), same, "full_outer")
    change = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").otherwise("revise")
    own = [F.when(F.col("now").isNull(), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in (*KEYS, "tokens")]
    out = met.select(change.alias("change"), *own, F.col("a.tokens").alias("old_tokens"))
    return out.filter(~((F.col("change") == "revise") & F.col("tokens").eqNullSafe(F.col("old_tokens"))))


class RollupStore:
    """Committed batches of deltas under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = prepare(spark), root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _folder(self, batch: str) -> str:
        if not batch or not all(c.isalnum() or c in "-_." for c in batch) or batch.startswith("."):
            raise ValueError(f"no batch name: {batch!r}")
        return f"{self.root}/batch={batch}"

    def committed(self) -> list[str]:
        """Folders of the batches whose write ended."""
        found = self.fs.globStatus(self._path(f"{self.root}/batch=*/_SUCCESS")) or []
        return sorted(str(f.getPath().getParent()) for f in found)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; false if it had been applied. One writer per batch name."""
        folder = self._folder(batch)
        if self.fs.exists(self._path(f"{folder}/_SUCCESS")):
            return False
        deltas(changes).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(folder)
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens."""
        paths = self.committed()
        if not paths:
            return self.spark.createDataFrame([], _TOTALS)
        rows = self.spark.read.schema(_TOTALS).parquet(*paths)
        summed = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return summed.filter("documents <> 0 OR tokens <> 0")
