"""What queries leave on, and move over, the disks."""

import time
from decimal import Decimal

from pyspark.sql import functions as F

from meterbook.operators.breakdown import model_breakdown, session_usage
from meterbook.session import DROP_SHUFFLES, staged


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


def test_staging_leaves_no_shuffle_files(spark):
    before, held = shuffle_files(spark), spark.conf.get(DROP_SHUFFLES, None)
    rows = spark.range(2_000).groupBy((F.col("id") % 50).alias("k")).agg(F.sum("id").alias("n"))
    assert staged(rows).agg(F.sum("n")).first()[0] == 1_999_000
    assert spark.conf.get(DROP_SHUFFLES, None) == held
    for _ in range(50):  # they are removed behind the query
        # What is left is of the sum over the stored rows.
        if len(shuffle_files(spark) - before) <= 4:
            break
        time.sleep(0.2)
    assert len(shuffle_files(spark) - before) <= 4


def test_session_totals_are_not_moved_again_for_a_join(spark):
    """Two hosts may use one session id; the totals of both join their session's row."""
    rows = [
        (p, s, m, i, 1, 0, 0, Decimal(10), f"r{i}", 100 + i, True)
        for i, (p, s, m) in enumerate([("claude", "a", "x"), ("claude", "a", "y"), ("codex", "a", "x"), ("claude", "b", "x")])
    ]
    priced = spark.createDataFrame(
        rows, "provider string, session_id string, model string, input bigint, output bigint, cache_write bigint, "
        "cache_read bigint, cost_units decimal(38,0), response_id string, ts_ms bigint, priced boolean")
    meta = spark.createDataFrame([("a", 1), ("b", 2)], "session_id string, n int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = session_usage(model_breakdown(priced, ["ts_ms", "response_id"])).join(meta, "session_id")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3, plan
        got = sorted((r.provider, r.session_id, r.n, r.input, tuple(r.models)) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [("claude", "a", 1, 1, ("x", "y")), ("claude", "b", 2, 3, ("x",)), ("codex", "a", 1, 2, ("x",))]
