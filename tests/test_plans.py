"""Plans, invariants, and the driver contract."""

import os

import pytest
from pyspark.sql import functions as F

from meterbook.queries.bridge import Bridge
from meterbook.queries.registry import load

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", [
    "usage_summary", "period_comparison", "project_summary", "concentration", "spend_by_day_family",
    "token_traffic", "month_bands", "velocity_scale", "session_day_segments", "codex_model_carry",
    "merge_ledger", "source_fingerprint", "unknown_models", "health_report",
])
def test_no_pairwise_joins_or_python(spark, name):
    text = plan(load()[name].run(spark, FOLDER))
    for bad in ("CartesianProduct", "NestedLoop", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert bad not in text, bad


def test_price_list_is_broadcast_and_scan_is_pruned(spark):
    b = Bridge(spark, FOLDER)
    text = plan(b.priced.groupBy("model").sum("cost_units"))
    assert "BroadcastHashJoin" in text
    assert "l_linestatus" not in text.split("FileScan")[1].split("ReadSchema")[1]


def test_tokens_are_conserved(spark):
    b = Bridge(spark, FOLDER)
    sums = [
        df.agg(*[F.sum(c) for c in ("input", "output", "cache_write", "cache_read")]).first()
        for df in (b.responses, b.breakdown, b.usage, b.turns, b.sessions)
    ]
    assert len(set(map(tuple, sums))) == 1


def test_order_of_input_rows_does_not_matter(spark):
    b = Bridge(spark, FOLDER)
    c = Bridge(spark, FOLDER)
    c.table = lambda name, t=c.table: t(name).orderBy(F.rand(3))
    pick = ["session_id", "total_tokens", "cost", "models"]
    rows = [sorted(map(tuple, x.usage.select(*pick).collect())) for x in (b, c)]
    assert rows[0] == rows[1]


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    own = set(load())
    assert own <= set(e.queries()) and own <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["claude_responses", "session_usage", "spend_by_day_family"])
def test_one_scan_of_the_responses(spark, name):
    scans = load()[name].run(spark, FOLDER)._jdf.queryExecution().sparkPlan().toString()
    assert scans.count("l_quantity") and sum("lineitem" in line for line in scans.split("FileScan")[1:]) == 1


def test_listing_queries_needs_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
