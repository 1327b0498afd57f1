"""Queries over folders of files written out from tables."""

import os
from types import SimpleNamespace

import pyarrow as pa
from helpers import said, write_lines
from pyspark.sql import functions as F

from meterbook.queries import files as qf
from meterbook.sources import growing
from meterbook.sources import transcripts as ts


def laid_out(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and p.suffix != ".crc"}


def test_files_are_written_by_the_tasks(spark, tmp_path, monkeypatch):
    """Lines in order, whatever the batches; the driver does no more for many files than for few."""
    client, sent = spark.sparkContext._gateway._gateway_client, []
    send = type(client).send_command
    monkeypatch.setattr(type(client), "send_command", lambda self, *a, **k: sent.append(1) or send(self, *a, **k))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    calls = []
    try:
        for n in (5, 150):
            rows = spark.range(n * 20).select(
                F.concat(F.lit("a!b"), F.col("id") % n, F.lit("!c.jsonl")).alias("name"),
                F.format_string("%05d", "id").alias("ord"), F.concat(F.lit("é"), "id").alias("value"),
            )
            rows = rows.repartition(3)
            sent.clear()
            qf._lay_out(SimpleNamespace(spark=spark), rows, f"{tmp_path}/n{n}")
            calls.append(len(sent))
            got = laid_out(tmp_path / f"n{n}")
            assert got == {f"a/b{k}/c.jsonl": "".join(f"é{i}\n" for i in range(k, n * 20, n)).encode() for k in range(n)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert calls[1] < calls[0] + 1000, calls


def test_odd_names_and_values(spark, tmp_path):
    """A null value is an empty line; rows without a name keep a file; a second layout replaces files of the same name."""
    kind = "name string, ord int, value string"
    b = SimpleNamespace(spark=spark)
    rows = [("x.json", 1, None), ("x.json", 0, "first"), (None, 0, "lost"), ("", 0, "lost"), ("  y!z w.json", 0, "")]
    qf._lay_out(b, spark.createDataFrame(rows, kind), str(tmp_path))
    assert laid_out(tmp_path) == {"x.json": b"first\n\n", "  y/z w.json": b"\n", "__HIVE_DEFAULT_PARTITION__": b"lost\nlost\n"}
    qf._lay_out(b, spark.createDataFrame([("x.json", 0, "s")], kind), str(tmp_path))
    assert laid_out(tmp_path)["x.json"] == b"s\n" and len(laid_out(tmp_path)) == 3


def test_no_rows_no_files(tmp_path):
    none = pa.RecordBatch.from_pydict({"name": pa.array([], pa.string()), "line": pa.array([], pa.binary())})
    assert [b.num_rows for b in growing.write_files(str(tmp_path), iter([none]))] == [0] and laid_out(tmp_path) == {}


def claude_tree(root, sessions, pad=""):
    for k in range(sessions):
        sid = f"{k:08x}-0000-4000-8000-{k:012x}"
        for name in (f"projects/demo/{sid}.jsonl", f"projects/other/{sid}/subagents/agent-1.jsonl"):
            write_lines(root / name, [said(f"m{k}-{name[9]}", "claude-opus-5", (1, 0, 0, k), pad=pad)])
    return sid


def test_many_small_files_take_few_tasks(spark, tmp_path):
    """Two tasks a core and no more for files without bytes; the caller's settings stay."""
    claude_tree(tmp_path, 100)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        for frame in (ts.scan_lines(spark, str(tmp_path)), ts.list_files(spark, str(tmp_path))):
            assert frame._jdf.rdd().getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
            assert frame.count() == 200 and frame.sparkSession is spark
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_claude_lines_are_not_shuffled_where_few_files_are_left_out(spark, tmp_path):
    """An older main file of a session and subagents without a main file do not count."""
    last = claude_tree(tmp_path, 3, "x" * 50_000)
    write_lines(tmp_path / f"projects/old/{last}.jsonl", [said("stale", "claude-opus-5", (1, 0, 0, 9))])
    os.utime(tmp_path / f"projects/old/{last}.jsonl", (1, 1))
    lone = last.replace("4000", "4001")
    write_lines(tmp_path / f"projects/other/{lone}/subagents/agent-1.jsonl", [said("lone", "claude-opus-5", (1, 0, 0, 9))])
    write_lines(tmp_path / "projects/other/notes.jsonl", [said("none", "claude-opus-5", (1, 0, 0, 9))])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        found = ts.scan_claude(spark, str(tmp_path))
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.session_id[:8], r.is_main, r.id) for r in found.select("session_id", "is_main", "message.id").collect()) == [
        (f"{k:08x}", main, f"m{k}-{'d' if main else 'o'}") for k in range(3) for main in (False, True)
    ]
