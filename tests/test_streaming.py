import json
from datetime import datetime, timedelta, timezone

from helpers import SID, context, counted, one, said, settings

from meterbook.operators.fold import fold_checkpoints
from meterbook.operators.pricing import price_responses
from meterbook.plans.spend import SUMS
from meterbook.sources.ledger import LedgerStore
from meterbook.streaming import ingest, ledger as sl
from meterbook.streaming.traffic import TrafficStore, stream_traffic, turn_windows

T0 = datetime(2026, 7, 1, 10, tzinfo=timezone.utc)


def put(root, source, number, text):
    path = root / source / f"{number:06d}.part"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def text(*records):
    return "".join(json.dumps(r) + "\n" for r in records)


def run(df, tmp, name):
    sl.reconcile_available(df, str(tmp / name), str(tmp / f"{name}-ck")).awaitTermination(120)
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp / name))


def deduped(df, tmp):
    """Run a stream of responses through the store of seen ids, a batch per folder."""
    spark = df.sparkSession
    seen = ingest.SeenResponses(spark, str(tmp / "seen"))
    sink = lambda batch, n: batch.write.mode("overwrite").parquet(str(tmp / "out" / f"n={n}"))
    ingest.stream_dedupe(df, seen, sink, str(tmp / "out-ck")).awaitTermination(120)
    return spark.read.schema(df.schema).parquet(str(tmp / "out" / "n=*"))


def claude(spark, tmp_path):
    lines = ingest.partial_tail(ingest.stream_increments(spark, str(tmp_path / "in")))
    return ingest.stream_claude_responses(lines)


def test_increments_partial_tail_and_dedupe(spark, dim, tmp_path):
    body = text(said("a", "claude-opus-5", (1000, 0, 0, 100)), said("b", "claude-opus-5", (10, 0, 0, 1)))
    cut = len(body) - 40
    put(tmp_path / "in", SID, 1, body[:cut])
    assert [r.response_id for r in deduped(claude(spark, tmp_path), tmp_path).collect()] == ["a"]
    put(tmp_path / "in", SID, 2, body[cut:] + text(said("a", "claude-opus-5", (1000, 0, 0, 100))))
    put(tmp_path / "in", SID, 3, json.dumps(said("c", "claude-opus-5", (5, 0, 0, 5))))
    rows = deduped(claude(spark, tmp_path), tmp_path)
    assert sorted(r.response_id for r in rows.collect()) == ["a", "b", "c"]
    priced = price_responses(rows, dim)
    assert priced.filter("response_id = 'a'").first().cost_units == 75_000_000_000


def test_old_responses_and_early_increments_count(spark, tmp_path):
    july = text(said("a", "claude-opus-5", (1, 0, 0, 1), at="2026-07-01T10:00:00.000Z"))
    may = text(said("b", "claude-opus-5", (2, 0, 0, 1), at="2026-05-01T10:00:00.000Z"))
    put(tmp_path / "in", SID, 1, july)
    put(tmp_path / "in", SID, 3, may[30:])
    assert [r.response_id for r in deduped(claude(spark, tmp_path), tmp_path).collect()] == ["a"]
    put(tmp_path / "in", SID, 2, july + may[:30])
    rows = deduped(claude(spark, tmp_path), tmp_path).collect()
    assert sorted(r.response_id for r in rows) == ["a", "b"]


def test_seen_ids_replay(spark, tmp_path):
    seen = ingest.SeenResponses(spark, str(tmp_path / "seen"))
    rows = lambda *ids: spark.createDataFrame([("s", i, 1) for i in ids], "session_id string, response_id string, n int")
    new = lambda batch, n: sorted(r.response_id or "" for r in seen.fresh(batch, n).collect())
    assert new(rows("a", "a", None), 0) == ["", "a"]
    assert new(rows("a", "b", None), 1) == ["b"] == new(rows("a", "b", None), 1)
    assert new(rows("a", "a", None), 0) == ["", "a"]


def test_usage_waits_for_the_first_model(spark, tmp_path):
    def carried():
        lines = ingest.partial_tail(ingest.stream_increments(spark, str(tmp_path / "in")))
        return ingest.codex_stream_responses(ingest.stream_carry(lines))

    put(tmp_path / "in", SID, 1, text(counted((7, 0, 0, 1))))
    assert run(carried(), tmp_path, "out").count() == 0
    put(tmp_path / "in", SID, 2, text(context("gpt-5.4", "t1"), counted((9, 0, 0, 1))))
    rows = run(carried(), tmp_path, "out").orderBy("input").collect()
    assert [(r.model, r.turn_id, r.input) for r in rows] == [("gpt-5.4", "turn-1", 7), ("gpt-5.4", "t1", 9)]


def test_carry_over_batches(spark, dim, tmp_path):
    def carried():
        lines = ingest.partial_tail(ingest.stream_increments(spark, str(tmp_path / "in")))
        return ingest.codex_stream_responses(ingest.stream_carry(lines))

    put(tmp_path / "in", SID, 1, text(
        counted((1, 0, 0, 1)), context("gpt-5.4", "t1"), counted((1000, 0, 0, 100), total=(1000, 0, 0, 100)),
    ))
    deduped(carried(), tmp_path)
    put(tmp_path / "in", SID, 2, text(
        settings(model="gpt-5.6-sol", service_tier="priority"),
        counted((1000, 0, 0, 100), total=(1000, 0, 0, 100)),
        counted((2000, 0, 0, 200), total=(3000, 0, 0, 300)),
    ))
    rows = deduped(carried(), tmp_path).orderBy("input", "model").collect()
    assert [(r.model, r.speed, r.turn_id, r.input) for r in rows] == [
        ("gpt-5.4", "default", "turn-1", 1), ("gpt-5.4", "default", "t1", 1000),
        ("gpt-5.6-sol", "priority", "t1", 2000),
    ]


CHECK = "session_id string, provider string, seq bigint, total_tokens bigint, cost decimal(18,6), fp string"


def checkpoints(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(a, b, c, d, Decimal(str(e)), f) for a, b, c, d, e, f in rows], CHECK)


def brute(rows):
    """The merge rule applied one checkpoint at a time."""
    out = {}
    for sid, host, _, tokens, cost, fp in sorted(rows, key=lambda r: r[2]):
        old = out.get(sid)
        if old and old[0] == host and (tokens < old[1] or cost < old[2]):
            out[sid] = (host, old[1], old[2], fp)
        else:
            out[sid] = (host, tokens, cost, fp)
    return out


def test_fold_equals_one_by_one(spark):
    import random

    rng = random.Random(7)
    rows = [
        (f"s{rng.randrange(9)}", rng.choice(["claude", "claude", "claude", "codex"]), i,
         rng.randrange(50), rng.randrange(50) / 10, f"f{i}")
        for i in range(600)
    ]
    got = fold_checkpoints(checkpoints(spark, rows)).collect()
    assert {r.session_id: (r.provider, r.total_tokens, float(r.cost), r.fp) for r in got} == brute(rows)


def test_redelivered_checkpoints_stay_one_row(spark, tmp_path):
    rows = [("s", "claude", 1, 10, 1.0, "a"), ("s", "claude", 1, 10, 1.0, "a"), ("s", "claude", 1, 8, 0.5, "b"), ("t", "claude", 1, 1, 0.1, "c")]
    got = {r.session_id: (r.total_tokens, r.fp) for r in fold_checkpoints(checkpoints(spark, rows)).collect()}
    assert got == {"s": (10, "a"), "t": (1, "c")}
    store = LedgerStore(spark, str(tmp_path / "ledger"), buckets=2)
    store.merge(checkpoints(spark, rows))
    store.merge(checkpoints(spark, rows + rows))
    assert store.read().count() == 2


def test_a_new_entry_outranks_removed_ones(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "ledger"), buckets=2)
    for n in (1, 2, 3):
        store.merge(checkpoints(spark, [("s", "claude", n, 10 * n, 1.0 * n, f"f{n}")]))
    for old in sorted((tmp_path / "ledger" / "log").glob("*.json"))[:2]:
        old.unlink()
    store.merge(checkpoints(spark, [("s", "claude", 4, 40, 4.0, "f4")]))
    assert [r.total_tokens for r in store.read().collect()] == [40]


def test_ledger_stream_never_lowers_usage(spark, tmp_path):
    first = [("s", "claude", 1, 1000, 1.5, "f1"), ("t", "claude", 1, 5, 0.1, "g1")]
    later = [("s", "claude", 2, 900, 0.9, "f2"), ("s", "claude", 3, 800, 0.8, "f3"),
             ("s", "claude", 4, 500, 0.5, "f4"), ("t", "claude", 2, 9, 0.2, "g2")]
    store = LedgerStore(spark, str(tmp_path / "ledger"), buckets=4)
    for n, rows in enumerate((first, later, later)):
        checkpoints(spark, rows).write.parquet(str(tmp_path / "in" / f"b{n}"))
        stream = spark.readStream.schema(CHECK).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        sl.stream_ledger(stream, store, str(tmp_path / "ck")).awaitTermination(120)
    rows = {r.session_id: r for r in store.read().collect()}
    assert (rows["s"].total_tokens, float(rows["s"].cost), rows["s"].fp) == (1000, 1.5, "f4")
    assert (rows["t"].total_tokens, rows["t"].fp) == (9, "g2")


HEALTH = "event_id bigint, provider string, hook_event_name string, status string, message string, occurred_ms bigint"


def test_health_in_arrival_order(spark, tmp_path):
    from meterbook.operators.capture import capture_health

    batches = [
        [(1, "claude", "Stop", "recorded", None, 1000), (2, "claude", "Stop", "failed", "boom", 2000)],
        [(3, "claude", "Stop", "recorded", None, 1500), (4, "codex", "Stop", "failed", None, 10)],
    ]
    store = sl.HealthStore(spark, str(tmp_path / "health"))
    assert store.health() is None
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, HEALTH).write.parquet(str(tmp_path / "in" / f"b{n}"))
        stream = spark.readStream.schema(HEALTH).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        sl.stream_capture_health(stream, store, str(tmp_path / "ck")).awaitTermination(120)
    last = {r.provider: r for r in store.health().collect()}
    claude_row = last["claude"]
    assert (claude_row.last_attempt_ms, claude_row.last_attempt_status) == (2000, "failed")
    assert (claude_row.last_success_ms, claude_row.last_failure_message) == (1000, "boom")
    assert last["codex"].last_failure_message == "Unknown hook capture failure"
    batch = capture_health(spark.createDataFrame(sum(batches, []), HEALTH))
    assert {r.provider: r.asDict() for r in batch.collect()} == {k: r.asDict() for k, r in last.items()}


def test_health_of_parts_is_that_of_the_whole(spark, tmp_path):
    import random

    from meterbook.operators.capture import capture_health

    rng = random.Random(6)
    rows = [
        (i * 9001, rng.choice("ab"), rng.choice(["Stop", None]), rng.choice(["recorded", "no_usage", "failed", "odd"]), rng.choice([None, "", "m"]), rng.randint(0, 60))
        for i in range(60)
    ]
    store = sl.HealthStore(spark, str(tmp_path / "health"))
    cuts = [0, 7, 8, 30, 60]
    for n, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = spark.createDataFrame(rows[low:high], HEALTH)
        store.add(part, n)
        store.add(part, n)  # delivered again
    whole = sorted(map(tuple, capture_health(spark.createDataFrame(rows, HEALTH)).collect()))
    assert sorted(map(tuple, store.health().collect())) == whole


def test_fold_over_many_ranges(spark):
    """One session over all tasks, by every number of ranges."""
    import random

    rng = random.Random(8)
    rows = [("s", rng.choice(["claude"] * 30 + ["codex"]), i, rng.randrange(20), rng.randrange(20) / 10, f"f{i}") for i in range(300)]
    for parts in (1, 7):
        got = fold_checkpoints(checkpoints(spark, rows), parts).collect()
        assert {r.session_id: (r.provider, r.total_tokens, float(r.cost), r.fp) for r in got} == brute(rows)


def test_bursts(spark, tmp_path):
    from meterbook.operators.capture import coalesce_bursts

    at = [T0 + timedelta(milliseconds=m) for m in (0, 1000, 2400, 5000, 90_000)]
    kind = "ledger string, at timestamp"
    spark.createDataFrame([("l", a) for a in at], kind).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    rows = run(sl.stream_bursts(stream, ["ledger"], "10 seconds"), tmp_path, "out").orderBy("first_at").collect()
    # The last burst stays open until a later write closes it.
    assert [r.writes for r in rows] == [3, 1]
    whole = coalesce_bursts(spark.read.parquet(str(tmp_path / "in")), keys=["ledger"]).orderBy("first_at")
    batch = whole.collect()
    assert [r.writes for r in batch] == [3, 1, 1]
    assert [(r.first_at, r.refresh_at) for r in batch[:2]] == [(r.first_at, r.refresh_at) for r in rows]


def test_traffic_windows_match_batch(spark, tmp_path):
    schema = "at timestamp, " + ", ".join(f"{c} bigint" for c in [*SUMS, "total_tokens"])
    rows = [(T0 + timedelta(minutes=m), 1, 2, 3, 4, 10) for m in (1, 7, 16, 14, 200)]
    for n, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).write.parquet(str(tmp_path / "in" / f"b{n}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option(
        "maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = TrafficStore(spark, str(tmp_path / "windows"))
    assert store.totals().count() == 0
    (tmp_path / "windows" / "batch=99").mkdir(parents=True)  # a batch that is still being written
    stream_traffic(stream, store, str(tmp_path / "ck")).awaitTermination(120)
    state = {r.start_ms: r.turns for r in store.totals().collect()}
    batch = {r.start_ms: r.turns for r in turn_windows(spark.createDataFrame(rows, schema)).collect()}
    assert state == batch and max(batch.values()) == 3


RUN = "run_id string, capture_id string, kind string, status string, at timestamp"


def test_settlement_and_timeout(spark, tmp_path):
    def at(s):
        return T0 + timedelta(seconds=s)

    batches = [
        [("good", "c1", "pending", None, at(0)), ("stuck", "c1", "pending", None, at(0))],
        [("good", "c1", "result", "recorded", at(1)), ("good", "c1", "result", "recorded", at(1))],
        [("other", "c9", "pending", None, at(5))],
        [("other", "c9", "result", "failed", at(30))],
        [("last", "x", "pending", None, at(31))],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, RUN).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
        stream = spark.readStream.schema(RUN).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        out = run(sl.stream_settlement(stream, "0 seconds"), tmp_path, "out")
    rows = {r.run_id: r for r in out.collect()}
    assert (rows["good"].timed_out, rows["good"].recorded, rows["good"].unresolved) == (False, 1, 0)
    assert (rows["stuck"].timed_out, rows["stuck"].unresolved) == (True, 1)
    assert rows["other"].timed_out and out.count() == 3
