import json
from decimal import Decimal

import pytest
from helpers import one, write_lines
from pyspark.sql import functions as F

from meterbook.functions import projects as pf
from meterbook.operators import ledger as lg
from meterbook.operators import pricing as pr
from meterbook.operators import quality as qc
from meterbook.operators import reconcile as rc
from meterbook.plans.sessions import derive, snapshot_meta
from meterbook.sources import capture as sc
from meterbook.sources import ledger as sl
from meterbook.sources import transcripts as ts
from meterbook.sources.feed import scan_price_feed


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=2))


CURRENT = {
    "session_slug": "calm-fox", "session_id": "cur-1", "project": " Demo ", "branch": "main", "cwd": "/work/demo",
    "machine": "north", "start_time": "2026-07-01T10:00:00.000Z", "end_time": "2026-07-01T11:00:00.000Z",
    "duration_seconds": 3600, "input_tokens": 100, "output_tokens": 50, "cache_creation_tokens": 20,
    "cache_read_tokens": 30, "total_tokens": 200, "total_cost_usd": 1.25, "models": ["claude-opus-5", " gpt-5.4 "],
    "model_breakdowns": [
        {"model": "claude-opus-5", "vendor": "anthropic", "total_tokens": 120, "total_cost_usd": 0.75},
        {"model": "gpt-5.4", "total_tokens": "80", "total_cost_usd": 0.5}],
    "turns": [{"turn_id": "t1", "start_time": "2026-07-01T10:00:00Z", "total_tokens": 200},
              {"turn_id": "bad", "start_time": "never"}],
    "provider": "codex",
}
OLD = {
    "session_id": "old-session-id", "start_time": "2026-07-01T12:00:00Z", "end_time": None, "machine": None,
    "input_tokens": " 40 ", "output_tokens": "", "total_tokens": "90", "total_cost_usd": "0.9",
    "models": ["claude-opus-5", "gpt-5.4"], "cwd": "/w/app/.claude/worktrees/x",
}


def test_old_and_current_records(spark, tmp_path):
    put(tmp_path / "a.json", CURRENT)
    put(tmp_path / "b.json", OLD)
    put(tmp_path / "c.json", '{"session_id": "x", "start_')
    put(tmp_path / "d.json", {"session_id": "no-start", "start_time": "soon"})
    put(tmp_path / "e.json", {**OLD, "session_id": "listed", "models": "claude-opus-5; gpt-5.4"})
    rows = sl.scan_ledger_json(spark, str(tmp_path))
    assert [r.file for r in sl.broken_files(rows).collect()] == ["c.json"]
    sessions = lg.normalize_ledger(sl.readable(rows))
    by = {r.session_id: r for r in sessions.collect()}
    assert set(by) == {"cur-1", "old-session-id", "listed"}
    cur, old = by["cur-1"], by["old-session-id"]
    assert (cur.project, cur.models, cur.total_tokens, cur.cost) == ("Demo", ["claude-opus-5", "gpt-5.4"], 200, Decimal("1.25"))
    assert (old.slug, old.project, old.machine, old.provider) == ("old-sess", "app", "-", "claude")
    assert (old.input, old.output, old.end_ms) == (40, 0, None)
    split = {(r.session_id, r.vendor): (r.cost, r.tokens) for r in lg.vendor_split(sessions).collect()}
    assert split == {
        ("cur-1", "anthropic"): (0.75, 120), ("cur-1", "openai"): (0.5, 80),
        ("old-session-id", "anthropic"): (0.45, 45), ("old-session-id", "openai"): (0.45, 45),
        ("listed", "unknown"): (0.9, 90),
    }
    meta = one(snapshot_meta(derive(sessions.filter("session_id <> 'listed'"))))
    assert (meta.sessions, float(meta.total_cost)) == (2, 2.15)
    turn = one(lg.normalize_turns(sl.readable(rows)))
    assert turn.turn_id == "t1" and turn.start_ms == turn.end_ms
    derived = derive(sessions)
    sl.write_snapshot(derived, snapshot_meta(derived), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "sessions")).count() == 3


CASES = [
    ("/Users/n/natalie/.claude/worktrees/wt-1", "natalie"), ("C:\\src\\natalie\\.claude\\worktrees\\wt\\sub", "natalie"),
    ("/Users/n/.t3/worktrees/claude-channel/t3code-1", "claude-channel"), ("/Users/n/usage-tool", "usage-tool"),
    ("/Users/n/.codex/worktrees/12/natalie", "natalie"), ("/x/.T3/Worktrees/natalie/y/", "natalie"), ("", ""),
    (None, ""), (".claude/worktrees", "worktrees"), ("/a/worktrees/b", "b"),
]


def test_project_cases(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "i int, cwd string")
    got = [r.p for r in df.orderBy("i").select(pf.project_from_cwd(F.col("cwd")).alias("p")).collect()]
    assert got == [w for _, w in CASES]


ROW = "session_id string, provider string, slug string, total_tokens bigint, cost decimal(18,6)"


def rows(spark, *items):
    return spark.createDataFrame([(a, b, c, d, Decimal(str(e))) for a, b, c, d, e in items], ROW)


def test_combine(spark):
    src = rows(spark, ("shared", "claude", "s", 200, 2), ("only", "claude", "s", 300, 3), ("newer", "claude", "s", 350, 3))
    dst = rows(spark, ("shared", "claude", "d", 100, 1), ("newer", "claude", "d", 400, 4))
    out = lg.combine_ledgers(src, dst)
    assert {r.session_id: r.total_tokens for r in out.collect()} == {"shared": 200, "only": 300, "newer": 400}
    assert {r.action: r.sessions for r in lg.action_counts(out).collect()} == {"copied": 2, "retained": 1}
    with pytest.raises(Exception, match="conflicting ledger row: shared"):
        lg.combine_ledgers(rows(spark, ("shared", "codex", "s", 1, 1)), dst).collect()


def test_merge_is_idempotent(spark):
    old = rows(spark, ("a", "claude", "o", 100, 1), ("b", "claude", "o", 100, 1), ("c", None, "o", 9, 9))
    new = rows(spark, ("a", "claude", "n", 90, 2), ("b", "codex", "n", 5, 0.1), ("c", "claude", "n", 5, 9), ("d", "claude", "n", 1, 1))
    once = lg.merge_ledger(old, new)
    got = {r.session_id: (r.action, r.slug, r.total_tokens) for r in once.collect()}
    assert got == {"a": ("preserve", "n", 100), "b": ("replace", "n", 5), "c": ("preserve", "n", 9), "d": ("insert", "n", 1)}
    again = lg.merge_ledger(once.drop("action"), new).drop("action")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.drop("action").collect()))


def test_legacy_csv(spark, tmp_path):
    head = ",".join(sl.LEGACY_FIELDS)
    def line(sid, slug="a b", cost="1.5", models="claude-opus-5;gpt-5.4"):
        v = {"session_id": sid, "session_slug": slug, "total_cost_usd": cost, "models": models,
             "end_time": "2026-01-01T00:00:00Z", "start_time": "2026-01-01T00:00:00Z", "project": '"say ""hi"", ok"'}
        return ",".join(v.get(f, "") for f in sl.LEGACY_FIELDS)
    put(tmp_path / "l.csv", "\r\n".join([head, line("one"), line("one", cost="9"), line(""), "short,row", line("have")]) + "\r\n")
    raw = sl.scan_legacy_csv(spark, str(tmp_path / "l.csv"))
    good = sl.legacy_sessions(raw)
    ledger = spark.createDataFrame([("have", "s", "e")], "session_id string, slug string, end_time string")
    added = {r.key: r for r in lg.import_legacy(good, ledger).collect()}
    assert set(added) == {"one", "a_b-2026-01-01T00_00_00Z"}
    assert added["one"].cost == Decimal("1.5") and added["one"].project == 'say "hi", ok'
    assert added["one"].models == ["claude-opus-5", "gpt-5.4"]
    c = one(lg.import_counts(good, ledger, raw.filter("malformed")))
    assert (c.migrated, c.superseded, c.malformed, c.without_id) == (2, 2, 1, 1)


def test_legacy_anomalies_and_totals(spark, tmp_path):
    put(tmp_path / "l.csv", "session_id,end_time,start_time,total_cost_usd\na,e,2026-01-01T00:00:00Z,1.5\nb,e,soon,2\nshort,row\nc,e,,4\na,e,,9\n")
    raw = sl.scan_legacy_csv(spark, str(tmp_path / "l.csv"))
    found = sorted((r.kind, r.detail) for r in lg.import_anomalies(raw).collect())
    assert found == [("fields", "short,row"), ("start_time", ""), ("start_time", ""), ("start_time", "soon")]
    rows, keep = sl.legacy_sessions(raw), ["session_id", "slug", "end_time", "cost"]
    before = rows.filter("session_id = 'c'").select(*keep)
    after = before.unionByName(lg.import_legacy(rows, before).select(*keep))
    c = one(lg.import_check(rows, before, after))
    assert (c.expected_sessions, c.expected_total, c.found_total, c.agrees) == (3, Decimal("7.5"), Decimal("7.5"), True)
    assert not one(lg.import_check(rows, before, before)).agrees
    assert one(lg.import_check(rows.limit(0), before.limit(0), before.limit(0))).agrees


FEED = {
    "claude-nova-6": {"litellm_provider": "anthropic", "mode": "chat", "input_cost_per_token": 8e-6, "output_cost_per_token": 4e-5},
    "claude-nova-6-20270101": {"litellm_provider": "anthropic", "mode": "chat", "input_cost_per_token": 9e-6, "output_cost_per_token": 9e-5},
    "gpt-6.1": {"litellm_provider": "openai", "mode": "responses", "input_cost_per_token": 4e-6, "output_cost_per_token": 1.6e-5, "cache_read_input_token_cost": 4e-7},
    "claude-tide-1": {"litellm_provider": "anthropic", "mode": "chat", "input_cost_per_token": 2e-6, "output_cost_per_token": 1e-5,
                      "cache_creation_input_token_cost": 2.5e-6, "cache_read_input_token_cost": 2e-7},
    "claude-opus-5": {"litellm_provider": "anthropic", "mode": "chat", "input_cost_per_token": 9.9e-5, "output_cost_per_token": 9.9e-5},
    "anthropic/claude-x": {"litellm_provider": "anthropic", "mode": "chat", "input_cost_per_token": 1e-6, "output_cost_per_token": 1e-6},
    "claude-bed": {"litellm_provider": "bedrock", "mode": "chat", "input_cost_per_token": 1e-6, "output_cost_per_token": 1e-6},
    "gpt-image": {"litellm_provider": "openai", "mode": "image_generation", "input_cost_per_token": 1e-6, "output_cost_per_token": 1e-6},
    "gpt-text": {"litellm_provider": "openai", "mode": "chat", "input_cost_per_token": "free", "output_cost_per_token": 1e-6},
}


def test_price_feed_and_dim(spark, dim, tmp_path):
    put(tmp_path / "feed.json", FEED)
    feed = scan_price_feed(spark, str(tmp_path / "feed.json"))
    got = {r.model: tuple(float(x) for x in r[1:]) for r in feed.collect()}
    assert got == {"claude-nova-6": (8, 40, 10, 0.8), "gpt-6.1": (4, 16, 4, 0.4), "claude-tide-1": (2, 10, 2.5, 0.2),
                   "claude-opus-5": (99, 99, 123.75, 9.9)}
    full = pr.build_dim_price(spark, feed)
    rates = {(r["view"], r.model): (r.origin, r.rate_input) for r in full.collect()}
    assert rates["shared", "claude-opus-5"] == ("anthropic", 5_000_000)
    assert rates["openai", "claude-opus-5"] == ("feed", 99_000_000)
    assert rates["shared", "claude-nova-6"] == ("feed", 8_000_000)
    a, b = one(pr.price_version(dim)).price_version, one(pr.price_version(full)).price_version
    assert len(a) == 16 and a != b and one(pr.price_version(dim.limit(0))).price_version == "none"


def test_reuse_cycle(spark):
    kind, rec = "file string, size bigint, mtime_ms bigint", "file string, record struct<v: int>"
    prior = spark.createDataFrame([("a", 1, 1, (1,)), ("b", 1, 1, (2,)), ("c", 1, 1, (3,)), ("gone", 1, 1, (4,))],
                                  kind + ", record struct<v: int>")
    files = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 2, 2), ("new", 1, 1), ("bad", 1, 1)], kind)
    todo = sorted(r.file for r in rc.changed_files(files, prior).collect())
    assert todo == ["b", "bad", "c", "new"]
    read = spark.createDataFrame([("b", (20,)), ("c", None), ("new", (50,)), ("bad", None)], rec)
    got = {r.file: (r.status, r.size, r.record.v) for r in rc.reuse_snapshot(files, read, prior).collect()}
    assert got == {"a": ("reused", 1, 1), "b": ("parsed", 2, 20), "c": ("failed", 1, 3), "new": ("parsed", 1, 50)}


def test_hook_log_and_misses(spark, dim, tmp_path):
    put(tmp_path / "hook.log", "\n".join([
        "[2026-07-01T10:00:00.000Z] pricing miss provider=codex models=gpt-5.4,ghost-1 billed at $0",
        "[2026-07-01T10:00:01.000Z] pricing miss models=claude-opus-5 billed at $0",
        "[2026-07-01T10:00:02.000Z] pricing miss models=<synthetic> billed at $0",
        "[2026-06-01T10:00:00.000Z] pricing miss models=old-ghost billed at $0", "[2026-07-01T10:00:03.000Z] done"]))
    misses = sc.scan_hook_log(spark, str(tmp_path / "hook.log"))
    found = qc.check_pricing_misses(misses, dim, 1_782_900_000_000)
    assert sorted(r.severity for r in found.collect()) == ["red", "yellow"]
    put(tmp_path / "odd.log", "\n".join(["[2026-07-01T10:00:00.000Z] pricing miss billed at $0"] * 2))
    odd = qc.check_pricing_misses(sc.scan_hook_log(spark, str(tmp_path / "odd.log")), dim, 1_782_900_000_000)
    assert [r.severity for r in odd.collect()] == ["red", "red"]


def test_legacy_header_names_the_columns(spark, tmp_path):
    put(tmp_path / "a.csv", 'session_id,models,project,end_time\none,claude-opus-5,"a, b",2026-01-01T00:00:00Z\nshort\n')
    put(tmp_path / "b.csv", "project,session_id\np,two\n")
    rows = {r.session_id: r for r in sl.scan_legacy_csv(spark, str(tmp_path)).filter("NOT malformed").collect()}
    assert (rows["one"].project, rows["one"].models, rows["one"].machine) == ("a, b", "claude-opus-5", None)
    assert rows["two"].project == "p" and len(rows) == 2


def test_the_later_record_wins(spark, tmp_path):
    schema = "session_id string, session_slug string, end_time string, timestamp string, total_tokens bigint"
    both = spark.createDataFrame([("s", "a", "e", "2026-01-01", 1), ("s", "a", "e", "2026-01-02", 2)], schema)
    sl.write_ledger_json(both, str(tmp_path / "out"))
    assert one(spark.read.json(str(tmp_path / "out"))).total_tokens == 2


def test_capture_run_files(spark, tmp_path):
    def result(i, **extra):
        return {"schema_version": 1, "run_id": "r1", "capture_id": f"capture-{i}", "completed_at": f"2026-07-01T10:00:0{i}Z", **extra}
    good = {"status": "recorded", "project": "p", "total_tokens": 5, "total_cost_usd": 0.5, "shard_path": "x"}
    base = tmp_path / "r1"
    put(base / "pending" / "capture-1.json", {})
    put(base / "pending" / "capture-9.json", {})
    put(base / "results" / "c1.json", result(1, **good))
    put(base / "results" / "c2.json", result(2, **{**good, "total_cost_usd": -1}))
    put(base / "results" / "c3.json", result(3, status="no_usage", reason="whatever"))
    put(base / "results" / "c4.json", result(4, status="failed", message="m"))
    put(base / "results" / "c5.json", {**result(5, **good), "run_id": "other"})
    put(base / "results" / "c6.json", '{"half": ')
    pending, results = sc.scan_capture_runs(spark, str(tmp_path))
    assert sorted(r.capture_id for r in results.collect()) == ["capture-1", "capture-4"]
    from meterbook.operators.capture import settle_runs

    r = one(settle_runs(pending, results))
    assert (r.outcome, r.unresolved, r.latest_tokens) == ("recorded+failed", 1, 5)


def test_detect_provider_and_gate(spark, tmp_path):
    write_lines(tmp_path / "a.jsonl", [{"type": "summary"}, {"type": "user", "entrypoint": "sdk-cli"}, {"type": "session_meta"}])
    write_lines(tmp_path / "b.jsonl", [{"type": "turn_context", "entrypoint": "cli"}])
    write_lines(tmp_path / "root" / "c.jsonl", [{"x": 1}], tail='{"type": "us')
    write_lines(tmp_path / "d.jsonl", [{"type": "?"}])
    lines = ts.scan_lines(spark, str(tmp_path))
    base = lines.first().path.rsplit("/", 1)[0].removesuffix("/root")
    roots = spark.createDataFrame([(f"{base}/root", "copilot")], "root string, provider string")
    got = {r.path.rsplit("/", 1)[1]: r.provider for r in rc.detect_provider(lines, roots).collect()}
    assert got == {"a.jsonl": "claude", "b.jsonl": "codex", "c.jsonl": "copilot", "d.jsonl": None}
    hooks = spark.createDataFrame([(e, f"{base}/{f}.jsonl") for e, f in (("Stop", "a"), ("SubagentStop", "a"), ("Stop", "b"), ("Stop", "zz"))],
                                  "hook_event_name string, transcript_path string")
    kept = sorted((r.hook_event_name, r.transcript_path[-7]) for r in rc.automation_gate(hooks, lines).collect())
    assert kept == [("Stop", "b"), ("Stop", "z"), ("SubagentStop", "a")]
    assert rc.automation_gate(hooks, lines, keep_all=True).count() == 4


def test_fingerprint_tail_and_needs_sync(spark, dim, tmp_path):
    import hashlib

    from meterbook.operators.providers import Copilot
    from meterbook.operators.reconcile import needs_sync

    big = tmp_path / "session-state" / "s1" / "events.jsonl"
    write_lines(big, [{"type": "session.shutdown", "data": {}, "pad": "x" * 70_000}])
    body = big.read_bytes()
    part = one(ts.file_parts(spark, str(tmp_path))).part
    assert part == f"{len(body)}:{hashlib.sha256(body[-65536:]).hexdigest()}"
    host = Copilot(spark, str(tmp_path))
    print1 = one(host.fingerprints("v1")).fingerprint
    ledger = spark.createDataFrame([("s1", "copilot", print1)], "session_id string, provider string, source_fingerprint string")
    stale = lambda version: needs_sync(host.fingerprints(version).selectExpr("'copilot' AS provider", "*"), ledger)
    assert stale("v1").count() == 0 and one(stale("v2")).session_id == "s1"
    index = ts.list_files(spark, str(tmp_path)).join(ts.file_parts(spark, str(tmp_path)), "path").selectExpr("*", "'s1' AS session_id")
    assert one(Copilot.prints(index, "v1")).fingerprint == print1


def test_large_files_are_fingerprinted_by_ranges(spark, tmp_path):
    import hashlib

    body = bytes(range(256)) * 40
    (tmp_path / "a.jsonl").write_bytes(body)
    (tmp_path / "b é.jsonl").write_bytes(body[:999])
    parts = lambda *args: {r.path.rpartition("/")[2][0]: r.part for r in ts.file_parts(spark, str(tmp_path), *args).collect()}
    assert parts(500, 1_000) == parts(500) == {k: f"{len(d)}:{hashlib.sha256(d[-500:]).hexdigest()}" for k, d in (("a", body), ("b", body[:999]))}
    pieces = [hashlib.sha256(body[i : i + 1_000]).hexdigest() for i in range(0, len(body), 1_000)]
    assert parts(None, 1_000)["a"] == f"{len(body)}:{hashlib.sha256(','.join(pieces).encode()).hexdigest()}"
    # A file without blocks on disk, too large for one value.
    with (tmp_path / "c.jsonl").open("wb") as f:
        f.truncate(3_000_000_000)
    assert parts()["c"] == f"3000000000:{hashlib.sha256(bytes(ts.TAIL_BYTES)).hexdigest()}"


def test_monitor_overrides_and_branch(spark):
    from meterbook.operators.capture import capture_strategy

    hosts = spark.createDataFrame([("claude",), ("codex",)], "provider string")
    over = spark.createDataFrame([("codex", "continuous")], "provider string, strategy string")
    got = {r.provider: r.strategy for r in capture_strategy(hosts, "batch", over).collect()}
    assert got == {"claude": "batch", "codex": "continuous"}
