"""Copilot and opencode."""

import json

import pytest
from helpers import one, write_lines

from meterbook import schemas
from meterbook.operators.providers import Copilot, Opencode, union_providers


def copilot(root, metrics, sid="cop-1", prompt="Fix the flaky test", done=True):
    events = [
        {"type": "session.start", "timestamp": "2026-07-01T10:00:00Z",
         "data": {"sessionId": sid, "startTime": "2026-07-01T09:59:58Z",
                  "context": {"cwd": "/work/demo", "branch": "dev"}}},
        {"type": "user.message", "timestamp": "2026-07-01T10:00:01Z", "data": {"content": prompt}},
        {"type": "assistant.message", "timestamp": "2026-07-01T10:00:02Z", "data": {"content": "ok"}},
    ]
    if done:
        events.append({"type": "session.shutdown", "timestamp": "2026-07-01T10:05:00Z",
                       "data": {"modelMetrics": metrics}})
    write_lines(root / "session-state" / sid / "events.jsonl", events, tail='{"type": "user.mess')


def details(i, r, w, o):
    names = {"input": i, "cache_read": r, "cache_write": w, "output": o}
    return {"tokenDetails": {k: {"tokenCount": v} for k, v in names.items()}}


def test_copilot_details_beat_usage(spark, dim, tmp_path):
    metric = {**details(1000, 2000, 500, 100), "usage": {"inputTokens": 1, "outputTokens": 1}}
    copilot(tmp_path, {"gpt-5.4-mini": metric})
    copilot(tmp_path, {}, sid="open", done=False)
    d = Copilot(spark, str(tmp_path)).derive(dim)
    u = one(d.usage)
    assert u.total_tokens == 3600 and float(u.cost) == 0.001725
    m = one(d.metadata)
    assert (m.slug, m.branch, m.cwd) == ("fix-the-flaky-test", "dev", "/work/demo")
    assert m.end_ms - m.start_ms == 302_000 and m.total_messages == 2
    assert one(Copilot(spark, str(tmp_path)).found()).session_id == "cop-1"


def test_copilot_native_cost_and_usage_fallback(spark, dim, tmp_path):
    copilot(tmp_path, {
        "Claude-Opus-4.8": {"totalNanoAiu": 2_325_000_000,
                            "usage": {"inputTokens": 100, "outputTokens": 5, "cacheReadTokens": 60,
                                      "cacheWriteTokens": 50}},
        "future-model-preview": {"usage": {"inputTokens": 10, "outputTokens": 2}},
    })
    d = Copilot(spark, str(tmp_path)).derive(dim)
    rows = {r.model: r for r in d.breakdown.collect()}
    assert float(rows["claude-opus-4-8"].cost) == 0.02325
    assert rows["claude-opus-4-8"].input == 0
    future = rows["future-model-preview"]
    assert (future.total_tokens, float(future.cost), future.unknown) == (12, 0.0, True)


def test_copilot_same_normal_form_stays_apart(spark, dim, tmp_path):
    copilot(tmp_path, {"claude-opus-4.8": details(1, 0, 0, 0), "claude-opus-4-8": details(2, 0, 0, 0)})
    d = Copilot(spark, str(tmp_path)).derive(dim)
    assert sorted(r.input for r in d.breakdown.collect()) == [1, 2]


def message(id_, sid, at, role, model=None, tokens=None, cost=0.0):
    data = {"role": role, "cost": cost}
    if model:
        data["modelID"] = model
    if tokens:
        i, o, reason, read, write = tokens
        data["tokens"] = {"input": i, "output": o, "reasoning": reason,
                          "cache": {"read": read, "write": write}}
    return (id_, sid, at, at, json.dumps(data))


TURN = (400, 250, 90, 800, 0)


def opencode(spark, messages, extra_sessions=()):
    rows = [("root", None, "C:/work/sample", "calm-orchid", "A title", 0.0, 0, 0, 0, 0, 0, 1000, 5000),
            *extra_sessions]
    parts = [("p2", "m1", "root", 2, 2, json.dumps({"type": "text", "text": " First turn "})),
             ("p1", "m1", "root", 1, 1, json.dumps({"type": "step", "text": "no"})),
             ("p3", "m1", "root", 3, 3, json.dumps({"type": "text", "text": "later"}))]
    return Opencode(
        spark.createDataFrame(rows, schemas.OPENCODE_SESSION),
        spark.createDataFrame(messages, schemas.OPENCODE_MESSAGE),
        spark.createDataFrame(parts, schemas.OPENCODE_PART),
    )


BASE = [
    message("m1", "root", 10, "user"),
    message("m2", "root", 20, "assistant", "claude-sonnet-4-5", TURN),
    message("m3", "root", 30, "user"),
    message("m4", "root", 40, "assistant", "mock-model", TURN),
]
SONNET = (400 * 3 + 340 * 15 + 800 * 0.3) / 1e6


def test_opencode_usage_and_metadata(spark, dim):
    d = opencode(spark, BASE).derive(dim)
    u = one(d.usage)
    assert (u.input, u.output, u.cache_read) == (800, 680, 1600)
    rows = {r.model: r for r in d.breakdown.collect()}
    assert float(rows["claude-sonnet-4-5"].cost) == pytest.approx(SONNET, abs=1e-9)
    assert rows["mock-model"].unknown and float(rows["mock-model"].cost) == 0
    m = one(d.metadata)
    assert (m.slug, m.first_prompt, m.total_messages) == ("calm-orchid", "First turn", 4)


def test_opencode_host_cost_and_broken_body(spark, dim):
    more = [*BASE, message("m5", "root", 50, "assistant", "mock-model", (1, 1, 0, 0, 0), 0.25),
            ("m6", "root", 60, 60, '{"role": "assistant", "tok'), ("m7", "root", 61, 61, "[1]"),
            message("m8", "root", 70, "assistant")]
    d = opencode(spark, more).derive(dim)
    rows = {r.model: r for r in d.breakdown.collect()}
    assert float(rows["mock-model"].cost) == 0.25 and not rows["mock-model"].unknown
    assert one(d.metadata).assistant_messages == 4


def test_opencode_child_sessions_and_cycles(spark, dim):
    blank = ("/x", "s", "t", 0.0, 0, 0, 0, 0, 0, 1, 1)
    extra = [("child", "root", *blank), ("grand", "child", *blank),
             ("loop-a", "loop-b", *blank), ("loop-b", "loop-a", *blank), ("orphan", "gone", *blank)]
    more = [*BASE, message("c1", "grand", 50, "assistant", "claude-sonnet-4-5", (100, 50, 10, 0, 0)),
            message("l1", "loop-a", 50, "assistant", "claude-sonnet-4-5", (9, 9, 9, 0, 0))]
    p = opencode(spark, more, extra)
    u = one(p.derive(dim).usage)
    assert (u.session_id, u.input, u.output) == ("root", 900, 740)
    assert one(p.found()).session_id == "root"


def test_opencode_fingerprint_moves_with_messages(spark, dim):
    a = one(opencode(spark, BASE).fingerprints("v1")).fingerprint
    b = one(opencode(spark, BASE).fingerprints("v1")).fingerprint
    more = [*BASE, message("m9", "root", 90, "user")]
    c = one(opencode(spark, more).fingerprints("v1")).fingerprint
    assert a == b and a != c and a != one(opencode(spark, BASE).fingerprints("v2")).fingerprint


def test_union_of_hosts(spark, dim, tmp_path):
    copilot(tmp_path, {"gpt-5.4-mini": details(1000, 0, 0, 0)})
    usage, meta, turns = union_providers(
        [opencode(spark, BASE).derive(dim), Copilot(spark, str(tmp_path)).derive(dim)]
    )
    assert {r.provider for r in usage.collect()} == {"opencode", "copilot"}
    assert meta.count() == 2 and turns is None
