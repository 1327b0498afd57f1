from helpers import SID, context, counted, one, settings, write_lines

from meterbook.operators.providers import Codex


def rollout(root, records, sid=SID, folder="sessions/2026/07/01"):
    write_lines(root / folder / f"rollout-2026-07-01T10-00-00-{sid}.jsonl", records)


def derive(spark, dim, root):
    return Codex(spark, str(root)).derive(dim)


def meta(**fields):
    return {"type": "session_meta", "timestamp": "2026-07-01T09:59:00Z", "payload": fields}


def user(text):
    return {"type": "event_msg", "timestamp": "2026-07-01T10:00:00Z",
            "payload": {"type": "user_message", "message": text}}


def test_split_dedupe_long_rates(spark, dim, tmp_path):
    first = counted((1000, 400, 0, 100), total=(1000, 400, 0, 100))
    rollout(tmp_path, [
        meta(id=SID, cwd="/work/demo", git={"branch": "main"}),
        user("Build usage analytics!"),
        context("gpt-5.4", "t1"), first, first,
        context("gpt-5.6-sol", "t2", at="2026-07-01T10:05:00Z"),
        counted((300_000, 200_000, 80_000, 1_000), total=(301_000, 200_400, 80_000, 1_100),
                at="2026-07-01T10:06:00Z"),
    ])
    d = derive(spark, dim, tmp_path)
    u = one(d.usage)
    assert (u.input, u.cache_write, u.cache_read, u.output) == (20_600, 80_000, 200_400, 1_100)
    assert u.total_tokens == 302_100
    assert float(u.cost) == 1.4481
    assert u.models == ["gpt-5.6-sol", "gpt-5.4"]
    m = one(d.metadata)
    assert m.slug == "build-usage-analytics" and m.branch == "main"


def test_tier_in_force(spark, dim, tmp_path):
    rollout(tmp_path, [
        context("gpt-5.6-sol", "t1"), settings(service_tier="default"),
        counted((1000, 0, 0, 100), total=(1000, 0, 0, 100)),
        context("gpt-5.6-sol", "t2", at="2026-07-01T11:00:00Z"), settings(service_tier="priority"),
        counted((1000, 0, 0, 100), total=(2000, 0, 0, 200), at="2026-07-01T11:00:09Z"),
    ])
    d = derive(spark, dim, tmp_path)
    assert [float(t.cost) for t in d.turns.orderBy("start_ms").collect()] == [0.008, 0.02]
    assert float(one(d.usage).cost) == 0.028


def test_priority_multipliers(spark, dim, tmp_path):
    want = {"gpt-5.6-sol": 0.02, "gpt-5.5": 0.02, "gpt-5.4": 0.008}
    for i, model in enumerate(want):
        sid = SID[:-1] + str(i)
        rollout(tmp_path, [context(model), settings(service_tier="priority"),
                           counted((1000, 0, 0, 100))], sid)
    rows = {r.model: float(r.cost) for r in derive(spark, dim, tmp_path).breakdown.collect()}
    assert rows == want


def test_switch_inside_a_turn(spark, dim, tmp_path):
    rollout(tmp_path, [
        context("gpt-5.6-sol"), counted((1000, 0, 0, 100), total=(1000, 0, 0, 100)),
        settings(model="gpt-5.6-luna"),
        counted((2000, 0, 0, 200), total=(3000, 0, 0, 300)),
    ])
    u = one(derive(spark, dim, tmp_path).usage)
    assert u.models == ["gpt-5.6-sol", "gpt-5.6-luna"]
    assert float(u.cost) == 0.0112


def test_first_declared_model_and_implicit_turn(spark, dim, tmp_path):
    rollout(tmp_path, [
        counted((1000, 0, 0, 100), at="2026-07-01T10:00:01Z"),
        {"type": "event_msg", "timestamp": "2026-07-01T10:00:30Z", "payload": {"type": "agent_message"}},
        context("codex-auto-review", None, at="2026-07-01T10:01:00Z"),
        counted((10, 0, 0, 1), at="2026-07-01T10:01:05Z"),
        context(None, "named", at="2026-07-01T10:02:00Z"),
        counted((20, 0, 0, 2), at="2026-07-01T10:02:05Z"),
        context(None, None, at="2026-07-01T10:03:00Z"),
        counted((30, 0, 0, 3), at="2026-07-01T10:03:05Z"),
        context(None, "named", at="2026-07-01T10:04:00Z"),
        counted((40, 0, 0, 4), at="2026-07-01T10:04:05Z"),
        context(None, "empty", at="2026-07-01T10:05:00Z"),
    ])
    d = derive(spark, dim, tmp_path)
    assert one(d.usage).models == ["gpt-5.5"]
    turns = {t.turn_id: t for t in d.turns.collect()}
    assert {k: t.total_tokens for k, t in turns.items()} == {
        "turn-1": 1100, "turn-2": 11, "named": 66, "turn-4": 33,
    }
    assert turns["turn-1"].end_ms - turns["turn-1"].start_ms == 29_000
    assert turns["named"].end_ms - turns["named"].start_ms == 125_000


def test_no_declaration_is_unknown(spark, dim, tmp_path):
    rollout(tmp_path, [counted((5, 0, 0, 5))])
    d = derive(spark, dim, tmp_path)
    assert one(d.usage).models == ["unknown"] and float(one(d.usage).cost) == 0


def test_identity_is_the_first_meta(spark, dim, tmp_path):
    rollout(tmp_path, [meta(id="fork-id"), meta(id="parent-id"), context("gpt-5.4"), counted((5, 0, 0, 5))])
    d = derive(spark, dim, tmp_path)
    assert one(d.usage).session_id == "fork-id" and one(d.metadata).session_id == "fork-id"


def test_fallback_prompt_and_archived_copy(spark, dim, tmp_path):
    import os

    item = {"type": "response_item", "timestamp": "2026-07-01T10:00:00Z",
            "payload": {"type": "message", "role": "user",
                        "content": [{"type": "input_text", "text": " Plain ask "}, {"type": "x", "text": "no"}]}}
    rollout(tmp_path, [context("gpt-5.4"), counted((5, 0, 0, 5))])
    old = next((tmp_path / "sessions").rglob("*.jsonl"))
    os.utime(old, (1_000_000, 1_000_000))
    rollout(tmp_path, [item, context("gpt-5.4"), counted((7, 0, 0, 7))], folder="archived_sessions")
    d = derive(spark, dim, tmp_path)
    assert one(d.usage).total_tokens == 14
    assert one(d.metadata).first_prompt == "Plain ask"
