from helpers import SID, one, said, write_lines

from meterbook.operators.providers import Claude


def derive(spark, dim, root):
    return Claude(spark, str(root)).derive(dim)


def main_file(root, sid=SID):
    return root / "projects" / "demo" / f"{sid}.jsonl"


def test_long_context_and_repeats(spark, dim, tmp_path):
    std = said("resp_standard", "gpt-5.6-sol", (1000, 2000, 400, 100))
    long = said("resp_long", "gpt-5.6-sol", (100_000, 20_000, 200_000, 1_000))
    write_lines(main_file(tmp_path), [std, std, std, long, long])
    u = one(derive(spark, dim, tmp_path).usage)
    assert (u.input, u.cache_write, u.cache_read, u.output) == (101_000, 22_000, 200_400, 1_100)
    assert u.total_tokens == 324_500
    assert float(u.cost) == 1.5157


def test_fast_speed(spark, dim, tmp_path):
    tokens = (1000, 2000, 400, 100)
    write_lines(main_file(tmp_path), [
        said("a", "claude-opus-5", tokens, speed="standard"),
        said("b", "claude-opus-5", tokens, at="2026-07-01T10:01:00Z", speed="fast"),
    ])
    d = derive(spark, dim, tmp_path)
    costs = [float(r.cost) for r in d.turns.orderBy("end_ms").collect()]
    assert costs == [0.0202, 0.0404]
    assert float(one(d.usage).cost) == 0.0606


def test_old_fast_speeds(spark, dim, tmp_path):
    write_lines(main_file(tmp_path), [
        said(m, m, (1000, 0, 0, 100), speed="fast")
        for m in ("claude-opus-4-8", "claude-opus-4-7", "claude-opus-4-6")
    ])
    rows = {r.model: float(r.cost) for r in derive(spark, dim, tmp_path).breakdown.collect()}
    assert rows == {"claude-opus-4-8": 0.015, "claude-opus-4-7": 0.045, "claude-opus-4-6": 0.045}


def test_subagents_and_partial_tail(spark, dim, tmp_path):
    write_lines(main_file(tmp_path), [said("main-one", "claude-sonnet-4-5", (1000, 0, 0, 100))])
    sub = tmp_path / "projects" / "elsewhere" / SID / "subagents" / "deep" / "a.jsonl"
    write_lines(sub, [said("sub-one", "claude-sonnet-4-5", (2000, 0, 0, 200), at="2026-07-01T10:01:00Z"),
                      said("main-one", "claude-sonnet-4-5", (9, 0, 0, 9))])
    assert one(derive(spark, dim, tmp_path).usage).total_tokens == 3_300
    write_lines(
        main_file(tmp_path),
        [said("main-one", "claude-sonnet-4-5", (1000, 0, 0, 100)),
         said("main-two", "claude-sonnet-4-5", (3000, 0, 0, 300), at="2026-07-01T10:02:00Z")],
        tail='{"type":"assistant","mess',
    )
    d = derive(spark, dim, tmp_path)
    assert one(d.usage).total_tokens == 6_600
    assert [r.turn_id for r in d.turns.orderBy("end_ms").collect()] == ["main-one", "sub-one", "main-two"]


def test_turns_across_midnight(spark, dim, tmp_path):
    write_lines(main_file(tmp_path), [
        said("a", "claude-sonnet-4-5", (1000, 0, 0, 100), at="2026-07-01T23:55:00Z"),
        said("b", "claude-sonnet-4-5", (2000, 0, 0, 200), at="2026-07-02T00:15:00Z"),
    ])
    d = derive(spark, dim, tmp_path)
    turns = d.turns.orderBy("end_ms").collect()
    assert [t.total_tokens for t in turns] == [1100, 2200]
    assert sum(t.cost for t in turns) == one(d.usage).cost


def test_undated_response_drops_turns(spark, dim, tmp_path):
    write_lines(main_file(tmp_path), [
        said("a", "claude-sonnet-4-5", (10, 0, 0, 1)), said("b", "claude-sonnet-4-5", (20, 0, 0, 2), at=None),
    ])
    d = derive(spark, dim, tmp_path)
    assert one(d.usage).total_tokens == 33
    assert d.turns.count() == 0


def test_not_billed_and_nameless(spark, dim, tmp_path):
    write_lines(main_file(tmp_path), [
        said("x", "<synthetic>", (5, 0, 0, 5)),
        said(None, "claude-sonnet-4-5", (1, 0, 0, 1), at="2026-07-01T10:00:00Z"),
        said(None, "claude-sonnet-4-5", (1, 0, 0, 1), at="2026-07-01T10:00:01Z"),
        said(None, "claude-sonnet-4-5", (1, 0, 0, 1), at="2026-07-01T10:00:02Z", uuid="u-3"),
        said("neg", "claude-sonnet-4-5", (-50, 0, 0, 3), at="2026-07-01T10:00:03Z"),
    ])
    d = derive(spark, dim, tmp_path)
    assert one(d.usage).total_tokens == 9
    names = [r.turn_id for r in d.turns.orderBy("end_ms").collect()]
    assert names == ["claude-response-1", "claude-response-2", "u-3", "neg"]


def test_metadata_follows_file_order(spark, dim, tmp_path):
    long = "word " * 40
    write_lines(main_file(tmp_path), [
        {"type": "file-history-snapshot", "timestamp": "bad"},
        {"type": "user", "timestamp": "2026-07-01T12:00:00Z", "slug": "calm-fox", "cwd": "/w/a",
         "gitBranch": "dev", "message": {"content": [{"type": "text", "text": long}, {"type": "image"}]}},
        said("a", "claude-sonnet-4-5", (1, 0, 0, 1), at="2026-07-01T14:00:00Z", cwd="/w/b"),
        {"type": "user", "timestamp": "2026-07-01T13:00:00Z", "message": {"content": "later"}},
    ])
    m = one(derive(spark, dim, tmp_path).metadata)
    assert (m.slug, m.cwd, m.branch) == ("calm-fox", "/w/b", "dev")
    assert (m.user_messages, m.assistant_messages, m.total_messages) == (2, 1, 4)
    assert m.end_ms - m.start_ms == 3_600_000
    assert m.first_prompt == long[:100].strip() + "..."


def test_string_prompt_that_looks_like_json(spark, dim, tmp_path):
    write_lines(main_file(tmp_path), [
        {"type": "user", "timestamp": "2026-07-01T12:00:00Z", "message": {"content": "[1, 2]"}},
    ])
    m = one(derive(spark, dim, tmp_path).metadata)
    assert m.first_prompt == "[1, 2]" and m.slug == SID[:8]


def test_only_uuid_files_and_newest_copy(spark, dim, tmp_path):
    import os

    rec = [said("a", "claude-sonnet-4-5", (1, 0, 0, 1))]
    write_lines(tmp_path / "projects" / "demo" / "notes.jsonl", rec)
    old, new = main_file(tmp_path), tmp_path / "projects" / "moved" / f"{SID}.jsonl"
    write_lines(old, [said("old", "claude-sonnet-4-5", (7, 0, 0, 7))])
    write_lines(new, [said("new", "claude-sonnet-4-5", (1, 0, 0, 1))])
    os.utime(old, (1_000_000, 1_000_000))
    assert one(derive(spark, dim, tmp_path).usage).total_tokens == 2
    found = one(Claude(spark, str(tmp_path)).found())
    assert found.project_path == f"moved/{SID}"
