"""Writing transcript fixtures."""

import json
from pathlib import Path

SID = "11111111-2222-3333-4444-555555555555"


def write_lines(path: Path, records, tail: str = "") -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    text = "".join(json.dumps(r) + "\n" for r in records) + tail
    path.write_text(text)


def said(id_, model, tokens, at="2026-07-01T10:00:00.000Z", speed=None, **extra):
    """A claude assistant record; tokens are input, write, read, output."""
    usage = dict(zip(
        ["input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens"],
        tokens,
    ))
    if speed:
        usage["speed"] = speed
    message = {"role": "assistant", "model": model, "usage": usage, "content": []}
    if id_:
        message["id"] = id_
    return {"type": "assistant", "timestamp": at, "message": message, **extra}


def context(model=None, turn="turn-a", at="2026-07-01T10:00:00.000Z", cwd="/work/demo"):
    return {"type": "turn_context", "timestamp": at,
            "payload": {"turn_id": turn, "model": model, "cwd": cwd}}


def settings(at="2026-07-01T10:00:00.000Z", **fields):
    return {"type": "event_msg", "timestamp": at,
            "payload": {"type": "thread_settings_applied", "thread_settings": fields}}


def counted(last, total=None, at="2026-07-01T10:00:01.000Z"):
    """A codex token event; tuples are input, cached, write, output."""
    def usage(t):
        return {"input_tokens": t[0], "cached_input_tokens": t[1], "cache_write_tokens": t[2],
                "output_tokens": t[3], "reasoning_output_tokens": 0, "total_tokens": t[0] + t[3]}

    info = {"last_token_usage": usage(last)}
    if total:
        info["total_token_usage"] = usage(total)
    return {"type": "event_msg", "timestamp": at, "payload": {"type": "token_count", "info": info}}


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]
