"""Stateful processors: line assembly, values in force, health, settlement."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB state store."""
    if spark.conf.get(PROVIDER_CONF, None) != ROCKSDB:
        spark.conf.set(PROVIDER_CONF, ROCKSDB)


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


class LineAssembler(StatefulProcessor):
    """Complete lines of a file from its increments, numbered in order.

    Increments are taken by their own number, each naming the one after it: one that
    arrives early waits until those before it are here, one that comes again is
    left out. The first number is that of ``first``. An incomplete last record
    waits for the next increment of its file. With ``restarts`` the first number,
    when it comes again, begins the file anew, line numbers included.
    """

    OUTPUT = "source string, line bigint, value string"

    def __init__(self, first: int = 1, restarts: bool = False):
        self.first, self.restarts = first, restarts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "tail string, line bigint, next bigint")
        # Increments that came early, one entry at a time on disk.
        self.early = handle.getMapState("early", "increment bigint", "text string, next bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.rest.get() if self.rest.exists() else None
        tail, line, wanted = tuple(held) if held else ("", 0, self.first)
        for row in rows:
            if row.increment >= wanted or self.restarts:
                self.early.updateValue((row.increment,), (row.text, row.next))
        if self.restarts and self.early.containsKey((self.first,)):
            tail, line, wanted = "", 0, self.first
        while self.early.containsKey((wanted,)):
            text, following = self.early.getValue((wanted,))
            self.early.removeKey((wanted,))
            wanted = following
            *full, tail = (tail + text).split("\n")
            if tail.strip() and _is_json(tail):
                full.append(tail)
                tail = ""
            for value in full:
                if value.strip():
                    yield Row(source=key[0], line=line, value=value)
                    line += 1
        self.rest.update((tail, line, wanted))

    def close(self) -> None:
        pass


class CarryInForce(StatefulProcessor):
    """Model, tier and turn in force on each usage line, kept across batches.

    Input rows are flat rollout lines with (line, kind, declared, tier_set,
    context_id, at) and the event's own payload in ``body``. Usage before the
    first declared model waits for it, as that model is also the one before.
    """

    OUTPUT = (
        "session_id string, line bigint, model string, tier string, turn_id string, "
        "turn_start string, at string, body string"
    )

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState(
            "now", "model string, tier string, turn string, start string, turns bigint"
        )
        # Start time of every turn so far, one entry at a time on disk.
        self.known = handle.getMapState("known", "turn string", "start string")
        self.waiting = handle.getListState(
            "waiting", "line bigint, tier string, turn_id string, turn_start string, at string, body string"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.now.get() if self.now.exists() else None
        model, tier, turn, start, turns = held if held else (None, "default", None, None, 0)
        batch = sorted(rows, key=lambda r: r.line)
        if model is None:
            model = next((r.declared for r in batch if r.declared), None)
            if model is not None and self.waiting.exists():
                for line, *values in self.waiting.get():
                    yield self._row(key[0], model, line, *values)
                self.waiting.clear()
        for r in batch:
            model = r.declared or model
            tier = r.tier_set or tier
            if r.kind == "context":
                turn = r.context_id or f"turn-{turns + 1}"
                if self.known.containsKey((turn,)):
                    start = self.known.getValue((turn,))[0]
                else:
                    start, turns = r.at, turns + 1
                    self.known.updateValue((turn,), (start,))
            if r.kind != "usage":
                continue
            if turn is None:
                turn, start, turns = "turn-1", r.at, turns + 1
                self.known.updateValue((turn,), (start,))
            if model is None:
                self.waiting.appendValue((r.line, tier, turn, start, r.at, r.body))
            else:
                yield self._row(key[0], model, r.line, tier, turn, start, r.at, r.body)
        self.now.update((model, tier, turn, start, turns))

    @staticmethod
    def _row(session, model, line, tier, turn, start, at, body) -> Row:
        return Row(
            session_id=session, line=line, model=model, tier=tier,
            turn_id=turn, turn_start=start, at=at, body=body,
        )

    def close(self) -> None:
        pass


class Settlement(StatefulProcessor):
    """A run settles when nothing is unresolved and nothing changed for a while.

    Input rows are (run_id, capture_id, kind, status, at_ms); kind is pending
    or result. Timers follow event time. An unsettled run reports a timeout
    once and is forgotten after the keep time.
    """

    OUTPUT = (
        "run_id string, settled_ms bigint, timed_out boolean, unresolved bigint, "
        "recorded bigint, failed bigint, no_usage bigint"
    )
    NAMES = ["recorded", "failed", "no_usage"]

    def __init__(self, quiet_ms: int = 1_000, timeout_ms: int = 15_000, keep_ms: int = 86_400_000):
        self.quiet_ms, self.timeout_ms, self.keep_ms = quiet_ms, timeout_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState(
            "run",
            "first bigint, changed bigint, unresolved bigint, recorded bigint, failed bigint, "
            "no_usage bigint, reported boolean",
        )
        # 1 pending, 2 resolved; one entry at a time on disk.
        self.captures = handle.getMapState("captures", "id string", "mark int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = list(self.run.get()) if self.run.exists() else None
        for r in sorted(rows, key=lambda r: (r.at_ms, r.kind)):
            if held is None:
                held = [r.at_ms, r.at_ms, 0, 0, 0, 0, False]
                self.handle.registerTimer(r.at_ms + self.timeout_ms)
                self.handle.registerTimer(r.at_ms + self.keep_ms)
            cid = (r.capture_id,)
            mark = self.captures.getValue(cid)[0] if self.captures.containsKey(cid) else 0
            if r.kind == "pending" and mark == 0:
                held[2] += 1
                self.captures.updateValue(cid, (1,))
            elif r.kind == "result" and mark < 2:
                held[2] -= mark
                held[3 + self.NAMES.index(r.status)] += 1
                self.captures.updateValue(cid, (2,))
            else:
                continue
            held[1] = max(held[1], r.at_ms)
        if held is not None:
            self.run.update(tuple(held))
            self.handle.registerTimer(held[1] + self.quiet_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.run.exists():
            return
        at = expiredTimerInfo.getExpiryTimeInMs()
        first, changed, unresolved, rec, fail, none, reported = self.run.get()
        quiet = unresolved == 0 and at >= changed + self.quiet_ms
        late = at >= first + self.timeout_ms
        if (quiet or late) and not reported:
            self.run.update((first, changed, unresolved, rec, fail, none, True))
            yield Row(
                run_id=key[0], settled_ms=at, timed_out=not quiet, unresolved=unresolved,
                recorded=rec, failed=fail, no_usage=none,
            )
        if at >= first + self.keep_ms:
            self.run.clear()
            self.captures.clear()

    def close(self) -> None:
        pass
