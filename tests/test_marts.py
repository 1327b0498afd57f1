from datetime import datetime, timezone
from decimal import Decimal

import pytest
from helpers import one

from meterbook.plans import projects as pp
from meterbook.plans import sessions as ps
from meterbook.plans import spend, tokens
from meterbook.plans import timeline as tl
from pyspark.sql import functions as F

KIND = (
    "session_id string, project string, machine string, provider string, start_ms bigint, "
    "end_ms bigint, dur_sec bigint, input bigint, output bigint, cache_write bigint, "
    "cache_read bigint, total_tokens bigint, cost decimal(18,6), models array<string>"
)
ZONE = "America/Chicago"


def ms(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1000)


ROWS = [
    ("alpha-old", "Alpha", "north", "claude", ms("2026-07-02T04:49:59"), ms("2026-07-02T04:59:59"),
     600, 30, 20, 10, 40, 100, Decimal(2), ["claude-sonnet-4-5"]),
    ("beta-turns", "Beta", "south", "codex", ms("2026-07-02T04:30:00"), ms("2026-07-02T05:00:00"),
     1800, 50, 30, 20, 100, 200, Decimal(3), ["gpt-5.6-sol", "claude-opus-4-1"]),
    ("alpha-new", "Alpha", "south", "claude", ms("2026-07-02T05:58:00"), ms("2026-07-02T06:00:00"),
     120, 10, 10, 10, 20, 50, Decimal(2), ["claude-opus-4-1"]),
    ("gamma", "Gamma", "north", "claude", ms("2026-07-03T04:30:00"), ms("2026-07-03T05:30:00"),
     3600, 100, 100, 100, 100, 400, Decimal(4), ["claude-haiku-3-5"]),
]


@pytest.fixture(scope="module")
def sessions(spark):
    return ps.derive(spark.createDataFrame(ROWS, KIND)).cache()


def test_usage_summary(sessions):
    r = one(spend.usage_summary(sessions))
    assert (float(r.cost), r.sessions, r.tokens) == (11, 4, 750)
    assert (r.cache_read, r.input, r.output, r.cache_write) == (260, 190, 160, 140)
    assert (r.avg_cost, r.cache_ratio) == (2.75, 260 / 750)


def test_empty_summary(sessions):
    r = one(spend.usage_summary(sessions.limit(0)))
    assert (float(r.cost), r.sessions, r.avg_cost, r.cache_ratio) == (0, 0, 0, 0)


def test_project_summary(sessions):
    rows = pp.project_table(pp.project_summary(sessions), "cost").collect()
    got = [(r.project, r.sessions, float(r.cost), r.tokens, r.dur_sec, r.machines, r.family) for r in rows]
    assert got == [
        ("Alpha", 2, 4, 150, 720, 2, "Sonnet"), ("Gamma", 1, 4, 400, 3600, 1, "Haiku"),
        ("Beta", 1, 3, 200, 1800, 1, "Sol"),
    ]


def test_calendar_days_in_zone(sessions):
    rows = spend.calendar_days(sessions, F.lit(ms("2026-07-03T06:00:00")), 3, ZONE).orderBy("day").collect()
    assert [(str(r.day), float(r.cost), r.sessions, r.tokens) for r in rows] == [
        ("2026-07-01", 2, 1, 100), ("2026-07-02", 5, 2, 250), ("2026-07-03", 4, 1, 400),
    ]
    assert (rows[1].input, rows[1].output, rows[1].cache_write, rows[1].cache_read) == (60, 40, 30, 120)


def test_interval_buckets(sessions):
    lo, hi = ms("2026-07-02T04:00:00"), ms("2026-07-02T08:00:00")
    period = ps.Period(F.lit(lo), F.lit(hi), F.lit(1))
    rows = spend.interval_buckets(sessions.filter("project <> 'Gamma'"), period, 2).orderBy("i").collect()
    assert [(float(r.cost), r.sessions, r.tokens) for r in rows] == [(7, 3, 350), (0, 0, 0)]


def test_window_ends_count_twice(sessions):
    end = ms("2026-07-02T05:00:00")
    period = ps.Period(F.lit(end), F.lit(end + 1), F.lit(1).cast("bigint"))
    assert ps.period_filter(sessions, period).count() == 1
    assert {r.session_id for r in ps.previous_period(sessions, period).collect()} == {"beta-turns", "alpha-old"}
    both = one(spend.period_comparison(sessions, period))
    assert (both.cur_sessions, both.prev_sessions) == (1, 2)


TURN = "provider string, session_id string, start_ms bigint, end_ms bigint, input bigint, output bigint, cache_write bigint, cache_read bigint, total_tokens bigint"


def test_traffic_uses_complete_turns(spark, sessions):
    a = ms("2026-07-02T04:45:00")
    turns = spark.createDataFrame([
        ("codex", "beta-turns", a, a, 25, 15, 10, 50, 100),
        ("codex", "beta-turns", a, ms("2026-07-02T05:00:00"), 25, 15, 10, 50, 100),
        ("claude", "gamma", a, a, 1, 1, 1, 1, 4),
    ], TURN)
    lo, hi = ms("2026-07-02T00:00:00"), ms("2026-07-03T12:00:00")
    traffic = tokens.token_traffic(sessions, turns, ps.Period(F.lit(lo), F.lit(hi), F.lit(2)))
    rows = {r.start_ms: r for r in traffic.filter("total_tokens > 0").collect()}
    quarter = rows[ms("2026-07-02T04:45:00")]
    assert (quarter.total_tokens, quarter.turns, quarter.sessions) == (200, 1, 1)
    assert (rows[ms("2026-07-02T05:00:00")].turns, rows[ms("2026-07-03T05:30:00")].sessions) == (1, 1)
    assert sum(r.total_tokens for r in rows.values()) == 750
    assert traffic.count() == 36 * 4


@pytest.mark.parametrize("values,want", [
    ([8, 9, 10, 11, 12, 200], (20, True, 1)), ([1, 2], (2, False, 0)),
    ([10, 12, 14, 16, 18, 22], (25, False, 0)), ([], (1, False, 0)),
])
def test_robust_scale(spark, values, want):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    r = one(tokens.robust_scale(df, "v"))
    assert (r.max, r.broken, r.outliers) == want


def test_series_slots(spark):
    names = ["Alpha", "Beta", "Alpha", "Gamma", "Delta", "Epsilon"]
    df = spark.createDataFrame([(n, i, f"s{i}") for i, n in enumerate(names)],
                               "project string, start_ms bigint, session_id string")
    got = {r.project: r.slot for r in tl.series_slots(df, df.limit(0)).collect()}
    assert got == {"Alpha": 0, "Beta": 1, "Gamma": 2, "Delta": 3, "Epsilon": -1}
    got = {r.project: r.slot for r in tl.series_slots(df, df.filter("project IN ('Delta', 'Beta')")).collect()}
    assert got == {"Beta": 0, "Delta": 1, "Alpha": 2, "Gamma": 3, "Epsilon": -1}


def greedy(segments):
    """Lanes by the reference rule, one cluster at a time."""
    out, cluster, reach = {}, [], -1

    def finish():
        ends = []
        for s, e, n in cluster:
            lane = next((i for i, x in enumerate(ends) if x <= s), len(ends))
            ends[lane:lane + 1] = [e]
            out[n] = lane
        for _, _, n in cluster:
            out[n] = (out[n], len(ends))

    for s, e, n in sorted(segments):
        if cluster and s >= reach:
            finish()
            cluster, reach = [], -1
        cluster.append((s, e, n))
        reach = max(reach, e)
    finish()
    return out


def test_lanes_match_greedy(spark):
    import random
    from datetime import date

    rng = random.Random(3)
    rows = []
    for i in range(400):
        s = rng.randrange(0, 86_000) * 1000
        rows.append((date(2026, 7, 1 + i % 2), s, s + rng.randrange(60, 3000) * 1000, "claude", f"n{i:04d}"))
    df = spark.createDataFrame(
        rows, "day date, day_start_ms bigint, day_end_ms bigint, provider string, session_id string")
    got = {r.session_id: (r.lane, r.lane_count) for r in tl.concurrency_lanes(df).collect()}
    want = {}
    for d in (1, 2):
        want.update(greedy([(r[1], r[2], r[4]) for r in rows if r[0].day == d]))
    assert got == want


def test_midnight_and_empty_segments(spark):
    from datetime import date

    def at(text):
        return ms(text) + 5 * 3_600_000  # Chicago in July

    rows = [("a", at("2026-07-01T23:30:00"), at("2026-07-02T00:00:00"), 0, 10),
            ("b", at("2026-07-01T10:00:00"), None, 0, 60), ("c", at("2026-07-01T22:00:00"), at("2026-07-03T01:00:00"), 0, 1)]
    df = spark.createDataFrame(rows, "session_id string, start_ms bigint, end_ms bigint, dur_sec bigint, total_tokens bigint")
    seg = tl.session_day_segments(tl.wall_spans(df), date(2026, 7, 1), date(2026, 7, 3), ZONE)
    got = {(r.session_id, r.day.day): (r.day_start_ms // 60000, r.day_end_ms // 60000) for r in seg.collect()}
    assert got == {("a", 1): (1410, 1440), ("b", 1): (600, 601), ("c", 1): (1320, 1440),
                   ("c", 2): (0, 1440), ("c", 3): (0, 60)}
    table = tl.rhythm_table(seg, date(2026, 7, 1), date(2026, 7, 4), date(2026, 7, 3)).orderBy("day").collect()
    assert [r.sessions for r in table] == [3, 1, 1, 0] and table[3].outside


def test_exact_quantiles(spark):
    import random

    import numpy as np
    from meterbook.plans.quantiles import exact_quantiles

    rng = random.Random(5)
    for values in ([1.5], [0.0, 0.0, 2.0], [rng.choice([1.0, rng.random() * 9]) for _ in range(777)]):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
        r = one(exact_quantiles(df, F.col("v"), [0.1, 0.5, 0.9]))
        assert np.allclose([r.q0, r.q1, r.q2], np.quantile(values, [0.1, 0.5, 0.9]), atol=1e-12)
    assert one(exact_quantiles(df.limit(0), F.col("v"), [0.5])).q0 is None


def test_calendar_window():
    from datetime import date

    assert tl.calendar_window("week", date(2026, 7, 5)) == (date(2026, 6, 29), date(2026, 7, 5))
    assert tl.calendar_window("month", date(2024, 2, 9)) == (date(2024, 2, 1), date(2024, 2, 29))
    assert tl.shift_anchor("month", date(2026, 1, 31), -1) == date(2025, 12, 1)
    assert tl.shift_anchor("week", date(2026, 1, 1), 1) == date(2026, 1, 8)


def test_period_change(spark):
    from meterbook.functions.money import period_change

    cases = [(633.0, 1.0), (1.0, 0.0), (104.0, 100.0), (261.0, 100.0), (96.0, 100.0)]
    change = period_change(F.col("c"), F.col("p"))
    rows = spark.createDataFrame(cases, "c double, p double").select(
        change["kind"].alias("k"), change["value"].alias("v")).collect()
    assert [(r.k, r.v) for r in rows] == [
        ("ratio", 633), ("none", None), ("percent", 4.0), ("percent", 161), ("percent", -4.0)]
