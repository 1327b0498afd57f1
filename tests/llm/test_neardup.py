import itertools
import random

import pytest

from meterbook.llm import graph, neardup
from meterbook.llm.graph import components


def shingled(text):
    words = (text or "").encode().lower().split()
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(i, shingled(t)) for i, t in rows]
    reach = {i: i for i, _ in rows}
    changed = True
    links = [
        (a, b)
        for (a, x), (b, y) in itertools.combinations(sets, 2)
        if x and y and 100 * len(x & y) >= 75 * len(x | y)
    ]
    while changed:
        changed = False
        for a, b in links:
            low = min(reach[a], reach[b])
            if (reach[a], reach[b]) != (low, low):
                reach[a] = reach[b] = low
                changed = True
    return {(i, len(s), reach[i], reach[i] == i) for i, s in sets}


def test_equals_all_pairs(frame, corpus):
    got = {tuple(r) for r in neardup.near_duplicates(frame(*corpus)).collect()}
    assert got == brute(corpus)


def test_a_star_of_copies_is_one_group(frame):
    """Copies that are similar to their origin only, not to each other."""
    base = [f"w{i}" for i in range(60)]
    rows = [(100, " ".join(base))]
    for k in range(25):
        copy = list(base)
        copy[5 + 2 * k] = f"x{k}"
        rows.append((k, " ".join(copy)))
    got = {tuple(r) for r in neardup.near_duplicates(frame(*rows)).collect()}
    assert got == brute(rows)
    assert {r[2] for r in got} == {0}


def test_repeated_and_missing_ids(frame):
    text, other = " ".join(map(str, range(30))), " ".join(map(str, range(100, 130)))
    rows = frame((5, text), (5, other), (2, text), (9, other), (None, text), (None, None))
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in neardup.near_duplicates(rows).collect())
    assert got == [(-1, None, True), (-1, None, True), (2, 2, True), (5, 2, False), (5, 2, False), (9, 2, False)]


def test_empty_table_and_stage(frame, spark):
    assert neardup.near_duplicates(frame().limit(0)).count() == 0
    rows = frame((1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "a b c d e f"))
    out = neardup.drop_near_duplicates(rows)
    assert out.columns == rows.columns
    assert sorted(r.doc_id or -1 for r in out.collect()) == [-1, 1, 3]


@pytest.mark.parametrize("links", [[(1, 2), (2, 3), (9, 8), (8, 7), (7, 3)], [(i, i + 1) for i in range(40)], [(4, 4)]])
def test_components(spark, links):
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    low = min(min(x) for x in links)
    assert got == {i: low for x in links for i in x}


@pytest.mark.parametrize("large, block", [(1, 3), (4, 256)])
def test_dense_regions_in_blocks(frame, monkeypatch, large, block):
    """Copies far from and near to each other, completed by zones and by pairs."""
    monkeypatch.setattr(neardup, "LARGE", large)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(70)]
    rows = []
    for k in range(60):
        copy = list(base)
        for at in rng.sample(range(70), rng.choice([1, 1, 2, 4, 6])):
            copy[at] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(copy)))
    got = {tuple(r) for r in neardup.near_duplicates(frame(*rows)).collect()}
    assert got == brute(rows)
    assert 1 < len({r[2] for r in got}) < 60


def test_a_plan_of_components_reads_its_input_a_few_times(spark, monkeypatch):
    """The driver's memory: what it plans at once does not multiply over the steps of a round."""
    scans, real = [], graph.staged

    def counted(df, what):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return real(df, what)

    monkeypatch.setattr(graph, "staged", counted)
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in components(path).collect()} == {0}
    assert len(scans) > 4 and max(scans) <= 6
