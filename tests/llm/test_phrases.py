import random
import re
from collections import Counter

import numpy as np
import pytest

from meterbook.llm import phrases

SCHEMA = "doc_id long, text string, lang string, words string, a long, id long"


def brute(rows, least=10, longest=3, covered=50, best=2000):
    f, n = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    candidates = {g: v for g, v in f.items() if len(g[1]) > 1 and v >= least}
    out = {}
    for (lang, ws), a in candidates.items():
        cuts = [(10**6 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        holders = (v for (g, xs), v in candidates.items() if g == lang and len(xs) > len(ws)
                   and any(xs[i : i + len(ws)] == ws for i in range(len(xs) - len(ws) + 1)))
        if all(100 * v < covered * a for v in holders):
            row = (" ".join(ws), a, f[lang, ws[:k]], f[lang, ws[k:]], n[lang], score)
            out.setdefault(lang, []).append(row)
    result = []
    for lang, rows_ in out.items():
        rows_.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        result += [(lang, i + 1, *r) for i, r in enumerate(rows_[:best])]
    return sorted(result)


def run(spark, rows, splits=3, **how):
    df = spark.createDataFrame([(i, t, lang, "x", 1, 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(splits)
    got = phrases.collocations(df, **how).collect()
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got)


def corpus(seed, texts=60, words=12):
    rng = random.Random(seed)
    make = lambda: "".join(
        rng.choice("abcdefghijkl"[:words]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " É "]) for _ in range(rng.randint(0, 80))
    )
    return [(make(), rng.choice(["en", "de", None, "und"])) for _ in range(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_equal_brute_force(spark, seed):
    rows = [*corpus(seed), (None, "en"), ("", "en"), (" \t", None), ("New York City! " * 30, "en"), ("x " * 500, "xx"), ("Ab aB " * 9, "e")]
    want = brute(rows)
    assert run(spark, rows) == want and want
    assert run(spark, rows, least=3, best=7) == brute(rows, least=3, best=7)


def test_longer_phrases(spark):
    rows = corpus(3, texts=40, words=4)
    assert run(spark, rows, longest=4) == brute(rows, longest=4)
    assert run(spark, rows, longest=2, covered=1) == brute(rows, longest=2, covered=1)


def test_seams_between_chunks_and_segments(spark, monkeypatch):
    rows = [*corpus(4, texts=20), (" ".join(random.Random(5).choice("abcd") for _ in range(5000)), "en"), ("w" * 900 + " a b c" * 50, "en")]
    want = brute(rows)
    df = spark.createDataFrame([(i, t, lang, "x", 1, 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(2)
    counts = {}
    for chunk in (1, 7, 100):
        totals, tables = phrases.frequent_phrases(df, chunk=chunk)
        for t in tables:
            for r in t.collect():
                counts.setdefault(chunk, {})[r.lang, tuple(r.words)] = r.f
    assert counts[1] == counts[7] == counts[100]
    assert {(" ".join(k[1]), v) for k, v in counts[7].items()} >= {(r[2], r[3]) for r in want}
    monkeypatch.setattr(phrases, "SEGMENT", 50)
    for text, _ in rows:
        raw = (text or "").encode()
        pieces = [w for part in phrases.pieces(raw) for w in part]
        words = lambda ws: [w for w in b" ".join(ws).split(b" ") if w]
        assert pieces == words([raw.translate(phrases._TABLE).replace(b"\xff", b" \xff ")])


def test_many_languages_and_empty_tables(spark):
    rows = [(f"w{i} of the {i % 3} " * 12, f"l{i}") for i in range(25)]
    assert run(spark, rows, splits=1) == brute(rows)
    assert run(spark, []) == [] and run(spark, [("a b", "en")]) == []


def test_tiles_count_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    for side, dense in ((512, 8), (4, 8), (4, 1), (3, 100)):
        monkeypatch.setattr(phrases, "SIDE", side)
        monkeypatch.setattr(phrases, "DENSE", dense)
        for size in (0, 1, 500, 20_000):
            a, b = (rng.zipf(1.3, size) % 200).astype(np.int64), (rng.zipf(1.5, size) % 90).astype(np.int64)
            found = phrases.count_pairs(a, b)
            assert Counter(zip(a.tolist(), b.tolist(), strict=True)) == {(x, y): n for x, y, n in zip(*(c.tolist() for c in found), strict=True)}
            assert len(found[0]) == len(set(zip(a.tolist(), b.tolist(), strict=True)))
