import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from meterbook.llm import language
from meterbook.llm.queries import op13_language_id

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, p string, score double, entropy string"


def brute_symbols(text):
    out = []
    for c in text or "":
        if c.isalpha():
            low = c.lower() if len(c.lower()) == 1 else c
            out.append(ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % 5)
        elif out and out[-1]:
            out.append(0)
    return out if not out or out[-1] == 0 else [*out, 0]


class Brute:
    """Interpolated Kneser-Ney by dictionaries of tuples."""

    def __init__(self, texts, order):
        self.order = order
        counts = Counter()
        for t in texts:
            s = brute_symbols(t)
            padded = (0,) * (order - 1) + tuple(s)
            counts.update(padded[i : i + order] for i in range(len(s)))
        self.tables = {order: counts}
        for n in range(order - 1, 0, -1):
            self.tables[n] = Counter(g[1:] for g in self.tables[n + 1])
        self.discount = {}
        for n, t in self.tables.items():
            once, twice = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
            self.discount[n] = once / (once + 2 * twice) if once and twice else 0.5

    def p(self, gram):
        n = len(gram)
        if not n:
            return 1 / 32
        t, d = self.tables[n], self.discount[n]
        after = {g: v for g, v in t.items() if g[:-1] == gram[:-1]}
        total = sum(after.values())
        lower = self.p(gram[1:])
        if not total:
            return lower
        return max(after.get(gram, 0) - d, 0) / total + d * len(after) / total * lower

    def entropy(self, text):
        s = brute_symbols(text)
        padded = (0,) * (self.order - 1) + tuple(s)
        memo = {}
        total = 0.0
        for i in range(len(s)):
            g = padded[i : i + self.order]
            if g not in memo:
                memo[g] = math.log2(self.p(g))
            total -= memo[g]
        return total / len(s)


def test_symbols():
    rng = random.Random(4)
    texts = [None, "", "  ", "A", "é日本 🎉x", "İstanbul ß", "a\nb--c", "1a", "123", "ʼn"]
    texts += ["".join(rng.choice("abZé ,.\n9") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    for t in texts:
        assert language.symbols(t).tolist() == brute_symbols(t), t


def test_models_and_predictions_equal_brute_force(spark):
    rng = random.Random(8)
    make = {"aa": "abcde ", "bb": "cdefg  ", "é": "éaüc. "}
    rows = [(i, "".join(rng.choice(make[lang]) for _ in range(rng.randint(1, 60))), lang) for i, lang in enumerate(["aa", "bb", "é"] * 20)]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "abc", None), (103, "1 2", "digits"), (104, "1 2", "aa"), (None, "abd", "aa"), (3, rows[3][1], "bb")]
    rows += [(200, "".join(rng.choice("abcde ") for _ in range(60_000)), "aa")]
    df = spark.createDataFrame([(i, t, lang, "x", 0.5, "y") for i, t, lang in rows], SCHEMA).repartition(3)
    model = language.fit(df)
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    texts = {}
    for i, t, lang in rows:
        if not out(i) and lang is not None and brute_symbols(t):
            texts.setdefault(lang, []).append(t)
    assert model.languages == sorted(texts) and model.order == 4
    brutes = [Brute(texts[lang], 4) for lang in model.languages]
    for m, b in zip(model.models, brutes, strict=True):
        grams = [tuple(rng.randrange(32) for _ in range(4)) for _ in range(50)] + list(b.tables[4])[:200]
        codes = np.array([sum(c << 5 * (3 - i) for i, c in enumerate(g)) for g in grams], np.int32)
        assert np.allclose(m.log2(codes), [math.log2(b.p(g)) for g in grams], atol=1e-12)
        heads = list(b.tables[4])[:3]
        for g in heads:  # a distribution over the next symbol
            assert sum(2 ** m.log2(np.array([(sum(c << 5 * (3 - i) for i, c in enumerate(g)) >> 5 << 5) + x for x in range(32)]))) == pytest.approx(1)
    got = [(r.doc_id, r.lang_pred, r.score, r.entropy, r.rejected) for r in language.predict(df, model).collect()]
    want = {}
    for i, t, _ in rows:
        if brute_symbols(t):
            e = [b.entropy(t) for b in brutes]
            best = min(range(len(e)), key=lambda k: (round(e[k], 6), k))
            want.setdefault(i, []).append((model.languages[best], e[best]))
        else:
            want.setdefault(i, []).append((language.UNKNOWN, None))
    assert len(got) == len(rows)
    for i, pred, score, entropy, rejected in got:
        assert any(pred == p and (entropy is None if e is None else entropy == pytest.approx(e, abs=1e-5)) for p, e in want[i])
        assert 0 <= score <= 1 and (rejected is None) == (entropy is None)


def test_nothing_to_learn_and_many_languages(spark):
    none = spark.createDataFrame([(1, "abc", None, "x", 0.5, "y"), (2, None, "en", "x", 0.5, "y")], SCHEMA)
    model = language.fit(none)
    assert model.languages == [] and {r.lang_pred for r in language.predict(none, model).collect()} == {"und"}
    assert language.predict(none.limit(0), language.fit(none.limit(0))).count() == 0
    assert [language.order_for(n) for n in (0, 1, 16, 17, 512, 513, 10**6)] == [4, 4, 4, 3, 3, 2, 1]
    many = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 9, f"l{i:03}", "x", 0.5, "y") for i in range(60)], SCHEMA)
    model = language.fit(many)
    right = [r for r in language.predict(many, model).collect() if r.lang_pred == f"l{r.doc_id:03}"]
    assert model.order == 3 and len(right) == len(model.languages) >= 30


def test_held_out_languages_and_rejection(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in op13_language_id(spark, FOLDER).collect()}
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    assert rows.keys() == truth.keys()
    held = [i for i, r in rows.items() if r.held_out]
    assert held == [i for i in rows if zlib.crc32(str(i).encode()) % 3 == 1] and len(held) > 250
    right = sum(rows[i].lang_pred == truth[i][0] for i in held)
    print("right", right, len(held))
    assert right / len(held) > 0.97
    odd = spark.createDataFrame([(1, "xqzj vkkw qqqx zzzt " * 20, "en", "", 0.0, "")], SCHEMA)
    assert language.predict(odd, language.fit(docs)).first().rejected
    assert sum(bool(r.rejected) for r in rows.values()) < 0.02 * len(rows)


def test_more_languages_change_no_model(spark, tmp_path):
    """The query's grams are as long with 20 languages, in two parts, as with two."""
    rng = random.Random(9)
    few = [(i, "".join(rng.choice("abcdef " if i % 2 else "cdefgh ") for _ in range(200)), "ab"[i % 2]) for i in range(40)]
    more = [(100 + i, f"{chr(0x3B1 + k)}{chr(0x3B1 + k // 5)} {chr(0x430 + k)} " * 3, f"m{k:02}") for k in range(18) for i in (3 * k, 3 * k + 1, 3 * k + 2)]
    found = {}
    for name, rows in (("few", few), ("more", few + more)):
        spark.createDataFrame([(i, t, lang, "x", 0.5, "y") for i, t, lang in rows], SCHEMA).write.parquet(str(tmp_path / name / "documents.parquet"))
        found[name] = {r.doc_id: r for r in op13_language_id(spark, str(tmp_path / name)).collect()}
        assert len(found[name]) == len(rows)
    for i, _, _ in few:
        a, b = found["few"][i], found["more"][i]
        assert (a.lang_pred, a.entropy, a.rejected) == (b.lang_pred, b.entropy, b.rejected)


def test_parts_equal_one_model(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(i, "".join(rng.choice("abcdefg "[k // 2 :]) for _ in range(rng.randint(1, 80))), f"l{k}") for i, k in enumerate([0, 1, 2, 3, 4, 5] * 20)]
    rows += [(200 + i, t, "l9") for i, t, lang in rows if lang == "l0" and zlib.crc32(str(i).encode()) % 3 != 1 and zlib.crc32(str(200 + i).encode()) % 3 != 1]
    rows += [(i, t, "l0") for i, t, lang in rows if lang == "l9"]  # equal languages differ in parts
    rows += [(300, None, "l0"), (301, "1 2", "l1"), (None, "abc", None), (7, rows[7][1], "l1"), (7, rows[7][1], "l1")]
    df = spark.createDataFrame([(i, t, lang, "x", 0.5, "y") for i, t, lang in rows], SCHEMA)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.entropy or 0)
    whole = language.fit(df, 2)
    one = sorted(language.predict(df, whole).collect(), key=key)
    monkeypatch.setattr(language, "CELLS", 3 << 10)
    split = language.fit(df, 2)
    assert len(whole.languages) == 7 and split.bounds() == [(0, 2), (2, 4), (4, 7)]
    assert np.array_equal(whole.limits, split.limits)
    several = sorted(language.predict(df, split).collect(), key=key)
    assert len(one) == len(several) == len(rows)
    for a, b in zip(one, several, strict=True):
        assert (a.doc_id, a.lang_pred, a.entropy, a.rejected) == (b.doc_id, b.lang_pred, b.entropy, b.rejected)
        assert a.score == pytest.approx(b.score, abs=1e-12)
