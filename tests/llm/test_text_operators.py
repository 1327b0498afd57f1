import base64
import hashlib
import json
import random
import time
import tracemalloc
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterbook.llm import bpe, decontaminate, fingerprint, licenses, quality, secrets

PATH = public_tokenizers.path("byte_bpe_50k.json")


# Encoding


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Bpe(f.read())


def test_encoder_equals_the_library(own):
    theirs, rng = Tokenizer.from_file(PATH), random.Random(3)
    texts = ["", "<|endoftext|>a<|endoftext|>", "  \n\n\t x ", "日本語 🎉🎉 मानक", "\x00\x01a" * 5, "=" * 3000, "ab" * 2000]
    texts += ["".join(rng.choice("aAeé \n\t=-12'stʼ²½你🎉#>　\x85\x1c") for _ in range(rng.randint(1, 80))) for _ in range(2000)]
    for text, want in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = own.encode(text)
        assert ids == want.ids
        assert own.decode(ids) == text == theirs.decode(want.ids, skip_special_tokens=False)
    cut = own.encode("日本語")[:-1]
    assert own.decode(cut) == theirs.decode(cut, skip_special_tokens=False)


def test_encoding_rows(frame, corpus):
    theirs = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in bpe.round_trip(frame(*corpus), PATH).collect()}
    tokens = {r.doc_id: r for r in bpe.tokenize(frame(*corpus), PATH).collect()}
    for i, text in corpus:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) == tokens[i].n_tokens and list(tokens[i].ids) == ids
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(frame().limit(0), PATH).count() == 0


def test_other_tokenizers_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        bpe.Bpe(f.read())


# Decontamination


def brute_hits(text, items):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    hit, ids = set(), set()
    for item, other in items:
        own = [w.decode() for w in decontaminate.words(other)]
        width = min(10, len(own))
        for at in range(len(own) - width + 1 if own else 0):
            for i in range(len(words) - width + 1):
                if words[i : i + width] == own[at : at + width]:
                    hit |= set(range(i, i + width))
                    ids |= {item} - {None}
    return len(words), sorted(hit), sorted(ids)


@pytest.mark.parametrize("block", [1 << 25, 200])
def test_decontamination_equals_brute_force(frame, spark, corpus, block):
    rng = random.Random(4)
    letters = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(1, corpus[6][1]), (2, "One, two THREE."), (3, None), (4, "!!"), (5, letters(12)), (6, letters(11)), (None, corpus[8][1]), (1, "é 日本")]
    docs = [*corpus, (900, letters(4000)), (901, "zero one two-three four " * 3), (902, "x " + corpus[6][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    marked = decontaminate.Benchmark(bench, block_bytes=block).mark(frame(*docs), "found_")
    got = {r.doc_id: r.found_ for r in marked.collect()}
    for i, text in docs:
        assert (got[i].n_words, list(got[i].hit_words), list(got[i]["items"])) == brute_hits(text, items)


def test_decontamination_stage(frame, spark):
    docs = frame((1, "a b c d e f g h i j k"), (2, "clean words"), (3, None), (4, ""))
    bench = spark.createDataFrame([(1, "b c d e f g h i j k")], "item_id long, text string")
    out = decontaminate.drop_contaminated(docs, bench)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 3, 4]
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 4
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


# Secrets


def brute_base(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def der(tag, body):
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x82]) + size.to_bytes(2, "big") if size > 255 else bytes([0x81, size])
    return bytes([tag]) + head + body


RSA = der(0x30, b"".join([der(2, b"\0"), *[der(2, bytes([77]) * 64) for _ in range(8)]]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(9)
    parts = ["token", "Password", "api_key", "apikey", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGHIJKLMNOP1", "deadbeef0123", "é", "🎉", "x", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert [s[:3] for s in secrets.spans(text) if s[0] in secrets.BASE] == brute_base(text)


def test_structure_decides():
    b64 = base64.b64encode(RSA).decode()
    assert ("der_key", 2, 2 + len(b64), "rsa") in secrets.spans("é " + b64)
    assert "der_key" in {s[0] for s in secrets.spans(RSA.hex().upper())}
    broken = base64.b64encode(RSA[:40] + b"x" + RSA[40:]).decode()
    assert "der_key" not in {s[0] for s in secrets.spans(broken)}
    lines = "\n".join(b64[i : i + 64] for i in range(0, len(b64), 64))
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{lines}\n-----END RSA PRIVATE KEY-----"
    assert ("pem_key", 3, 3 + len(pem), "rsa") in secrets.spans("x: " + pem + " y")
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 40) + field(b"s" * 50)
    assert "ssh_key" in {s[0] for s in secrets.spans(base64.b64encode(ssh).decode())}
    assert "ssh_key" not in {s[0] for s in secrets.spans(base64.b64encode(ssh + b"abc").decode())}
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    good = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': '1'})}.c2lnbmF0dXJl"
    assert ("signed_token", 1, 1 + len(good), "HS256") in secrets.spans(" " + good)
    assert not secrets.spans(f"{part(['alg'])}.{part({'sub': '1'})}.c2lnbmF0dXJl")
    assert not secrets.spans("plain." * 20)


def test_structure_decides_in_sentences_and_escapes():
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    good = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': '1'})}.c2lnbmF0dXJl"
    bare = f"{part({'alg': 'none'})}.{part({'sub': '1'})}."
    of = lambda kind, text: [text[s[1] : s[2]] for s in secrets.spans(text) if s[0] == kind]
    for token in (good, bare):
        for before in ("", "é ", "see: ...", '"', "a\\n"):
            for behind in ("", " ", ". Next", "...", ".", ".\n", '."', "\\n"):
                assert of("signed_token", before + token + behind) == [token], (before, behind)
    assert not of("signed_token", f"{good}.c2ln") and not of("signed_token", f"a.{good}")

    b64, digits = base64.b64encode(RSA).decode(), RSA.hex()
    for end in ("\n", "\r\n", "\\n", "\\r\\n", "\\\\n"):
        lines = end.join(b64[i : i + 64] for i in range(0, len(b64), 64))
        pem = f"-----BEGIN RSA PRIVATE KEY-----{end}{lines}{end}-----END RSA PRIVATE KEY-----"
        for text in (pem, pem.replace("/", "\\/")):
            assert ("pem_key", 7, 7 + len(text), "rsa") in secrets.spans(f'{{"k": "{text}"}}')
        assert not of("pem_key", pem.replace(b64[:8], b64[:7], 1))
    for prefix in ("0x", "0X", "x = 0x", "\\n", "\\n0x", ""):
        assert of("der_key", prefix + digits + ";") == [digits] == of("der_key", (prefix + digits))
        assert of("der_key", prefix.replace("0x", "") + "\\n" + b64) == [b64]
    assert not of("der_key", "a0x" + digits) and not of("der_key", "0x" + digits + "f")


def test_secret_rows(frame):
    rows = frame((1, None), (2, ""), (3, "ü token = abcdef1"), (3, "ü token = abcdef1"), (4, "AKIA" + "B" * 16 + " " + "ab" * 12))
    got = sorted(map(tuple, secrets.digests(secrets.scan(rows)).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[0] == (1, 0, 0, 0, sha(""), "") and got[1][1:] == got[0][1:]
    assert got[2] == got[3] == (3, 1, 0, 0, sha("assign:2:17"), "assign:2:17")
    assert got[4] == (4, 0, 1, 1, sha("access:0:20,hex:21:45"), "access:0:20,hex:21:45")
    assert secrets.scan(rows.limit(0)).count() == 0


# Licenses


def test_alignment_equals_the_full_table():
    """The band loses nothing against an alignment over every cell."""
    index, rng = licenses.Index(), random.Random(2)
    for name, template in index.templates.items():
        copy = list(template)
        for _ in range(len(copy) // 12):
            copy[rng.randrange(len(copy))] = "other"
        text = ["word"] * rng.randint(0, 30) + copy + ["word"] * 20
        for low, high, _ in licenses.clusters(index.anchors(text)[name], len(template)):
            banded = licenses.align(text, template, low - licenses.band(len(template)), high + licenses.band(len(template)))
            assert banded == licenses.align(text, template, -len(template), len(text))


def test_every_long_shared_run_is_anchored():
    index = licenses.Index()
    need = licenses.GROUP + licenses.WINDOW - 1
    for name, template in index.templates.items():
        for at in range(len(template) - need + 1):
            assert name in index.anchors(["x", *template[at : at + need], "y"])


def unbanded(text, index):
    """(template, first word, end, matched words) of every template against every cell."""
    words = licenses.tokens(text)
    best = {n: licenses.align(words, t, -len(t), len(words), index.need[n]) for n, t in index.templates.items()}
    kept = licenses.closest({name: {got} for name, got in best.items() if got}, index)
    return {(name, first, last, matched) for name, matched, first, last in kept}


def in_words(text, index):
    """The matches of a text, places counted in words."""
    count = lambda end: len(licenses.tokens(text[:end]))
    return {(name, count(start), count(end), matched) for name, start, end, matched, _ in licenses.matches(text, index)}


def test_edited_short_lines_are_found():
    """All one-word edits of the short lines, and words strewn between, against every cell of every template."""
    index, rng = licenses.Index(), random.Random(5)
    short = {name: words for name, words in index.templates.items() if len(words) <= licenses.SHORT}
    assert {"mit-line", "apache-line", "gpl-line", "cc-by-nc", "all-rights"} <= set(short)
    texts = ["Released under MIT License", "Released under an MIT License", "All of these rights are reserved", "Licensed under Apache 2.0"]
    for words in short.values():
        for at in range(len(words) + 1):
            texts += [" ".join(["so", *words[:at], *put, *words[at + cut :], "ends"]) for cut in (0, 1) for put in ([], ["other"])]
        texts.append(" x ".join(words))
        for _ in range(60):
            some = [w for w in words if rng.random() < 0.85]
            texts.append(" ".join(v for w in some for v in (w, *["x"] * rng.choice((0, 0, 0, 1, 2)))))
    for text in texts:
        assert unbanded(text, index) == in_words(text, index), text
    assert {m[0] for m in licenses.matches(texts[0], index)} == {m[0] for m in licenses.matches(texts[1], index)} == {"mit-line"}


def test_no_choice_of_differing_words_hides_a_template():
    rng = random.Random(6)
    for name, words in licenses.Index().templates.items():
        index = licenses.Index({name: licenses.TEMPLATES[name]})
        spare = len(words) - index.need[name]
        picks = [rng.sample(range(len(words)), spare) for _ in range(40)]
        picks += [[p for p in range(start, len(words), 4)][:spare] for start in range(4)]
        for pick in picks:
            text = ["other" if i in pick else w for i, w in enumerate(words)]
            text = [v for w in text for v in (w, *["x"] * rng.choice((0, 0, 0, 1)))]
            text[len(text) // 2 : 0] = ["x"] * rng.choice((0, 20))
            if licenses.align(text, words, -len(words), len(text), index.need[name]):
                assert name in {m[0] for m in licenses.matches(" ".join(text), index)}


def test_short_lines_beside_each_other():
    text = "All rights reserved. All rights reserved. Released under MIT License, all rights are reserved."
    found = licenses.matches(text, licenses.Index())
    assert [(m[0], text[m[1] : m[2]]) for m in found] == [
        ("all-rights", "All rights reserved"), ("all-rights", "All rights reserved"),
        ("mit-line", "Released under MIT License"), ("all-rights", "all rights are reserved"),
    ]


def test_places_hold_where_lowering_lengthens_the_text():
    index, line = licenses.Index(), "All rights reserved"
    for before in ("", "İstanbul. ", "İİİ İ İzmir, ", "ΑΣ İ ẞ "):
        for behind in ("", ".", " İstanbul"):
            text = before + line + behind
            assert licenses.matches(text, index) == [("all-rights", len(before), len(before) + len(line), 3, 3)]
            assert len(licenses.tokens(text)) == len(list(licenses._WORD.finditer(text)))


def test_variants_have_their_own_names():
    index, names = licenses.Index(), lambda text: [m[0] for m in licenses.matches(text, licenses.Index())]
    assert {name for group in licenses.VARIANTS for name in group} <= set(index.templates)
    for name in licenses._VARIANT:
        assert names(f"x {licenses.TEMPLATES[name]} y") == [name]
    assert names("Licensed under CC BY-SA 3.0.") == ["cc-by-sa"]
    assert names(licenses.TEMPLATES["gpl"].replace("version 3", "version 2")) == ["gpl"]
    assert names("This work is licensed under a Creative Commons Attribution 3.0 Unported License.") == ["cc-by-name"]
    assert names(licenses.TEMPLATES["agpl"] + " " + licenses.TEMPLATES["gpl"]) == ["agpl", "gpl"]
    for name in ("unlicense", "cc0", "bsd-binary", "bsd-3-clause"):
        assert name in names(licenses.TEMPLATES[name])


def best_first(words, template, need):
    """The best alignment of all cells, then the best before and behind it, and so on."""
    got = licenses.align(words, template, -len(template), len(words), need) if words else None
    if not got:
        return set()
    behind = {(m, f + got[2], e + got[2]) for m, f, e in best_first(words[got[2] :], template, need)}
    return {got} | best_first(words[: got[1]], template, need) | behind


def test_copies_in_a_row_equal_best_first():
    index, rng = licenses.Index(), random.Random(8)
    for name in ("mit-line", "all-rights", "cc-by-nc", "apache-line", "gpl-line"):
        template, need = index.templates[name], index.need[name]
        for _ in range(40):
            text = []
            for _ in range(rng.randint(1, 8)):
                text += [w if rng.random() < 0.9 else "other" for w in template if rng.random() < 0.95]
                text += ["x"] * rng.choice((0, 0, 1, 3))
            assert set(licenses.aligned(text, template, need, list(range(len(text))))) == best_first(text, template, need)


def test_a_notice_thousands_of_times_takes_linear_time():
    index, line = licenses.Index({"all-rights": licenses.TEMPLATES["all-rights"]}), "All rights reserved. "
    seconds = []
    for times in (700, 7_000):
        start = time.process_time()
        found = licenses.traced(line * times, index)
        seconds.append(time.process_time() - start)
        assert len(found) == times and {m[5] for m in found} == {"index"}
    assert seconds[1] < 30 * seconds[0]


def test_short_lines_come_through_the_index():
    index = licenses.Index()
    for name, words in index.templates.items():
        assert {m[5] for m in licenses.traced(f"x {licenses.TEMPLATES[name]} y", index) if m[0] == name} == {"index"}
    strewn = licenses.traced("all x rights x reserved", index)
    assert [(m[0], m[5]) for m in strewn] == [("all-rights", "words")]


def test_license_rows(frame):
    line = licenses.TEMPLATES["apache-line"]
    rows = frame((1, f"É {line} End."), (2, None), (3, ""), (4, "Licensed under the moon"), (1, f"{line}\n{line}"))
    got = sorted(tuple(r)[:6] for r in licenses.scan(rows).collect() if r.template == "apache-line")
    size = len(line) - 1
    assert [g[2:4] for g in got] == [(0, size), (2, 2 + size), (len(line) + 1, len(line) + 1 + size)]
    whole = licenses.TEMPLATES["mit"]
    found = licenses.matches("intro " + whole.replace("merge, publish,", "") + " outro", index=licenses.Index())
    assert [(m[0], m[3] >= m[4] - 2) for m in found] == [("mit", True)]
    assert licenses.scan(rows.limit(0)).count() == 0


# Fingerprints


def test_fingerprints_are_sums():
    h = fingerprint.Hasher()
    whole = h.of_text("a b c\nd e\n\na b c")
    assert whole == h.of(["d e", "a b c", "a b c"]) != h.of(["d e", "a b c"])
    assert h.delete(h.insert(whole, "new one"), "new one") == whole
    assert h.insert(h.of(["d e", "a b c"]), "a b c") == whole
    assert h.of_text(None) == h.of_text("") == h.of_text("\n\n") == bytes(len(whole))
    assert fingerprint.likeness(whole, whole) == 1.0 and fingerprint.likeness(h.of_text(""), whole) == 0.0
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words), " ".join(words[:200] + [f"v{i}" for i in range(200)])
    assert abs(fingerprint.likeness(h.of_text(a), h.of_text(b)) - 1 / 3) < 0.12
    assert fingerprint.likeness(h.of_text(a), h.of_text(" ".join(rng.sample(words, 400)))) < 0.2


@pytest.mark.parametrize("size", [0, 1, 2, 40])
def test_edits_equal_brute_force(frame, corpus, size):
    rows = corpus[:size]
    h = fingerprint.Hasher()
    got = {r.doc_id: r for r in fingerprint.compare_edits(frame(*rows) if rows else frame().limit(0)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    for at, (i, text) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        changed = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert bytes(r.fingerprint) == h.of_text(text) and bytes(r.edited_fingerprint) == h.of_text(changed)
        assert r.near_next == fingerprint.likeness(h.of_text(text), h.of_text(after))


def test_edits_with_ties_and_missing_ids(frame):
    rows = frame((1, "b"), (1, "a"), (None, "last"), (2, "first"))
    got = {(r.doc_id, r.n_chars): r for r in fingerprint.compare_edits(rows).collect()}
    assert got[None, 4].edited_sha256 == hashlib.sha256(b"lasf").hexdigest()
    assert len(fingerprint.compare_edits(rows.union(rows)).collect()) == 8


# Quality


def test_votes_equal_brute_force():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.3, (60, quality.WIDTH)).astype(np.float32)
    labels = (np.arange(60) % 3 > 0).astype(float)
    model = quality.fit_space(counts, labels)
    fresh = rng.poisson(0.3, (9, quality.WIDTH)).astype(np.float32)
    for row, score in zip(fresh, model.scores(fresh), strict=True):
        v = row * model.idf
        v = (v / np.linalg.norm(v)) @ model.axes
        cos = model.vectors @ (v / np.linalg.norm(v))
        near = sorted(range(60), key=lambda i: -cos[i])[: quality.NEIGHBOURS]
        w = np.maximum(cos[near], 0) ** 4
        assert abs(score - (w * labels[near]).sum() / w.sum()) < 1e-4
    assert model.scores(np.zeros((1, quality.WIDTH), np.float32))[0] == labels.mean()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id")
    rows = scored.filter(quality.held_out(F.col("doc_id"))).collect()
    right = [(r.score >= quality.THRESHOLD) == (r.quality == 1) for r in rows]
    assert len(rows) > 50 and sum(right) / len(right) > 0.95


def test_quality_edges(frame, spark):
    docs = frame((1, None), (2, ""), (3, "good text here"), (4, "GOOD!!"), (3, "good text here"), (None, "x y z"))
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (None, 1), (9, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0), labels.filter("doc_id = 3")):
        model = quality.fit(docs, known)
        rows = quality.score(docs, model).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
        assert {r.score for r in rows if r.doc_id in (1, 2)} == {model.prior}
    out = quality.keep_good(docs, model)
    assert out.columns == docs.columns
    assert quality.keep_good(docs.limit(0), model).count() == 0


def test_fitting_holds_one_array_of_counts():
    """The driver's memory: beyond the counts no second array of their size."""
    rng = np.random.default_rng(4)
    counts = rng.poisson(0.3, (1500, quality.WIDTH)).astype(np.float32)
    whole = quality.fit_space(counts.copy(), np.arange(1500) % 2.0)
    rows = counts * whole.idf
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    places = rows @ whole.axes
    assert np.allclose(whole.vectors, places / np.linalg.norm(places, axis=1, keepdims=True), atol=1e-5)
    del rows
    tracemalloc.start()
    quality.fit_space(counts, np.arange(1500) % 2.0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 0.8 * counts.nbytes
