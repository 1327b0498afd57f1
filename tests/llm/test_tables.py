import base64
import hashlib
import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from meterbook.llm import rollup, surrogates, warc
from meterbook.llm.common import staged

# WARC

PAGES = "page_id long, url string, html string, digest string, salt int, row string"


def pages(spark, rows):
    return staged(spark.createDataFrame([(*r, "d", 1, "x") for r in rows], PAGES), "test-pages")


@pytest.mark.parametrize("segment", [64, 32 << 10])
def test_archives_round_trip(spark, tmp_path, segment):
    rng = random.Random(1)
    long = "".join(rng.choice("abé🎉\r\n") for _ in range(9000))
    rows = [(1, "http://a/ b", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", long), (6, "u", long),
            (7, "u", "WARC/1.1\r\n\r\n0\r\n\r\n"), (7, "u", "other"), (6, "u", long), (None, "u", "x")]
    path = str(tmp_path / "w")
    warc.write_archives(pages(spark, rows), path, segment=segment)
    found = warc.reassemble(warc.read_records(spark, path)).collect()
    by_kind = sorted((r.type, bytes(r.payload).decode() if r.payload is not None else None) for r in found if r.type == "response")
    assert by_kind == sorted(("response", t) for t in {(r[2] or "") for r in rows})
    assert len(found) == len(rows)
    for r in found:
        if r.payload is not None:
            assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
    stored = {r.record_id: r for r in found if r.type == "response"}
    for r in found:
        if r.type == "revisit":
            first = stored[r.refers_to]
            assert r.payload_digest == first.payload_digest and r.payload_length == len(first.payload)
    ids = {r.record_id.split(":")[2]: r.type for r in found}
    assert ids["2"] == "response" and ids["1"] == ids["none"] == ids["3"] == "revisit"
    again = warc.reassemble(warc.read_records(spark, path).filter("segment IS NULL OR segment <> 2")).collect()
    lost = [r for r in again if r.type == "response" and r.payload is None]
    assert bool(lost) == (segment == 64)


def test_small_payloads_are_never_revisits(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(pages(spark, [(1, "u", "ab"), (2, "u", "ab")]), path, min_bytes=3)
    assert {r.type for r in warc.read_records(spark, path).collect()} == {"response"}
    empty = str(tmp_path / "none")
    warc.write_archives(pages(spark, [(1, "u", "x")]).limit(0), empty)
    assert warc.reassemble(warc.read_records(spark, empty)).count() == 0


@pytest.mark.parametrize(
    "block, want",
    [(None, None), (b"no head", None), (b"H\r\n\r\nraw", b"raw"),
     (b"H\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nab\r\n0\r\n\r\n", b"ab"),
     (b"H\r\nTransfer-Encoding: chunked\r\n\r\n2;x=1\r\nab\r\n0\r\nT: 1\r\n\r\n", b"ab"),
     (b"H\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nab\r\n0\r\n\r\n", None),
     (b"H\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nab\r\n", None)],
)
def test_chunk_framing(block, want):
    assert warc.payload_of(block) == (want,)


# Rollups

CHANGES = "change string, source string, lang string, tokenizer string, tokens long, old_tokens long, extra int"


def test_rollups(spark, tmp_path):
    store = rollup.RollupStore(spark, str(tmp_path / "r"))
    batch = lambda *rows: spark.createDataFrame([(*r, 1) for r in rows], CHANGES)
    total = lambda: {tuple(r) for r in store.totals().collect()}
    assert total() == set()
    first = batch(("insert", "a", "en", "1", 5, None), ("insert", "a", "en", "1", 5, None), ("insert", None, "de", "1", None, None))
    assert store.commit("b1", first) and not store.commit("b1", first)
    assert total() == {("a", "en", "1", 2, 10), (None, "de", "1", 1, 0)}
    store.commit("b2", batch(("revise", "a", "en", "1", 9, 5), ("delete", None, "de", "1", None, None)))
    assert total() == {("a", "en", "1", 2, 14)}
    store.commit("b3", batch().limit(0))
    assert total() == {("a", "en", "1", 2, 14)}
    with pytest.raises(Exception, match="unknown change"):
        store.commit("b4", batch(("upsert", "a", "en", "1", 9, 5)))
    assert total() == {("a", "en", "1", 2, 14)}
    assert store.commit("b4", batch(("delete", "a", "en", "1", 9, None)))
    assert total() == {("a", "en", "1", 1, 5)}
    with pytest.raises(ValueError):
        store.commit("../x", first)


def test_changes_lead_from_one_state_to_the_next(spark, tmp_path):
    schema = "doc_id long, source string, lang string, tokenizer string, tokens long"
    a = spark.createDataFrame([(1, "s", "en", "1", 3), (2, "s", "en", "1", 4), (3, "s", None, "1", 5)], schema)
    b = spark.createDataFrame([(1, "t", "en", "1", 3), (2, "s", "en", "1", 9), (3, "s", None, "1", 5), (4, "s", "en", "2", 1)], schema)
    store = rollup.RollupStore(spark, str(tmp_path / "r"))
    store.commit("1", rollup.changes_between(a.limit(0), a))
    store.commit("2", rollup.changes_between(a, b))
    want = b.groupBy("source", "lang", "tokenizer").agg(F.count("*"), F.sum("tokens"))
    assert {tuple(r) for r in store.totals().collect()} == {tuple(r) for r in want.collect()}


# Surrogates

TEXTS = [
    (1, "Mail jo.Doe+1@mail5.example.com or JO@x.org. Call +1 (499) 555-6503, 212-555-0199."),
    (2, "Card 4539 1488 0343 6467 and 4539148803436468; 10.0.0.1 and 152.143.123.131; SSN 078-05-1120."),
    (3, "Mr. John Smith met Mrs Smith, Frau Müller and Г-н Иванов; DE89 3704 0044 0532 0130 00."),
    (4, "Again jo.Doe+1@mail5.example.com for Mr. John Smith."),
    (5, None), (6, ""), (7, "Nothing here, 12.5% of 3,000 in 2024."), (4, "Again jo.Doe+1@mail5.example.com for Mr. John Smith."),
]


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_surrogates(frame):
    docs = frame(*TEXTS)
    out = surrogates.replace_personal(docs)
    assert out.columns == docs.columns
    ents = lambda df: {(r.doc_id, r.text): r.e for r in df.withColumn("e", surrogates.entities_of(F.col("text"))).collect()}
    before, after = ents(docs), ents(out)
    assert sorted(len(e or []) for e in before.values()) == sorted(len(e or []) for e in after.values())
    by_doc = lambda m: {k[0]: (k[1], v) for k, v in m.items()}
    a, b = by_doc(before), by_doc(after)
    pairs = {x: y for i in a for x, y in zip(a[i][1] or [], b[i][1] or [], strict=True)}
    assert len(pairs) == 14 and len(set(pairs.values())) == len(pairs) and not set(pairs) & set(pairs.values())
    for x, y in pairs.items():
        if x[0].isdigit() and x.count(".") != 3:
            assert [c.isdigit() for c in x] == [c.isdigit() for c in y] and luhn(x) == luhn(y) or "-" in x
    assert pairs["jo.Doe+1@mail5.example.com"].endswith(".com") and b[4][1][0] == b[1][1][0]
    john, smith, mueller, ivanov = (pairs[k].split(" ") for k in ("Mr. John Smith", "Mrs Smith", "Frau Müller", "Г-н Иванов"))
    assert john[0] == "Mr." and john[2] == smith[1] and mueller[0] == "Frau" and mueller[1].isascii()
    assert john[1] in surrogates._GIVEN["latin", "male"] and len(smith) == len(mueller) == len(ivanov) == 2
    assert not ivanov[1].isascii() and ivanov[0] == "Г-н"
    assert b[7] == a[7] and b[5][0] is None and b[6][0] == ""
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
    rebuilt = a[2][0]
    for x in a[2][1]:
        rebuilt = rebuilt.replace(x, pairs[x])
    assert rebuilt == b[2][0]
    other = surrogates.replace_personal(docs, key="another")
    assert by_doc(ents(other))[1][1] != b[1][1]
    assert surrogates.replace_personal(docs.limit(0)).count() == 0


NATIONAL = {
    "a 030 1234567 b": "030 1234567", "a (030) 1234567.": "(030) 1234567", "06 12 34 56 78,": "06 12 34 56 78", "0171/1234567": "0171/1234567",
    "call 5551234567 now": "5551234567", "at 2001:db8::8a2e:370:7334.": "2001:db8::8a2e:370:7334", "fe80::1": "fe80::1",
    "2001:0DB8:0:0:0:8a2e:370:7334 x": "2001:0DB8:0:0:0:8a2e:370:7334", "so Dr. Anna Weiss said": "Dr. Anna Weiss",
    "Prof. Dr. Müller": "Prof. Dr. Müller", "Frau Dr. Schmidt": "Frau Dr. Schmidt",
}


def test_national_phones_titles_and_ipv6(frame):
    none = ["on 01.02.2024 at 12:30:45", "01/02/2024", "01 02 2024", "std::vector a::b", "1733000000", "00:1a:2b:3c:4d:5e", "0.0301234567", "x = 3::"]
    docs = frame(*enumerate([*NATIONAL, *none]))
    found = {r.text: r.e for r in docs.select("text", surrogates.entities_of(F.col("text")).alias("e")).collect()}
    assert {t: found[t] for t in NATIONAL} == {t: [e] for t, e in NATIONAL.items()}
    assert not any(found[t] for t in none)
    out = {r.doc_id: r.text for r in surrogates.replace_personal(docs).collect()}
    for i, (text, entity) in enumerate(NATIONAL.items()):
        before, behind = text.split(entity)
        new = out[i].removeprefix(before).removesuffix(behind)
        assert new != entity and out[i] == before + new + behind
        if ":" in entity:
            assert ipaddress.ip_address(new).version == 6
        elif entity[0] in "(0":
            assert [c if not c.isdigit() else "0" for c in new] == [c if not c.isdigit() else "0" for c in entity]
    assert out[8].startswith("so Dr. ") and out[9].startswith("Prof. Dr. ") and out[10].startswith("Frau Dr. ")
    assert [out[len(NATIONAL) + i] for i in range(len(none))] == none


def test_surrogates_stay_distinct_when_draws_collide(spark):
    """More entities of a short format than chance keeps apart."""
    rows = [("name", f"Mr Aa{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}") for i in range(4000)]
    table = surrogates.surrogate_table(staged(spark.createDataFrame(rows, "kind string, entity string"), "test"), "k").collect()
    assert len({r.entity for r in table}) == len({r.surrogate for r in table}) == 4000


def mod_97(iban):
    iban = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def table_of(spark, rows, key="k"):
    distinct = staged(spark.createDataFrame(sorted(set(rows)), "kind string, entity string"), "test")
    return {r.entity: r.surrogate for r in surrogates.surrogate_table(distinct, key).collect()}


def test_one_core_has_one_surrogate_in_every_format(spark):
    same = [
        [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "DE89370400440532013000")],
        [("phone", "+49 30 1234567"), ("phone", "+49-30-1234567"), ("phone", "+49 (30) 1234567")],
        [("card", "4111 1111 1111 1111"), ("card", "4111-1111-1111-1111"), ("card", "4111111111111111")],
        [("email", "Ann@X.com"), ("email", "ann@x.com"), ("email", "ANN@x.com")],
        [("phone_local", "555-123-4567"), ("phone_local", "(555) 123-4567"), ("phone_bare", "5551234567")],
    ]
    got = table_of(spark, [r for rows in same for r in rows])
    bare = lambda t: "".join(c for c in t.lower() if c.isalnum() or c in "+@")
    for rows in same:
        assert len({bare(got[e]) for _, e in rows}) == 1
        for _, e in rows:
            assert bare(got[e]) != bare(e) and len(got[e]) == len(e)
            assert [c.isalnum() for c in got[e]] == [c.isalnum() for c in e]
            assert [c.isupper() for c in got[e]] == [c.isupper() for c in e]
    iban = got["DE89 3704 0044 0532 0130 00"]
    assert iban.startswith("DE") and mod_97(iban) == 1 and luhn(got["4111111111111111"])
    assert got["+49 30 1234567"].startswith("+49 ")


def test_names_keep_coreference_when_given_names_run_out(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6)).capitalize()
    given, family = [word() for _ in range(60)] + ["Adam", "Alma"], [word() for _ in range(12)] + ["Smith", "ΣΟΦΟΥ", "Иванов"]
    names = [f"{t} {g} {f}" for t in ("Mr", "Mrs.", "Dr") for g in given for f in family if rng.random() < 0.3]
    names += [f"{t} {f}" for t in ("Mr", "Frau", "Prof. Dr.") for f in family] + ["Mr JOHN SMITH", "Mr John Smith"]
    got = table_of(spark, [("name", n) for n in names])
    assert len(got) == len(set(names)) == len(set(got.values())) and not set(got) & set(got.values())
    families, givens, men, women = {}, {}, set(), set()
    for entity, new in got.items():
        title = re.match(r"(?:Prof\. Dr\.|Mrs\.|Mr|Frau|Dr)(?= )", entity)[0]
        assert new.startswith(title + " ")
        old, now = entity[len(title) + 1 :].split(" "), new[len(title) + 1 :].split(" ")
        assert len(old) == len(now) and [w.isupper() for w in old] == [w.isupper() for w in now]
        families.setdefault(old[-1].lower(), set()).add(now[-1].lower())
        if len(old) > 1:
            givens.setdefault((old[0].lower(), title in ("Mr",), title in ("Mrs.",)), set()).add(now[0].lower())
            (men if title == "Mr" else women if title == "Mrs." else set()).add(now[0].lower())
    assert all(len(v) == 1 for v in families.values()) and all(len(v) == 1 for v in givens.values())
    assert len(set.union(*families.values())) == len(families)
    assert len(set.union(*families.values()) & {f.lower() for f in family}) == 0 and not men & women
    starts = lambda names, g: all(n.startswith(tuple(x.lower() for x in surrogates._GIVEN["latin", g])) for n in names)
    assert starts(men, "male") and starts(women, "female")


def test_short_formats_never_run_out(spark):
    rows = [("email", f"{a}@{b}.co") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrst"]
    rows += [("ipv6", f"{a}{b}8::") for a in "abcdef" for b in "abcdef"] + [("national", f"00{i}-0{j}-000{k}") for i in range(3) for j in range(3) for k in range(3)]
    got = table_of(spark, rows)
    assert len(got) == len(rows) == len(set(got.values())) and not set(got) & set(got.values())
    assert all(new.endswith(".co") and "@" in new for old, new in got.items() if "@" in old)
    assert all(ipaddress.ip_address(new).version == 6 for old, new in got.items() if ":" in old)
