"""Secret scan with structural confirmation.

Three base patterns find assignments, access keys and hex strings. Beyond them,
base64 and hex runs are decoded and reported only if their structure holds: a DER
private key whose nested lengths all add up, an OpenSSH key whose length-prefixed
fields fill it exactly, or a signed token whose header and claims are JSON. Line ends
may be written out (backslash and n, r or t), as in JSON and env files, and hex may
follow 0x; a span of the latter covers the digits. A token has exactly three parts: a
stop before or behind it is a sentence's unless another part is on its other side.

Defined cases: a null text is empty; an empty text has no spans; repeated documents
each get their own row. Spans are code points, end exclusive, over the whole text.
"""

import base64
import binascii
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, prepare, text_udf

#: Kinds in the order in which spans of one start are listed; the first three are base.
KINDS = ("assign", "access", "hex", "pem_key", "der_key", "ssh_key", "signed_token")
BASE = KINDS[:3]
_FOUND = "spans array<struct<kind:string,start:int,end:int,detail:string>>"

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_LONG = 24
#: A written-out line end or tab, whose letter does not belong to the run behind it.
_ESCAPED = rb"(?:(?<=\\)[nrt])?"
_PEM = re.compile(
    rb"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----((?:[A-Za-z0-9+/=\s]++|\\++[nrt/])++)-----END \1PRIVATE KEY-----"
)
_PEM_BLANK = re.compile(rb"\s+|\\+[nrt]?")
_BASE64 = re.compile(_ESCAPED + rb"([A-Za-z0-9+/_-]{40,}={0,2})")
_HEX_KEY = re.compile(rb"(?<![0-9A-Za-z])" + _ESCAPED + rb"(?:0[xX])?((?:[0-9A-Fa-f]{2}){32,})(?![0-9A-Za-z])")
_TOKEN = re.compile(
    rb"(?<![A-Za-z0-9_-])(?<![A-Za-z0-9_-]\.)" + _ESCAPED
    + rb"([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?!\.?[A-Za-z0-9_-])"
)

_INTEGER, _BITS, _OCTETS, _OID, _SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def decode64(raw: bytes) -> bytes | None:
    """Standard or URL-safe base64, padded or not; null unless it is well formed."""
    raw = raw.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    try:
        return base64.b64decode(raw + b"=" * (-len(raw) % 4), validate=True)
    except binascii.Error:
        return None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """The DER elements that fill ``data`` exactly, or null."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length >= 0x80:
            width = length & 0x7F
            if not 0 < width <= 4 or at + width > len(data) or data[at] == 0:
                return None
            length, at = int.from_bytes(data[at : at + width], "big"), at + width
            if length < 0x80:
                return None
        if at + length > len(data):
            return None
        out.append((tag, data[at : at + length]))
        at += length
    return out


def der_private_key(data: bytes) -> str | None:
    """Which private key encoding the bytes are, if any."""
    outer = elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != _SEQUENCE:
        return None
    parts = elements(outer[0][1])
    if not parts:
        return None
    tags = [t for t, _ in parts]
    if tags[:9] == [_INTEGER] * 9 and parts[0][1] in (b"\0", b"\1") and len(parts[1][1]) >= 32:
        return "rsa"
    if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS] and parts[0][1] in (b"\0", b"\1"):
        algorithm = elements(parts[1][1])
        if algorithm and algorithm[0][0] == _OID:
            return "pkcs8"
    if tags[:2] == [_INTEGER, _OCTETS] and parts[0][1] == b"\1" and 16 <= len(parts[1][1]) <= 72:
        return "ec"
    return None


def ssh_private_key(data: bytes) -> str | None:
    """``openssh`` if the length-prefixed fields fill the bytes exactly."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    for _ in range(keys + 1):  # the public keys, then the private section
        if field() is None:
            return None
    return "openssh" if at == len(data) and keys else None


def signed_token(header: bytes, claims: bytes, signature: bytes) -> str | None:
    """The algorithm a token's header names, if header, claims and signature agree."""
    try:
        head, body = (json.loads(decode64(x) or b"") for x in (header, claims))
    except (ValueError, RecursionError):
        return None
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str):
        return None
    signed = bool(signature) and decode64(signature) is not None
    return head["alg"] if signed or (head["alg"].lower() == "none" and not signature) else None


def _base(raw: bytes, widest: int) -> Iterator[tuple[str, int, int, str]]:
    low = raw.lower()
    if any(hint in low for hint in _ASSIGN_HINTS):
        for m in _ASSIGN.finditer(low):
            if m.end(2) - m.start(2) >= 6:
                yield "assign", m.start(), m.end(), m[1].decode()
    if b"AKIA" in raw:
        for m in _ACCESS.finditer(raw):
            yield "access", m.start(), m.end(), ""
    if widest >= _LONG:
        for m in _HEX.finditer(raw):
            yield "hex", m.start(), m.end(), ""


def _confirmed(raw: bytes, widest: int) -> Iterator[tuple[str, int, int, str]]:
    if b"PRIVATE KEY-----" in raw:
        for m in _PEM.finditer(raw):
            data = decode64(_PEM_BLANK.sub(b"", m[2]))
            what = data and (der_private_key(data) or ssh_private_key(data))
            if what:
                yield "pem_key", m.start(), m.end(), what
    if widest < 16:
        return
    if b"." in raw:
        for m in _TOKEN.finditer(raw):
            if what := signed_token(m[1], m[2], m[3]):
                yield "signed_token", m.start(1), m.end(), what
    if widest < 40:
        return
    for pattern, decode in ((_HEX_KEY, binascii.unhexlify), (_BASE64, decode64)):
        for m in pattern.finditer(raw):
            data = decode(m[1])
            if not data:
                continue
            if what := der_private_key(data):
                yield "der_key", m.start(1), m.end(), what
            elif what := ssh_private_key(data):
                yield "ssh_key", m.start(1), m.end(), what


def spans(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, detail) of one text, by start and then by kind."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    widest = max(map(len, raw.split()), default=0)
    found = sorted({*_base(raw, widest), *_confirmed(raw, widest)}, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    if not found:
        return []
    places = sorted({p for _, start, end, _ in found for p in (start, end)})
    points, before, count = {}, 0, 0
    for p in places:  # bytes to code points, reading the text once
        count += sum((c & 0xC0) != 0x80 for c in raw[before:p]) if len(raw) != len(text) else p - before
        points[p], before = count, p
    return [(kind, points[start], points[end], detail) for kind, start, end, detail in found]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind,start,end,detail>>; one row per document."""
    prepare(docs.sparkSession)
    return annotate(docs, text_udf(_FOUND, lambda: lambda text: (spans(text),)))


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the joined spans of a scan."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    joined = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
