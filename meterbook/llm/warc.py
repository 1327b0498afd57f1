"""WARC archives: segmented, chunk-framed records written and put together again.

Writing: one record per page. Of equal payloads the largest page_id is stored as a
response, the others as revisits of it. A response's HTTP block frames its payload in
chunks; a block longer than a segment goes on in continuation records. Spark's text
writer ends each record with a blank line pair, so any store it can write to will do.

Reading: archives are cut into records by their content lengths. Continuations are
grouped by their origin's record id, ordered by segment number, checked against the
total length, and the chunk framing is taken off.

Defined cases: a null html is an empty payload; a null url leaves out the target URI.
Of rows that repeat the largest page_id of a payload one is the response. A null
page_id orders below all others. A record whose segments are not 1 to n, or do not
add up to the total length, or whose framing is broken, has a null payload.
"""

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, map_rows, prepare, text_udf

SEGMENT, CHUNK = 32 << 10, 8 << 10
#: Records of a segment at most: a file stays under 64 MB.
RECORDS_PER_FILE = 2000
#: Copies of the table of repeated payloads, so that one payload spreads over tasks.
SALTS = 16
_END = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LOWEST = -(1 << 63)
RECORD = (
    "record_id string, type string, target_uri string, refers_to string, payload_digest string, "
    "payload_length long, origin_id string, segment int, total_length long, block binary"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four groups of 40 bits, eight letters each."""
    digest = F.sha1(payload)
    groups = (F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4))
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _ALPHABET)


def _pieces(data: Column, size: int) -> Column:
    """The bytes cut into pieces of ``size``; none of empty data."""
    n = F.ceil(F.octet_length(data) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(data, (i - 1) * size + 1, F.lit(size)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<binary>"))


def _framed(payload: Column) -> Column:
    chunk = lambda c: F.concat(F.hex(F.octet_length(c).cast("long")), F.lit(_END), c.cast("string"), F.lit(_END))
    return F.concat(F.array_join(F.transform(_pieces(payload, CHUNK), chunk), ""), F.lit("0\r\n\r\n"))


def _line(name: str, value: Column | str) -> Column:
    """A header line, or nothing where the value is null."""
    value = F.lit(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_END)), F.lit(""))


def decisions(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Each page with its payload, digest, row number and the record it revisits, if any."""
    rows = columns(pages, page_id="long", url="string", html="string").select(
        "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
        F.coalesce("page_id", F.lit(_LOWEST)).alias("place"), F.monotonically_increasing_id().alias("row"),
    )
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    rows = rows.withColumn("uri", F.concat(F.lit("urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), "row"))
    large = rows.filter(F.octet_length("payload") >= min_bytes)
    last = large.groupBy("digest", "place").agg(F.max("row").alias("row"), F.count("*").alias("n"))
    first = last.groupBy("digest").agg(F.max("place").alias("to_place"), F.max_by("row", "place").alias("to_row"), F.sum("n").alias("n"))
    first = first.filter("n > 1").select("digest", "to_place", "to_row", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = rows.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int")).join(first, ["digest", "salt"], "left")
    other = F.when(F.col("to_place") == _LOWEST, F.lit("none")).otherwise(F.col("to_place").cast("string"))
    other = F.when(F.col("to_row") != F.col("row"), F.concat(F.lit("urn:x-page:"), other, F.lit(":"), "to_row"))
    other = F.when(F.octet_length("payload") >= min_bytes, other)
    return met.select("page_id", "url", "uri", "digest", "payload", other.alias("revisits"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment: int = SEGMENT, date: str = "2000-01-01T00:00:00Z") -> None:
    """One response or revisit per page, in gzip-compressed archives under ``path``.

    The rows are numbered where they are read, so ``pages`` must be a stored table.
    """
    prepare(pages.sparkSession)
    rows = decisions(pages, min_bytes)
    is_visit = F.col("revisits").isNull()
    block = F.when(is_visit, F.concat(F.lit(_HTTP), _framed(F.col("payload")))).otherwise(F.lit("")).cast("binary")
    target = F.regexp_replace("url", r"[\x00-\x20]+", "%20")
    size = F.octet_length("payload")
    rows = rows.select("uri", "digest", "revisits", target.alias("url"), size.alias("size"), block.alias("block"))
    rows = rows.select("*", F.octet_length("block").alias("total"), _pieces(F.col("block"), segment).alias("pieces"))
    parts = rows.select(
        "uri", "digest", "revisits", "url", "size", "total", F.size("pieces").alias("n"),
        F.posexplode_outer("pieces").alias("at", "piece"),
    )
    at = F.coalesce(F.col("at"), F.lit(0)) + 1
    begins, many, ends = at == 1, F.col("n") > 1, at == F.col("n")
    kind = F.when(F.col("revisits").isNotNull(), "revisit").when(begins, "response").otherwise("continuation")
    uri = F.concat(F.lit("<"), "uri", F.when(begins, F.lit("")).otherwise(F.concat(F.lit(":"), at.cast("string"))), F.lit(">"))
    piece = F.coalesce(F.col("piece").cast("string"), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", uri),
        _line("WARC-Date", date),
        F.when(begins, _line("WARC-Target-URI", F.col("url"))).otherwise(""),
        F.when(begins, _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))).otherwise(""),
        F.when(begins, _line("Content-Type", "application/http;msgtype=response")).otherwise(""),
        F.when(F.col("revisits").isNotNull(), F.concat(
            _line("WARC-Profile", _PROFILE),
            _line("WARC-Refers-To", F.concat(F.lit("<"), "revisits", F.lit(">"))),
            _line("X-Payload-Length", F.col("size")),
        )).otherwise(""),
        F.when(many, _line("WARC-Segment-Number", at)).otherwise(""),
        F.when(many & ~begins, _line("WARC-Segment-Origin-ID", F.concat(F.lit("<"), "uri", F.lit(">")))).otherwise(""),
        F.when(many & ends, _line("WARC-Segment-Total-Length", F.col("total"))).otherwise(""),
        _line("Content-Length", F.octet_length(piece)),
        F.lit(_END),
        piece,
    )
    out = parts.select(record.alias("value")).write.option("lineSep", _END + _END).option("compression", "gzip")
    out.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _records(rows: Iterator[tuple]) -> Iterator[tuple]:
    for (content,) in rows:
        raw = io.BytesIO(content)
        data = gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw
        while line := data.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record begins with {line[:40]!r}")
            head: dict[str, str] = {}
            while (line := data.readline().rstrip(b"\r\n")):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head[name.strip().lower()] = value.strip()
            block = data.read(int(head["content-length"]))
            if len(block) != int(head["content-length"]):
                raise ValueError("the archive ends inside a record")
            number = lambda name: int(head[name]) if name in head else None  # noqa: E731, B023
            name = lambda name: head[name].strip("<>") if name in head else None  # noqa: E731, B023
            yield (
                name("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), name("warc-refers-to"),
                head.get("warc-payload-digest"), number("x-payload-length"), name("warc-segment-origin-id"),
                number("warc-segment-number"), number("warc-segment-total-length"), block,
            )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``, compressed or not.

    A file is read by one task, a record at a time.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return map_rows(files, _records, RECORD)


def payload_of(block: bytes | None) -> tuple[bytes | None]:
    """The payload of an HTTP response block, without its chunk framing."""
    if block is None:
        return (None,)
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return (None,)
    chunked = any(
        line.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for line in head.split(b"\r\n")
    )
    if not chunked:
        return (body,)
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return (None,)
        try:
            size = int(body[at:end].partition(b";")[0], 16)
        except ValueError:
            return (None,)
        at = end + 2
        if not size:  # trailers, if any, and the last blank line
            return (b"".join(out),) if body[at:].endswith(b"\r\n") else (None,)
        if body[at + size : at + size + 2] != b"\r\n":
            return (None,)
        out.append(body[at : at + size])
        at += size + 2


def reassemble(records: DataFrame) -> DataFrame:
    """(record_id, type, target_uri, refers_to, payload_digest, payload_length, payload).

    Only segmented records are shuffled; a group is the segments of one record.
    """
    keys = ["record_id", "type", "target_uri", "refers_to", "payload_digest", "payload_length"]
    whole = records.filter("segment IS NULL").select(*keys, "block")
    parts = records.filter("segment IS NOT NULL")
    part = F.struct("segment", "total_length", "block", F.struct(*keys).alias("head"))
    found = parts.groupBy(F.coalesce("origin_id", "record_id").alias("origin")).agg(
        F.array_sort(F.collect_list(part), lambda a, b: a["segment"] - b["segment"]).alias("parts")
    )
    n = F.size("parts")
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    numbered = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), n)
    total = F.element_at("parts", -1)["total_length"]
    complete = numbered & (total == F.octet_length(block))
    joined = found.select(F.col("parts")[0]["head"].alias("head"), F.when(complete, block).alias("block")).select("head.*", "block")
    every = whole.unionByName(joined)
    body = text_udf("payload binary", lambda: payload_of)
    is_response = F.col("type") == "response"
    out = every.select(*keys, body(F.when(is_response, F.col("block"))).alias("found"))
    return out.select(*keys, "found.payload")
