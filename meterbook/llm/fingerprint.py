"""Homomorphic multiset hash of documents over their paragraphs.

A paragraph (a non-empty line) hashes to a wide vector: 32 lanes of 64 bits from an
extendable-output hash, and 512 lanes of 32 bits in which each word pair of the
paragraph adds or subtracts one. A fingerprint is the lane-wise sum over all
paragraphs, modulo the lanes' powers of two. So the order of paragraphs does not
matter, and a paragraph is inserted or deleted by adding or subtracting its vector.
The first section decides equality; inner products of the second estimate how much
two documents have in common.

Defined cases: a null text is empty; a text without paragraphs has the zero
fingerprint, alike to itself (1) and to nothing else (0). Documents are ordered by
descending doc_id, null ids last, equal ids by ascending text; the document after the
last is the first, which for a single document is itself.
"""

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, columns, map_rows, prepare, text_udf

WIDE, NEAR = 32, 512
_WORDS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOWEST = -(1 << 63)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Hasher:
    """Fingerprints as bytes: the wide lanes, then the near ones, little-endian."""

    def __init__(self) -> None:
        self.words = _WordHashes()

    def of(self, paragraphs: Iterable[str]) -> bytes:
        wide = np.zeros(WIDE, "<u8")
        hashes: list[int] = []
        starts = []
        for text in paragraphs:
            raw = text.encode("utf-8", "surrogatepass")
            if not raw:
                continue
            wide += np.frombuffer(hashlib.shake_128(raw).digest(WIDE * 8), "<u8")
            starts.append(len(hashes))
            hashes.append(0)  # stands before the first word
            hashes.extend(map(self.words.__getitem__, raw.split()))
        near = np.zeros(NEAR, "<i8")
        if len(hashes) > len(starts):
            h = np.array(hashes, np.uint64)
            with np.errstate(over="ignore"):
                pairs = (h[:-1] * _MIX) ^ (h[1:] + _MIX)
                pairs = (pairs ^ (pairs >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            inside = np.ones(len(pairs), bool)
            inside[np.array(starts[1:], int) - 1] = False
            pairs = pairs[inside]
            lane = (pairs >> np.uint64(32)).astype(np.int64) & (NEAR - 1)
            sign = np.where(pairs >> np.uint64(63), -1.0, 1.0)
            near = np.bincount(lane, weights=sign, minlength=NEAR).astype("<i8")
        return wide.tobytes() + near.astype("<u4").tobytes()

    def of_text(self, text: str | None) -> bytes:
        return self.of((text or "").split("\n"))

    def insert(self, fingerprint: bytes, paragraph: str) -> bytes:
        return combine(fingerprint, self.of([paragraph]))

    def delete(self, fingerprint: bytes, paragraph: str) -> bytes:
        return combine(fingerprint, self.of([paragraph]), -1)


def _lanes(fingerprint: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(fingerprint, "<u8", WIDE), np.frombuffer(fingerprint, "<u4", NEAR, WIDE * 8)


def combine(a: bytes, b: bytes, sign: int = 1) -> bytes:
    """Fingerprint of the union (or difference) of two multisets of paragraphs."""
    return b"".join((x + y if sign > 0 else x - y).tobytes() for x, y in zip(_lanes(a), _lanes(b), strict=True))


def likeness(a: bytes, b: bytes) -> float:
    """Shared share of word pairs, estimated from the near lanes: 1 if equal."""
    if a == b:
        return 1.0
    x, y = (_lanes(f)[1].astype("<i4").astype(np.float64) for f in (a, b))
    both = float(x @ y)
    either = float(x @ x) + float(y @ y) - both
    return min(1.0, max(0.0, both / either)) if either > 0 else 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint binary; one row per document, nothing shuffled."""
    prepare(docs.sparkSession)
    return annotate(docs, text_udf("fingerprint binary", lambda: lambda text, h=Hasher(): (h.of_text(text),)))


def edited(text: str, after: str) -> str:
    """The text with its last third replaced by the start of the next one."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def _bin_udf(cuts: list[int]):
    """Which descending range of ids a row is in."""
    bounds = np.array(sorted(cuts), np.int64)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            at = np.searchsorted(bounds, ids.to_numpy(zero_copy_only=False), side="right")
            yield pa.array(len(bounds) - at, pa.int32())

    return F.arrow_udf(run, T.IntegerType())


def _compare(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of ranges in order, each followed by the first rows of the next range."""
    hasher = Hasher()
    held: tuple | None = None  # range, id, text, fingerprint: waits for the next text
    done = None  # the range whose following row has been seen
    for part, guest, doc_id, text in rows:
        if part == done or (guest and held is None):
            continue
        mine = hasher.of_text(text)
        if held is not None:
            yield _pair(hasher, held, text, mine)
        held, done = (None, part) if guest else ((part, doc_id, text, mine), None)


def _pair(hasher: Hasher, held: tuple, after: str, theirs: bytes) -> tuple:
    _, doc_id, text, mine = held
    changed = edited(text, after)
    new = hasher.of_text(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, mine, new, likeness(mine, new), likeness(mine, theirs)


def compare_edits(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and the document after it.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The texts are shuffled once, by ranges of ids; the first row of each
    range is also sent to the range before, where it follows the last row.
    """
    spark = prepare(docs.sparkSession)
    rows = columns(docs, doc_id="long", text="string").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(_LOWEST)).alias("place")
    )
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / n for i in range(1, n)]
    cuts = rows.select(F.percentile_approx("place", shares, 10 * n)).first()[0] or []
    range_of = _bin_udf(cuts)
    first = {r[0]: r[1] for r in rows.select(range_of("place").alias("part"), "place").groupBy("part").agg(F.max("place")).collect()}
    order = sorted(first)
    before = {first[part]: order[i - 1] for i, part in enumerate(order)}  # the first follows the last
    guest_of = F.create_map(*(F.lit(x) for pair in (before or {_LOWEST: 0}).items() for x in pair))
    sent = rows.withColumn("own", range_of("place")).withColumn("other", F.try_element_at(guest_of, F.col("place")))
    one = lambda part, guest: F.struct(part.cast("int").alias("part"), F.lit(guest).alias("guest"))
    to = F.filter(F.array(one(F.col("own"), 0), one(F.col("other"), 1)), lambda x: x["part"].isNotNull())
    dealt = (
        sent.select(F.explode(to).alias("to"), "doc_id", "text", "place")
        .select("to.part", "to.guest", "doc_id", "text", "place")
        .repartition(n, "part")
        .sortWithinPartitions("part", "guest", F.desc("place"), "text")
        .select("part", "guest", "doc_id", "text")
    )
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    return map_rows(dealt, _compare, schema)
