"""Benchmark decontamination by Wu-Manber search over words.

A test item's windows of ten consecutive words are the patterns. A table maps each
block of two words to how far the search may move on; where it may not, a bucket
of the patterns ending in that block is checked by first word and then compared
word by word.

Defined cases: a null or empty text has no words and no hits. Repeated documents
each get their own row. Items with equal windows are all reported; an item with no
words or a null text has no window; an item with a null id marks words but is not
listed. An empty benchmark hits nothing.
"""

import math
from collections import defaultdict
from collections.abc import Iterable

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, decide, free_name, prepare, staged, text_udf, worker_cache

WINDOW = 10
#: Most bytes of benchmark text in one broadcast, about 150 MB as a worker's tables; a larger
#: benchmark goes in several, one after the other.
BLOCK_BYTES = 1 << 20
_FOUND = "n_words long, hit_words array<int>, items array<long>"
#: Every byte that is no word character becomes a blank.
_BLANKS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` of the text with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_BLANKS).split()


def windows(found: list[bytes], width: int = WINDOW) -> Iterable[tuple[bytes, ...]]:
    if 0 < len(found) < width:
        yield tuple(found)
    for at in range(len(found) - width + 1):
        yield tuple(found[at : at + width])


class WuManber:
    """Patterns of equal length: shifts by block, buckets by suffix block."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], frozenset]):
        self.length, self.block = length, min(2, length)
        self.free = length - self.block + 1
        self.shifts: dict = {}
        self.buckets: dict = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key, left = pattern[end - self.block : end], length - end
                self.shifts[key] = min(left, self.shifts.get(key, self.free))
            self.buckets[pattern[-self.block :]].append((pattern[0], pattern, items))

    def search(self, text: list[bytes]) -> Iterable[tuple[int, frozenset]]:
        """(first word, items) of every occurrence, overlapping ones too."""
        m, block, free, shifts, buckets = self.length, self.block, self.free, self.shifts, self.buckets
        end, n = m, len(text)
        while end <= n:
            key = (text[end - 2], text[end - 1]) if block == 2 else (text[end - 1],)
            move = shifts.get(key, free)
            if move:
                end += move
                continue
            start = end - m
            for first, pattern, items in buckets[key]:
                if text[start] == first and tuple(text[start:end]) == pattern:
                    yield start, items
            end += 1


class Searcher:
    """One search per window length; almost always only the full one."""

    def __init__(self, rows: Iterable[tuple[int | None, str | None]], width: int = WINDOW):
        by_length: dict = defaultdict(lambda: defaultdict(set))
        for item, text in rows:
            for window in windows(words(text), width):
                by_length[len(window)][window].update(() if item is None else (item,))
        self.groups = [
            WuManber(length, {p: frozenset(ids) for p, ids in found.items()})
            for length, found in sorted(by_length.items())
        ]

    def __call__(self, text: str | None) -> tuple[int, list[int], list[int]]:
        found = words(text)
        hit: set[int] = set()
        items: set[int] = set()
        for group in self.groups:
            for start, ids in group.search(found):
                hit.update(range(start, start + group.length))
                items |= ids
        return len(found), sorted(hit), sorted(items)


@worker_cache
def _searcher(rows: Broadcast, width: int) -> Searcher:
    return Searcher(rows.value, width)


class Benchmark:
    """The test items, in blocks small enough to send to every worker."""

    def __init__(self, items: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES):
        self.spark, self.width = prepare(items.sparkSession), width
        self.rows = columns(items, item_id="long", text="string").filter("text IS NOT NULL").distinct()
        size = self.rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
        self.blocks = max(1, math.ceil(size / block_bytes))
        if self.blocks > 1:
            self.rows = staged(self.rows, "benchmark")

    def udf(self, block: int):
        """Search for the items of one block, which alone is read and sent."""
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(self.blocks))
        sent = self.spark.sparkContext.broadcast([tuple(r) for r in self.rows.filter(part == block).collect()])
        width = self.width
        return text_udf(_FOUND, lambda: _searcher(sent, width)), sent

    def mark(self, docs: DataFrame, name: str) -> DataFrame:
        """``docs`` with a struct of n_words, hit_words (positions) and items.

        With several blocks, the table is staged after each, so that driver and
        workers hold one block at a time.
        """
        text = F.col("`text`").cast("string")
        first, sent = self.udf(0)
        docs = docs.withColumn(name, first(text))
        for block in range(1, self.blocks):
            more = free_name(docs, "more")
            docs = staged(docs, "marks")
            sent.unpersist()
            udf, sent = self.udf(block)
            docs = docs.withColumn(more, udf(text))
            a, b = F.col(name), F.col(more)
            both = [F.array_sort(F.array_union(a[k], b[k])).alias(k) for k in ("hit_words", "items")]
            docs = docs.withColumn(name, F.struct(a["n_words"].alias("n_words"), *both)).drop(more)
        return docs


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, hit_words array<int>, items array<long>; one row per document."""
    marked = Benchmark(benchmark, width).mark(columns(docs, doc_id="long", text="string"), "found")
    return marked.select("doc_id", "found.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents, all columns, in which no window of a test item occurs."""
    tests = Benchmark(benchmark, width)
    clean = lambda found: F.size(found["hit_words"]) == 0
    if tests.blocks == 1:
        return decide(docs, tests.udf(0)[0], clean)
    name = free_name(docs, "found")
    return tests.mark(docs, name).filter(clean(F.col(name))).drop(name)


def digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items.cast("array<string>")), ","), 256)
