"""Collocations: phrases whose words occur together far more often than apart.

Texts become sequences of word numbers, in chunks of about ``CHUNK`` words with as
much context before them as a phrase has words, so that a phrase over the seam counts
once. Words that occur often enough are numbered by falling frequency, over all
partitions; a chunk's few distinct words meet their numbers in a join, so a common word
costs a row per chunk and the table of words is never sent anywhere whole.

Neighbouring numbers are pairs, and a chunk's pairs fall into square tiles of ``SIDE``
ranks. A tile with many is counted by direct address (``bincount`` over its cells), the
others together as sorted coordinates. Counts of all chunks add up by pair, frequent
pairs are numbered by falling frequency in turn, and the sequences are rewritten into
pair numbers: two neighbouring pairs are a phrase of three words, and so on, by the same
steps. A phrase can only be frequent if both its ends are, so nothing is lost.

Scores are integers from decimals of 38 digits: exact for counts below 10^15.

Defined cases: a null or empty text has no words; a null lang is ``und``. Repeated rows
count each. An empty table, or one without a frequent phrase, gives no rows. Equal scores
go by count, then by the phrase's bytes. A word may be of any length. ids are not used.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import SLICE, columns, prepare, staged, unstage

LEAST, LONGEST, COVERED, BEST = 10, 3, 50, 2000
#: Words to a chunk, and bytes of one text cut into words at once.
CHUNK, SEGMENT = 1 << 20, 1 << 20
#: Languages a task fills chunks of at once; the next one first closes the oldest.
OPEN = 8
#: Ranks to a tile's side, and the share of its cells from which a tile is dense.
SIDE, DENSE = 512, 8
#: Parts a language's candidates are ranked in before the last ranking.
PARTS = 64
MILLION = 1_000_000

_BREAK = b"\xff"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + b".,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _BREAK * 10)


# Texts into chunks of numbers


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, with a mark at the end of every piece, in bounded lists."""
    flat = text.translate(_TABLE)
    at = 0
    while at < len(flat):
        end = at + SEGMENT
        if end < len(flat):
            cut = max(flat.rfind(b" ", at + 1, end), flat.rfind(_BREAK, at + 1, end))
            if cut < 0:  # one very long word
                ends = [i for i in (flat.find(b" ", end), flat.find(_BREAK, end)) if i >= 0]
                cut = min(ends, default=len(flat))
            end = cut
        yield [w for w in flat[at:end].replace(_BREAK, b" \xff ").split(b" ") if w]
        at = end


def _pack(numbers: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(numbers, np.int64).tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, decompressed_size=8 * size, codec="zstd", asbytes=True), np.int64)


_CHUNKS = pa.schema({
    "chunk": pa.int64(), "lang": pa.string(), "lead": pa.int32(), "n": pa.int64(), "size": pa.int64(),
    "numbers": pa.binary(), "words": pa.list_(pa.binary()), "counts": pa.list_(pa.int32()),
})


class _Filling:
    """A chunk of one language that is being filled."""

    def __init__(self, context: list[bytes]):
        self.number = defaultdict(count().__next__)
        self.number[_BREAK] = -1
        self.parts = [np.array([self.number[w] for w in context], np.int64)]
        self.lead = self.size = len(context)

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def row(self, chunk: int, lang: str) -> pa.RecordBatch:
        numbers = np.concatenate(self.parts)
        del self.number[_BREAK]
        own = numbers[self.lead :]
        counts = np.bincount(own[own >= 0], minlength=len(self.number)).astype(np.int32)
        ends = pa.array([0, len(counts)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(list(self.number), pa.binary())), pa.ListArray.from_arrays(ends, pa.array(counts))]
        flat = [[chunk], [lang], [self.lead], [int(counts.sum())], [len(numbers)], [_pack(numbers)]]
        arrays = [pa.array(c, _CHUNKS.field(i).type) for i, c in enumerate(flat)] + lists
        return pa.RecordBatch.from_arrays(arrays, schema=_CHUNKS)


def _chunks(longest: int, words: int):
    """(lang, text) to chunks; their numbers are local, words in order of first occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = count(TaskContext.get().partitionId() << 32)
        filling: dict[str, _Filling] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    tail: list[bytes] = []
                    for found in pieces(text):
                        if lang in filling and filling[lang].size >= words:
                            yield filling.pop(lang).row(next(ids), lang)
                        if lang not in filling:
                            if len(filling) >= OPEN:
                                oldest = next(iter(filling))
                                yield filling.pop(oldest).row(next(ids), oldest)
                            filling[lang] = _Filling(tail)
                        filling[lang].add(found)
                        tail = (tail + found[1 - longest :] if len(found) < longest else found)[1 - longest :]
                        if _BREAK in tail:
                            tail = tail[len(tail) - tail[::-1].index(_BREAK) :]
                    if lang in filling:
                        filling[lang].add([_BREAK])
        for lang, chunk in filling.items():
            yield chunk.row(next(ids), lang)

    return run


# Numbers by falling frequency


def _ranked(df: DataFrame, by: list, what: str) -> DataFrame:
    """The rows, staged, with their rank from 0 as ``id``; sorted and numbered over all partitions."""
    placed = df.orderBy(*by).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    placed = staged(placed.withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))), what)
    before, offsets = 0, []
    for part, n in placed.groupBy("part").count().orderBy("part").collect():  # a row per partition
        offsets.append((part, before))
        before += n
    starts = df.sparkSession.createDataFrame(offsets, "part int, start long")
    return placed.join(starts, "part").withColumn("id", F.col("start") + F.col("at")).drop("part", "at", "start")


# Tiles


def count_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of two equally long lists of ranks, and how often each occurs."""
    if not len(a):
        return a, b, np.zeros(0, np.int64)
    heads, x = np.unique(a, return_inverse=True)
    tails, y = np.unique(b, return_inverse=True)
    across = len(tails) // SIDE + 1
    tile = x // SIDE * across + y // SIDE
    load = np.bincount(tile)
    dense = load >= SIDE * SIDE // DENSE
    thin = ~dense[tile]
    codes, n = np.unique(x[thin] * len(tails) + y[thin], return_counts=True)
    found = [(codes // len(tails), codes % len(tails), n)]
    for t in np.flatnonzero(dense):
        own = tile == t
        cells = np.bincount(x[own] % SIDE * SIDE + y[own] % SIDE, minlength=SIDE * SIDE)
        some = np.flatnonzero(cells)
        found.append((t // across * SIDE + some // SIDE, t % across * SIDE + some % SIDE, cells[some]))
    rows, cols, times = (np.concatenate(c) for c in zip(*found, strict=True))
    return heads[rows], tails[cols], times


_PAIRS = pa.schema({"chunk": pa.int64(), "a": pa.int64(), "b": pa.int64(), "n": pa.int64()})
_SEQUENCE = pa.schema({"chunk": pa.int64(), "lead": pa.int32(), "size": pa.int64(), "numbers": pa.binary()})


def _pairs(words: int):
    """Pairs of each chunk; ``words`` is the length of the phrases that they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, lead, size, packed = (c[i].as_py() for c in batch.columns)
                numbers = _unpack(packed, size)[max(0, lead - words + 1) :]
                whole = np.flatnonzero((numbers[:-1] >= 0) & (numbers[1:] >= 0))
                a, b, n = count_pairs(numbers[whole], numbers[whole + 1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), chunk)), *map(pa.array, (a, b, n))], schema=_PAIRS)

    return run


def _sequence(left: pa.Table, numbers: np.ndarray) -> pa.Table:
    arrays = [left.column("chunk"), left.column("lead"), pa.array([len(numbers)]), pa.array([_pack(numbers)], pa.binary())]
    return pa.Table.from_arrays(arrays, schema=_SEQUENCE)


def _old(left: pa.Table) -> np.ndarray:
    return _unpack(left.column("numbers")[0].as_py(), left.column("size")[0].as_py())


def _number_words(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk's local word numbers become ranks; words without one, and ends of pieces, -1."""
    old = _old(left)
    ranks = np.full(int(old.max(initial=-1)) + 2, -1, np.int64)  # the last place is that of -1
    ranks[right.column("a").to_numpy()] = right.column("id").to_numpy()
    return _sequence(left, ranks[old])


def _number_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk's ranks become ranks of the pairs they begin."""
    old = _old(left)
    a, b, ids = (right.column(c).to_numpy() for c in ("a", "b", "id"))
    new = np.full(max(len(old) - 1, 0), -1, np.int64)
    if len(ids):
        heads, x = np.unique(a, return_inverse=True)
        tails, y = np.unique(b, return_inverse=True)
        codes = x * len(tails) + y
        order = np.argsort(codes)
        codes, ids = codes[order], ids[order]
        first, second = np.searchsorted(heads, old[:-1]), np.searchsorted(tails, old[1:])
        first, second = np.minimum(first, len(heads) - 1), np.minimum(second, len(tails) - 1)
        known = (heads[first] == old[:-1]) & (tails[second] == old[1:])
        asked = (first * len(tails) + second)[known]
        at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
        new[known] = np.where(codes[at] == asked, ids[at], -1)
    return _sequence(left, new)


def _renumber(sequences: DataFrame, keys: DataFrame, work) -> DataFrame:
    """Each chunk with its own keys, one chunk to a call."""
    schema = from_arrow_schema(_SEQUENCE)
    rows = lambda left, right: work(left, right) if left.num_rows else _SEQUENCE.empty_table()
    keys = keys.withColumnRenamed("chunk", "of")
    return staged(sequences.groupBy("chunk").cogroup(keys.groupBy("of")).applyInArrow(rows, schema), "sequences")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, chunk: int = CHUNK) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language (lang, n), and per length from 1 on a table of the phrases with at least ``least`` occurrences.

    Tables: id (rank), lang, words, f, heads and tails (occurrences of the first and the
    last 1, 2, ... words), a and b (ids of the phrases without the last and the first word).
    """
    prepare(docs.sparkSession)
    rows = columns(docs, lang="string", text="string").filter("text IS NOT NULL")
    rows = rows.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    chunks = staged(rows.mapInArrow(_chunks(longest, chunk), from_arrow_schema(_CHUNKS)), "chunks")
    totals = chunks.groupBy("lang").agg(F.sum("n").alias("n"))

    zipped = F.posexplode(F.arrays_zip(F.col("words").cast("array<string>").alias("word"), "counts")).alias("a", "z")
    local = chunks.select("chunk", "lang", zipped).select("chunk", "lang", F.col("a").cast("long"), F.col("z.word").alias("word"), "z.counts")
    known = local.groupBy("lang", "word").agg(F.sum("counts").alias("f")).filter(F.col("f") >= least)
    known = _ranked(known, [F.desc("f"), "lang", "word"], "words")
    tables = [
        staged(known.select("id", "lang", "f", F.array("word").alias("words"), *(F.array("f").alias(c) for c in ("heads", "tails"))), "phrases")
    ]
    keys = local.join(known.select("lang", "word", "id"), ["lang", "word"]).select("chunk", "a", "id")
    sequences = _renumber(chunks.select(*_SEQUENCE.names), keys, _number_words)
    for words in range(2, longest + 1):
        met = sequences.mapInArrow(_pairs(words), from_arrow_schema(_PAIRS))
        counted = met.groupBy("a", "b").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        ranked = staged(_ranked(counted, [F.desc("f"), "a", "b"], "pairs"), "pairs")
        side = lambda name, *cols: tables[-1].select(F.col("id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in cols))  # noqa: E731,B023
        whole = ranked.join(side("a", "lang", "words", "heads"), "a").join(side("b", "words", "tails"), "b")
        f = F.array("f")
        whole = whole.select(
            "id", "a", "b", "f", F.col("a_lang").alias("lang"),
            F.concat("a_words", F.slice("b_words", -1, 1)).alias("words"),
            F.concat("a_heads", f).alias("heads"), F.concat("b_tails", f).alias("tails"),
        )
        tables.append(staged(whole, "phrases"))
        if words < longest:
            keys = met.select("chunk", "a", "b").join(ranked.select("a", "b", "id"), ["a", "b"])
            longer = _renumber(sequences, keys, _number_pairs)
            unstage(sequences)
            sequences = longer
    return totals, tables


def _scored(table: DataFrame, words: int) -> DataFrame:
    """The lowest-scoring cut of every phrase; of equal ones that after the fewest words."""
    big = lambda c: c.cast("decimal(16,0)")
    cuts = []
    for k in range(1, words):
        left, right = F.col("heads")[k - 1], F.col("tails")[words - k - 1]
        whole = big(F.col("f")) * big(F.col("f")) * F.lit(MILLION).cast("decimal(7,0)")
        score = F.call_function("div", whole, big(left) * big(right))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return table.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0])


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of every language.

    A phrase inside a longer one with at least ``covered`` percent of its occurrences is
    left out. Among the phrases that hold it, those longer by one word occur most.
    """
    totals, tables = frequent_phrases(docs, least, longest)
    kept = []
    for words in range(2, longest + 1):
        rows = _scored(tables[words - 1], words)
        if words < longest:
            longer = tables[words]
            over = longer.select(F.col("a").alias("id"), "f").union(longer.select(F.col("b").alias("id"), "f"))
            over = over.groupBy("id").agg(F.max("f").alias("over"))
            rows = rows.join(over, "id", "left").filter("over IS NULL OR 100 * over < %d * f" % covered)
        kept.append(rows.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score"))
    order = "ORDER BY score DESC, a DESC, phrase"
    part = f"row_number() OVER (PARTITION BY lang, pmod(xxhash64(phrase), {PARTS}) {order})"
    few = reduce(DataFrame.union, kept).withColumn("rank", F.expr(part)).filter(F.col("rank") <= best)
    few = few.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("long")).filter(F.col("rank") <= best)
    return few.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
