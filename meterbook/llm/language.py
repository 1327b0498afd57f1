"""Language identification by character language models with Kneser-Ney smoothing.

Texts become symbols: a letter a-z is itself, any other letter one of five classes by
code point, a run of anything else one gap, those before the first letter none; gaps are thought
before a text. Grams of ``order``
symbols of all learned texts are counted, a language's grams in one array per task and
then by (language, gram). From these counts every language gets an interpolated
Kneser-Ney model: the highest order from counts, lower ones from how many symbols a
gram follows, ending in the uniform distribution. Each order is kept as two sorted arrays
of gram codes, with the discounted probability of seen grams and the back-off weight of
seen contexts; a lookup is a binary search.

A text goes to the language of lowest cross-entropy per symbol. What lies above all but
one in a thousand of the learned texts of that language is marked rejected.

Size of a model: codes of ``order`` symbols number 32^order, so it does not follow the
rows. Languages are taken in parts of at most ``CELLS`` codes; driver and workers hold one
part at a time, each scores all texts, and a text's results of all parts are merged, so
that the order asked for holds for any number of languages. Counts cover all learned rows.

Defined cases: a text that is null or has no letter is ``und``, with score 0 and neither
cross-entropy nor rejection. Null languages and languages without a letter are not learned;
if none is, every text is ``und``. Equal cross-entropies go to the language first in byte
order. A held-out row is one whose crc32(doc_id as text) modulo 3 is 1; a null doc_id is
learned. Repeated rows count each.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import SLICE, columns, prepare, staged, unstage, worker_cache

ALPHABET, BITS, ORDER = 32, 5, 4
#: Gram codes of the languages of a part together, and so cells a worker keeps at most.
CELLS = 1 << 24
#: Share of a language's learned texts that rejection may hit.
REJECTED = 0.001
#: Cells a bit of cross-entropy is cut into for the thresholds.
STEPS = 256
#: Languages whose grams a task counts at once; the next one first hands these on.
OPEN = 8
#: How fast the score falls with the distance in bits per symbol.
SHARPNESS = 12.0
UNKNOWN = "und"


# Symbols


@functools.cache
def _classes() -> np.ndarray:
    """Symbol of every code point: 0 a gap, 1-26 the letters a-z, 27-31 other letters."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or not chr(c).isalpha():
            continue
        low = ord(lowered) if len(lowered := chr(c).lower()) == 1 else c
        table[c] = low - 96 if 97 <= low <= 122 else 27 + low % 5
    return table


def symbols(text: str | None) -> np.ndarray:
    """Symbols of a text, gaps merged, one gap at the end; empty without a letter."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    found = _classes()[raw]
    if not found.any():
        return np.zeros(0, np.uint8)
    found = np.append(found, np.uint8(0))
    keep = np.append(found[0] > 0, (found[1:] > 0) | (found[:-1] > 0))
    return found[keep]


def grams(found: np.ndarray, order: int) -> np.ndarray:
    """Code of the gram that ends at each symbol; before the text there are gaps."""
    padded = np.concatenate([np.zeros(order - 1, np.int32), found.astype(np.int32)])
    code = np.zeros(len(found), np.int32)
    for i in range(order):
        code = (code << BITS) | padded[i : i + len(found)]
    return code


# The model of one language


@dataclass
class Kneser:
    """Sorted gram codes of every order with their discounted probabilities, and contexts with their back-off weights."""

    order: int
    seen: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]

    def log2(self, codes: np.ndarray) -> np.ndarray:
        """Base-two logarithm of the probability of each code's last symbol after the others."""
        p = np.full(len(codes), 1.0 / ALPHABET)
        for n in range(1, self.order + 1):
            own = codes & (ALPHABET**n - 1)
            p = _found(self.seen[n - 1], own, 0.0) + _found(self.contexts[n - 1], own >> BITS, 1.0) * p
        return np.log2(p)


def _found(table: tuple[np.ndarray, np.ndarray], asked: np.ndarray, otherwise: float) -> np.ndarray:
    keys, values = table
    if not len(keys):
        return np.full(len(asked), otherwise)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], otherwise)


def kneser(codes: np.ndarray, counts: np.ndarray, order: int) -> Kneser:
    """From sorted distinct codes of the highest order and how often each occurs."""
    tables = [(codes.astype(np.int64), counts.astype(np.float64))]
    for n in range(order - 1, 0, -1):  # in how many grams of the next order a shorter one is the end
        ends, kinds = np.unique(tables[0][0] & (ALPHABET**n - 1), return_counts=True)
        tables.insert(0, (ends, kinds.astype(np.float64)))
    seen, contexts = [], []
    for keys, number in tables:
        once, twice = (number == 1).sum(), (number == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        heads, first, kinds = np.unique(keys >> BITS, return_index=True, return_counts=True)
        total = np.add.reduceat(number, first)
        seen.append((keys.astype(np.int32), (number - discount) / np.repeat(total, kinds)))
        contexts.append((heads.astype(np.int32), discount * kinds / total))
    return Kneser(order, seen, contexts)


# Learning


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


_COUNTED = pa.schema({"lang": pa.string(), "gram": pa.int32(), "n": pa.int64()})


def _count(order: int):
    """Grams per language over a partition; an array of counts for each open language."""

    def rows(lang: str, total: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(total)
        arrays = [pa.array([lang]).take(pa.array(np.zeros(len(some), np.int32))), pa.array(some.astype(np.int32)), pa.array(total[some])]
        return pa.RecordBatch.from_arrays(arrays, schema=_COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = grams(symbols(text), order)
                    if not len(found):
                        continue
                    if lang not in totals:
                        if len(totals) >= OPEN:
                            oldest = next(iter(totals))
                            yield rows(oldest, totals.pop(oldest))
                        totals[lang] = np.zeros(ALPHABET**order, np.int64)
                    np.add.at(totals[lang], found, 1)
        for lang, total in totals.items():
            yield rows(lang, total)

    return run


def learned(docs: DataFrame) -> DataFrame:
    """lang, text of the rows that may be learned from."""
    rows = columns(docs, doc_id="long", lang="string", text="string")
    return rows.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")


@dataclass
class Part:
    """Some of a model's languages, from number ``first`` on, with their models and limits."""

    first: int
    languages: list[str]
    order: int
    models: list[Kneser]
    limits: np.ndarray


@dataclass
class Model:
    """Languages in byte order, the stored counts of their grams, and the cross-entropy above which each rejects."""

    languages: list[str]
    order: int
    counted: DataFrame
    limits: np.ndarray
    _built: tuple[int, list[Kneser]] | None = None

    def bounds(self) -> list[tuple[int, int]]:
        """First and end of every part; parts of like size."""
        number = -(-len(self.languages) // max(1, CELLS // ALPHABET**self.order))
        cuts = [len(self.languages) * i // number for i in range(number + 1)] if number else []
        return list(zip(cuts, cuts[1:], strict=False))

    def part(self, first: int, end: int) -> Part:
        """Languages first to end; the driver keeps the models of the last one asked for."""
        names = self.languages[first:end]
        if self._built is None or self._built[0] != first:
            self._built = None
            self._built = first, _models(self.counted.filter(F.col("lang").between(names[0], names[-1])), self.order)
        return Part(first, names, self.order, self._built[1], self.limits[first:end])

    @property
    def models(self) -> list[Kneser]:
        """All models at once."""
        return [m for bounds in self.bounds() for m in self.part(*bounds).models]


def _models(counted: DataFrame, order: int) -> list[Kneser]:
    """Of the languages of a part, in byte order."""
    found = counted.orderBy("lang", "gram").toArrow()  # at most CELLS rows
    lang = found.column("lang").combine_chunks().dictionary_encode()
    ids, gram, n = lang.indices.to_numpy(), found.column("gram").to_numpy(), found.column("n").to_numpy()
    starts = np.flatnonzero(np.diff(ids, prepend=-1))
    return [kneser(gram[at:end], n[at:end], order) for at, end in zip(starts, [*starts, len(ids)][1:], strict=True)]


class Scorer:
    """Cross-entropies of texts; a worker keeps the logarithms it has looked up, by gram."""

    def __init__(self, model: Part):
        self.model = model
        self.known = np.zeros(ALPHABET**model.order, bool)
        self.logs = np.zeros((ALPHABET**model.order, len(model.languages)), np.float32)

    def entropies(self, text: str | None) -> np.ndarray | None:
        """Bits per symbol under each language; None without a letter."""
        codes = grams(symbols(text), self.model.order)
        if not len(codes):
            return None
        new = codes[~self.known[codes]]
        if len(new):
            new = np.unique(new)
            self.logs[new] = np.stack([m.log2(new) for m in self.model.models], axis=1)
            self.known[new] = True
        total = np.zeros(len(self.model.languages))
        for at in range(0, len(codes), 1 << 16):
            total -= self.logs[codes[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return total / len(codes)


@worker_cache
def _scorer(sent: Broadcast) -> Scorer:
    return Scorer(sent.value)


#: Of a part's best language: cross-entropy, number, name, limit, and the part's weights relative to it.
_PREDICTED = pa.schema({"entropy": pa.float64(), "at": pa.int32(), "lang": pa.string(), "limit": pa.float64(), "weight": pa.float64()})


def _best(scorer: Scorer, text: str | None) -> tuple[int, float, float] | None:
    """Language, its cross-entropy, and the weight of all languages of the part, its own being one."""
    found = scorer.entropies(text)
    if found is None:
        return None
    best = int(found.argmin())
    weight = np.exp2(np.maximum(-SHARPNESS * (found - found[best]), -1000)).sum()
    return best, float(found[best]), float(weight)


def _predictor(sent: Broadcast, part: Part):
    """UDF text -> the part's best language; null without a letter."""
    first, languages, limits = part.first, part.languages, part.limits.tolist()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _scorer(sent)
        for batch in batches:
            rows = []
            for at in range(0, len(batch), SLICE):
                for text in batch.slice(at, SLICE).to_pylist():
                    best = _best(scorer, text)
                    if best is None:
                        rows.append((None,) * len(_PREDICTED))
                    else:
                        i, entropy, weight = best
                        rows.append((entropy, first + i, languages[i], limits[i], weight))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(_PREDICTED)
            arrays = [pa.array(c, f.type) for c, f in zip(cols, _PREDICTED, strict=True)]
            yield pa.StructArray.from_arrays(arrays, fields=list(_PREDICTED))

    return F.arrow_udf(run, from_arrow_schema(_PREDICTED)).asNondeterministic()


def _predicted(rows: DataFrame, model: Model) -> DataFrame:
    """The columns of (..., text) other than text, then lang_pred, score, entropy, rejected.

    A model of one part takes the texts as they come. Those of several are scored part
    after part, and what the parts say of a row, a few numbers each, is put together.
    """
    sc, bounds = rows.sparkSession.sparkContext, model.bounds()
    others = [c for c in rows.columns if c != "text"]
    if not bounds:
        found = rows.select(*others, F.lit(None).cast(from_arrow_schema(_PREDICTED)).alias("p"))
    elif len(bounds) == 1:
        part = model.part(*bounds[0])
        found = rows.select(*others, _predictor(sc.broadcast(part), part)(F.col("text")).alias("p"))
    else:
        rows = staged(rows.withColumn("row_", F.monotonically_increasing_id()), "texts")
        said = []
        for first, end in bounds:
            part = model.part(first, end)
            sent = sc.broadcast(part)
            said.append(staged(rows.select("row_", *others, _predictor(sent, part)(F.col("text")).alias("p")), "part"))
            sent.destroy()
        unstage(rows)
        # smallest cross-entropy first, then first in byte order; every part has a say, or none
        ranked = F.array_sort(F.collect_list(F.when(F.col("p.entropy").isNotNull(), F.col("p"))))
        found = reduce(DataFrame.union, said).groupBy("row_", *others).agg(ranked.alias("all"))
        best = F.try_element_at("all", F.lit(1))
        near = lambda x: F.pow(F.lit(2.0), F.greatest(-SHARPNESS * (x["entropy"] - best["entropy"]), F.lit(-1000.0)))
        total = F.aggregate("all", F.lit(0.0), lambda so_far, x: so_far + x["weight"] * near(x))
        found = found.select(*others, best.alias("p"), total.alias("total")).withColumn("p", F.col("p").withField("weight", F.col("total")))
    return found.select(
        *others,
        F.coalesce("p.lang", F.lit(UNKNOWN)).alias("lang_pred"),
        F.coalesce(1 / F.col("p.weight"), F.lit(0.0)).alias("score"),
        F.col("p.entropy").alias("entropy"),
        (F.col("p.entropy") > F.col("p.limit")).alias("rejected"),
    )


def order_for(languages: int) -> int:
    """The highest order up to ``ORDER`` whose codes, for all languages, stay within ``CELLS``."""
    return max((n for n in range(1, ORDER + 1) if languages * ALPHABET**n <= CELLS), default=1)


def count_grams(rows: DataFrame, order: int) -> DataFrame:
    """lang, gram, n over all rows of (lang, text)."""
    counted = rows.select("lang", "text").mapInArrow(_count(order), from_arrow_schema(_COUNTED))
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, order: int | None = None) -> Model:
    """Count all learned texts for models of ``order``, and calibrate rejection on the same texts.

    Without an order it is the highest at which all languages make one part; the models
    then depend on how many languages there are, which those of a given order do not.
    """
    prepare(docs.sparkSession)
    rows = learned(docs)
    if order is None:
        order = order_for(rows.select("lang").distinct().count())
    counted = staged(count_grams(rows, order).repartitionByRange("lang"), "grams")  # a part reads its own files
    languages = [r.lang for r in counted.select("lang").distinct().orderBy("lang").collect()]
    return calibrate(rows, Model(languages, order, counted, np.full(len(languages), np.inf)))


def calibrate(rows: DataFrame, model: Model) -> Model:
    """Thresholds: the cell of cross-entropy above which at most ``REJECTED`` of a language's own texts lie."""
    if not model.languages:
        return model
    found = _predicted(rows.select("lang", "text"), model).filter("lang = lang_pred")
    cells = found.groupBy("lang", F.floor(F.col("entropy") * STEPS).alias("cell")).count().orderBy("lang", "cell").collect()
    of_lang: dict[str, list[tuple[int, int]]] = {}
    for r in cells:
        of_lang.setdefault(r.lang, []).append((r.cell, r["count"]))
    limits = np.full(len(model.languages), np.inf)
    for i, lang in enumerate(model.languages):
        own = of_lang.get(lang, [])
        least = (1 - REJECTED) * sum(c for _, c in own)
        reached = 0
        for cell, count in own:
            reached += count
            if reached >= least:
                limits[i] = (cell + 1) / STEPS
                break
    return replace(model, limits=limits)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, entropy, rejected; one row per document; nothing is shuffled for a model of one part."""
    prepare(docs.sparkSession)
    return _predicted(columns(docs, doc_id="long", text="string"), model)
