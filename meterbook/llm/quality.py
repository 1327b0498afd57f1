"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed letter trigrams, trigrams of letter shapes and repeated words,
weighted by tf-idf.
A truncated singular value decomposition of a bounded sample of labelled documents
gives the latent space; the sample's vectors go to every worker, each document's
cosine with all of them is computed exactly, in blocks, and the nearest vote with
their similarity as weight.

Defined cases: a null or empty text, and one of fewer than three bytes, has no terms;
it scores the share of label 1 in the sample, as does every text if nothing is
labelled or the decomposition is empty. Of a doc_id labelled more than once the
larger label counts. Null labels are left out.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE, columns, free_name, prepare, text_udf

#: Terms: trigrams of bytes, trigrams of shapes, and words that repeat the word before,
#: which count several times over.
TERMS, SHAPES, REPEATS = 4096, 1024, 8
WIDTH = TERMS + SHAPES + REPEATS
DIMS = 48
NEIGHBOURS = 25
#: Most labelled documents the space is fitted on: those with the smallest hash of their id.
SAMPLE = 4096
THRESHOLD = 0.7
PRIOR = 0.5

_SHAPE = np.zeros(256, np.uint32)
for _c in range(256):
    _SHAPE[_c] = (
        1 if 0x61 <= _c <= 0x7A or _c >= 0x80 else 2 if 0x41 <= _c <= 0x5A else 3 if 0x30 <= _c <= 0x39
        else 4 if _c in b" \t\r" else 5 if _c == 10 else 6 + (_c % 26)
    )


def terms(text: str | None) -> np.ndarray:
    """Log-damped counts of hashed terms, as float32."""
    own = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(own, np.uint8)
    if len(raw) < 3:
        return np.zeros(WIDTH, np.float32)
    words = own.split()
    again = sum(map(bytes.__eq__, words, words[1:]))
    a, b, c = (raw[i : len(raw) - 2 + i].astype(np.uint32) for i in range(3))
    letters = ((a << 16 | b << 8 | c) * np.uint32(2654435761)) >> np.uint32(20)
    x, y, z = (_SHAPE[raw[i : len(raw) - 2 + i]] for i in range(3))
    shapes = ((x << 10 | y << 5 | z) * np.uint32(2246822519)) >> np.uint32(22)
    counts = np.concatenate([np.bincount(letters, minlength=TERMS), np.bincount(shapes, minlength=SHAPES), np.full(REPEATS, again)])
    return np.log1p(counts).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 1e-9)


@dataclass
class Model:
    """The latent space and the labelled vectors in it; a few megabytes at any size."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by similarity, for a block of rows."""
        out = np.full(len(counts), self.prior)
        if not len(self.vectors) or not len(counts):
            return out
        places = _unit(_unit(counts * self.idf) @ self.axes)
        cosines = places @ self.vectors.T
        k = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(cosines, near, 1), 0) ** 4
        total = weights.sum(axis=1)
        votes = (weights * self.labels[near]).sum(axis=1)
        np.divide(votes, total, out=out, where=total > 1e-9)
        return np.clip(out, 0.0, 1.0)


def fit_space(counts: np.ndarray, labels: np.ndarray) -> Model:
    """Tf-idf, then the leading right singular vectors by subspace iteration.

    ``counts`` is overwritten with its weighted unit rows, a block at a time: the driver
    holds one array of that size.
    """
    n, width = counts.shape if len(counts) else (0, WIDTH)
    prior = float(labels.mean()) if n else PRIOR
    idf = np.log((1 + n) / (1 + (counts > 0).sum(axis=0) if n else np.ones(width))).astype(np.float32) + 1
    if n < 2:
        return Model(idf, np.zeros((width, 0), np.float32), np.zeros((0, 0), np.float32), labels, prior)
    for at in range(0, n, SLICE):
        counts[at : at + SLICE] = _unit(counts[at : at + SLICE] * idf)
    rows = counts
    k = min(DIMS, n - 1)
    basis = rows.T @ np.random.default_rng(7).standard_normal((n, min(n, k + 16))).astype(np.float32)
    for _ in range(4):
        basis = rows.T @ (rows @ np.linalg.qr(basis)[0])
    basis = np.linalg.qr(basis)[0]
    axes = (basis @ np.linalg.svd(rows @ basis, full_matrices=False)[2].T)[:, :k].astype(np.float32)
    return Model(idf, axes, _unit(rows @ axes), labels.astype(np.float64), prior)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents outside the held-out part.

    Only the sample's term counts reach the driver: at most ``sample`` packed vectors.
    """
    prepare(docs.sparkSession)
    known = columns(labels, doc_id="long", quality="int").filter("quality IN (0, 1) AND doc_id IS NOT NULL")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = columns(docs, doc_id="long", text="string").join(chosen, "doc_id")
    packed = text_udf("counts binary", lambda: lambda text: (zlib.compress(terms(text).tobytes(), 1),))
    rows = texts.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) if sample else texts.limit(0)
    found = rows.select("quality", packed(F.col("text")).alias("found")).select("quality", "found.counts").collect()
    counts = np.empty((len(found), WIDTH), np.float32)
    for row, (_, packed_row) in zip(counts, found, strict=True):
        row[:] = np.frombuffer(zlib.decompress(packed_row), np.float32)
    return fit_space(counts, np.array([r[0] for r in found], np.float64))


def scorer(docs: DataFrame, model: Model):
    """UDF text -> score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        for batch in batches:
            scores = [np.zeros(0)]
            for at in range(0, len(batch), SLICE):
                block = np.array([terms(t) for t in batch.slice(at, SLICE).to_pylist()], np.float32)
                scores.append(own.scores(block))
            yield pa.array(np.concatenate(scores), pa.float64())

    return F.arrow_udf(run, T.DoubleType()).asNondeterministic()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score; one row per document, nothing shuffled."""
    prepare(docs.sparkSession)
    rows = columns(docs, doc_id="long", text="string")
    return rows.select("doc_id", scorer(docs, model)(F.col("text")).alias("score"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that score at least the threshold."""
    prepare(docs.sparkSession)
    mark = free_name(docs, "score")
    scored = docs.withColumn(mark, scorer(docs, model)(F.col("`text`").cast("string")))
    return scored.filter(F.col(mark) >= threshold).drop(mark)
