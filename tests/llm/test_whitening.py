import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterbook.llm import whitening
from meterbook.llm.queries import op11_whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component string"


def brute(rows):
    """(vec_id, x, deviation) of usable rows, mean and covariance, in exact integers as far as they go."""
    fine = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    widths = [len(v) for _, v in fine]
    width = max(set(widths), key=lambda w: (widths.count(w), w)) if widths else 0
    xs = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in fine if len(v) == width]
    n, total = len(xs), [sum(x[d] for _, x in xs) for d in range(width)]
    out = [(i, x, sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True))) for i, x in xs]
    centred = [[n * a - s for a, s in zip(x, total, strict=True)] for _, x in xs]
    cells = [[sum(c[i] * c[j] for c in centred) / n**3 for j in range(width)] for i in range(width)]
    return out, np.array(cells).reshape(width, width)


def check(spark, rows, splits=3):
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA).repartition(splits)
    model = whitening.fit(df)
    want, cells = brute(rows)
    got = {}
    for r in whitening.whiten(df, model).collect():
        got.setdefault((r.vec_id, r.deviation), []).append(r)
    if not want:
        assert not got
        return
    k = min(8, len(cells))
    values = np.maximum(np.linalg.eigvalsh(cells)[::-1][:k], 0)
    assert sum(map(len, got.values())) == k * len(want)
    whitened = np.zeros((len(want), k))
    for at, (i, _, deviation) in enumerate(want):
        own = got[(i, deviation)]
        for r in own:
            assert r.n == len(want)
            trace = np.trace(cells)
            if trace > 0:
                assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9, abs=1e-12)
            whitened[at, r.component - 1] = 0 if r.whitened is None else r.whitened
    kept = values > 1e-9 * max(values.max(), 1e-300)
    if kept.any():
        gap = np.cov(whitened.T, bias=True).reshape(k, k) - np.eye(k)
        assert np.abs(gap[np.ix_(kept, kept)]).max() < 1e-9
        assert whitening.identity_error(df, model) < 1e-9
        # the whitened rows are what the eigenvectors give: x - mean = whitened * sqrt(value) along each
        x = np.array([x for _, x, _ in want], float)
        axes = model.axes
        assert np.abs(cells @ axes - axes * values).max() < 1e-9 * values[0]
        assert np.allclose(((x - x.mean(0)) @ axes)[:, kept], (whitened * np.sqrt(values))[:, kept], atol=1e-6)


def test_whitening_equals_brute_force(spark):
    rng = random.Random(3)
    vector = lambda w: [rng.gauss(0, 1) * (1 + d) for d in range(w)]
    rows = [(i, vector(12)) for i in range(200)]
    rows += [(300, None), (301, []), (302, [1.0] * 11 + [None]), (303, [float("nan")] * 12), (304, [float("inf")] + [0.0] * 11)]
    rows += [(305, vector(5)), (None, vector(12)), (7, rows[7][1])]
    check(spark, rows)


@pytest.mark.parametrize("rows", [
    [],
    [(1, None), (2, [])],
    [(1, [0.5, 0.25])],
    [(i, [1.0, 2.0, 3.0]) for i in range(5)],
    [(i, [float(i), 2.0 * i, -1.0 * i]) for i in range(9)],
    [(i, [float(i % 2), float(i // 2 % 2), float(i // 4)]) for i in range(8)],  # three equal eigenvalues
    [(i, [-0.3 * i]) for i in range(6)],
    [(i, [3e9 * i, 1.0, float(i * i)]) for i in range(6)],
])
def test_small_and_degenerate_tables(spark, rows):
    if rows and rows[0][1] and rows[0][1][0] == 0.0 and rows[1][1][0] == 3e9:
        df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA)
        found = whitening.whiten(df, whitening.fit(df)).collect()
        wide = {i: d for i, _, d in brute(rows)[0]}
        assert {r.vec_id: r.deviation for r in found} == {i: d if d < 1 << 63 else None for i, d in wide.items()}
        return
    check(spark, rows)


def test_counts_certify_eigenvalues():
    rng = np.random.default_rng(5)
    for width in (1, 2, 5, 33):
        for kind in range(3):
            a = rng.standard_normal((width, width))
            q = np.linalg.qr(a)[0]
            values = [np.sort(rng.standard_normal(width)), np.repeat(1.0, width), np.round(np.sort(rng.standard_normal(width)))][kind]
            matrix = (q * values) @ q.T
            matrix = (matrix + matrix.T) / 2
            for shift in (-0.77, -0.13, 0.4142, 1.3):
                assert whitening.inertia_above(matrix, shift) == (values > shift).sum()
            found, vectors = whitening.leading_eigenpairs(matrix, 8)
            assert np.allclose(found, values[::-1][: len(found)], atol=1e-12)
            assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-12)
            assert np.abs(matrix @ vectors - vectors * found).max() < 1e-12


def test_registered_query(spark):
    rows = op11_whitening(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert rows.count() == 8 * n
    worst = rows.agg(F.max("identity_error").alias("e"), F.count_distinct("identity_error").alias("k")).first()
    assert worst.e < 1e-4 and worst.k == 1
