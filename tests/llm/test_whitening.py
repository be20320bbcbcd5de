"""Whitening against numpy's eigenvalues and Python's exact numbers."""

import math

import numpy as np
import pytest

from lorebase.llm import whitening
from lorebase.llm.queries import queries

DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, component string"


def fixed(vector):
    return [math.floor(1024 * float(np.float32(c))) + 100_000 for c in vector]


def expected(vectors):
    x = np.array([fixed(v) for v in vectors])
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    y = x - np.array(sums) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    return n, [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x], y, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("seed", range(6))
def test_counts(seed):
    rng = np.random.default_rng(seed)
    for size in (1, 2, 5, 20):
        a = rng.standard_normal((size, size))
        a = a + a.T
        if seed % 2:
            np.fill_diagonal(a, 0)
        values = np.linalg.eigvalsh(a)
        for shift in rng.uniform(values[0] - 1, values[-1] + 1, 10):
            assert whitening.count_above(a, shift) == (values > shift).sum()
    assert whitening.count_above(np.zeros((3, 3)), 0) == 0


@pytest.mark.parametrize("values", [[9, 5, 3, 1], [4, 4, 4, 1], [7, 7 - 1e-9, 2, 2], [1, 0, 0, 0], [1e6, 1, 1e-3, 1e-12], [0, 0, 0, 0]])
def test_eigenpairs(values):
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((len(values), len(values))))
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, axes = whitening.leading_eigenpairs(matrix, 3)
    kept = [v for v in values if v > 1e-14 * sum(values)][:3]
    assert np.allclose(found, kept, rtol=0, atol=1e-13 * max(1, sum(values)))
    assert np.allclose(axes @ axes.T, np.eye(len(found)), atol=1e-12)
    assert np.allclose(axes @ matrix, found[:, None] * axes, atol=1e-12 * max(1, sum(values)))


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    kept = [r for r in rows if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    n, deviation, y, values, axes = expected([r.embedding for r in kept])
    made = queries()["op13_whitening"](spark, DIR).collect()
    assert len(made) == 8 * len(kept)
    by = {(r.vec_id, r.component): r for r in made}
    for k in range(8):
        ours = np.array([by[r.vec_id, k + 1].whitened for r in kept])
        theirs = y @ axes[:, k] / np.sqrt(values[k])
        assert np.allclose(ours, theirs * np.sign(ours @ theirs), atol=1e-9)
        assert math.isclose(by[kept[0].vec_id, k + 1].explained, values[k] / values.sum(), rel_tol=1e-9)
    assert all(by[r.vec_id, 1].deviation == d for r, d in zip(kept, deviation, strict=True))
    assert {r.n for r in made} == {n} and len({r.identity_error for r in made}) == 1 and made[0].identity_error < 1e-9


def test_odd_rows(spark):
    good = [(k, [math.sin(k), math.cos(3 * k), k / 7], 0, "x") for k in range(12)]
    bad = [(20, None, 0, "x"), (21, [], 0, "x"), (22, [1.0, None, 2.0], 0, "x"), (23, [1.0, float("nan"), 2.0], 0, "x"), (24, [1.0, float("inf"), 2.0], 0, "x"), (25, [1.0, 2.0], 0, None)]
    rows = [*good, good[3], (None, [5.0, 5.0, 5.0], None, None), *bad]
    made = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    kept = [*good, good[3], (None, [5.0, 5.0, 5.0])]
    n, deviation, y, values, axes = expected([r[1] for r in kept])
    assert sorted((str(r.vec_id), r.component) for r in made) == sorted((str(r[0]), c) for r in kept for c in (1, 2, 3))
    assert sorted(r.deviation for r in made if r.component == 1) == sorted(deviation) and made[0].n == 14
    for c in (1, 2, 3):
        ours = sorted(abs(r.whitened) for r in made if r.component == c)
        assert np.allclose(ours, sorted(np.abs(y @ axes[:, c - 1] / np.sqrt(values[c - 1]))), atol=1e-9)


def test_nothing_to_whiten(spark):
    same = [(k, [1.0, 2.0], 0, "x") for k in range(5)]
    for rows in ([], same[:1], same, [(1, None, 0, "x")]):
        made = whitening.whitened(spark.createDataFrame(rows, SCHEMA))
        assert made.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and made.count() == 0


def test_large_entries(spark):
    rows = [(1, [3e38, 0.0], 0, "x"), (2, [-3e38, 1.0], 0, "x"), (3, [0.0, 2.0], 0, "x")]
    made = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id for r in made} == {1, 2, 3} and all(r.deviation is None for r in made if r.vec_id < 3)
    near = [(k, [float(k * 2**19), 1.0], 0, "x") for k in range(3)]
    assert {r.vec_id: r.deviation for r in whitening.whitened(spark.createDataFrame(near, SCHEMA)).collect()} == {0: 9 * 2**58, 1: 0, 2: 9 * 2**58}
