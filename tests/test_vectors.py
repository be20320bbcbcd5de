"""The nearest vectors by clusters against brute force."""

import contextlib
import io
import math

import numpy as np
import pytest

from lorebase.operators import vectors


def brute(rows, asked, n):
    good = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    out = {}
    for q, w in asked:
        if good(w) and len(w) == 3:
            scored = sorted((-round(math.cosh(np.dot(w, v) / (np.linalg.norm(w) * np.linalg.norm(v))), 6), t) for t, v in rows if good(v) and len(v) == 3)
            out[q] = [(t, -s) for s, t in scored[:n]]
    return out


def made(spark, rows, asked, n, **options):
    found = vectors.nearest(spark.createDataFrame(rows, "text string, vector array<float>"), spark.createDataFrame(asked, "query_id long, vector array<double>"), n, **options)
    out = {}
    for r in found.collect():
        out.setdefault(r.query_id, []).append((r.text, r.score))
    return {q: sorted(x, key=lambda p: (-p[1], p[0])) for q, x in out.items()}


@pytest.mark.parametrize(("heads", "block"), [(8, 16), (1, 4096), (64, 5)])
def test_against_brute_force(spark, heads, block):
    rng = np.random.default_rng(heads)
    centres = rng.standard_normal((6, 3))
    data = [[float(np.float32(x)) for x in centres[k % 6] * rng.choice([-2, 1]) + 0.05 * rng.standard_normal(3)] for k in range(240)]
    rows = [(f"t{k:03}", v) for k, v in enumerate(data)] + [(f"same{k:02}", [1.0, 2.0, 3.0]) for k in range(40)]
    rows += [("none", None), ("empty", []), ("zero", [0.0, 0.0, 0.0]), ("odd", [1.0, 2.0]), ("nan", [float("nan"), 1.0, 1.0]), ("hole", [1.0, None, 2.0])]
    asked = [(k, data[7 * k]) for k in range(20)] + [(50, [1.0, 2.0, 3.0]), (51, [-1.0, -2.0, -3.0]), (52, None), (53, [0.0, 0.0, 0.0]), (54, [1.0])]
    for n in (1, 10):
        assert made(spark, rows, asked, n, heads=heads, block=block) == brute(rows, asked, n)


def test_fewer_than_wanted_and_none(spark):
    rows = [("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0])]
    assert made(spark, rows, [(1, [1.0, 1.0, 0.0])], 5) == brute(rows, [(1, [1.0, 1.0, 0.0])], 5)
    assert made(spark, [], [(1, [1.0, 1.0, 0.0])], 5) == {} and made(spark, rows, [], 5) == {}


def test_bounds_hold_and_leave_clusters_out():
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    heads = unit(rng.standard_normal((12, 16)))
    members = [unit(h + 0.1 * rng.standard_normal((50, 16))) * rng.choice([-1, 1], (50, 1)) for h in heads]
    bare = vectors.Clusters(heads, np.zeros(12), np.full(12, 50))
    clusters = vectors.Clusters(heads, np.array([bare.angles(m)[:, k].max() for k, m in enumerate(members)]), np.full(12, 50))
    asked = unit(heads[:4] + 0.05 * rng.standard_normal((4, 16)))
    best = clusters.best(clusters.angles(asked))
    for k, m in enumerate(members):
        assert (np.cosh(asked @ m.T).max(axis=1) <= best[:, k] + 1e-12).all()
    worst = np.sort(np.cosh(np.concatenate([asked @ m.T for m in members], axis=1)), axis=1)[:, -20]
    assert (best >= worst[:, None]).sum() <= 12


def test_no_join_of_everything_with_everything(spark):
    rows = spark.createDataFrame([(f"t{k}", [float(k), 1.0]) for k in range(30)], "text string, vector array<double>")
    found = vectors.nearest(rows, spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, vector array<double>"), 3)
    with contextlib.redirect_stdout(io.StringIO()) as out:
        found.explain("formatted")
    assert "NestedLoop" not in out.getvalue() and "Cartesian" not in out.getvalue()
