"""Whitening against a plain eigendecomposition, and its edges."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermalcube.llm import whitening
from thermalcube.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def brute(pairs, k=4):
    """{(id, component): (n, deviation, |whitened|, explained)} of usable rows, all of one dimension."""
    rows = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in pairs]
    fit = sorted({tuple(x) for _, x in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(c) - s / n for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    out = {}
    for i, x in rows:
        off = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        y = np.array([float(c) - s / n for c, s in zip(x, sums)])
        for j, at in enumerate(order):
            if values[at] > 1e-9 * values.max():
                out.setdefault((i, j + 1), []).append((n, off, abs(y @ vectors[:, at]) / math.sqrt(values[at]), values[at] / values.sum()))
    return out


def check(rows, want):
    got = {}
    for r in rows:
        got.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, abs(r.whitened), r.explained))
        assert r.identity_error <= 1e-9
    assert got.keys() == want.keys()
    for key, cells in want.items():
        assert [g[:2] for g in sorted(got[key])] == [w[:2] for w in sorted(cells)]
        assert np.allclose([g[2:] for g in sorted(got[key])], [w[2:] for w in sorted(cells)], rtol=1e-8, atol=1e-9)


def test_query_by_brute_force(spark):
    data = pd.read_parquet(f"{SF}/embeddings.parquet")
    rows = QUERIES["op11_feast_whitening"](spark, SF).collect()
    assert len(rows) == 4 * len(data)
    check(rows, brute(list(zip(data.vec_id, data.embedding))))
    for part in range(1, 5):
        signs = [r.whitened for r in rows if r.component == part]
        assert abs(np.mean(signs)) < 0.2 and min(signs) < 0 < max(signs)


NAN, INF = float("nan"), float("inf")
ROWS = [
    (1, [1.0, 0.0, 0.5]), (1, [1.0, 0.0, 0.5]), (2, [0.25, 3.0, -1.0]), (None, [2.0, -1.0, 0.0]), (4, [0.0, 0.0, 7.0]),
    (5, [5.0, 5.0, 5.0]), (6, None), (7, [1.0, None, 2.0]), (8, [1.0, NAN, 2.0]), (9, [INF, 0.0, 0.0]), (10, []), (11, [0.001, -0.001, 0.0]),
]
USED = [r for r in ROWS if r[0] not in (6, 7, 8, 9, 10)]


def test_unusable_rows_repeated_rows_and_clashing_names(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    check(whitening.whiten(frame).collect(), brute(USED))
    clash = frame.withColumns({c: F.lit("x") for c in ("n", "x", "d", "component", "sums", "i", "entries", "whitened")})
    check(whitening.whiten(clash).collect(), brute(USED))


def test_dimensions_are_fitted_apart(spark):
    other = [(20, [1.0, 2.0]), (21, [3.0, -1.0]), (22, [0.0, 0.5])]
    rows = whitening.whiten(spark.createDataFrame(ROWS + other, SCHEMA)).collect()
    check([r for r in rows if r.vec_id in (20, 21, 22)], brute(other))
    check([r for r in rows if r.vec_id not in (20, 21, 22)], brute(USED))


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_to_scale(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_equal_eigenvalues(spark):
    rows = [(i, [float(s if j == i // 2 else 0) for j in range(6)]) for i, s in enumerate([1, -1] * 6)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 48 and all(abs(r.explained - 1 / 6) < 1e-12 and r.identity_error < 1e-9 for r in got)


def test_wide_values_stay_exact(spark):
    rows = [(1, [2.0**50, 1.0]), (2, [2.0**50 + 2**28, 2.0]), (3, [2.0**51, 4.0])]
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA), 1).collect()}
    xs = [[256 * int(c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*xs)]
    for (i, _), x in zip(rows, xs):
        off = sum((3 * c - s) ** 2 for c, s in zip(x, sums))
        assert got[i].deviation == (off if off < 2**63 else None)
    huge = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])]
    assert len(whitening.whiten(spark.createDataFrame(huge, SCHEMA), 1).collect()) == 3


@pytest.mark.parametrize("d,k", [(1, 4), (3, 4), (40, 4), (64, 12)])
@pytest.mark.parametrize("kind", ["random", "falling", "flat", "pairs", "thin"])
def test_contour_finds_the_leading_pairs(d, k, kind):
    rng = np.random.default_rng(d * k)
    a = rng.standard_normal((d, 3 * d))
    if kind == "falling":
        a *= np.logspace(0, -4, d)[:, None]
    if kind == "flat":
        a = np.linalg.qr(rng.standard_normal((d, d)))[0]
    if kind == "pairs":
        a = np.diag(np.repeat(np.arange(1.0, d + 1), 2)[:d])
    if kind == "thin":
        a = a[:, :2]
    v = a @ a.T
    values, vectors = whitening.leading_components(v, k)
    want = np.linalg.eigvalsh(v)[::-1]
    want = want[: min(k, d)][want[: min(k, d)] > 1e-11 * want[0]]
    assert np.allclose(values, want, rtol=1e-9)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-11 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_inertia_counts_every_eigenvalue():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((30, 30))
    a += a.T
    counts = whitening.Tridiagonal(a)
    values = np.linalg.eigvalsh(a)
    for bound in (values[1:] + values[:-1]) / 2:
        assert counts.above(bound) == (values > bound).sum()
