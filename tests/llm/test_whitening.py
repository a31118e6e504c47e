"""Whitening against exact fractions and a plain eigendecomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest

from countloom.llm import catalog, whitening


def table(spark, vectors, extra=False):
    df = spark.createDataFrame([(i, v) for i, v in vectors], "vec_id bigint, embedding array<double>")
    return df.selectExpr("*", "'z' AS x", "'z' AS e", "'z' AS component") if extra else df


def brute(vectors, d):
    fine = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in vectors if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in fine})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mid = [Fraction(s, n) for s in sums]
    cov = np.array([[float(sum((x[a] - mid[a]) * (x[b] - mid[b]) for x in fit) / n) for b in range(d)] for a in range(d)])
    values, vecs = np.linalg.eigh(cov)
    return fine, fit, n, sums, values[::-1], vecs[:, ::-1], np.trace(cov)


def check(spark, vectors, d, extra=False):
    got = whitening.whiten(table(spark, vectors, extra).repartition(3)).collect()
    fine, fit, n, sums, values, vecs, trace = brute(vectors, d)
    k = min(4, d)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"]) for r in got) == sorted((i is None, i or 0, c) for i, _ in fine for c in range(1, k + 1))
    by = {}
    for i, x in fine:
        by.setdefault(i, []).append(x)
    for r in got:
        c = r["component"] - 1
        assert r["n"] == n
        devs = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in by[r["vec_id"]]]
        assert int(r["deviation_text"]) in devs and r["deviation"] == (int(r["deviation_text"]) if int(r["deviation_text"]) < 1 << 63 else None)
        assert r["explained"] == pytest.approx(values[c] / trace if trace else 0.0, rel=1e-9, abs=1e-12)
        if values[c] > 1e-12 * trace:
            want = [abs(float(np.dot([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)], vecs[:, c]) / np.sqrt(values[c]))) for x in by[r["vec_id"]]]
            assert any(abs(r["whitened"]) == pytest.approx(v, abs=1e-7) for v in want)
            assert r["identity_error"] < 1e-8
        else:
            assert r["whitened"] is None and r["explained"] == 0
    return got


def test_spread(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) @ np.diag([9, 7, 5, 3, 2, 1])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    check(spark, [*rows, *rows[:40], (None, x[0].tolist())], 6, extra=True)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, []), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [1.0, inf]), (5, [1.0, 2.0, 3.0]), (6, [0.0, -0.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [-0.3, 5.0]), (9, [3.5, -1.25]), (10, [1e300, 0.0])]
    check(spark, [r for r in rows if r[0] != 10], 2)
    assert {r["vec_id"] for r in whitening.whiten(table(spark, rows)).collect()} == {6, 7, 8, 9}
    assert whitening.whiten(table(spark, [(0, None), (1, [])])).collect() == []
    assert whitening.whiten(table(spark, [])).collect() == []


def test_no_variance(spark):
    """One distinct vector has no components to whiten by; a constant dimension has none of its own."""
    got = whitening.whiten(table(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])).collect()
    assert len(got) == 4 and all(r["whitened"] is None and r["identity_error"] is None and r["deviation"] == 0 and r["n"] == 1 for r in got)
    check(spark, [(i, [float(i), 5.0, float(i * i)]) for i in range(20)], 3)


def test_large_entries(spark):
    """Centred entries beyond a long, and deviations beyond it."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.integers(-(2**53), 2**53, 3)]) for i in range(90)]
    got = check(spark, rows, 3)
    assert any(r["deviation"] is None for r in got)


def test_gram_is_exact():
    rng = np.random.default_rng(7)
    for top in (3, 2**19, 2**20, 2**41, 2**62):
        y = rng.integers(-top, top, (whitening.BLOCK + 9, 3), dtype=np.int64)
        y[0] = [top - 1, -top, 0]
        o = y.astype(object)
        assert (whitening.gram(y) == o.T @ o).all()
    o = rng.integers(-(2**60), 2**60, (50, 2)).astype(object) << 70
    assert (whitening.gram(o) == o.T @ o).all()


def test_registered(spark, small):
    got = catalog.op12_whitening(spark, small)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = got.toPandas()
    v = {r["vec_id"]: list(r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    x = {i: np.floor(256 * np.array(e, float)).astype(int) for i, e in v.items()}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    cov = np.cov(fit.T, bias=True)
    values, vecs = np.linalg.eigh(cov)
    assert len(rows) == 4 * len(v) and set(rows.n) == {n} and rows.identity_error.max() < 1e-9
    for c in range(4):
        one = rows[rows.component == c + 1].set_index("vec_id")
        w = np.array([(x[i] - s / n) @ vecs[:, -1 - c] for i in one.index]) / np.sqrt(values[-1 - c])
        assert min(abs(one.whitened - w).max(), abs(one.whitened + w).max()) < 1e-8
        assert abs(one.explained - values[-1 - c] / np.trace(cov)).max() < 1e-10
        assert all(one.deviation[i] == ((n * x[i] - s).astype(object) ** 2).sum() for i in one.index)
