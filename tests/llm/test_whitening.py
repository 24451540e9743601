"""Whitening against exact arithmetic and numpy."""

from fractions import Fraction

import numpy as np
import pytest

from pinweave.llm import registry, whitening


def exact_products(x):
    """Sum of centred outer products, as fractions."""
    n = len(x)
    s = [sum(c) for c in zip(*x, strict=True)]
    c = [[Fraction(n * a - b, n) for a, b in zip(row, s, strict=True)] for row in x]
    return [[sum(r[i] * r[j] for r in c) for j in range(len(s))] for i in range(len(s))]


def test_outer_products_have_over_a_hundred_bits():
    rng = np.random.default_rng(0)
    x = (rng.normal(0, 1, (300, 4)) * [3, 1e6, 1, 2**40]).astype(np.int64) + 10**9
    n = len(x)
    mean = np.array([whitening.as_pair(Fraction(int(s), n)) for s in x.sum(axis=0)]).T.copy()
    total = whitening.Sum(4)
    for at in (0, 7, 150):  # as tasks' shares
        total.add(*whitening.centred(x[at : {0: 7, 7: 150, 150: 300}[at]], mean))
    exact = exact_products(x.tolist())
    for i in range(4):
        for j in range(4):
            got = Fraction(total.hi[i, j]) + Fraction(total.lo[i, j])
            size = (exact[i][i] * exact[j][j]) ** Fraction(1, 2)
            assert abs(got - exact[i][j]) <= 2.0**-78 * float(size)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 33, 64, 150])
def test_divide_and_conquer(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.diag(rng.integers(0, 3, n).astype(float)), np.ones((n, n)), rng.normal(size=(n, 2)) @ rng.normal(size=(2, n)), np.zeros((n, n)), np.diag(10.0 ** rng.uniform(-9, 9, n))):
        a = a @ a.T
        e, u = whitening.eigen(a)
        scale = max(np.abs(a).max(), 1e-300)
        assert np.allclose(u.T @ u, np.eye(n), atol=1e-12)
        assert np.allclose(u * e @ u.T, a, atol=1e-12 * scale * n)
        assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * scale * n) and (np.diff(e) <= 0).all()


def test_clustered_tridiagonal():
    d, e = np.abs(np.arange(21) - 10).astype(float), np.ones(20)  # pairs of eigenvalues that agree in 14 digits
    values, vectors = whitening.divide(d, e)
    full = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    assert np.allclose(values, np.linalg.eigvalsh(full), atol=1e-13) and np.allclose(vectors.T @ vectors, np.eye(21), atol=1e-13)
    assert np.allclose(full @ vectors, vectors * values, atol=1e-13)


def plain(rows, most=16):
    """The contract, by numpy on one machine: (n, {row: (deviation, whitened)}, explained)."""
    kept = [(i, [int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), object)
    n, s = len(fit), fit.sum(axis=0)
    v = np.array([[float(sum((n * a - p) * (n * b - q) for a, b in zip(fit[:, i], fit[:, j], strict=True)) / Fraction(n**3)) for j, q in enumerate(s)] for i, p in enumerate(s)]) if fit.shape[1] < 6 else np.cov(fit.astype(float).T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > len(e) * 2.3e-16 * e[0]).sum()))
    mean = s.astype(float) / n
    out = [(i, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), (np.array(x) - mean) @ u[:, :k] / np.sqrt(e[:k])) for i, x in kept]
    return n, out, e[:k] / np.trace(v)


def compare(got, rows):
    n, out, explained = plain(rows)
    by = {}
    for r in got:
        assert r.n == n and abs(r.identity_error) < 1e-9 and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        by.setdefault(r.vec_id, []).append(r)
    assert len(got) == len(out) * len(explained)
    sign = {}
    for i, deviation, whitened in out:
        for r in by[i][:]:
            assert r.deviation == deviation
            w = whitened[r.component - 1]
            if abs(w) > 1e-3:
                s = sign.setdefault(r.component, np.sign(w * r.whitened))
                assert abs(r.whitened * s - w) < 1e-7 * max(1, abs(w))


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in registry.table(spark, sf_dir, "embeddings").collect()]
    compare(registry.QUERIES["op12_whitening"](spark, sf_dir).collect(), rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(np.sin(i * k)) * 3 for k in (1, 2, 3)]) for i in range(40)]
    rows = [*good, (5, good[5][1]), (None, good[6][1]), (90, None), (91, [1.0, None, 2.0]), (92, [nan, 0.0, 0.0]), (93, [inf, 1.0, 1.0]), (94, []), (95, [1.0, 2.0]), (96, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "vec_id long, embedding array<double>, n int, component string").repartition(3)
    got = whitening.whiten(df).collect()
    assert {r.vec_id for r in got} == {*range(40), None} and len(got) == 42 * 3
    n, out, _ = plain(good)
    assert n == 40 == got[0].n and {r.deviation for r in got if r.vec_id == 5} == {out[5][1]}
    assert whitening.whiten(df.limit(0)).columns == [f.split()[0] for f in whitening.SCHEMA.split(", ")] and whitening.whiten(df.limit(0)).count() == 0
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0
    flat = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.component) for r in whitening.whiten(flat).collect()) == [(k, 1) for k in range(5)]


def test_large_deviations_are_exact():
    x = np.array([[1 << 40, 3], [5, 7]])
    total = np.array([(1 << 40) + 5, 10], object)
    assert whitening.deviations(x, total, 2) == [sum((2 * a - s) ** 2 for a, s in zip(row, total, strict=True)) for row in x.tolist()]
    small = np.array([[1, 3], [5, 7]])
    assert whitening.deviations(small, np.array([6, 10], object), 2) == [32, 32]
