"""Incremental eigendecomposition against numpy over all rows, and its edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import whitening
from colloquy.llm.whitening import Spectrum, secular, updated

SCHEMA = "vec_id long, embedding array<float>, label int"


def scatter(x):
    y = x - x.mean(0)
    return y.T @ y


def same_scatter(s, x, close=1e-11):
    m = scatter(x)
    assert s.n == len(x) and np.allclose(s.mean, x.mean(0), rtol=1e-12, atol=1e-9)
    assert np.abs(s.basis.T @ s.basis - np.eye(s.basis.shape[1])).max(initial=0) < 1e-12
    assert np.abs(s.basis * s.values @ s.basis.T - m).max() <= close * max(np.abs(m).max(), 1)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_secular(n):
    rng = np.random.default_rng(n)
    for _ in range(100):
        d = np.sort(rng.random(n) * 10.0 ** rng.integers(-3, 4))
        z = rng.standard_normal(n) * 10.0 ** rng.integers(-3, 3, n)
        roots, v = secular(d, z)
        m = np.diag(d) + np.outer(z, z)
        assert np.abs(roots - np.linalg.eigvalsh(m)).max() <= 1e-13 * roots[-1]
        assert np.abs(v.T @ v - np.eye(n)).max() < 1e-12 and np.abs(m @ v - v * roots).max() <= 1e-12 * roots[-1]


def test_deflation():
    rng = np.random.default_rng(1)
    for _ in range(100):
        d = np.sort(rng.integers(0, 4, 9).astype(float))  # equal eigenvalues
        z = rng.standard_normal(9) * rng.integers(0, 2, 9)  # and entries that are zero
        q = np.linalg.qr(rng.standard_normal((9, 9)))[0]
        values, basis = updated(d, q, z)
        m = q @ (np.diag(d) + np.outer(z, z)) @ q.T
        assert np.allclose(values, np.linalg.eigvalsh(m), atol=1e-12) and np.allclose(basis * values @ basis.T, m, atol=1e-12)
        assert np.allclose(basis.T @ basis, np.eye(9), atol=1e-13)


def test_spectrum():
    rng = np.random.default_rng(2)
    x = np.floor(64 * rng.standard_normal((900, 12)))
    x[100:300] = x[100]
    s = Spectrum(12)
    for row in x:
        s.add(row)
    same_scatter(s, x)
    s = Spectrum(12)
    s.add(x[100], 200)
    same_scatter(s, x[100:300])
    for at in (0, 1, 5, 450):  # fewer rows than dimensions, too
        a, b = Spectrum(12), Spectrum(12)
        for row in x[:at]:
            a.add(row)
        for row in x[at:]:
            b.add(row)
        a.join(b)
        same_scatter(a, x)
    s = Spectrum(12)
    for low in range(0, 900, 250):
        s.add_block(x[low : low + 250])
    same_scatter(s, x)


def brute(rows, k):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e] for e in rows])
    n, total = len(x), x.sum(0)
    y = x - total / n
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return [sum((n * int(a) - int(t)) ** 2 for a, t in zip(r, total)) for r in x], y @ basis / np.sqrt(values), values / np.trace(y.T @ y / n), n


@pytest.mark.parametrize("dim", [5, 40])
def test_same_as_numpy(spark, dim):
    rng = np.random.default_rng(5)
    rows = (rng.standard_normal((700, dim)) * np.linspace(0.1, 2, dim)).tolist()
    bad = [None, [], [1.0] * (dim - 1), [None, *rows[0][1:]], [float("nan"), *rows[0][1:]], [float("inf"), *rows[0][1:]]]
    every = [(i, e, 0) for i, e in enumerate(rows)] + [(None, e, 1) for e in bad]
    df = spark.createDataFrame(every, SCHEMA).withColumns({"x": F.lit(1), "n": F.lit("a"), "component": F.lit(2)}).repartition(19)
    out = whitening.report(df).toPandas()
    deviation, white, share, n = brute(rows, 32)
    k = min(dim, 32)
    assert len(out) == n * k and (out.n == n).all() and out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-10
    out = out.sort_values(["vec_id", "component"])
    assert (out.deviation.to_numpy().reshape(n, k) == np.array(deviation)[:, None]).all()
    assert np.allclose(out.explained.to_numpy().reshape(n, k), share, rtol=1e-12)
    got = out.whitened.to_numpy().reshape(n, k)
    sign = np.sign((got * white).sum(0))
    assert np.abs(got - white * sign).max() < 1e-8


def test_folded(spark):
    rng = np.random.default_rng(6)
    x = whitening.whole_numbers(spark.createDataFrame([(i, e, 0) for i, e in enumerate(rng.standard_normal((500, 8)).tolist())], SCHEMA))
    a, b = whitening.fit(x), whitening.fit(x, fold=128)
    assert np.allclose(a.values, b.values, rtol=1e-12) and np.abs(np.abs((a.basis * b.basis).sum(0)) - 1).max() < 1e-10


def test_edges(spark):
    one = [0.5, -0.25, 1.0]
    for rows in ([], [(1, one, 0)], [(1, one, 0)] * 5, [(1, None, 0), (2, [], 0)]):
        out = whitening.report(spark.createDataFrame(rows, SCHEMA))
        assert out.count() == 0 and [f.dataType.simpleString() for f in out.schema] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    flat = [(i, [float(i % 3), 7.0, float(i % 3)], 0) for i in range(9)]  # one direction only
    out = whitening.report(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {r.component for r in out} == {1} and len(out) == 9 and abs(out[0].explained - 1) < 1e-12 and out[0].identity_error < 1e-10
    for power in (23, 24):  # by whole numbers of any length; null where a long cannot hold it
        large = [(i, [float((-1) ** i * 2.0**power), 0.0], 0) for i in range(4)] + [(9, [0.0, 1.0], 0)]
        want = {d if d < 2**63 else None for d in brute([r[1] for r in large], 2)[0]}
        assert {r.deviation for r in whitening.report(spark.createDataFrame(large, SCHEMA)).collect()} == want and (None in want) == (power == 24)
    assert len(whitening.report(spark.createDataFrame([(None, [1.0], 0), (None, [2.0], 0)], SCHEMA)).collect()) == 2
