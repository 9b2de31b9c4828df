"""Whitening: spectra against NumPy, the whole operator against a direct computation, edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from covarium.llm import whitening


def with_values(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        [5.0],
        [3, 2, 1],
        [7, 7, 7, 7],
        list(range(1, 65)),
        [10, 10 + 1e-9, 10 - 1e-9, 5, 5, 1],
        [1e6, 1e3, 1, 1e-3, 1e-6],
        [4, 4, 4, 1, 1, 0.5, 0, 0],
        [2.0 ** -k for k in range(40)],
        list(np.random.default_rng(3).gamma(2, 2, 150)),
    ],
)
def test_slices_find_the_leading_pairs(values):
    a = with_values(np.array(values, float))
    a = (a + a.T) / 2
    floor = whitening.FLAT * np.trace(a)
    got, vectors = whitening.Spectrum(a).leading(16, floor)
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    k = min(16, int((want > floor).sum()))
    assert len(got) == k
    assert np.allclose(got, want[:k], rtol=1e-12, atol=1e-13 * want[0])
    assert np.abs(a @ vectors - vectors * got).max() < 2e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def test_counts_are_inertia():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 33):
        a = rng.standard_normal((n, n))
        a += a.T
        values = np.linalg.eigvalsh(a)
        for shift in [*rng.uniform(-5, 5, 10), 0.0]:
            f = whitening.Factor(a - shift * np.eye(n))
            assert f.positive() == (values > shift).sum()
            b = rng.standard_normal(n)
            assert np.allclose((a - shift * np.eye(n)) @ f.solve(b, 1e-300), b, atol=1e-8)
    zero = whitening.Factor(np.array([[0.0, 1.0], [1.0, 0.0]]))
    assert zero.positive() == 1 and np.allclose(zero.solve(np.array([2.0, 3.0]), 1e-300), [3, 2])


def direct(rows, k):
    """The contract, row by row."""
    ok = [(i, e) for i, e in rows if e is not None and len(e) and all(c is not None and math.isfinite(c) for c in e)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e] for _, e in ok])
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    y = u - s / n
    v = y.T @ y / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    white = (x - s / n) @ w[:, :k] / np.sqrt(e[:k])
    return [i for i, _ in ok], n, ((n * x - s) ** 2).sum(axis=1), white, e[:k] / np.trace(v)


def test_operator_equals_direct_computation(spark):
    rng = np.random.default_rng(11)
    base = (rng.standard_normal((400, 24)) * np.linspace(0.1, 2, 24) + 3).astype(np.float32).tolist()
    rows = list(enumerate(base)) + [(1000 + i, base[0]) for i in range(200)] + [(2000, None), (2001, [None] * 24), (2002, [float("nan")] * 24), (2003, [float("inf")] * 24), (2004, []), (None, base[1]), (5, base[5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit("x")).withColumn("x", F.lit(1)).repartition(7)
    got = whitening.whiten(df).collect()
    ids, n, deviation, white, explained = direct(rows, 16)
    assert len(got) == 16 * len(ids) and {r["n"] for r in got} == {n} == {400}
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    signs = {}
    want = {}
    for i, d, w in zip(ids, deviation, white):
        want[i] = (d, w)
    for r in got:
        d, w = want[r["vec_id"]]
        k = r["component"] - 1
        assert r["deviation"] == d
        assert abs(r["explained"] / explained[k] - 1) < 1e-9
        if abs(w[k]) > 0.1:
            signs.setdefault(k, set()).add(np.sign(w[k]) == np.sign(r["whitened"]))
        assert abs(abs(w[k]) - abs(r["whitened"])) < 1e-8
    assert all(len(s) == 1 for s in signs.values())


def test_few_rows_and_flat_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (2, [2.0, 4.0])], schema)).collect()
    assert [r["component"] for r in two] == [1, 1, 1] and sorted(abs(r["whitened"]) for r in two) == pytest.approx([1, 1, 1])
    assert all(abs(r["explained"] - 1) < 1e-12 for r in two)
    with pytest.raises(Exception, match="several lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema)).collect()


def test_wide_values_stay_exact(spark):
    rows = [(1, [3e9, 1.0]), (2, [-2e9, 2.0]), (3, [1e9, -5.0]), (4, [0.0, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        whitening.whiten(df).collect()
    f = whitening.fit(whitening._usable(df).select("x").distinct())
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in e] for _, e in rows], float)
    v = np.cov(x.T, bias=True)
    assert f.values[0] == pytest.approx(np.linalg.eigvalsh(v)[-1], rel=1e-12)
