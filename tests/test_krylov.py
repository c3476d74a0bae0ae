"""Eigenpairs and least squares against numpy."""

import numpy as np
import pytest

from gridstone.operators import krylov


def coo(spark, m):
    return spark.createDataFrame([(int(r), int(c), float(m[r, c])) for r, c in zip(*np.nonzero(m))], "r long, c long, v double")


def vectors(df, n, pairs):
    out = np.zeros((n, pairs))
    for r in df.collect():
        out[r.i, r.which] = r.v
    return out


def symmetric(n, share, seed):
    rng = np.random.default_rng(seed)
    m = np.where(rng.random((n, n)) < share, rng.normal(size=(n, n)), 0)
    return m + m.T + np.diag(np.arange(1.0, n + 1))


@pytest.mark.parametrize(("largest", "size"), [(True, 10), (False, 40)])  # the first restarts
def test_eigenpairs(spark, largest, size):
    m = symmetric(60, 0.1, 1)
    df, values, left = krylov.lanczos(coo(spark, m), 3, largest, size, tol=1e-5)
    want = np.linalg.eigvalsh(m)
    assert np.allclose(values, want[::-1][:3] if largest else want[:3], atol=1e-4)
    v = vectors(df, 60, 3)
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-8)
    assert np.allclose(np.linalg.norm(m @ v - v * values, axis=0), left, atol=1e-6) and left.max() <= 1e-5 * abs(want).max() * 1.01


def test_equal_values_and_small_matrices(spark):
    m = np.diag([5.0, 5.0, 2.0, 2.0, 1.0])
    df, values, _ = krylov.lanczos(coo(spark, m), 3)
    assert np.allclose(values, [5, 5, 2]) and np.linalg.matrix_rank(vectors(df, 5, 3)) == 3
    _, values, _ = krylov.lanczos(coo(spark, np.array([[0, 2.0], [2, 0]])), 9)
    assert np.allclose(values, [2, -2])


def test_least_squares(spark):
    rng = np.random.default_rng(4)
    m = np.where(rng.random((50, 12)) < 0.4, rng.normal(size=(50, 12)), 0)
    b = rng.normal(size=50)
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(b)] + [(99, 3.0), (98, None)], "i long, v double")
    x, left = krylov.least_squares(coo(spark, m), rows, tol=1e-9)
    got = {r.i: r.v for r in x.collect()}
    assert np.allclose([got[i] for i in range(12)], np.linalg.lstsq(m, b, rcond=None)[0], atol=1e-6) and left <= 1e-9
    x, _ = krylov.least_squares(coo(spark, m), rows, damp=2.0, tol=1e-9)
    got = {r.i: r.v for r in x.collect()}
    assert np.allclose([got[i] for i in range(12)], np.linalg.solve(m.T @ m + 4 * np.eye(12), m.T @ b), atol=1e-6)


def test_least_length_and_zero(spark):
    m = np.array([[1.0, 1.0, 0.0], [0.0, 0.0, 2.0]])
    x, _ = krylov.least_squares(coo(spark, m), spark.createDataFrame([(0, 4.0), (1, 6.0)], "i long, v double"))
    assert np.allclose([r.v for r in x.orderBy("i").collect()], [2, 2, 3])
    x, left = krylov.least_squares(coo(spark, m), spark.createDataFrame([(7, 1.0)], "i long, v double"))
    assert [r.v for r in x.collect()] == [0, 0, 0] and left == 0
