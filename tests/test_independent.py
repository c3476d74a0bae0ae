"""Independent components of known mixtures."""

import numpy as np
import pytest

from gridstone.operators import independent

RNG = np.random.default_rng(5)
N = 3000
#: One source above, two below normal, all of unit variance; the first is skewed too.
TRUE = np.stack([RNG.exponential(size=N) - 1, RNG.uniform(-1, 1, N) * 3 ** 0.5, np.sign(RNG.normal(size=N))], axis=1)
MIX = np.array([[3.0, 1.0, 0.5], [0.2, 2.0, 1.0], [1.0, -1.0, 1.5], [2.0, 0.0, 1.0]])


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(TRUE @ MIX.T + 10)]
    return spark.createDataFrame(rows + [(N, None), (N + 1, [1.0, None, 2.0, 3.0])], "id long, f array<double>").repartition(4)


def matched(got, want):
    """Least absolute correlation of each true source with its best component."""
    c = np.abs(np.corrcoef(got.T, want.T)[: got.shape[1], got.shape[1]:])
    return c.max(axis=0).min(), set(c.argmax(axis=0))


@pytest.mark.parametrize(("method", "contrast"), [("symmetric", c) for c in ("pow3", "tanh", "gauss")] + [("deflated", "tanh"), ("extended", "")])
def test_sources_are_found(mixed, method, contrast):
    found = independent.components(mixed, "f", method=method, contrast=contrast, tol=1e-2 if method == "extended" else 1e-4)  # each rule has its own measure of a step
    out = {r.id: r.sources for r in found.sources.collect()}
    assert len(out) == N + 2 and out[N] is None and out[N + 1] is None
    got = np.array([out[i] for i in range(N)])
    least, columns = matched(got, TRUE)
    assert got.shape[1] == 3 and least > 0.97 and len(columns) == 3  # the fourth dimension holds nothing of its own
    x = TRUE @ MIX.T + 10
    assert np.allclose(got @ found.mixing.T + x.mean(axis=0), x, atol=1e-6)
    assert np.allclose(found.unmixing @ found.mixing, np.eye(3), atol=1e-8)
    standard = found.mixing / x.std(axis=0)[:, None]
    assert (np.diff(np.linalg.norm(standard, axis=0)) <= 1e-9).all() and (standard[np.abs(standard).argmax(axis=0), range(3)] > 0).all()


def test_skewed_source_and_fewer_components(mixed):
    found = independent.components(mixed, "f", 1, "deflated", "skew")
    got = np.array([r.sources for r in found.sources.where("sources IS NOT NULL").orderBy("id").collect()])
    assert got.shape[1] == 1 and abs(np.corrcoef(got[:, 0], TRUE[:, 0])[0, 1]) > 0.97


def test_a_step_by_its_definition(spark):
    x, b = RNG.normal(size=(40, 3)), RNG.normal(size=(3, 2))
    rows = spark.createDataFrame([([float(v) for v in r],) for r in x], "f array<double>").repartition(3)
    for contrast, (g, h) in {"pow3": (lambda u: u ** 3, lambda u: 3 * u * u), "tanh": (lambda u: np.tanh(2 * u), lambda u: 2 / np.cosh(2 * u) ** 2),
                             "gauss": (lambda u: u * np.exp(-u * u), lambda u: (1 - 2 * u * u) * np.exp(-u * u)), "skew": (lambda u: u * u, lambda u: 2 * u)}.items():
        want = np.array([[np.mean([r[i] * g(r @ b[:, j]) for r in x]) - b[i, j] * np.mean([h(r @ b[:, j]) for r in x]) for j in range(2)] for i in range(3)])
        assert np.allclose(independent._step(rows, b, contrast, 2.0, len(x)), want)


def test_units_and_constants_do_not_matter(spark):
    x = TRUE[:500] @ MIX[:3].T
    rows = lambda y: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(y)], "id long, f array<double>").repartition(2)
    a = independent.components(rows(x), "f", 2, contrast="pow3")
    b = independent.components(rows(np.column_stack([x * [1e6, 1, 1e-6] + 5, np.full(len(x), 1e9)])), "f", 2, contrast="pow3")
    get = lambda c: np.array([r.sources for r in c.sources.orderBy("id").collect()])
    assert np.allclose(get(a), get(b), atol=1e-4) and np.allclose(b.mixing[3], 0)


def test_odd_tables(spark):
    with pytest.raises(ValueError):
        independent.components(spark.createDataFrame([], "f array<double>"), "f")
    with pytest.raises(ValueError):
        independent.components(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "f array<double>"), "f")
    same = independent.components(spark.createDataFrame([(7, [1.0, 2.0])] * 4, "sources int, f array<double>"), "f")
    assert [r.sources for r in same.sources.collect()] == [[]] * 4 and same.rounds == 0
