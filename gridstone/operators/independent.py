"""Independent components: rows are whitened once, then each round is one pass that sums a matrix of dimensions by components.

Only those sums, the mean and the covariance reach the driver; rows stay where they are, and a lost task is read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.state import remove, write

#: Contrasts: the nonlinearity of projections u at scale a, and its derivative.
CONTRASTS: dict[str, Callable[[np.ndarray, float], tuple[np.ndarray, np.ndarray]]] = {
    "pow3": lambda u, a: (u ** 3, 3 * u ** 2),
    "tanh": lambda u, a: (np.tanh(a * u), a * (1 - np.tanh(a * u) ** 2)),
    "gauss": lambda u, a: (u * np.exp(-a * u ** 2 / 2), (1 - a * u ** 2) * np.exp(-a * u ** 2 / 2)),
    "skew": lambda u, a: (u ** 2, 2 * u),
}


class Components(NamedTuple):
    sources: DataFrame
    mixing: np.ndarray  # dimensions x components: a row is its mean plus mixing times its sources
    unmixing: np.ndarray  # components x dimensions
    rounds: int


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in batch.column(0).to_numpy(zero_copy_only=False)])


def summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of a function of a batch of vectors: a row of sums a task, added up by Spark."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += of(_rows(b)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "v"])

    found = rows.mapInArrow(part, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[found["i"]] = found["v"]
    return out


def whitening(rows: DataFrame, dims: int, most: int | None = None, least: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, deviation, whitener, dewhitener) over the largest principal components of the standardised dimensions. Two passes.

    Components under ``least`` of the largest variance hold nothing and go, as do constant dimensions, whose deviation is told as 1.
    """
    sums = summed(rows, lambda x: np.append(x.sum(axis=0), len(x)), dims + 1)
    mean = sums[:dims] / sums[dims]
    cov = summed(rows, lambda x: (x - mean).T @ (x - mean), dims * dims).reshape(dims, dims) / sums[dims]
    spread = np.sqrt(np.diag(cov))
    spread = np.where(spread > 1e-12 * np.abs(mean), spread, 0.0)
    held = spread > 0
    spread[~held] = 1.0
    values, vectors = np.linalg.eigh(np.where(np.outer(held, held), cov / np.outer(spread, spread), 0.0))
    order = [i for i in np.argsort(-values, kind="stable") if values[i] > least * max(values.max(), 1e-300)][:most]
    scale = np.sqrt(values[order])
    return mean, spread, vectors[:, order] / scale / spread[:, None], (vectors[:, order] * scale).T * spread


def _orthonormal(b: np.ndarray) -> np.ndarray:
    """The orthonormal matrix nearest to b."""
    u, _, v = np.linalg.svd(b, full_matrices=False)
    return u @ v


def _step(rows: DataFrame, b: np.ndarray, contrast: str, a: float, n: int) -> np.ndarray:
    """One fixed-point step of all columns of b: mean of x g(x.b), less b times the mean of g'."""
    g, (d, k) = CONTRASTS[contrast], b.shape

    def of(x: np.ndarray) -> np.ndarray:
        value, slope = g(x @ b, a)
        return np.vstack([x.T @ value, slope.sum(axis=0)])

    s = summed(rows, of, (d + 1) * k).reshape(d + 1, k) / n
    return s[:d] - b * s[d]


def _symmetric(rows, start, contrast, a, n, tol, most) -> tuple[np.ndarray, int]:
    b = _orthonormal(start)
    for k in range(1, most + 1):
        new = _orthonormal(_step(rows, b, contrast, a, n))
        turned = 1 - np.abs((new * b).sum(axis=0)).min()
        b = new
        if turned < tol:
            return b, k
    raise RuntimeError(f"components did not settle in {most} rounds")


def _deflated(rows, start, contrast, a, n, tol, most) -> tuple[np.ndarray, int]:
    found, spent = np.zeros((len(start), 0)), 0
    for c in range(start.shape[1]):
        b = start[:, c]
        for k in range(most + 1):
            b = b - found @ (found.T @ b)
            b = b / np.linalg.norm(b)
            if k and 1 - abs(b @ old) < tol:  # noqa: F821
                break
            if k == most:
                raise RuntimeError(f"component {c} did not settle in {most} rounds")
            old, b, spent = b, _step(rows, b[:, None], contrast, a, n)[:, 0], spent + 1
        found = np.column_stack([found, b])
    return found, spent


def _extended(rows, start, n, rate, tol, most) -> tuple[np.ndarray, int]:
    """Natural gradient of the extended infomax rule over all rows at once; the rate falls where steps turn aside.

    Signs are those for which a separated source is a stable point. The sign of the kurtosis, which is the simpler rule, left one of five starts
    of the tests' mixture at two sources mixed evenly.
    """
    d = len(start)
    b, last = _orthonormal(start).T, None  # rows are components

    for k in range(1, most + 1):
        def of(x: np.ndarray, b=b) -> np.ndarray:
            u = x @ b.T
            return np.vstack([np.tanh(u).T @ u, u.T @ u, (1 - np.tanh(u) ** 2).sum(axis=0)])

        s = summed(rows, of, (2 * d + 1) * d).reshape(2 * d + 1, d) / n
        sign = np.where(s[2 * d] * np.diag(s[d:2 * d]) >= np.diag(s[:d]), 1.0, -1.0)
        step = (np.eye(d) - sign[:, None] * s[:d] - s[d:2 * d]) @ b
        if last is not None and (step * last).sum() < 0.5 * np.linalg.norm(step) * np.linalg.norm(last):
            rate *= 0.7
        b, last = b + rate * step, step
        if np.abs(step).max() < tol:
            return b.T, k
    raise RuntimeError(f"components did not settle in {most} rounds")


def components(df: DataFrame, features: str, count: int | None = None, method: str = "symmetric", contrast: str = "tanh", a: float = 1.0, principal: int | None = None,
               rate: float = 0.5, tol: float = 1e-6, most: int = 1000, seed: int = 0) -> Components:
    """Rows with a column ``sources`` of independent components of unit variance, and the matrices between them and the features.

    ``method`` is symmetric (all components turn together), deflated (one after the other) or extended (infomax for sources above
    and below normal, which has as many components as principal ones and an own scale). Contrasts of the first two: pow3, tanh, gauss, skew; skew finds nothing in symmetric
    sources. Dimensions are standardised first, so their units don't matter. Components come by falling length of their mixing column in standard
    units, their largest weight there positive. Rows without features, or with a null in them, have null sources and no part in the fit; vectors of unlike length are an error, fewer
    components than asked for are all there are, no row at all is an error. Normal sources can't be told apart: rounds then end in an error after ``most``.
    A column of the table called ``sources`` is replaced.
    """
    spark = df.sparkSession
    whole = F.col(features).isNotNull() & ~F.exists(features, lambda x: x.isNull())
    rows = df.where(whole).select(F.col(features).cast("array<double>").alias("f"))
    low, high, n = rows.agg(F.min(F.size("f")), F.max(F.size("f")), F.count(F.lit(1))).first()
    if not n or low != high or not low:
        raise ValueError("features must be vectors of one length")
    mean, spread, whitener, dewhitener = whitening(rows, low, principal)
    size = whitener.shape[1]
    k = size if method == "extended" else min(count or size, size)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(list((_rows(b) - mean) @ whitener))], ["f"])

    white, path = write(rows.mapInArrow(turn, "f array<double>"))
    try:
        start = np.random.default_rng(seed).normal(size=(size, k))
        if not size:
            b, rounds = start, 0
        elif method == "extended":
            b, rounds = _extended(white, start, n, rate, tol, most)
        else:
            b, rounds = {"symmetric": _symmetric, "deflated": _deflated}[method](white, start, contrast, a, n, tol, most)
    finally:
        remove(spark, path)
    unmixing, mixing = (whitener @ b).T, dewhitener.T @ np.linalg.pinv(b).T
    standard = mixing / spread[:, None]
    sign = np.sign(standard[np.abs(standard).argmax(axis=0), range(k)]) if k else np.ones(0)
    order = np.argsort(-np.linalg.norm(standard, axis=0), kind="stable")
    unmixing, mixing = (unmixing * sign[:, None])[order], (mixing * sign)[:, order]
    centred = F.zip_with(F.col(features).cast("array<double>"), F.lit([float(m) for m in mean]), lambda x, m: x - m)
    each = [F.aggregate(F.zip_with(centred, F.lit([float(w) for w in row]), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) for row in unmixing]
    value = F.array(*each) if k else F.array().cast("array<double>")
    return Components(df.withColumn("sources", F.when(whole, value)), mixing, unmixing, rounds)
