"""Robust mean and covariance: the share of the rows whose covariance has the least determinant."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

State = tuple[np.ndarray, np.ndarray]
#: Accuracy of the quantile of distances: ranks are off by n over this at most, and exact for fewer rows.
ACCURACY = 100_000


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column(0)
    if len(set(pa.compute.list_value_length(lists).to_pylist())) > 1:
        raise ValueError("rows of unlike lengths")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(lists), -1)


def _distances(x: np.ndarray, states: list[State]) -> np.ndarray:
    """Squared Mahalanobis distances (rows x states), by matrix products."""
    return np.stack([(((x - m) @ np.linalg.pinv(c, hermitian=True)) * (x - m)).sum(axis=1) for m, c in states], axis=1)


def concentrate(rows: DataFrame, states: list[State], ratio: float) -> list[State]:
    """One step of all states together: each goes to the mean and covariance of the share of the rows nearest to it. Two passes; sums reach the driver only."""
    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_matrix(b), states)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(len(states)), len(d))), pa.array(d.ravel())], ["s", "d"])

    cuts = {r.s: r.cut for r in rows.mapInArrow(far, "s long, d double").groupBy("s").agg(F.percentile_approx("d", ratio, ACCURACY).alias("cut")).collect()}
    dims = len(states[0][0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(states), 1 + dims + dims * dims))
        for b in batches:
            if b.num_rows:
                x = _matrix(b)
                d = _distances(x, states)
                for s, (mean, _) in enumerate(states):
                    y = x[d[:, s] <= cuts[s]] - mean  # about the old mean, so digits are kept
                    total[s] += np.concatenate([[len(y)], y.sum(axis=0), (y.T @ y).ravel()])
        s, i = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(s.ravel()), pa.array(i.ravel()), pa.array(total.ravel())], ["s", "i", "v"])

    found = rows.mapInArrow(sums, "s long, i long, v double").groupBy("s", "i").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((len(states), 1 + dims + dims * dims))
    total[found["s"], found["i"]] = found["v"]
    out = []
    for (mean, _), t in zip(states, total):
        shift, square = t[1:dims + 1] / t[0], t[dims + 1:].reshape(dims, dims) / t[0]
        out.append((mean + shift, square - np.outer(shift, shift)))
    return out


def minimum_covariance(df: DataFrame, features: str, ratio: float = 0.75, trials: int = 10, kept: int = 3, tol: float = 1e-4, most: int = 100, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance divided by n) of the ``ratio`` of the rows of least determinant, as far as ``trials`` starts find it.

    A start is the mean and covariance of 2 (dims + 1) rows, drawn by a hash. All starts take two concentration steps together; the ``kept`` best go
    on until no determinant falls by more than ``tol`` of itself, which none can do for ever. Rows without features are left out; fewer rows than a start needs
    are an error. Steps never raise a determinant, but for the quantile's error in tables of over ACCURACY rows.
    """
    rows = df.where(F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("f"))
    first = rows.first()
    need = 2 * (len(first[0]) + 1) if first else 1
    drawn = rows.orderBy(F.xxhash64("f", F.lit(seed)), "f").limit(need * trials).collect()
    if not first or len(drawn) < need:
        raise ValueError("too few rows for a start")
    x = np.array([r[0] for r in drawn])
    rng = np.random.default_rng(seed)
    starts = [x[rng.choice(len(x), need, replace=False)] for _ in range(trials)]
    states = [(s.mean(axis=0), np.cov(s.T, bias=True).reshape(x.shape[1], -1)) for s in starts]
    size = lambda s: np.linalg.slogdet(s[1])
    worth = lambda s: size(s)[1] if size(s)[0] > 0 else -np.inf
    for _ in range(2):
        states = concentrate(rows, states, ratio)
    states = sorted(states, key=worth)[:kept]
    for _ in range(most):
        new = concentrate(rows, states, ratio)
        falls = [worth(a) - worth(b) for a, b in zip(states, new) if np.isfinite(worth(a))]
        states = new
        if not falls or max(falls) <= tol:
            break
    return min(states, key=worth)
