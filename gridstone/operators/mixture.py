"""Variational mixture of Gaussians: rounds of one distributed sum each; only the classes' parameters reach the driver.

Each round the executors turn batches of points into responsibilities and into sums of them, of their points and of the
points' products, a row a class; the rows combine before they are shuffled. The driver updates the posteriors of
weights, means and precisions (Dirichlet and Wishart priors). Classes whose share of the points falls under ``least`` are removed.
Rounds go on until the counts settle: between removals each one raises the same bound, so they do, but classes that overlap may take
thousands. ``rounds`` is for callers that want an error sooner.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count as numbers

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstone.functions.special import digamma


@dataclass
class Mixture:
    """Posterior parameters: weights' counts, scale of the means, means, inverse scale matrices and degrees of freedom."""

    alpha: np.ndarray
    beta: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    dof: np.ndarray

    def expected_log_det(self) -> np.ndarray:
        d = self.mean.shape[1]
        half = np.array([digamma((v + 1 - np.arange(1, d + 1)) / 2).sum() for v in self.dof])
        return half + d * math.log(2) - np.array([np.linalg.slogdet(s)[1] for s in self.scale])

    def log_rho(self, x: np.ndarray) -> np.ndarray:
        """Unnormalised log responsibilities (points x classes)."""
        d = x.shape[1]
        weight = digamma(self.alpha) - digamma(np.array([self.alpha.sum()]))[0]
        out = np.empty((len(x), len(self.alpha)))
        log_det = self.expected_log_det()
        for k in range(len(self.alpha)):
            chol = np.linalg.cholesky(self.scale[k])
            z = np.linalg.solve(chol, (x - self.mean[k]).T)
            out[:, k] = weight[k] + 0.5 * log_det[k] - 0.5 * d * math.log(2 * math.pi) - 0.5 * (d / self.beta[k] + self.dof[k] * (z * z).sum(axis=0))
        return out

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responsibilities, and each point's log normaliser."""
        rho = self.log_rho(x)
        top = rho.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(rho - top).sum(axis=1))
        return np.exp(rho - total[:, None]), total


def _points(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), d)


def _sums(points: DataFrame, model: Mixture) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Counts, sums and sums of products by class, and the sum of the log normalisers."""
    k, d = model.mean.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, 2 + d + d * d))
        for b in batches:
            if b.num_rows:
                x = _points(b.column(0), d)
                r, norm = model.responsibilities(x)
                total[:, 0] += r.sum(axis=0)
                total[:, 1:1 + d] += r.T @ x
                for j in range(k):
                    total[j, 1 + d:-1] += ((r[:, j, None] * x).T @ x).reshape(-1)
                total[0, -1] += norm.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["k", "v"])

    rows = points.mapInArrow(run, "k long, v array<double>").select("k", F.posexplode("v").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((k, 2 + d + d * d))
    total[rows["k"].to_numpy(int), rows["i"].to_numpy(int)] = rows["v"].to_numpy(float)
    return total[:, 0], total[:, 1:1 + d], total[:, 1 + d:-1].reshape(k, d, d), float(total[0, -1])


def variational_mixture(points: DataFrame, features: str, starts: list[list[float]], spread: float = 1.0, least: float = 0.01, rounds: int | None = None, close: float = 1e-6) -> Mixture:
    """Fits classes that start at given means, until the classes' counts move by less than ``close`` of all points.

    ``features`` is an array column without nulls; ``spread`` is the variance that classes start with. A class under ``least`` of all points is removed; the last one stays."""
    base = points.select(F.col(features).cast("array<double>").alias("x")).where(F.col(features).isNotNull())
    n = base.count()
    if not n:
        raise ValueError("no points")
    centre = np.array(base.agg(*[F.avg(F.get("x", F.lit(i))) for i in range(len(starts[0]))]).first(), float)
    return _fit(lambda model: _sums(base, model)[:3], n, centre, np.array(starts, float), spread, least, rounds, close)


def fit_points(x: np.ndarray, starts: np.ndarray, spread: float = 1.0, least: float = 0.01, rounds: int | None = None, close: float = 1e-6) -> Mixture:
    """The same fit of points that one task holds, such as a bounded draw of one image."""
    def sums(model: Mixture) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, _ = model.responsibilities(x)
        return r.sum(axis=0), r.T @ x, np.stack([(r[:, j, None] * x).T @ x for j in range(r.shape[1])])

    return _fit(sums, len(x), x.mean(axis=0), np.asarray(starts, float), spread, least, rounds, close)


def _fit(sums_of: Callable[[Mixture], tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, prior_mean: np.ndarray, mean: np.ndarray, spread: float, least: float, rounds: int | None, close: float) -> Mixture:
    k, d = mean.shape
    prior_alpha, prior_beta, prior_dof = 1.0, 1.0, float(d)
    prior_scale = np.eye(d) * spread * prior_dof
    count = n / k
    model = Mixture(np.full(k, prior_alpha + count), np.full(k, prior_beta + count), mean, np.array([prior_scale * (1 + count / prior_dof)] * k), np.full(k, prior_dof + count))
    last = None
    for _ in numbers() if rounds is None else range(rounds):
        counts, sums, products = sums_of(model)
        kept = counts >= least * n
        if not kept.any():
            kept = counts == counts.max()
        counts, sums, products = counts[kept], sums[kept], products[kept]
        centre = sums / counts[:, None]
        spread_of = products - counts[:, None, None] * centre[:, :, None] * centre[:, None, :]
        off = centre - prior_mean
        beta = prior_beta + counts
        scale = prior_scale + spread_of + (prior_beta * counts / beta)[:, None, None] * off[:, :, None] * off[:, None, :]
        model = Mixture(prior_alpha + counts, beta, (prior_beta * prior_mean + sums) / beta[:, None], (scale + scale.transpose(0, 2, 1)) / 2, prior_dof + counts)
        if last is not None and len(last) == len(counts) and abs(last - counts).max() < close * n:
            return model
        last = counts
    raise RuntimeError(f"classes did not settle in {rounds} rounds")


def classify(points: DataFrame, features: str, model: Mixture, name: str = "cluster") -> DataFrame:
    """``points`` with the class of the largest responsibility, the lower number in ties; -1 for a null point."""
    kept = [f for f in points.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, T.IntegerType())])
    at, d = [f.name for f in kept].index(features), model.mean.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(at).is_valid().to_numpy(zero_copy_only=False)
            out = np.full(b.num_rows, -1, np.int32)
            if held.any():
                out[held] = model.log_rho(_points(b.column(at).filter(pa.array(held)), d)).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], schema.names)

    return points.select(*[f.name for f in kept]).mapInArrow(run, schema)


def rank_classes(points: DataFrame, label: str, value: str, name: str = "rank") -> DataFrame:
    """``points`` with the rank of their class by its mean value, from 0; any number of classes, removed ones included."""
    means = points.groupBy(label).agg(F.avg(value).alias("_m")).collect()  # a row a class
    order = {r[label]: i for i, r in enumerate(sorted(means, key=lambda r: (r["_m"], r[label])))}
    table = F.create_map(*[F.lit(x) for pair in order.items() for x in pair]) if order else F.create_map()
    return points.withColumn(name, table[F.col(label)] if order else F.lit(None).cast("int"))
