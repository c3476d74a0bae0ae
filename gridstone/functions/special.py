"""Special functions and densities: closed forms as Column expressions, the rest vectorised in numpy for Arrow UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_erf = np.vectorize(math.erf, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def normal_pdf(x: Column, mu: float = 0.0, sigma: float = 1.0) -> Column:
    return F.exp(-((x - mu) * (x - mu)) / (2 * sigma * sigma)) / (sigma * math.sqrt(2 * math.pi))


def exponential_pdf(x: Column, rate: float) -> Column:
    return F.when(x < 0, 0.0).otherwise(rate * F.exp(-rate * x))


def exponential_cdf(x: Column, rate: float) -> Column:
    return F.when(x < 0, 0.0).otherwise(1 - F.exp(-rate * x))


def uniform_pdf(x: Column, a: float, b: float) -> Column:
    return F.when((x >= a) & (x <= b), 1.0 / (b - a)).otherwise(0.0)


def poisson_pmf(k: Column, rate: float) -> Column:
    return F.exp(k * math.log(rate) - rate - log_gamma(k + 1))


@F.pandas_udf(DoubleType())
def erf(x: pd.Series) -> pd.Series:
    return pd.Series(_erf(x.to_numpy(float)))


@F.pandas_udf(DoubleType())
def log_gamma(x: pd.Series) -> pd.Series:
    return pd.Series(_lgamma(x.to_numpy(float)))


def normal_cdf(x: Column, mu: float = 0.0, sigma: float = 1.0) -> Column:
    return 0.5 * (1 + erf((x - mu) / (sigma * math.sqrt(2))))


def gamma_p(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma: a series below a + 1, a continued fraction above."""
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    low = (x > 0) & (x < a + 1)
    if low.any():
        v, term, total = x[low], np.full(low.sum(), 1 / a), np.full(low.sum(), 1 / a)
        for n in range(1, 500):
            term = term * v / (a + n)
            total += term
        out[low] = total * np.exp(-v + a * np.log(v) - math.lgamma(a))
    high = x >= a + 1
    if high.any():
        v, f = x[high], np.zeros(high.sum())
        for n in range(200, 0, -1):
            f = n * (n - a) / (v + 2 * n + 1 - a - f)
        out[high] = 1 - np.exp(-v + a * np.log(v) - math.lgamma(a)) / (v + 1 - a - f)
    return out


def digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        out[small] -= 1 / x[small]
        x[small] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def beta_i(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction."""
    x = np.asarray(x, float)
    swap = x > (a + 1) / (a + b + 2)
    p, q, v = np.where(swap, b, a), np.where(swap, a, b), np.clip(np.where(swap, 1 - x, x), 1e-300, 1 - 1e-16)
    f = np.zeros_like(v)
    for m in range(200, 0, -1):
        even = m * (q - m) * v / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * v / ((p + 2 * m) * (p + 2 * m + 1))
        f = even / (1 + odd / (1 + f))
    first = -(p + q) * v / (p + 1)
    front = np.exp(p * np.log(v) + q * np.log1p(-v) - np.log(p) - (_lgamma(p) + _lgamma(q) - _lgamma(p + q)))
    out = front / (1 + first / (1 + f))
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(swap, 1 - out, out)))


def student_cdf(t: np.ndarray, dof: float) -> np.ndarray:
    t = np.asarray(t, float)
    tail = 0.5 * beta_i(dof / 2, 0.5, dof / (dof + t * t))
    return np.where(t > 0, 1 - tail, tail)


def chi2_cdf(x: np.ndarray, dof: float) -> np.ndarray:
    return gamma_p(dof / 2, np.asarray(x, float) / 2)


def f_cdf(x: np.ndarray, d1: float, d2: float) -> np.ndarray:
    x = np.maximum(np.asarray(x, float), 0)
    return beta_i(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2))


def clenshaw_curtis(n: int) -> tuple[list[float], list[float]]:
    """Nodes and weights on [-1, 1] for an even n, with weights from the cosine moments."""
    x = [math.cos(math.pi * k / n) for k in range(n + 1)]
    w = []
    for k in range(n + 1):
        s = 1.0 - sum((1.0 if 2 * j == n else 2.0) / (4 * j * j - 1) * math.cos(2 * math.pi * j * k / n) for j in range(1, n // 2 + 1))
        w.append(s * (1.0 if k in (0, n) else 2.0) / n)
    return x, w


def spherical_mean(b: np.ndarray, lp: np.ndarray, lt: np.ndarray) -> np.ndarray:
    """Mean signal over directions of an axisymmetric compartment: exp(-b lt) sqrt(pi)/2 erf(x)/x, x = sqrt(b (lp - lt)), 1 at x = 0."""
    x = np.sqrt(np.maximum(b * (lp - lt), 0))
    safe = np.where(x > 1e-8, x, 1.0)
    return np.exp(-b * lt) * np.where(x > 1e-8, math.sqrt(math.pi) / 2 * _erf(safe) / safe, 1.0)
