"""Measures of samples and of pairs of samples: binned distributions, their distances, correlation of vectors, densities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstone.functions.special import log_gamma


def shares(df: DataFrame, v: str, bins: int, low: float | None = None, high: float | None = None) -> tuple[DataFrame, float, float, int]:
    """(bin, p) with bins of width (high - low) / (bins - 1), the bounds, and the number of bins, which is at most the number of values.

    Values outside given bounds are left out; without bounds they are the least and the largest value."""
    limits = df.agg(F.min(v), F.max(v), F.count(v)).first()
    if not limits[2]:
        raise ValueError("no values")
    bins = min(bins, limits[2])
    low, high = float(limits[0]) if low is None else low, float(limits[1]) if high is None else high
    width = (high - low) / max(1, bins - 1)
    at = F.floor((F.col(v) - low) / width).cast("int") if width > 0 else F.lit(0)
    counts = df.where(F.col(v).between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).where(F.col("bin") < bins)
    return counts.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("p")), low, high, bins  # ``bins`` rows at most


def quantile(df: DataFrame, v: str, q: float, bins: int = 1000) -> float:
    """Interpolated inside the bin in which the running share reaches q; the least value at 0, the largest at 1."""
    p, low, high, bins = shares(df, v, bins)
    if q <= 0 or q >= 1:
        return low if q <= 0 else high
    width, before = (high - low) / max(1, bins - 1), 0.0
    for r in p.orderBy("bin").collect():  # ``bins`` rows at most
        if before + r["p"] >= q:
            return max(low, low + r["bin"] * width) + (q - before) / r["p"] * width
        before += r["p"]
    return high


def bounded_shares(df: DataFrame, v: str, low_q: float, high_q: float, bins: int = 1000) -> DataFrame:
    """(bin, p) between two quantiles of the whole distribution."""
    return shares(df, v, bins, quantile(df, v, low_q, bins), quantile(df, v, high_q, bins))[0]


def summary(df: DataFrame, v: str, bins: int = 1000) -> DataFrame:
    """One row: median, mode (middle of the fullest bin, the lower in ties) and entropy (less the logarithm of the number of bins)."""
    p, low, high, n = shares(df, v, bins)
    mode = (F.min_by("bin", F.struct(-F.col("p"), F.col("bin"))) + 0.5) * ((high - low) / n) + low
    return p.agg(F.lit(quantile(df, v, 0.5, bins)).alias("median"), mode.alias("mode"), (-F.sum(F.col("p") * F.log("p")) - math.log(n)).alias("entropy"))


def distance(p: DataFrame, q: DataFrame) -> DataFrame:
    """Sum of absolute differences of two tables of shares by bin."""
    both = p.select("bin", F.col("p").alias("_p")).join(q.select("bin", F.col("p").alias("_q")), "bin", "full")
    return both.agg(F.sum(F.abs(F.coalesce("_p", F.lit(0.0)) - F.coalesce("_q", F.lit(0.0)))).alias("distance"))


def vector_correlation_distance(df: DataFrame, a: str, b: str, dims: int) -> DataFrame:
    """1 - r of two array columns over all rows: products summed over rows and dimensions, the denominator 1e-6 at least."""
    x, y = ([F.get(c, F.lit(i)).cast("double") for i in range(dims)] for c in (a, b))
    sums = [F.struct(F.sum(p).alias("a"), F.sum(q).alias("b"), F.sum(p * q).alias("ab"), F.sum(p * p).alias("aa"), F.sum(q * q).alias("bb")) for p, q in zip(x, y)]
    held = df.agg(F.count(F.lit(1)).alias("_n"), F.array(*sums).alias("_s"))
    part = lambda f: F.aggregate("_s", F.lit(0.0), lambda t, s: t + f(s))
    n = F.col("_n")
    ab, aa, bb = part(lambda s: s.ab - s.a * s.b / n), part(lambda s: s.aa - s.a * s.a / n), part(lambda s: s.bb - s.b * s.b / n)
    return held.select((1 - ab / F.greatest(F.sqrt(aa * bb), F.lit(1e-6))).alias("distance"))


def gauss_dist(v: Column, mu: Column, var: Column) -> Column:
    return (v - mu) * (v - mu) / var


def gauss_prob(v: Column, mu: Column, var: Column, prior: Column) -> Column:
    return prior * F.exp(-0.5 * gauss_dist(v, mu, var)) / F.sqrt(2 * math.pi * var)


def gamma_pdf(x: Column, shape: float, scale: float) -> Column:
    return F.when(x > 0, F.exp((shape - 1) * F.log(x) - x / scale - math.lgamma(shape) - shape * math.log(scale))).otherwise(0.0)


def inverse_gamma_pdf(x: Column, shape: float, scale: float) -> Column:
    return F.when(x > 0, F.exp(shape * math.log(scale) - math.lgamma(shape) - (shape + 1) * F.log(x) - scale / x)).otherwise(0.0)


def chi2_pdf(x: Column, dof: float) -> Column:
    return gamma_pdf(x, dof / 2, 2.0)


def beta_pdf(x: Column, a: float, b: float) -> Column:
    inside = (x > 0) & (x < 1)
    return F.when(inside, F.exp((a - 1) * F.log(x) + (b - 1) * F.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))).otherwise(0.0)


def binomial_pmf(k: Column, n: int, p: float) -> Column:
    choose = math.lgamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)
    return F.when((k >= 0) & (k <= n), F.exp(choose + k * math.log(p) + (n - k) * math.log(1 - p))).otherwise(0.0)


def student_pdf(x: Column, dof: float) -> Column:
    return math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi) * F.pow(1 + x * x / dof, F.lit(-(dof + 1) / 2))


def f_pdf(x: Column, d1: float, d2: float) -> Column:
    constant = math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2) + d1 / 2 * math.log(d1 / d2)
    return F.when(x > 0, F.exp(constant + (d1 / 2 - 1) * F.log(x) - (d1 + d2) / 2 * F.log(1 + d1 / d2 * x))).otherwise(0.0)


def marginals(matrix: DataFrame) -> DataFrame:
    """(axis, i, sum, off, largest): sums of a matrix (r, c, v) by row and column, without the diagonal, and the place of the largest value, the first in ties."""
    out = None
    for axis, i, j in (("row", "r", "c"), ("column", "c", "r")):
        part = matrix.groupBy(F.col(i).alias("i")).agg(F.sum("v").alias("sum"), F.sum(F.when(F.col("r") != F.col("c"), F.col("v")).otherwise(0.0)).alias("off"), F.max_by(j, F.struct(F.col("v"), -F.col(j))).alias("largest"))
        part = part.select(F.lit(axis).alias("axis"), "i", "sum", "off", "largest")
        out = part if out is None else out.unionByName(part)
    return out


def abs_argmax(df: DataFrame, keys: list[str], v: str, idx: str) -> DataFrame:
    """Index of the value farthest from 0, the smallest index in ties."""
    return df.groupBy(*keys).agg(F.max_by(idx, F.struct(F.abs(F.col(v)), -F.col(idx))).alias("argmax"), F.max(F.abs(F.col(v))).alias("max"))
