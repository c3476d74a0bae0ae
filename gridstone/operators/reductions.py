"""Reductions: ranges, moments, order statistics, group summaries, overlaps. Partial sums combine before any shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstone.operators.ordered import running
from pyspark.sql import types as T


def value_range(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(v).alias("low"), F.max(v).alias("high"))


def mean_var(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.var_samp(v).alias("var"))


def count_nonzero(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(F.col(v) != 0).alias("nnz"))


def neg_entropy(df: DataFrame, keys: list[str], p: Column) -> DataFrame:
    """sum of p ln p over positive p; entropy is its negative."""
    return df.groupBy(*keys).agg(F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0)).alias("neg_entropy"))


def argmax_first(df: DataFrame, keys: list[str], v: str, idx: str) -> DataFrame:
    """Index of the largest value, the smallest index of ties."""
    return df.groupBy(*keys).agg(F.max_by(idx, F.struct(F.col(v), -F.col(idx))).alias("argmax"), F.max(v).alias("max"))


def argmin_first(df: DataFrame, keys: list[str], v: str, idx: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(idx, F.struct(F.col(v), F.col(idx))).alias("argmin"), F.min(v).alias("min"))


def order_quantiles(df: DataFrame, v: str, keys: list[str] | None = None) -> DataFrame:
    """Seven picks of the sorted values without interpolation: first, n/40, n/4, n/2, 3n/4, 39n/40, last (integer ranks)."""
    keys = keys or []
    # a global sort would be one task; running counts over ranges find the picked ranks
    ranked = _ranked(df, v, keys)
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    picks = [(0, F.lit(0)), (1, F.floor(F.col("n") / 40)), (2, F.floor(F.col("n") / 4)), (3, F.floor(F.col("n") / 2)), (4, F.floor(3 * F.col("n") / 4)), (5, F.floor(39 * F.col("n") / 40)), (6, F.col("n") - 1)]
    want = totals.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("q"), r.cast("bigint").alias("rank")) for i, r in picks])).alias("w")).select(*keys, "w.q", "w.rank")
    return want.join(ranked, [*keys, "rank"]).select(*keys, "q", F.col(v).alias("value"))


def _ranked(df: DataFrame, v: str, keys: list[str]) -> DataFrame:
    """(keys, value, rank from 0). Ungrouped, values are counted first and the ranks are running counts over ranges of values."""
    if keys:
        return df.select(*keys, v).withColumn("rank", (F.row_number().over(Window.partitionBy(*keys).orderBy(v)) - 1).cast("bigint"))
    counted = running(df.groupBy(v).agg(F.count(F.lit(1)).alias("_n")), [v], {"_through": F.col("_n")})
    n = df.count()
    picked = sorted({0, n // 40, n // 4, n // 2, 3 * n // 4, 39 * n // 40, max(0, n - 1)})
    held = F.filter(F.lit(picked).cast("array<bigint>"), lambda r: (r >= F.col("_through") - F.col("_n")) & (r < F.col("_through")))
    return counted.select(v, F.explode(held).alias("rank"))


def centroids(df: DataFrame, label: str, features: str) -> DataFrame:
    """(label, dim, mean): mean of each dimension over a label's rows."""
    dims = df.select(label, F.posexplode(features).alias("dim", "_v"))
    return dims.groupBy(label, "dim").agg(F.avg(F.col("_v").cast("double")).alias("mean"))


def rank_groups(df: DataFrame, key: str, v: str) -> DataFrame:
    """Groups numbered from 0 by the mean of a value, smaller key first in ties."""
    means = df.groupBy(key).agg(F.avg(v).alias("mean"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy("mean", key)) - 1)


def group_summary(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))


def shape_moments(df: DataFrame, label: str, axes: list[str]) -> DataFrame:
    """Count, centre and central second moments of each object."""
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"m_{a}") for a in axes]]
    aggs += [F.covar_pop(a, b).alias(f"c_{a}{b}") for i, a in enumerate(axes) for b in axes[i:]]
    return df.groupBy(label).agg(*aggs)


def bounding_box(df: DataFrame, keys: list[str], axes: list[str], margin: int = 0) -> DataFrame:
    return df.groupBy(*keys).agg(*[f.alias(n) for a in axes for f, n in ((F.min(a) - margin, f"{a}_low"), (F.max(a) + margin, f"{a}_high"))])


def overlap(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Dice, Jaccard, sensitivity and specificity of two masks, b being the reference."""
    c = df.agg(F.count_if(a & b).alias("tp"), F.count_if(a & ~b).alias("fp"), F.count_if(~a & b).alias("fn"), F.count_if(~a & ~b).alias("tn"))
    return c.select((2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("dice"), (F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn"))).alias("jaccard"),
                    (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("sensitivity"), (F.col("tn") / (F.col("tn") + F.col("fp"))).alias("specificity"))


def ssd(df: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """Mean squared difference."""
    return df.groupBy(*keys).agg(F.avg((a - b) * (a - b)).alias("ssd"))


def correlation_distance(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*keys).agg((1 - F.corr(a, b)).alias("distance"))


def mislabel_rate(df: DataFrame, predicted: str, label: str) -> DataFrame:
    return df.agg(F.avg((F.col(predicted) != F.col(label)).cast("double")).alias("rate"))


def regression(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """Ordinary least squares of one regressor for each group."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def comoments(df: DataFrame, features: str, dims: int, key: str | None = None) -> DataFrame:
    """([key,] i, j, n, c): rows that have both dimensions, and the sum of products of their deviations; null without such rows.

    A batch gives a matrix of sums about its own mean, so no expression grows with the square of the dimensions.
    """
    fields = [df.schema[key]] if key else []
    schema = T.StructType([*fields, *[T.StructField(c, T.IntegerType()) for c in "ij"], T.StructField("_n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("_c", "_x", "_y", "_b")]])
    rows = df.select(*([key] if key else []), F.array(*[F.get(features, F.lit(i)).cast("double") for i in range(dims)]).alias("_f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = (pa.array(x.ravel().astype(np.int32)) for x in np.indices((dims, dims)))
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(b.num_columns - 1).flatten()
            there = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, dims)
            values = np.where(there, flat.to_numpy(zero_copy_only=False).reshape(-1, dims), 0.0)
            codes = b.column(0).dictionary_encode(null_encoding="encode") if key else None
            group = codes.indices.to_numpy(zero_copy_only=False) if key else np.zeros(b.num_rows, np.int32)
            order = np.argsort(group, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                v = there[at].astype(float)
                mean = values[at].sum(0) / np.maximum(v.sum(0), 1)
                x = (values[at] - mean) * v
                n, sx, xx = v.T @ v, x.T @ v, x.T @ x
                c = xx - sx * sx.T / np.maximum(n, 1)
                sx += n * mean[:, None]  # about zero again
                out = [n.astype(np.int64), c, sx, sx.T, sx * sx.T / np.maximum(n, 1)]
                own = [pa.array([codes.dictionary[int(group[at[0]])].as_py()] * dims * dims, b.schema.field(0).type)] if key else []
                yield pa.RecordBatch.from_arrays([*own, i, j, *[pa.array(np.ascontiguousarray(o).ravel()) for o in out]], schema.names)

    keys = [*([key] if key else []), "i", "j"]
    sums = rows.mapInArrow(run, schema).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_n", "_c", "_x", "_y", "_b")])
    return sums.select(*keys, F.col("_n").alias("n"), F.when(F.col("_n") > 0, F.col("_c") + F.col("_b") - F.col("_x") * F.col("_y") / F.col("_n")).alias("c"))


def covariance(df: DataFrame, features: str, dims: int) -> DataFrame:
    """(i, j, cov): population covariance of the first dimensions, one pass."""
    return comoments(df, features, dims).select("i", "j", (F.col("c") / F.col("n")).alias("cov"))


def within_scatter(df: DataFrame, label: str, features: str, dims: int) -> DataFrame:
    """(i, j, scatter): sums of products of deviations from the label's mean, over all labels."""
    return comoments(df, features, dims, label).groupBy("i", "j").agg(F.sum("c").alias("scatter"))
