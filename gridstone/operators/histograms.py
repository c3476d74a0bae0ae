"""Histograms of one and two dimensions, empirical distributions, joint counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram_round(df: DataFrame, v: str, bins: int) -> DataFrame:
    """(bin, p): normalised counts by the rounding bin round((bins - 1) (v - low) / (high - low))."""
    lim = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(v).alias("_n"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.floor((bins - 1) * (F.col(v) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) + 0.5)).otherwise(0)
    binned = df.select(v).crossJoin(F.broadcast(lim)).groupBy(at.cast("bigint").alias("bin")).agg((F.count(F.lit(1)) / F.first("_n")).alias("p"))
    return binned


def linear_bin(v: Column, low: float, high: float, bins: int) -> Column:
    """Bin from 0; the top value belongs to the last bin, values outside to none."""
    at = F.floor((v - low) / (high - low) * bins)
    return F.when((v >= low) & (v <= high), F.least(at, F.lit(bins - 1))).cast("int")


def log_bin(v: Column, low: float, high: float, bins: int) -> Column:
    import math

    at = F.floor((F.log(v) - math.log(low)) / (math.log(high) - math.log(low)) * bins)
    return F.when((v >= low) & (v <= high), F.least(at, F.lit(bins - 1))).cast("int")


def hist2d(df: DataFrame, i: Column, j: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, j, n) of rows that both bins take."""
    keys = keys or []
    return df.select(*keys, i.alias("i"), j.alias("j")).where("i is not null and j is not null").groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).alias("n"))


def data_log_bin(df: DataFrame, v: str, bins: int, name: str, least: float = 1e-6) -> DataFrame:
    """Adds a logarithmic bin over the range of the data; values below ``least`` go to bin 0 and don't set the range."""
    lim = df.agg(F.min(F.when(F.col(v) >= least, F.log(v))).alias("_lo"), F.max(F.when(F.col(v) >= least, F.log(v))).alias("_hi"))
    at = F.floor((F.log(v) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    bin_ = F.when(F.col(v) < least, 0).when(F.col("_hi") <= F.col("_lo"), 0).otherwise(F.least(at, F.lit(bins - 1)))
    return df.crossJoin(F.broadcast(lim)).withColumn(name, bin_.cast("int")).drop("_lo", "_hi")


def log_counts(hist: DataFrame) -> DataFrame:
    """Counts as logarithms, 0 staying 0."""
    return hist.withColumn("log_n", F.when(F.col("n") == 0, 0.0).otherwise(F.log("n")))


def sum_histograms(hists: DataFrame) -> DataFrame:
    """Sum over images of (image, i, j, n)."""
    return hists.groupBy("i", "j").agg(F.sum("n").alias("n"))


def empirical(df: DataFrame, v: str, bins: int = 1000) -> DataFrame:
    """(bin, x, p, cdf) of an empirical distribution with bins of width (max - min) / (bins - 1); empty bins are left out.

    The running sum goes over at most ``bins`` rows.
    """
    lim = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(v).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / (bins - 1)
    at = F.when(width > 0, F.floor((F.col(v) - F.col("_lo")) / width)).otherwise(0).cast("bigint")
    counts = df.select(v).crossJoin(F.broadcast(lim)).groupBy(at.alias("bin")).agg((F.count(F.lit(1)) / F.first("_n")).alias("p"), F.first(F.col("_lo")).alias("_lo"), F.first(width).alias("_w"))
    return counts.select("bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("x"), "p", F.sum("p").over(Window.orderBy("bin")).alias("cdf"))


def empirical_quantile(df: DataFrame, v: str, q: list[float], bins: int = 1000) -> DataFrame:
    """(q, x): the first bin whose cumulated share reaches q."""
    dist = empirical(df, v, bins)
    want = F.explode(F.array(*[F.lit(float(x)) for x in q])).alias("q")
    return dist.select("*", want).where(F.col("cdf") >= F.col("q") - 1e-12).groupBy("q").agg(F.min("x").alias("x"))


def empirical_mode(df: DataFrame, v: str, bins: int = 1000) -> DataFrame:
    return empirical(df, v, bins).agg(F.min_by("x", F.struct(-F.col("p"), F.col("bin"))).alias("mode"))


def joint_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def nmi(joint: DataFrame) -> DataFrame:
    """Normalised mutual information of (a, b, n): mutual information over the mean of both entropies."""
    n = joint.agg(F.sum("n").alias("_t"))
    p = joint.crossJoin(F.broadcast(n)).select("a", "b", (F.col("n") / F.col("_t")).alias("p")).where("p > 0")
    pa, pb = p.groupBy("a").agg(F.sum("p").alias("pa")), p.groupBy("b").agg(F.sum("p").alias("pb"))
    mi = p.join(pa, "a").join(pb, "b").agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mi"))
    ha, hb = pa.agg((-F.sum(F.col("pa") * F.log("pa"))).alias("ha")), pb.agg((-F.sum(F.col("pb") * F.log("pb"))).alias("hb"))
    return mi.crossJoin(ha).crossJoin(hb).select(F.when(F.col("ha") + F.col("hb") == 0, 0.0).otherwise(2 * F.col("mi") / (F.col("ha") + F.col("hb"))).alias("nmi"))


def cooccurrence(df: DataFrame, keys: list[str], order: list[str], v: str) -> DataFrame:
    """(a, b, n) of values that follow each other inside a group."""
    nxt = F.lead(v).over(Window.partitionBy(*keys).orderBy(*order))
    return df.select(F.col(v).alias("a"), nxt.alias("b")).where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def cooccurrence_distance(x: DataFrame, y: DataFrame) -> DataFrame:
    """L1 distance of two normalised co-occurrence tables."""
    norm = lambda t, n: t.crossJoin(F.broadcast(t.agg(F.sum("n").alias("_t")))).select("a", "b", (F.col("n") / F.col("_t")).alias(n))
    both = norm(x, "p").join(norm(y, "q"), ["a", "b"], "full")
    return both.agg(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))).alias("distance"))
