"""One-dimensional window operators on signals and dense grids. Windows are partitioned by channel or by the other axes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mirror_pad(df: DataFrame, channel: str, t: str, v: str, half: int) -> DataFrame:
    """Rows before and after each channel, mirrored with the edge repeated: places -1, -2, .. take values 0, 1, ..

    Places are numbered from 0 inside a channel. Only rows within ``half`` of an end are added.
    """
    w = Window.partitionBy(channel)
    pos = df.select(channel, F.col(t).alias("_t"), F.col(v).cast("double").alias("_v"), (F.row_number().over(w.orderBy(t)) - 1).alias("_i"), F.count(F.lit(1)).over(w).alias("_n"))
    places = F.array_compact(F.array(F.col("_i"), F.when(F.col("_i") < half, -1 - F.col("_i")), F.when(F.col("_n") - F.col("_i") <= half, 2 * F.col("_n") - 1 - F.col("_i"))))
    return pos.select(channel, F.when(F.size(places) > 0, F.col("_t")).alias("_t"), "_v", "_n", F.col("_i").alias("_own"), F.explode(places).alias("_i"))


def fir_filter(df: DataFrame, channel: str, t: str, v: str, taps: list[float], name: str = "filtered") -> DataFrame:
    """Weighted sum over an odd window around each row, mirror-padded; shorter channels than half a window are padded as far as they go."""
    half = len(taps) // 2
    w = Window.partitionBy(channel).orderBy("_i")
    padded = mirror_pad(df, channel, t, v, half)
    terms = [F.coalesce((F.lag if k < half else F.lead)("_v", abs(k - half)).over(w) if k != half else F.col("_v"), F.lit(0.0)) * float(c) for k, c in enumerate(taps)]
    out = padded.withColumn(name, sum(terms[1:], terms[0]))
    return out.where("_i = _own").select(channel, F.col("_t").alias(t), name)


def moving_average(df: DataFrame, channel: str, t: str, v: str, length: int, name: str = "ma") -> DataFrame:
    """Mean over an odd window (an even length takes one more), mirror-padded."""
    length += 1 - length % 2
    return fir_filter(df, channel, t, v, [1.0 / length] * length, name)


def hamming_taps(cutoff: float, length: int) -> list[float]:
    """Low-pass taps of unit sum: windowed sinc, cutoff as a fraction of the sampling rate."""
    length += 1 - length % 2
    h = length // 2
    taps = [(2 * cutoff if k == h else math.sin(2 * math.pi * cutoff * (k - h)) / (math.pi * (k - h))) * (0.54 - 0.46 * math.cos(2 * math.pi * k / (length - 1))) for k in range(length)]
    return [x / sum(taps) for x in taps]


def iir_filter(df: DataFrame, channel: str, t: str, v: str, b: list[float], a: list[float], name: str = "filtered") -> DataFrame:
    """Direct-form recursion per channel (a[0] = 1); a channel is sequential, channels run apart."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        x, y = pdf[v].to_numpy(float), []
        for i in range(len(x)):
            s = sum(c * x[i - k] for k, c in enumerate(b) if i >= k)
            y.append(s - sum(c * y[i - k] for k, c in enumerate(a) if k and i >= k))
        return pdf[[channel, t]].assign(**{name: y})

    types = dict(df.dtypes)
    return df.select(channel, t, v).groupBy(channel).applyInPandas(run, f"{channel} {types[channel]}, {t} {types[t]}, {name} double")


def epoch_average(df: DataFrame, channel: str, pos: str, v: str, is_trigger: Column, before: int, after: int, centred: bool = True) -> DataFrame:
    """(offset, n, mean): values around triggers, averaged by offset, less the mean of these averages unless ``centred`` is false.

    A trigger counts only if its whole epoch is inside the channel.

    ``pos`` is a running number in the channel; each trigger is turned into its places, which meet the rows by equi-join.
    """
    n = F.max(pos).over(Window.partitionBy(channel))
    low = F.min(pos).over(Window.partitionBy(channel))
    trig = df.withColumn("_n", n).withColumn("_l", low).where(is_trigger).where((F.col(pos) - before >= F.col("_l")) & (F.col(pos) + after <= F.col("_n")))
    places = trig.select(channel, F.col(pos).alias("_at"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")).withColumn(pos, (F.col("_at") + F.col("offset")).cast(df.schema[pos].dataType))
    found = places.join(df.select(channel, pos, v), [channel, pos]).groupBy("offset").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"))
    # before + after + 1 rows
    return found.withColumn("mean", F.col("mean") - F.avg("mean").over(Window.partitionBy(F.lit(0)))) if centred else found


def center(df: DataFrame, keys: list[str], v: str, name: str = "centered") -> DataFrame:
    return df.withColumn(name, F.col(v) - F.avg(v).over(Window.partitionBy(*keys)))


def zscore(df: DataFrame, keys: list[str], v: str, name: str = "z") -> DataFrame:
    """(v - mean) / sample sd; 0 where the sd is 0 or there is one row."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_samp(v).over(w)
    return df.withColumn(name, F.when(sd > 0, (F.col(v) - F.avg(v).over(w)) / sd).otherwise(0.0))


def argsort(df: DataFrame, v: str, idx: str, keys: list[str], descending: bool = False) -> DataFrame:
    """Place of each row in sorted order from 0, the smaller index first in ties."""
    order = F.desc(v) if descending else F.asc(v)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order, idx)) - 1)


def box(df: DataFrame, others: list[str], axis: str, v: str, half: int) -> DataFrame:
    """Sum, mean and sample variance over the rows within ``half`` along an axis, cut at the borders; rows of a line are dense."""
    w = Window.partitionBy(*others).orderBy(axis).rowsBetween(-half, half)
    return df.withColumn("box_sum", F.sum(v).over(w)).withColumn("box_mean", F.avg(v).over(w)).withColumn("box_var", F.var_samp(v).over(w))


def gaussian_taps(sigma: float, degree: int = 0) -> list[float]:
    """Kernel as wide as six sigmas, rounded down to whole places, 3 at least, and one more if that is even; divided by its sum.

    The sum of degree 1 is 0 but for rounding, so that kernel is divided by the sum of k times its k-th tap, which makes a ramp's slope exact."""
    n = max(int(6 * abs(sigma)), 3)
    half = n // 2
    g = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-half, half + 1)]
    if degree == 1:
        g = [-k / sigma ** 2 * x for k, x in zip(range(-half, half + 1), g)]
    elif degree == 2:
        g = [(k * k / sigma ** 4 - 1 / sigma ** 2) * x for k, x in zip(range(-half, half + 1), g)]
    total = sum(g) if degree != 1 else sum(-k * x for k, x in zip(range(-half, half + 1), g))
    return [x / total for x in g]


def gaussian_filter(df: DataFrame, others: list[str], axis: str, v: str, sigma: float, name: str = "smooth", mask: Column | None = None) -> DataFrame:
    """One pass of a separable Gaussian; weights outside the grid (or the mask) are left out and the rest made up for."""
    taps = gaussian_taps(sigma)
    half = len(taps) // 2
    w = Window.partitionBy(*others).orderBy(axis)
    df = df.withColumn("_w", F.lit(1.0) if mask is None else mask.cast("double")).withColumn("_wv", F.col(v) * F.col("_w"))
    at = lambda c, k: F.coalesce((F.lag if k < half else F.lead)(c, abs(k - half)).over(w) if k != half else F.col(c), F.lit(0.0))
    num, den = (sum((at(c, k) * float(g) for k, g in enumerate(taps)), F.lit(0.0)) for c in ("_wv", "_w"))
    return df.withColumn(name, F.when(den > 0, num / den).otherwise(0.0)).drop("_w", "_wv")


def lee_filter(df: DataFrame, others: list[str], axis: str, v: str, half: int, d: float, name: str = "lee") -> DataFrame:
    """Mean of the neighbours along an axis whose values differ from the row's own by less than d, the row's own included; its own value if d is 0."""
    w = Window.partitionBy(*others).orderBy(axis)
    own = F.col(v)
    at = [own] + [f(v, k).over(w) for k in range(1, half + 1) for f in (F.lag, F.lead)]
    inside = [F.when(F.abs(x - own) < d, x) for x in at]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in inside), F.lit(0.0))
    count = sum((x.isNotNull().cast("int") for x in inside), F.lit(0))
    return df.withColumn(name, F.when(count > 0, total / count).otherwise(own))


def gradient_central(df: DataFrame, others: list[str], axis: str, v: str) -> DataFrame:
    """Central difference and second difference along an axis, at interior places only."""
    w = Window.partitionBy(*others).orderBy(axis)
    out = df.withColumn("_p", F.lag(v).over(w)).withColumn("_q", F.lead(v).over(w)).where("_p is not null and _q is not null")
    return out.withColumn("gradient", (F.col("_q") - F.col("_p")) / 2).withColumn("laplace", F.col("_q") - 2 * F.col(v) + F.col("_p")).drop("_p", "_q")


def autocorrelation(df: DataFrame, channel: str, t: str, v: str, lags: int) -> DataFrame:
    """(channel, lag, acf) of lags 0 to lags - 1: centred products over the first n - lags places, over that of lag 0; 1 for a constant channel.

    A channel of no more places than ``lags`` has none to sum over, and so counts as constant."""
    w = Window.partitionBy(channel)
    base = df.select(channel, (F.col(v) - F.avg(v).over(w)).alias("_c"), F.row_number().over(w.orderBy(t)).alias("_i"), F.count(F.lit(1)).over(w).alias("_n"), t)
    led = base.select(channel, "_c", "_i", "_n", *[F.lead("_c", k).over(w.orderBy(t)).alias(f"_l{k}") if k else F.col("_c").alias("_l0") for k in range(lags)])
    inside = F.col("_i") <= F.col("_n") - lags
    sums = led.groupBy(channel).agg(*[F.coalesce(F.sum(F.when(inside, F.col("_c") * F.col(f"_l{k}"))), F.lit(0.0)).alias(f"_s{k}") for k in range(lags)])
    return sums.select(channel, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.when(F.col("_s0") != 0, F.col(f"_s{k}") / F.col("_s0")).otherwise(1.0).alias("acf")) for k in range(lags)])).alias("_x")).select(channel, "_x.*")


def power_spectrum(df: DataFrame, channel: str, t: str, v: str) -> DataFrame:
    """(channel, k, power, phase) of each channel's discrete Fourier transform."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = np.fft.rfft(pdf.sort_values(t)[v].to_numpy(float))
        return pd.DataFrame({channel: pdf[channel].iloc[0], "k": np.arange(len(f)), "power": np.abs(f), "phase": np.angle(f)})

    return df.select(channel, t, v).groupBy(channel).applyInPandas(run, f"{channel} {dict(df.dtypes)[channel]}, k int, power double, phase double")
