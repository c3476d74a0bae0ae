"""Running sums and minima over a whole ordered table without a task that holds all of it.

Rows are dealt into ranges of a key by literal cut points, which a bounded sample of keys gives: the sample bears on the ranges' sizes
only, and equal keys share a range. Each range is summed up in one row; the running values over these few rows are joined
back, and the rest is a window inside each range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Different keys that cut points are taken from, about: those whose hash is under a share of its range; and ranges at most.
SAMPLE, RANGES = 20_000, 400


def rank_among(cuts: list[Column], x: Column) -> Column:
    """Number of cut points, which are in order, at or below a value: those of every k-th cut first, then one stretch between two of them, so a row meets about 2 sqrt(n) of n."""
    if not cuts:
        return F.lit(0)
    k = math.isqrt(len(cuts) - 1) + 1
    below = lambda among: F.size(F.filter(among, lambda c: c <= x))
    at = below(F.array(*cuts[::k]))
    stretches = F.array(*[F.array(*cuts[i:i + k]) for i in range(0, len(cuts), k)])
    return F.when(at == 0, 0).otherwise((at - 1) * k + below(F.get(stretches, at - 1)))


def ranges(df: DataFrame, key: str, name: str = "_range") -> DataFrame:
    """``df`` with the number of its range, in the order of ``key``; null keys are in the first one."""
    spark = df.sparkSession
    parts = min(RANGES, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    different = df.agg(F.approx_count_distinct(key)).first()[0]
    few = F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, different)))
    keys = sorted(r[0] for r in df.select(key).where(F.col(key).isNotNull() & few).distinct().collect())
    cuts = sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if len(keys) > 1 else []
    if not cuts:
        return df.withColumn(name, F.lit(0))
    kind = df.schema[key].dataType
    return df.withColumn(name, F.when(F.col(key).isNull(), 0).otherwise(rank_among([F.lit(c).cast(kind) for c in cuts], F.col(key))))


def running(df: DataFrame, order: list[str], sums: dict[str, Column] | None = None, least: dict[str, Column] | None = None, ascending: bool = True) -> DataFrame:
    """``df`` with the sums and minima of expressions over all rows up to each one, in the order of ``order`` (or down to it)."""
    dealt = ranges(df, order[0])
    made = {n: (F.sum, c) for n, c in (sums or {}).items()} | {n: (F.min, c) for n, c in (least or {}).items()}
    way = (lambda c: F.asc(c)) if ascending else (lambda c: F.desc(c))
    whole = dealt.groupBy("_range").agg(*[f(c).alias(f"_all_{n}") for n, (f, c) in made.items()])
    before = Window.orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    whole = whole.select("_range", *[f(f"_all_{n}").over(before).alias(f"_before_{n}") for n, (f, _) in made.items()])
    inside = Window.partitionBy("_range").orderBy(*map(way, order)).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({n: f(c).over(inside) for n, (f, c) in made.items()}).join(F.broadcast(whole), "_range")
    joint = {n: F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0)) if f is F.sum else F.least(F.col(n), F.col(f"_before_{n}")) for n, (f, _) in made.items()}
    return out.withColumns(joint).drop("_range", *[f"_before_{n}" for n in made])
