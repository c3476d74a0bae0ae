"""Draws that a seed and the rows' keys decide: the same rows give the same draws, however they are dealt out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.operators.ordered import running
from gridstone.state import remove, write

#: Draws are under this.
DRAWS = 1 << 60


def draw(key: Column, seed: int) -> Column:
    """A whole number from 0 to 2^60 - 1 for each key: the first 15 hex digits of the md5 of ``seed:key``."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def permutation(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """``df`` with the place of each row, from 0, in an order drawn from the seed; rows of one key follow one another. Ranks go over ranges of the draws."""
    drawn = df.withColumn("_draw", F.coalesce(draw(F.col(key), seed), F.lit(-1)))
    return running(drawn, ["_draw", key], {name: F.lit(1)}).withColumn(name, (F.col(name) - 1).cast("bigint")).drop("_draw")


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, or all if there are fewer: those of the least draws.

    Draws are even, so a bound that somewhat more than ``n`` rows are under is told by their number; the rows under it are written and counted,
    and only these are ranked. Where they are too few after all, as with many rows of one key, the bound is doubled.
    """
    rows = df.count()
    if n >= rows:
        return df
    spark, bound = df.sparkSession, min(1.0, (n + 6 * math.sqrt(n) + 10) / rows)
    drawn = df.withColumn("_draw", F.coalesce(draw(F.col(key), seed), F.lit(-1)))
    few, path = write(drawn.where(F.col("_draw") < int(bound * DRAWS)))
    while few.count() < n:
        remove(spark, path)
        bound *= 2
        few, path = write(drawn.where(F.col("_draw") < int(bound * DRAWS)))
    return running(few, ["_draw", key], {"_place": F.lit(1)}).where(F.col("_place") <= n).drop("_place", "_draw")


def bootstrap(df: DataFrame, key: str, seed: int, n: int | None = None, name: str = "draws") -> DataFrame:
    """The rows that ``n`` draws with replacement (as many as there are rows, if not told) hit, with the number of draws that each got.

    Rows are numbered from 0 in the order of the key, and draw i takes row number draw(i) modulo their number.
    """
    rows = df.count()
    if not rows:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    numbered = running(df, [key], {"_at": F.lit(1)}).withColumn("_at", (F.col("_at") - 1).cast("bigint"))
    hits = df.sparkSession.range(rows if n is None else n).select((draw(F.col("id"), seed) % rows).alias("_at")).groupBy("_at").agg(F.count(F.lit(1)).alias(name))
    return numbered.join(hits, "_at").drop("_at")
