"""Rearrangement of grids: flips, transposes, crops, pastes, interpolation, noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flip(df: DataFrame, axis: str, size: int) -> DataFrame:
    return df.withColumn(axis, (size - 1 - F.col(axis)).cast(df.schema[axis].dataType))


def transpose(df: DataFrame, order: dict[str, str]) -> DataFrame:
    """Axes renamed by {new: old}."""
    kept = [c for c in df.columns if c not in order.values()]
    return df.select(*kept, *[F.col(old).alias(new) for new, old in order.items()])


def cut(df: DataFrame, low: dict[str, int], high: dict[str, int]) -> DataFrame:
    """The box low <= site <= high, moved to the origin."""
    out = df
    for a in low:
        out = out.where((F.col(a) >= low[a]) & (F.col(a) <= high[a]))
    for a in low:
        out = out.withColumn(a, (F.col(a) - low[a]).cast(df.schema[a].dataType))
    return out


def paste(small: DataFrame, grid: DataFrame, origin: dict[str, int], value: str) -> DataFrame:
    """The small grid's values over the large one's at an origin."""
    axes = list(origin)
    moved = small.select(*[(F.col(a) + origin[a]).cast(grid.schema[a].dataType).alias(a) for a in axes], F.col(value).alias("_new"))
    return grid.join(moved, axes, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def interpolate(grid: DataFrame, points: DataFrame, axes: list[str], value: str, id_col: str) -> DataFrame:
    """(id, value): multilinear interpolation at real coordinates; corners meet the grid by equi-join, those outside count 0."""
    corners = [[]]
    for _ in axes:
        corners = [c + [d] for c in corners for d in (0, 1)]
    base = points.select(id_col, *[F.floor(F.col(a)).cast("int").alias(f"_f_{a}") for a in axes], *[(F.col(a) - F.floor(F.col(a))).alias(f"_r_{a}") for a in axes])

    def weight(c: list[int]) -> Column:
        w = F.lit(1.0)
        for a, d in zip(axes, c):
            w = w * (F.col(f"_r_{a}") if d else 1 - F.col(f"_r_{a}"))
        return w

    met = base.select(id_col, F.explode(F.array(*[F.struct(*[(F.col(f"_f_{a}") + d).alias(a) for a, d in zip(axes, c)], weight(c).alias("_w")) for c in corners])).alias("s")).select(id_col, *[F.col(f"s.{a}").cast(grid.schema[a].dataType).alias(a) for a in axes], "s._w")
    return met.join(grid.select(*axes, value), axes, "left").groupBy(id_col).agg(F.sum(F.col("_w") * F.coalesce(value, F.lit(0.0))).alias(value))


def noise_variance(grid: DataFrame, axes: list[str], value: str) -> DataFrame:
    """Mean squared pseudo-residual of interior sites: (2 d v - sum of axis neighbours)^2 / (2 d (2 d + 1)); 42 in three dimensions."""
    from gridstone.operators.relate import neighbours

    d = len(axes)
    steps = [tuple(s if i == k else 0 for i in range(d)) for k in range(d) for s in (-1, 1)]
    sums = neighbours(grid, axes, value, steps).groupBy(*axes).agg(F.first(value).alias("_v"), F.sum("neighbour").alias("_s"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 2 * d)
    r = 2 * d * F.col("_v") - F.col("_s")
    return sums.agg(F.avg(r * r / (2 * d * (2 * d + 1))).alias("noise"))


def subsample(df: DataFrame, axes: list[str], step: int) -> DataFrame:
    for a in axes:
        df = df.where(F.col(a) % step == 0)
    return df
