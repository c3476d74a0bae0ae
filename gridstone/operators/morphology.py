"""Morphology and labelling of masks: sites are rows with integer axes; neighbours meet by equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.operators.graph import component_roots
from gridstone.operators.relate import offsets


def _shifted(sites: DataFrame, axes: list[str], steps: list[tuple[int, ...]]) -> DataFrame:
    step = F.explode(F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip(axes, s)]) for s in steps])).alias("_o")
    return sites.select(*[F.col(a).alias(f"_{a}") for a in axes], step).select(*[(F.col(f"_{a}") + F.col(f"_o.{a}")).cast(sites.schema[a].dataType).alias(a) for a in axes])


def _ball(dist: float, dims: int) -> list[tuple[int, ...]]:
    from itertools import product

    r = int(dist)
    return [o for o in product(range(-r, r + 1), repeat=dims) if sum(x * x for x in o) <= dist * dist]


def dilate(mask: DataFrame, axes: list[str], dist: float, grid: DataFrame) -> DataFrame:
    """Sites of the grid within a distance of the mask."""
    return _shifted(mask.select(*axes), axes, _ball(dist, len(axes))).distinct().join(grid.select(*axes), axes, "left_semi")


def erode(mask: DataFrame, axes: list[str], dist: float, grid: DataFrame) -> DataFrame:
    """Sites of the mask farther than a distance from all other sites of the grid."""
    outside = grid.select(*axes).join(mask.select(*axes), axes, "left_anti")
    return mask.select(*axes).join(_shifted(outside, axes, _ball(dist, len(axes))).distinct(), axes, "left_anti")


def opened(mask: DataFrame, axes: list[str], dist: float, grid: DataFrame) -> DataFrame:
    return dilate(erode(mask, axes, dist, grid), axes, dist, grid)


def closed(mask: DataFrame, axes: list[str], dist: float, grid: DataFrame) -> DataFrame:
    return erode(dilate(mask, axes, dist, grid), axes, dist, grid)


def boundary(mask: DataFrame, axes: list[str], grid: DataFrame, connectivity: int = 6) -> DataFrame:
    """Sites of the mask with a neighbour inside the grid and outside the mask."""
    outside = grid.select(*axes).join(mask.select(*axes), axes, "left_anti")
    return mask.select(*axes).join(_shifted(outside, axes, offsets(connectivity, len(axes))).distinct(), axes, "left_semi")


def label(mask: DataFrame, axes: list[str], sizes: list[int], connectivity: int = 6) -> DataFrame:
    """Sites with ``root``, the smallest linear index of their connected component."""
    idx, stride = F.lit(0).cast("bigint"), 1
    for a, n in zip(axes, sizes):
        idx, stride = idx + F.col(a).cast("bigint") * stride, stride * n
    nodes = mask.select(*axes, idx.alias("id"))
    step = [s for s in offsets(connectivity, len(axes)) if s > (0,) * len(axes)]
    moved = nodes.select("id", *axes, F.explode(F.array(*[F.struct(*[F.lit(d).alias(f"o_{a}") for a, d in zip(axes, s)]) for s in step])).alias("o"))
    moved = moved.select(F.col("id").alias("src"), *[(F.col(a) + F.col(f"o.o_{a}")).cast(mask.schema[a].dataType).alias(a) for a in axes])
    edges = moved.join(nodes.withColumnRenamed("id", "dst"), axes).select("src", "dst")
    return nodes.join(component_roots(nodes.select("id"), edges), "id").select(*axes, "root")


def largest(labels: DataFrame, axes: list[str]) -> DataFrame:
    """Sites of the largest component, the smaller root of ties."""
    top = labels.groupBy("root").count().agg(F.max_by("root", F.struct("count", -F.col("root"))).alias("root"))
    return labels.join(F.broadcast(top), "root", "left_semi").select(*axes)


def fill_holes(mask: DataFrame, axes: list[str], sizes: list[int], grid: DataFrame) -> DataFrame:
    """The mask and every background component that doesn't touch the border."""
    outside = grid.select(*axes).join(mask.select(*axes), axes, "left_anti")
    parts = label(outside, axes, sizes)
    edge = F.lit(False)
    for a, n in zip(axes, sizes):
        edge = edge | (F.col(a) == 0) | (F.col(a) == n - 1)
    open_ = parts.where(edge).select("root").distinct()
    return mask.select(*axes).unionByName(parts.join(open_, "root", "left_anti").select(*axes))


def distance_transform(mask: DataFrame, axes: list[str], grid: DataFrame, most: int) -> DataFrame:
    """Sites of the grid within ``most`` of the mask with their Euclidean distance to it."""
    step = F.explode(F.array(*[F.struct(*[F.lit(d).alias(f"o_{a}") for a, d in zip(axes, s)], F.lit(float(sum(x * x for x in s))).alias("d2")) for s in _ball(most, len(axes))])).alias("o")
    moved = mask.select(*[F.col(a).alias(f"_{a}") for a in axes], step).select(*[(F.col(f"_{a}") + F.col(f"o.o_{a}")).cast(mask.schema[a].dataType).alias(a) for a in axes], "o.d2")
    return moved.groupBy(*axes).agg(F.sqrt(F.min("d2")).alias("distance")).join(grid.select(*axes), axes, "left_semi")
