"""Schemas and index arithmetic of the grid tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOXEL = T.StructType.fromDDL("image_id string, channel int, idx bigint, x int, y int, z int, value double")
SIGNAL = T.StructType.fromDDL("channel int, t bigint, v double")
NODES = T.StructType.fromDDL("id bigint, weight double")
EDGES = T.StructType.fromDDL("src bigint, dst bigint, weight double")
COO = T.StructType.fromDDL("r bigint, c bigint, v double")
VERTEX = T.StructType.fromDDL("id bigint, x double, y double, z double, nx double, ny double, nz double, val double")
TRIANGLE = T.StructType.fromDDL("id bigint, a bigint, b bigint, c bigint")
BUNDLE = T.StructType.fromDDL("seq int, tag string, attrs map<string,string>, repn string, data binary")


def index_of(x: Column, y: Column, z: Column, nx: int, ny: int) -> Column:
    """Linear index of a site, x fastest."""
    return ((z * ny + y) * nx + x).cast("bigint")


def site_of(idx: Column, nx: int, ny: int) -> tuple[Column, Column, Column]:
    """Site of a linear index."""
    return F.pmod(idx, F.lit(nx)), F.pmod(F.floor(idx / nx), F.lit(ny)), F.floor(idx / (nx * ny))
