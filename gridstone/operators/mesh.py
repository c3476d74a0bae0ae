"""Triangle meshes as vertex (id, x, y, z) and triangle (id, a, b, c) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.operators.elementwise import cross, vector_norm


def corners(tri: DataFrame) -> DataFrame:
    """(id, corner, vertex): which vertices a triangle has."""
    return tri.select("id", F.posexplode(F.array("a", "b", "c")).alias("corner", "vertex"))


def edges(tri: DataFrame) -> DataFrame:
    """(u, v, n): each edge once, with the number of triangles at it; loops of degenerate triangles are left out."""
    pairs = F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("a", "c"))])
    return tri.select(F.explode(F.array_distinct(pairs)).alias("e")).select("e.u", "e.v").where("u != v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))


def euler(tri: DataFrame) -> DataFrame:
    """Vertices, edges, faces and V - E + F."""
    v = corners(tri).agg(F.countDistinct("vertex").alias("v"))
    e = edges(tri).agg(F.count(F.lit(1)).alias("e"))
    return v.crossJoin(e).crossJoin(tri.agg(F.count(F.lit(1)).alias("f"))).withColumn("euler", F.col("v") - F.col("e") + F.col("f"))


def with_corners(vertices: DataFrame, tri: DataFrame) -> DataFrame:
    out = tri
    for k in "abc":
        out = out.join(vertices.select(F.col("id").alias(k), *[F.col(x).alias(f"{k}{x}") for x in "xyz"]), k)
    return out


def faces(vertices: DataFrame, tri: DataFrame) -> DataFrame:
    """(id, area, nx, ny, nz, cx, cy, cz): area, unit normal (0 where degenerate) and centre of each triangle."""
    t = with_corners(vertices, tri)
    u, v = ([F.col(f"{k}{x}") - F.col(f"a{x}") for x in "xyz"] for k in "bc")
    n = cross(u, v)
    size = vector_norm(n)
    unit = [F.when(size > 0, c / size).otherwise(0.0).alias(f"n{x}") for c, x in zip(n, "xyz")]
    centre = [((F.col(f"a{x}") + F.col(f"b{x}") + F.col(f"c{x}")) / 3).alias(f"c{x}") for x in "xyz"]
    return t.select("id", (0.5 * size).alias("area"), *unit, *centre)


def laplacian_step(vertices: DataFrame, tri: DataFrame, rate: float) -> DataFrame:
    """Vertices moved towards the mean of their neighbours."""
    e = edges(tri).select("u", "v")
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.join(vertices.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(*[F.avg(x).alias(f"_{x}") for x in "xyz"])
    return vertices.join(near, "id", "left").select("id", *[(F.col(x) + rate * (F.coalesce(f"_{x}", x) - F.col(x))).alias(x) for x in "xyz"])
