"""Registered queries of masks, their components and labels, over the grids of ``volumes``. One has SQL; tests hold the rest against flood fills and hand-worked values."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridstone.operators import masks, volume
from gridstone.plans.bindings import query
from gridstone.plans.volumes import IM, VOL, XYZ, vol


def _smooth(spark, d):
    return volume.gaussian(vol(spark, d), "v", 1.0, keys=IM)


@query("component_sizes_3d")
def _(spark, d):
    """Parts of the sites with more than 30 pieces, with their first site, size and whether they reach the border."""
    parts = masks.components(vol(spark, d).withColumn("m", F.col("v") > 30), "m", IM)
    return parts.groupBy("im", F.col("root.z").alias("z"), F.col("root.y").alias("y"), F.col("root.x").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.bool_or("rim").alias("rim"))


_TWO = f"""WITH {VOL}, r AS (SELECT im, CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM vol GROUP BY 1),
b AS (SELECT vol.im, x, y, z, CAST(CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 64), 63) ELSE 0 END AS INTEGER) AS b FROM vol JOIN r USING (im)),
h AS (SELECT im, b, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY 1, 2), c AS (SELECT unnest(range(65)) AS c),
s AS (SELECT im, c, b >= c AS up, sum(n * b * b) - sum(n * b) * sum(n * b) / sum(n) AS ss FROM h, c GROUP BY 1, 2, 3),
q AS (SELECT im, c, round(sum(ss), 6) AS ss FROM s GROUP BY 1, 2), k AS (SELECT im, c, row_number() OVER (PARTITION BY im ORDER BY ss, c DESC) AS k FROM q)"""


@query("two_classes_3d", f"{_TWO} SELECT b.im, x, y, z, CAST(b >= c AS INTEGER) AS class FROM b JOIN k ON b.im = k.im AND k = 1")
def _(spark, d):
    return masks.histogram_classes(vol(spark, d), "v", 64, 2, IM).select(*XYZ, "class")


@query("foreground_mask")
def _(spark, d):
    return masks.foreground(_smooth(spark, d).select(*XYZ, "v", "smooth"), ["smooth"], IM).select(*XYZ, "mask")


@query("brain_mask")
def _(spark, d):
    return masks.brain_mask(_smooth(spark, d), "smooth", 0.5, 1.0, IM).select(*XYZ, "mask")


@query("tissue_labels")
def _(spark, d):
    """Foreground sites of each grid in three tissues by smoothed sums and their box means."""
    grid = _smooth(spark, d).select(*XYZ, "smooth")
    wide = volume.box_stats(grid, "smooth", 1, IM).select(*XYZ, "smooth", F.col("mean").alias("wide"))
    fore = masks.foreground(wide, ["wide", "smooth"], IM)
    return masks.segment(fore, ["smooth", "wide"], "smooth", "mask", IM).select(*XYZ, "mask", "tissue")
