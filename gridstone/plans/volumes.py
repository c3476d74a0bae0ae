"""Registered queries of three-dimensional grids, dense matrices and image tables, each with its SQL.

The grid has a site for each line number, quantity modulo 20 and supplier, so it grows with the tables; values are sums of whole
quantities, 0 where there are none. The matrix has a row for each nation and a column for each market segment or order priority.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.operators import dense, draws, tensor, volume
from gridstone.operators.ordered import running
from gridstone.operators.relate import grid_extent
from gridstone.plans.bindings import query, r6, t
from gridstone.state import write

VOL = """ext AS (SELECT CAST(max(s_suppkey) AS INTEGER) AS m FROM supplier), ims AS (SELECT DISTINCT l_returnflag AS im FROM lineitem),
g AS (SELECT im, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z FROM ims, (SELECT unnest(range(7)) AS x), (SELECT unnest(range(20)) AS y), (SELECT unnest(range(m)) AS z FROM ext)),
a AS (SELECT l_returnflag AS im, l_linenumber - 1 AS x, CAST(l_quantity AS INTEGER) % 20 AS y, CAST(l_suppkey - 1 AS INTEGER) AS z, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
vol AS MATERIALIZED (SELECT g.im, g.x, g.y, g.z, coalesce(q, 0.0) AS v FROM g LEFT JOIN a USING (im, x, y, z))"""


def _box(half: int, where: str = "true") -> str:
    r = f"range({-half}, {half + 1})"
    return f"""off AS (SELECT * FROM (SELECT unnest({r}) AS dx), (SELECT unnest({r}) AS dy), (SELECT unnest({r}) AS dz) WHERE {where}),
ao AS MATERIALIZED (SELECT a.im, a.x, a.y, a.z, a.v, dx, dy, dz, a.x + dx AS bx, a.y + dy AS by_, a.z + dz AS bz FROM vol a, off),
nb AS MATERIALIZED (SELECT ao.im, ao.x, ao.y, ao.z, ao.v, dx, dy, dz, b.v AS w FROM ao JOIN vol b ON b.im = ao.im AND b.x = bx AND b.y = by_ AND b.z = bz)"""


def _extent(spark: SparkSession, d: str) -> tuple[int, int, int]:
    return 7, 20, t(spark, d, "supplier").agg(F.max("s_suppkey")).first()[0]


def vol(spark: SparkSession, d: str) -> DataFrame:
    """Three grids, told apart by im."""
    sites = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("im")).distinct().crossJoin(grid_extent(spark, dict(zip(volume.AXES, _extent(spark, d)))))
    sums = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("im"), (F.col("l_linenumber") - 1).cast("int").alias("x"), F.pmod(F.col("l_quantity").cast("int"), F.lit(20)).alias("y"), (F.col("l_suppkey") - 1).cast("int").alias("z")).agg(F.sum("l_quantity").alias("v"))
    return sites.join(sums.hint("merge"), XYZ, "left").na.fill(0.0, ["v"])  # a merge: the sums' part of the file's compressed size can pass for a table to broadcast


IM = ["im"]
XYZ = ["im", *volume.AXES]


@query("box_stats_3d", f"WITH {VOL}, {_box(1)} SELECT im, x, y, z, count(*) AS n, round(avg(w), 6) AS mean, round(var_samp(w), 4) AS var FROM nb GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return volume.box_stats(vol(spark, d), "v", 1, IM).select(*XYZ, F.col("n").cast("bigint").alias("n"), r6("mean"), r6("var", 4))


def _weights(sigma: float, half: int) -> str:
    g = [2.718281828459045 ** (-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    return "CAST([" + ", ".join(repr(x / sum(g)) for x in g) + "] AS DOUBLE[])"


@query("gaussian_3d", f"WITH {VOL}, {_box(2)}, k AS (SELECT *, {_weights(0.7, 2)} AS g FROM nb) SELECT im, x, y, z, round(sum(w * g[dx + 3] * g[dy + 3] * g[dz + 3]) / sum(g[dx + 3] * g[dy + 3] * g[dz + 3]), 5) AS smooth FROM k GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return volume.gaussian(vol(spark, d), "v", 0.7, keys=IM).select(*XYZ, r6("smooth", 5))


@query("lee_3d", f"WITH {VOL}, {_box(1)} SELECT im, x, y, z, round(avg(w) FILTER (abs(w - v) < 20), 6) AS lee FROM nb GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return volume.lee(vol(spark, d), "v", 1, 20.0, keys=IM).select(*XYZ, r6("lee"))


@query("median_3d", f"WITH {VOL}, {_box(1)} SELECT im, x, y, z, median(w) AS median FROM nb GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return volume.median(vol(spark, d), "v", keys=IM).select(*XYZ, "median")


@query("rank_filter_3d", f"WITH {VOL}, {_box(1, 'dx <> 0 OR dy <> 0 OR dz <> 0')} SELECT im, x, y, z, count(*) FILTER (w > 20) >= 6 AS kept FROM nb GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return volume.rank_filter(vol(spark, d).select(*XYZ, (F.col("v") > 20).alias("m")), "m", 6, keys=IM)


#: Sites with six neighbours: those off the border.
_INNER = "inn AS (SELECT im, x, y, z FROM nb WHERE abs(dx) + abs(dy) + abs(dz) = 1 GROUP BY 1, 2, 3, 4 HAVING count(*) = 6)"


@query("subimage_3d", f"WITH {VOL}, {_box(1)}, {_INNER}, o AS (SELECT im, x, y, z, k FROM vol, (SELECT unnest(range(27)) AS k)) SELECT o.im, o.x, o.y, o.z, string_agg(CAST(CAST(CASE WHEN inn.im IS NULL THEN 0 ELSE coalesce(w, 0) END AS BIGINT) AS VARCHAR), ',' ORDER BY k) AS sub FROM o LEFT JOIN nb ON o.im = nb.im AND o.x = nb.x AND o.y = nb.y AND o.z = nb.z AND k = (dz + 1) * 9 + (dy + 1) * 3 + dx + 1 LEFT JOIN inn ON o.im = inn.im AND o.x = inn.x AND o.y = inn.y AND o.z = inn.z GROUP BY 1, 2, 3, 4")
def _(spark, d):
    sub = volume.subimage(vol(spark, d), "v", keys=IM)
    return sub.select(*XYZ, F.array_join(F.transform("sub", lambda v: v.cast("bigint")), ",").alias("sub"))


_GRAD = f"""{VOL}, {_box(1)}, gs AS (SELECT im, x, y, z, v, {', '.join(f"sum(w * d{a}) FILTER (abs(dx) + abs(dy) + abs(dz) = 1) / 2 AS g{a}" for a in "xyz")},
sum(w - v) FILTER (abs(dx) + abs(dy) + abs(dz) = 1) AS laplace, sum(w * dx * dy) FILTER (dz = 0) AS gxy, count(*) FILTER (abs(dx) + abs(dy) + abs(dz) = 1) = 6 AS inside FROM nb GROUP BY im, x, y, z, v),
gr AS (SELECT im, x, y, z, v, CASE WHEN inside THEN gx ELSE 0 END AS gx, CASE WHEN inside THEN gy ELSE 0 END AS gy, CASE WHEN inside THEN gz ELSE 0 END AS gz, CASE WHEN inside THEN laplace ELSE 0 END AS laplace, CASE WHEN inside THEN gxy ELSE 0 END AS gxy FROM gs)"""


@query("gradient_magnitude_3d", f"WITH {_GRAD} SELECT im, x, y, z, round(sqrt(gx * gx + gy * gy + gz * gz), 6) AS magnitude, laplace, gxy FROM gr")
def _(spark, d):
    return volume.gradients(vol(spark, d), "v", IM).select(*XYZ, r6("magnitude"), "laplace", "gxy")


@query("zero_crossings_3d", f"WITH {VOL}, s AS (SELECT im, x, y, z, v - 12.5 AS v FROM vol) SELECT im, x, y, z, coalesce(lead(v) OVER (PARTITION BY im, y, z ORDER BY x) * v < 0, false) OR coalesce(lead(v) OVER (PARTITION BY im, x, z ORDER BY y) * v < 0, false) OR coalesce(lead(v) OVER (PARTITION BY im, x, y ORDER BY z) * v < 0, false) AS crossing FROM s")
def _(spark, d):
    return volume.zero_crossings(vol(spark, d).withColumn("v", F.col("v") - 12.5), "v", keys=IM).select(*XYZ, "crossing")


_SIX = "abs(dx) + abs(dy) + abs(dz) = 1"


@query("diffusion_3d", f"WITH {VOL}, {_box(1, _SIX)} SELECT im, x, y, z, round(v + 0.1 * sum(exp(-((w - v) / 15) * ((w - v) / 15)) * (w - v)), 6) AS v FROM nb GROUP BY im, x, y, z, v")
def _(spark, d):
    return volume.diffuse(vol(spark, d), "v", 15.0, keys=IM).select(*XYZ, r6("v"))


def _patches(pairs: str) -> str:
    """CTE dist of table pairs (im, x, y, z, tx, ty, tz): the mean squared difference of the boxes around both sites."""
    return f"""po AS MATERIALIZED (SELECT p.*, p.x + dx AS sx, p.y + dy AS sy, p.z + dz AS sz, p.tx + dx AS ux, p.ty + dy AS uy, p.tz + dz AS uz FROM {pairs} p, off),
ps AS MATERIALIZED (SELECT po.*, s.v AS sv FROM po JOIN vol s ON s.im = po.im AND s.x = sx AND s.y = sy AND s.z = sz),
dist AS MATERIALIZED (SELECT ps.im, ps.x, ps.y, ps.z, tx, ty, tz, avg((sv - o.v) * (sv - o.v)) AS dist FROM ps JOIN vol o ON o.im = ps.im AND o.x = ux AND o.y = uy AND o.z = uz GROUP BY ALL)"""


@query("patch_distance_3d", f"""WITH {VOL}, p AS (SELECT a.im, a.x, a.y, a.z, a.x + 1 AS tx, a.y AS ty, a.z AS tz FROM vol a WHERE a.x < 6), {_box(1).split('ao AS')[0].rstrip().rstrip(',')}, {_patches('p')}
SELECT im, x, y, z, round(dist, 6) AS dist FROM dist""")
def _(spark, d):
    v = vol(spark, d)
    pairs = v.where("x < 6").select(*XYZ, (F.col("x") + 1).alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))
    return volume.patch_distance(pairs, v, "v", 1, IM).select(*XYZ, r6("dist"))


_NOISE = "ns AS (SELECT im, sum(r * r) / (42 * count(*)) AS s2 FROM (SELECT im, x, y, z, sum(v - w) AS r FROM nb WHERE abs(dx) + abs(dy) + abs(dz) = 1 GROUP BY 1, 2, 3, 4 HAVING count(*) = 6) GROUP BY 1)"
_PAIRS = f"""WITH {VOL}, {_box(1)}, {_NOISE}, st AS MATERIALIZED (SELECT im, x, y, z, v, avg(w) AS mn, var_samp(w) AS vr FROM nb GROUP BY ALL),
so AS MATERIALIZED (SELECT st.*, x + dx AS tx, y + dy AS ty, z + dz AS tz FROM st, off WHERE mn <> 0 AND vr <> 0),
p AS MATERIALIZED (SELECT so.im, so.x, so.y, so.z, tx, ty, tz FROM so JOIN st o ON o.im = so.im AND o.x = tx AND o.y = ty AND o.z = tz WHERE o.mn <> 0 AND o.vr <> 0 AND so.mn / o.mn BETWEEN 0.95 - 1e-9 AND 1 / 0.95 + 1e-9 AND so.vr / o.vr BETWEEN 0.5 - 1e-9 AND 2.0 + 1e-9),
{_patches('p')}, q AS (SELECT dist.*, o.v AS other FROM dist JOIN vol o ON o.im = dist.im AND o.x = tx AND o.y = ty AND o.z = tz)"""


@query("noise_variance_3d", f"WITH {VOL}, {_box(1)}, {_NOISE} SELECT im, round(s2, 4) AS noise FROM ns")
def _(spark, d):
    return volume.noise(vol(spark, d), "v", IM).select("im", r6("noise", 4))


@query("nonlocal_means_3d", f"""{_PAIRS},
r AS (SELECT im, x, y, z, sum(other * exp(-dist / (2 * s2))) / sum(exp(-dist / (2 * s2))) AS m FROM q JOIN ns USING (im) GROUP BY 1, 2, 3, 4) SELECT vol.im, vol.x, vol.y, vol.z, round(coalesce(m, v), 5) AS denoised FROM vol LEFT JOIN r USING (im, x, y, z)""")
def _(spark, d):
    return volume.nonlocal_means(vol(spark, d), "v", 1, 1, keys=IM).select(*XYZ, r6("denoised", 5))


@query("nonlocal_means_rician_3d", f"""{_PAIRS},
r AS (SELECT im, x, y, z, sqrt(greatest(0.0, sum(other * other * exp(-dist / (2 * s2))) / sum(exp(-dist / (2 * s2))) - 2 * any_value(s2))) AS m FROM q JOIN ns USING (im) GROUP BY 1, 2, 3, 4) SELECT vol.im, vol.x, vol.y, vol.z, round(coalesce(m, v), 5) AS denoised FROM vol LEFT JOIN r USING (im, x, y, z)""")
def _(spark, d):
    return volume.nonlocal_means(vol(spark, d), "v", 1, 1, keys=IM, rician=True).select(*XYZ, r6("denoised", 5))


_COOC = f"""{_GRAD}, h AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS m FROM gr),
b AS (SELECT *, CAST(floor(6 * v / 60) AS INTEGER) AS i, CAST(floor(4 * m / 40) AS INTEGER) AS g FROM h WHERE v >= 0 AND v < 60 AND m >= 0 AND m < 40),
o AS (SELECT * FROM (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dz) WHERE dx + dy + dz > 0),
bo AS MATERIALIZED (SELECT b.*, x + dx AS bx, y + dy AS by_, z + dz AS bz FROM b, o),
pr AS MATERIALIZED (SELECT p.im, p.i, q.i AS i2, p.g, q.g AS g2, greatest(-1.0, least(1.0, p.gx * q.gx + p.gy * q.gy + p.gz * q.gz)) AS dot FROM bo p JOIN b q ON q.im = p.im AND q.x = bx AND q.y = by_ AND q.z = bz),
k AS (SELECT im, 'intensity' AS kind, i, i2 AS j FROM pr UNION ALL SELECT im, 'gradient', g, g2 FROM pr UNION ALL SELECT im, 'angle', CAST(least(7, floor(acos(dot) * 8 / pi())) AS INTEGER), 0 FROM pr),
co AS (SELECT im, kind, i, j, count(*) / sum(count(*)) OVER (PARTITION BY im, kind) AS share FROM k GROUP BY im, kind, i, j)"""


def _cooc(spark: SparkSession, d: str, only: list[str] | None = None) -> DataFrame:
    grids = vol(spark, d) if only is None else vol(spark, d).where(F.col("im").isin(*only))
    return volume.cooccurrence(volume.gradients(grids, "v", IM), "v", "magnitude", ["gx", "gy", "gz"], {"v": (0.0, 60.0, 6), "magnitude": (0.0, 40.0, 4)}, 8, IM)


@query("cooccurrence_3d", f"WITH {_COOC} SELECT im, kind, i, j, round(share, 6) AS share FROM co")
def _(spark, d):
    return _cooc(spark, d).select("im", "kind", "i", "j", r6("share"))


@query("cooccurrence_entropy_3d", f"WITH {_COOC} SELECT im, kind, round(-sum(ln(share)), 5) AS entropy FROM co GROUP BY 1, 2")
def _(spark, d):
    return volume.cooccurrence_entropy(_cooc(spark, d), IM).select("im", "kind", r6("entropy", 5))


@query("cooccurrence_distance_3d", f"""WITH {_COOC}, ab AS (SELECT coalesce(a.share, 0) - coalesce(b.share, 0) AS diff FROM (SELECT * FROM co WHERE im = 'A') a FULL JOIN (SELECT * FROM co WHERE im = 'N') b USING (kind, i, j))
SELECT round(CASE WHEN (SELECT count(*) FROM pr WHERE im = 'A') < 120 THEN 0 ELSE (SELECT sum(abs(diff)) FROM ab) END, 6) AS dist""")
def _(spark, d):
    both, _ = write(_cooc(spark, d, ["A", "N"]))  # a row for each pair of bins, read twice
    return volume.cooccurrence_distance(both.where("im = 'A'"), both.where("im = 'N'")).select(r6("dist"))


@query("euler_3d", f"""WITH {VOL}, m AS (SELECT im, x, y, z FROM vol WHERE v > 30),
c AS (SELECT DISTINCT im, 2 * x + 1 + a AS a, 2 * y + 1 + b AS b, 2 * z + 1 + c AS c FROM m, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b), (SELECT unnest([-1, 0, 1]) AS c)),
pr AS (SELECT im, count(*) AS n FROM m p JOIN m q USING (im) WHERE (q.x = p.x + 1 AND q.y = p.y AND q.z = p.z) OR (q.x = p.x AND q.y = p.y + 1 AND q.z = p.z) OR (q.x = p.x AND q.y = p.y AND q.z = p.z + 1) GROUP BY 1),
sq AS (SELECT im, count(*) AS n FROM (SELECT p.im, p.x, p.y, p.z, f.k FROM m p, (SELECT unnest([0, 1, 2]) AS k) f JOIN m q ON q.im = p.im AND q.x - p.x IN (0, 1) AND q.y - p.y IN (0, 1) AND q.z - p.z IN (0, 1) AND (k <> 0 OR q.x = p.x) AND (k <> 1 OR q.y = p.y) AND (k <> 2 OR q.z = p.z) GROUP BY ALL HAVING count(*) = 4) GROUP BY 1),
cu AS (SELECT im, count(*) AS n FROM (SELECT p.im, p.x, p.y, p.z FROM m p JOIN m q ON q.im = p.im AND q.x - p.x IN (0, 1) AND q.y - p.y IN (0, 1) AND q.z - p.z IN (0, 1) GROUP BY ALL HAVING count(*) = 8) GROUP BY 1)
SELECT im, CAST((SELECT sum(CASE WHEN ((a % 2) + (b % 2) + (c % 2)) % 2 = 0 THEN 1 ELSE -1 END) FROM c WHERE c.im = t.im) AS BIGINT) AS c26, n - coalesce((SELECT n FROM pr WHERE pr.im = t.im), 0) + coalesce((SELECT n FROM sq WHERE sq.im = t.im), 0) - coalesce((SELECT n FROM cu WHERE cu.im = t.im), 0) AS c6 FROM (SELECT im, count(*) AS n FROM m GROUP BY 1) t""")
def _(spark, d):
    return volume.euler(vol(spark, d).where("v > 30"), IM)


_TRI = """SELECT p.im, p.x, p.y, p.z, sum(s.{v} * (CASE WHEN dx = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN dy = 1 THEN fy ELSE 1 - fy END) * (CASE WHEN dz = 1 THEN fz ELSE 1 - fz END)) AS v
FROM (SELECT im, x, y, z, x * sx - floor(x * sx) AS fx, y * sy - floor(y * sy) AS fy, z * sz - floor(z * sz) AS fz, CAST(floor(x * sx) AS INTEGER) AS lx, CAST(floor(y * sy) AS INTEGER) AS ly, CAST(floor(z * sz) AS INTEGER) AS lz
      FROM (SELECT unnest(range({nx})) AS x), (SELECT unnest(range({ny})) AS y), (SELECT unnest(range({nz})) AS z FROM ext), ims, (SELECT {rx} AS sx, {ry} AS sy, {rz} AS sz FROM ext)) p,
     (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dz), ext JOIN {t} s ON s.im = p.im AND s.x = least(lx + dx, 6) AND s.y = least(ly + dy, 19) AND s.z = least(lz + dz, m - 1) GROUP BY 1, 2, 3, 4"""


@query("rescale_3d", f"WITH {VOL}, r AS ({_TRI.format(v='v', t='vol', nx=5, ny=8, nz='m', rx='7 / 5.0', ry='20 / 8.0', rz='1.0')}) SELECT im, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, round(v, 6) AS v FROM r")
def _(spark, d):
    extent = _extent(spark, d)
    return volume.rescale(vol(spark, d), "v", extent, (5, 8, extent[2]), IM).select(*XYZ, r6("v"))


@query("pyramid_level_3d", f"WITH {VOL}, {_box(2)}, k AS (SELECT *, {_weights(0.7, 2)} AS g FROM nb), sm AS (SELECT im, x, y, z, sum(w * g[dx + 3] * g[dy + 3] * g[dz + 3]) / sum(g[dx + 3] * g[dy + 3] * g[dz + 3]) AS s FROM k GROUP BY 1, 2, 3, 4), r AS ({_TRI.format(v='s', t='sm', nx=3, ny=10, nz='m // 2', rx='7 / 3.0', ry='2.0', rz='m / CAST(m // 2 AS DOUBLE)')}) SELECT im, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, round(v, 5) AS v FROM r")
def _(spark, d):
    return volume.halve(vol(spark, d), "v", _extent(spark, d), 0.7, IM).select(*XYZ, r6("v", 5))


@query("insert_plane_3d", f"WITH {VOL} SELECT im, x, y, z, CASE WHEN z = 2 THEN 100.0 * x + y ELSE v END AS v FROM vol")
def _(spark, d):
    v = vol(spark, d)
    plane = v.where("z = 2").select("im", "x", "y", (F.col("x") * 100.0 + F.col("y")).alias("v"))
    return volume.insert_plane(v, plane, "v", 2, IM).select(*XYZ, "v")


@query("mask_clear_invert", f"WITH {VOL}, o AS (SELECT im, x, y, z, v % 2 = 0 AS m FROM vol WHERE z % 3 <> 0) SELECT vol.im, vol.x, vol.y, vol.z, NOT (v > 10 AND coalesce(o.m, false)) AS m FROM vol LEFT JOIN o USING (im, x, y, z)")
def _(spark, d):
    v = vol(spark, d)
    return volume.invert(volume.clear_where(v.select(*XYZ, (F.col("v") > 10).alias("m")), v.where("z % 3 != 0").select(*XYZ, (F.col("v") % 2 == 0).alias("m")), "m", IM), "m")


# Dense matrices: counts of customers and sums of orders by nation.

_A = "a AS (SELECT r, c, coalesce(v, 0.0) AS v FROM (SELECT * FROM (SELECT unnest(range(25)) AS r), (SELECT unnest(range(5)) AS c)) LEFT JOIN (SELECT c_nationkey AS r, CAST(ascii(c_mktsegment) % 5 AS INTEGER) AS c, CAST(count(*) AS DOUBLE) AS v FROM customer GROUP BY ALL) USING (r, c))"
_B = "b AS (SELECT r, c, coalesce(v, 0.0) AS v FROM (SELECT * FROM (SELECT unnest(range(25)) AS r), (SELECT unnest(range(5)) AS c)) LEFT JOIN (SELECT s_nationkey AS r, CAST(s_suppkey % 5 AS INTEGER) AS c, CAST(count(*) AS DOUBLE) AS v FROM supplier GROUP BY ALL) USING (r, c))"
_M = f"WITH {_A}, {_B}"
_OUT = "SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, v FROM"


def _matrix(spark: SparkSession, d: str, name: str, row: str, column) -> DataFrame:
    counts = t(spark, d, name).groupBy(F.col(row).alias("r"), column.cast("int").alias("c")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return grid_extent(spark, {"r": 25, "c": 5}).join(counts, ["r", "c"], "left").na.fill(0.0, ["v"])


def _a(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d, "customer", "c_nationkey", F.ascii("c_mktsegment") % 5)


def _b(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d, "supplier", "s_nationkey", F.col("s_suppkey") % 5)


@query("dense_combine", f"{_M} SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, a.v * b.v + a.v - b.v AS v FROM a JOIN b USING (r, c)")
def _(spark, d):
    return dense.combine(_a(spark, d), _b(spark, d), lambda x, y: x * y + x - y)


@query("dense_multiply", f"{_M} SELECT CAST(a.r AS INTEGER) AS r, CAST(b.r AS INTEGER) AS c, sum(a.v * b.v) AS v FROM a JOIN b USING (c) GROUP BY 1, 2")
def _(spark, d):
    return dense.multiply(_a(spark, d), dense.transpose(_b(spark, d)))


@query("dense_transpose_multiply", f"{_M} SELECT CAST(a.c AS INTEGER) AS r, CAST(b.c AS INTEGER) AS c, sum(a.v * b.v) AS v FROM a JOIN b USING (r) GROUP BY 1, 2")
def _(spark, d):
    return dense.transpose_multiply(_a(spark, d), _b(spark, d))


@query("dense_symmetrize", f"{_M}, g AS (SELECT a.c AS r, b.c AS c, sum(a.v * b.v) AS v FROM a JOIN b USING (r) GROUP BY 1, 2) SELECT CAST(g.r AS INTEGER) AS r, CAST(g.c AS INTEGER) AS c, (g.v + h.v) / 2 + CASE WHEN g.r = g.c THEN 7.0 ELSE 0 END AS v FROM g JOIN g h ON h.r = g.c AND h.c = g.r")
def _(spark, d):
    return dense.add_to_diagonal(dense.symmetrize(dense.transpose_multiply(_a(spark, d), _b(spark, d))), 7.0)


@query("dense_shift_columns", f"{_M} SELECT CAST(r AS INTEGER) AS r, CAST((c + 3) % 5 AS INTEGER) AS c, v FROM a")
def _(spark, d):
    return dense.shift_columns(_a(spark, d), 5, 3)


@query("dense_part", f"{_M} SELECT CAST(r - 4 AS INTEGER) AS r, CAST(c - 1 AS INTEGER) AS c, v FROM a WHERE r >= 4 AND r < 20 AND c >= 1 AND c < 4")
def _(spark, d):
    return dense.part(_a(spark, d), (4, 20), (1, 4))


@query("dense_edit_rows", f"{_M}, s AS (SELECT CASE r WHEN 2 THEN 9 WHEN 9 THEN 2 ELSE r END AS r, c, v FROM a), e AS (SELECT CASE WHEN r > 5 THEN r - 1 ELSE r END AS r, c, v FROM s WHERE r <> 5) {_OUT} (SELECT CASE WHEN r >= 1 THEN r + 1 ELSE r END AS r, c, v FROM e UNION ALL SELECT 1, c, c * 2.0 FROM (SELECT unnest(range(5)) AS c))")
def _(spark, d):
    return dense.insert_row(dense.delete_row(dense.swap_rows(_a(spark, d), 2, 9), 5), 1, F.col("c") * 2.0)


@query("dense_inverse", f"{_M}, g AS (SELECT a.c AS r, b.c AS c, sum(a.v * b.v) AS v FROM a JOIN a b USING (r) WHERE a.c < 2 AND b.c < 2 GROUP BY 1, 2), m AS (SELECT max(v) FILTER (r = 0 AND c = 0) + 1 AS p, max(v) FILTER (r = 0 AND c = 1) AS q, max(v) FILTER (r = 1 AND c = 1) + 1 AS s FROM g) SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, round(CASE WHEN r + c = 1 THEN -q WHEN r = 0 THEN s ELSE p END / (p * s - q * q), 9) AS v FROM m, (SELECT unnest([0, 1]) AS r), (SELECT unnest([0, 1]) AS c)")
def _(spark, d):
    a = dense.part(_a(spark, d), (0, 25), (0, 2))
    return dense.apply(dense.add_to_diagonal(dense.transpose_multiply(a, a), 1.0), np.linalg.inv).select("r", "c", r6("v", 9))


@query("dense_root", f"{_M}, g AS (SELECT a.c AS r, b.c AS c, sum(a.v * b.v) AS v FROM a JOIN a b USING (r) WHERE a.c < 2 AND b.c < 2 GROUP BY 1, 2), m AS (SELECT max(v) FILTER (r = 0 AND c = 0) + 1 AS p, max(v) FILTER (r = 0 AND c = 1) AS q, max(v) FILTER (r = 1 AND c = 1) + 1 AS s FROM g), k AS (SELECT *, sqrt(p * s - q * q) AS h, sqrt(p + s + 2 * sqrt(p * s - q * q)) AS t FROM m) SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, round(CASE WHEN r + c = 1 THEN q WHEN r = 0 THEN p + h ELSE s + h END / t, 6) AS v FROM k, (SELECT unnest([0, 1]) AS r), (SELECT unnest([0, 1]) AS c)")
def _(spark, d):
    a = dense.part(_a(spark, d), (0, 25), (0, 2))
    return dense.apply(dense.add_to_diagonal(dense.transpose_multiply(a, a), 1.0), dense.matrix_root).select("r", "c", r6("v"))


@query("least_squares", "SELECT 'slope' AS name, round(regr_slope(l_extendedprice, l_quantity), 4) AS v FROM lineitem UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 3) FROM lineitem")
def _(spark, d):
    w = dense.least_squares(t(spark, d, "lineitem").withColumn("one", F.lit(1.0)), ["one", "l_quantity"], "l_extendedprice")
    return spark.createDataFrame([("slope", round(float(w[1]), 4)), ("intercept", round(float(w[0]), 3))], "name string, v double")


@query("greedy_assignment")
def _(spark, d):
    return dense.greedy_assignment(_a(spark, d))


# Tensors: a signal for each of seven directions of a part.

_DIRECTIONS = [(1.0, 0.0, 0.0, 1.0), (0.0, 1.0, 0.0, 1.0), (0.0, 0.0, 1.0, 1.0), (0.6, 0.8, 0.0, 2.0), (0.6, 0.0, 0.8, 2.0), (0.0, 0.6, 0.8, 2.0), (0.48, 0.6, 0.64, 3.0)]


def _fit_sql() -> str:
    x, y, z, b = (np.array(c) for c in zip(*_DIRECTIONS))
    rows = np.stack([b * x * x, 2 * b * x * y, 2 * b * x * z, b * y * y, 2 * b * y * z, b * z * z], axis=1)
    p = np.linalg.solve(rows.T @ rows, rows.T)  # full rank: the normal equations
    parts = ", ".join("CAST(" + " + ".join(f"({w!r}) * r[{i + 1}]" for i, w in enumerate(row.tolist())) + f" AS DOUBLE) AS {n}" for n, row in zip(("txx", "txy", "txz", "tyy", "tyz", "tzz"), p))
    rates = ", ".join(f"(ln(CAST(100 AS DOUBLE)) - ln(s[{i + 1}])) / {d[3]}" for i, d in enumerate(_DIRECTIONS))
    return f"""WITH s AS (SELECT p_partkey, [CASE WHEN (p_partkey + i) % 11 = 0 THEN 0.01 ELSE 100 * exp(-(p_size + (p_partkey * (i + 3)) % 17) / CAST(20 AS DOUBLE)) END FOR i IN range(7)] AS s FROM part),
r AS (SELECT p_partkey, [{rates}] AS r FROM s), f AS (SELECT p_partkey, {parts} FROM r),
q AS (SELECT *, txx + tyy + tzz AS tr, txx * txx + tyy * tyy + tzz * tzz + 2 * (txy * txy + txz * txz + tyz * tyz) AS sq FROM f)
SELECT p_partkey, round(txx, 6) AS txx, round(tyz, 6) AS tyz, round(CASE WHEN sq > 0.1 THEN least(1.0, sqrt(greatest(0.0, 1.5 * (sq - tr * tr / 3)) / sq)) ELSE 0 END, 6) AS fa FROM q"""


@query("tensor_fit", _fit_sql())
def _(spark, d):
    k = F.col("p_partkey")
    signals = {f"s{i}": F.when((k + i) % 11 == 0, 0.0).otherwise(100 * F.exp(-(F.col("p_size") + (k * (i + 3)) % 17) / F.lit(20.0))) for i in range(7)}
    fitted = tensor.fit(t(spark, d, "part").select("p_partkey", F.lit(100.0).alias("s"), *[c.alias(n) for n, c in signals.items()]), list(signals), "s", _DIRECTIONS)
    return tensor.anisotropy(fitted).select("p_partkey", r6("txx"), r6("tyz"), r6("fa"))


# Image tables and draws.

@query("image_mean", f"WITH {VOL}, w AS (SELECT im, x, y, z, v * 3 + 1 AS v FROM vol) SELECT im, x, y, z, (vol.v + w.v) / 2 AS mean FROM vol JOIN w USING (im, x, y, z)")
def _(spark, d):
    v = vol(spark, d)
    other = v.select(*XYZ, (F.col("v") * 3 + 1).alias("_w"))
    return v.join(other, XYZ).select(*XYZ, ((F.col("v") + F.col("_w")) / 2).alias("mean"))


@query("merge_class", "SELECT p_partkey, CASE WHEN p_size % 6 = 5 THEN 4 ELSE p_size % 6 END AS class FROM part")
def _(spark, d):
    k = F.col("p_size") % 6
    return t(spark, d, "part").select("p_partkey", F.when(k == 5, 4).otherwise(k).alias("class"))


@query("image_gradient_join", f"WITH {VOL}, gt AS (SELECT n_nationkey AS dir, n_nationkey % 3 AS shell, (n_nationkey + 1) / 10.0 AS b FROM nation WHERE n_nationkey < 7) SELECT im, x AS dir, shell, round(sum(v * b), 4) AS weighted, count(*) AS sites FROM vol JOIN gt ON dir = x GROUP BY 1, 2, 3")
def _(spark, d):
    n = F.col("n_nationkey")
    table = t(spark, d, "nation").where("n_nationkey < 7").select(n.alias("dir"), (n % 3).alias("shell"), ((n + 1) / 10.0).alias("b"))
    met = vol(spark, d).withColumnRenamed("x", "dir").join(table, "dir")
    return met.groupBy("im", "dir", "shell").agg(F.round(F.sum(F.col("v") * F.col("b")), 4).alias("weighted"), F.count(F.lit(1)).alias("sites"))


@query("drop_empty_rows", f"WITH {VOL}, i AS (SELECT *, x + 7 * (y + 20 * CAST(z AS BIGINT)) AS idx FROM vol) SELECT im, idx, v, round(ln(v), 6) AS log_v, row_number() OVER (ORDER BY idx, im) - 1 AS kept FROM i WHERE v <> 0")
def _(spark, d):
    i = vol(spark, d).withColumn("idx", F.col("x") + 7 * (F.col("y") + 20 * F.col("z").cast("bigint"))).where("v != 0")
    return running(i, ["idx", "im"], {"kept": F.lit(1)}).select("im", "idx", "v", F.round(F.log("v"), 6).alias("log_v"), (F.col("kept") - 1).cast("bigint").alias("kept"))


@query("sort_vector", "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS up, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey DESC) - 1 AS down FROM customer")
def _(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    both = running(running(c, ["c_acctbal", "c_custkey"], {"up": F.lit(1)}), ["c_acctbal", "c_custkey"], {"down": F.lit(1)}, ascending=False)
    return both.select("c_custkey", "c_acctbal", *[(F.col(n) - 1).cast("bigint").alias(n) for n in ("up", "down")])


_DRAW = "CAST('0x' || md5({seed} || ':' || {key})[1:15] AS BIGINT)"


@query("random_permutation", f"SELECT c_custkey, row_number() OVER (ORDER BY {_DRAW.format(seed=7, key='c_custkey')}, c_custkey) - 1 AS place FROM customer")
def _(spark, d):
    return draws.permutation(t(spark, d, "customer").select("c_custkey"), "c_custkey", 7)


@query("bootstrap_counts", f"WITH n AS (SELECT count(*) AS n FROM customer), k AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer), d AS (SELECT {_DRAW.format(seed=11, key='j')} % n AS i FROM (SELECT n, unnest(range(n)) AS j FROM n)) SELECT c_custkey, count(*) AS draws FROM d JOIN k USING (i) GROUP BY 1")
def _(spark, d):
    return draws.bootstrap(t(spark, d, "customer").select("c_custkey"), "c_custkey", 11)


@query("foreground_sample", f"WITH {VOL}, f AS (SELECT *, im || '/' || x || '/' || y || '/' || z AS site FROM vol WHERE v > 0) SELECT im, x, y, z FROM f QUALIFY row_number() OVER (ORDER BY {_DRAW.format(seed=5, key='site')}, site) <= least(50000, (SELECT count(*) // 10 FROM f))")
def _(spark, d):
    f, _ = write(vol(spark, d).where("v > 0").withColumn("site", F.concat_ws("/", *XYZ)))  # counted twice and drawn from
    return draws.sample(f, "site", min(50_000, f.count() // 10), 5).select(*XYZ)
