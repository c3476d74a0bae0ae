"""Filters and measures of dense three-dimensional grids, kept as rows (keys, x, y, z, value).

``keys`` are the columns that tell the grids of an image table apart; no filter looks from one grid into another. What needs the values
around a site goes over bricks with rims (``bricks``), one shuffle a filter. Neighbours are those at the places beside a
site: where a place has no site, or a null value, it is left out, so a grid needs no border and may have holes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstone.operators import bricks
from gridstone.operators.bricks import AXES, brick_tables, over_bricks, shifted
from gridstone.operators.sequence import gaussian_taps

Keys = Iterable[str]


def _offsets(half: int, kept=lambda o: True) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(k).alias(f"d{a}") for a, k in zip(AXES, o)]) for o in product(range(-half, half + 1), repeat=3) if kept(o)])).alias("_o")


def around(df: DataFrame, values: list[str], half: int = 1, kept=lambda o: True, keys: Keys = ()) -> DataFrame:
    """``df`` beside each row of the box of ``half`` around a site: dx, dy, dz and the other's values, named with an underscore before."""
    there = df.select(*keys, *AXES, *values, _offsets(half, kept))
    there = there.select(*keys, *[(F.col(a) - F.col(f"_o.d{a}")).cast(df.schema[a].dataType).alias(a) for a in AXES], *[F.col(v).alias(f"_{v}") for v in values], *[F.col(f"_o.d{a}").alias(f"d{a}") for a in AXES])
    return df.join(there, [*keys, *AXES])


def box_stats(df: DataFrame, v: str, half: int, keys: Keys = ()) -> DataFrame:
    """n, mean and sample variance (0 for one site) over the box around each site; squares are taken about the box's mean."""
    def f(arrays):
        return dict(zip(("n", "mean", "var"), bricks.box_stats(arrays[v], half)))

    return over_bricks(df, [v], half, f, {"n": "bigint", "mean": "double", "var": "double"}, keys)


def gaussian(df: DataFrame, v: str, sigma: float, name: str = "smooth", keys: Keys = (), mask: str | None = None) -> DataFrame:
    """Separable Gaussian; weights outside the grid, or where the boolean column ``mask`` is not true, are made up for by the rest. A site off the mask keeps its value."""
    taps = np.array(gaussian_taps(sigma))
    half = len(taps) // 2

    def f(arrays):
        held = np.isfinite(arrays[v]) & (True if mask is None else arrays[mask] == 1)
        sums = [np.where(held, arrays[v], 0.0), held.astype(float)]
        for axis in range(3):
            sums = [sum((g * shifted(s, tuple(k - half if i == axis else 0 for i in range(3)), 0) for k, g in enumerate(taps)), np.zeros_like(s)) for s in sums]
        return {name: np.where(held, sums[0] / np.where(held, sums[1], 1.0), arrays[v])}

    df = df if mask is None else df.withColumn(mask, F.col(mask).cast("double"))
    return over_bricks(df, [v] if mask is None else [v, mask], half, f, {name: "double"}, keys)


def lee(df: DataFrame, v: str, half: int, d: float, name: str = "lee", keys: Keys = ()) -> DataFrame:
    """Mean of the box's values that differ from the site's by less than d; the site's own if there is none."""
    def f(arrays):
        a = arrays[v]
        total, n = np.zeros_like(a), np.zeros_like(a)
        for o in bricks.box(half):
            other = shifted(a, o)
            near = np.abs(other - a) < d
            total += np.where(near, other - a, 0.0)
            n += near
        return {name: a + total / np.maximum(n, 1)}

    return over_bricks(df, [v], half, f, {name: "double"}, keys)


def median(df: DataFrame, v: str, half: int = 1, name: str = "median", keys: Keys = ()) -> DataFrame:
    return over_bricks(df, [v], half, lambda arrays: {name: bricks.medians(arrays[v], half)}, {name: "double"}, keys)


def rank_filter(df: DataFrame, mask: str, least: int, name: str = "kept", keys: Keys = ()) -> DataFrame:
    """A mask that holds where ``least`` or more of the 26 neighbours are in the mask. The rule is this library's own."""
    def f(arrays):
        a = arrays["_m"] == 1
        return {name: sum((shifted(a, o, False) for o in bricks.box(1) if any(o)), np.zeros(a.shape, int)) >= least}

    flags = df.select(*keys, *AXES, F.coalesce(F.col(mask), F.lit(False)).cast("double").alias("_m"))
    return over_bricks(flags, ["_m"], 1, f, {name: "boolean"}, keys).drop("_m")


def subimage(df: DataFrame, v: str, name: str = "sub", keys: Keys = ()) -> DataFrame:
    """The 27 values around each site as an array, x fastest; all 0 for a site on the border of the grid (one of its six neighbours is absent)."""
    def f(arrays):
        a = arrays[v]
        near = np.stack([np.nan_to_num(shifted(a, (i, j, k))) for k in (-1, 0, 1) for j in (-1, 0, 1) for i in (-1, 0, 1)], axis=-1)
        return {name: np.where(bricks.inner(a)[..., None], near, 0.0)}

    return over_bricks(df, [v], 1, f, {name: "array<double>"}, keys)


def gradients(df: DataFrame, v: str, keys: Keys = ()) -> DataFrame:
    """Central differences gx, gy, gz (halved), their magnitude, the Laplacian, and the corner differences gxy, gxz, gyz (not divided); all 0 on the border of the grid."""
    names = ("gx", "gy", "gz", "laplace", "gxy", "gxz", "gyz", "magnitude")

    def f(arrays):
        a = arrays[v]
        at = lambda **o: shifted(a, tuple(o.get(n, 0) for n in AXES))
        step = [(at(**{n: 1}) - at(**{n: -1})) / 2 for n in AXES]
        bend = sum(at(**{n: 1}) - 2 * a + at(**{n: -1}) for n in AXES)
        cross = [at(**{m: 1, n: 1}) - at(**{m: 1, n: -1}) - at(**{m: -1, n: 1}) + at(**{m: -1, n: -1}) for m, n in (("x", "y"), ("x", "z"), ("y", "z"))]
        inside = bricks.inner(a)
        found = [*step, bend, *cross, np.sqrt(sum(g * g for g in step))]
        return {n: np.where(inside, np.nan_to_num(g), 0.0) for n, g in zip(names, found)}

    return over_bricks(df, [v], 1, f, dict.fromkeys(names, "double"), keys)


def zero_crossings(df: DataFrame, v: str, name: str = "crossing", keys: Keys = ()) -> DataFrame:
    """True where a value and the next one along an axis have unlike signs. The rule is this library's own."""
    def f(arrays):
        a = arrays[v]
        return {name: (shifted(a, (1, 0, 0)) * a < 0) | (shifted(a, (0, 1, 0)) * a < 0) | (shifted(a, (0, 0, 1)) * a < 0)}

    return over_bricks(df, [v], 1, f, {name: "boolean"}, keys)


def diffuse(df: DataFrame, v: str, kappa: float, rate: float = 0.1, rounds: int = 1, keys: Keys = ()) -> DataFrame:
    """Anisotropic diffusion: each round adds rate times the sum of exp(-(d / kappa)^2) d over the differences d to the six neighbours. The rule is this library's own.

    The rim is as wide as there are rounds, so all of them take one shuffle."""
    def f(arrays):
        a = arrays[v]
        for _ in range(rounds):
            d = [shifted(a, tuple(k if i == axis else 0 for i in range(3))) - a for axis in range(3) for k in (-1, 1)]
            a = a + rate * sum((np.where(np.isfinite(x), np.exp(-(x / kappa) ** 2) * x, 0.0) for x in d), np.zeros_like(a))
        return {"_v": a}

    return over_bricks(df, [v], rounds, f, {"_v": "double"}, keys).drop(v).withColumnRenamed("_v", v)


#: Bits that a double holds exactly, fewer by one.
BITS = 52


def patch_distance(pairs: DataFrame, df: DataFrame, v: str, half: int, keys: Keys = ()) -> DataFrame:
    """``pairs`` (keys, x, y, z, tx, ty, tz) with the mean squared difference of the boxes around both sites, over places inside the grid for both.

    A place's box is one array, so a pair meets two rows and not one for each place of its boxes. Pairs of places that have no site count too.
    """
    keys, steps = list(keys), bricks.box(half)
    at = [*keys, *AXES]

    def f(arrays):
        held = np.stack([shifted(arrays["_held"], o) == 1 for o in steps], axis=-1)
        words = [held[..., k:k + BITS] @ 2.0 ** np.arange(min(BITS, len(steps) - k)) for k in range(0, len(steps), BITS)]
        return {"_box": np.stack([shifted(arrays["_v"], o) for o in steps], axis=-1), "_in": np.stack(words, axis=-1)}

    def places(names: list[str]) -> DataFrame:
        here = [F.col(n).cast(df.schema[a].dataType).alias(a) for n, a in zip(names, AXES)]
        return pairs.select(*keys, *here, F.lit(None).cast("double").alias("_v"), F.lit(None).cast("double").alias("_held"))

    sites = df.select(*at, F.col(v).cast("double").alias("_v"), F.lit(1.0).alias("_held"))
    sites = sites.unionByName(places(list(AXES))).unionByName(places([f"t{a}" for a in AXES])).groupBy(*at).agg(F.max("_v").alias("_v"), F.max("_held").alias("_held"))
    boxes = over_bricks(sites, ["_v", "_held"], half, f, {"_box": "array<double>", "_in": "array<double>"}, keys).drop("_v", "_held")

    def met(rows: DataFrame, names: list[str], mark: str) -> DataFrame:
        named = boxes.select(*keys, *[F.col(a).alias(f"_{a}") for a in AXES], F.col("_box").alias(f"_{mark}"), F.col("_in").alias(f"_in_{mark}"))
        placed = rows.withColumns({f"_{a}": F.col(n).cast(df.schema[a].dataType) for n, a in zip(names, AXES)})
        return placed.join(named.hint("merge"), [*keys, *[f"_{a}" for a in AXES]]).drop(*[f"_{a}" for a in AXES])

    both = met(met(pairs, list(AXES), "s"), [f"t{a}" for a in AXES], "t")
    shared = F.exists(F.zip_with("_in_s", "_in_t", lambda a, b: a.cast("bigint").bitwiseAND(b.cast("bigint"))), lambda w: w != 0)
    squares = F.filter(F.zip_with("_s", "_t", lambda a, b: (a - b) * (a - b)), lambda x: ~F.isnan(x))
    mean = F.when(F.size("_d") > 0, F.aggregate("_d", F.lit(0.0), lambda a, x: a + x) / F.size("_d"))
    return both.where(shared).withColumn("_d", squares).select(*pairs.columns, mean.alias("dist"))


#: 42 is the sum of squares of the weights 6 and six times -1; the ratios of means and of variances that non-local means admit.
RESIDUAL, MEAN_RATIO, VAR_RATIO = 42, 0.95, 0.5


def noise(df: DataFrame, v: str, keys: Keys = ()) -> DataFrame:
    """(keys, noise): noise variance of each grid, the mean square of six times a value less its six neighbours, over 42; 0 without such sites."""
    keys = list(keys)

    def run(rows, arrays, places):
        a = arrays[v]
        r = 6 * a
        for axis in range(3):
            for k in (-1, 1):
                r = r - shifted(a, tuple(k if i == axis else 0 for i in range(3)))
        r = r[places]
        r = r[np.isfinite(r)]
        return pa.table({**{k: rows[k].slice(0, 1) for k in keys}, "_s": [float((r * r).sum())], "_n": [float(len(r))]})

    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("_s", T.DoubleType()), T.StructField("_n", T.DoubleType())])
    sums = brick_tables(df, [v], 1, run, schema, keys).groupBy(*keys).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    return sums.select(*keys, F.when(F.col("_n") > 0, F.col("_s") / (RESIDUAL * F.col("_n"))).otherwise(0.0).alias("noise"))


def nonlocal_means(df: DataFrame, v: str, reach: int, half: int, variance: float | None = None, name: str = "denoised", keys: Keys = (), rician: bool = False) -> DataFrame:
    """Each site's mean over the sites in its ``reach`` whose boxes have a mean ratio of 0.95 and a variance ratio of 0.5 or nearer to 1,
    weighted by exp(-patch distance / 2 noise). Sites of mean or variance 0 keep their value.

    The noise variance is each grid's own (``noise``), unless one is given. ``rician``: the root of the weighted mean of squares less twice the
    noise variance, 0 where that is negative. Without noise only equal patches count.
    """
    keys = list(keys)
    if variance is None:
        known = df.select(*keys, *AXES, v)
        own = noise(df, v, keys).withColumnRenamed("noise", "_noise")
        # one row a grid: a shuffle by grid would sort each grid's sites in one task
        known = known.join(F.broadcast(own), keys) if keys else known.crossJoin(F.broadcast(own))
    else:
        known = df.select(*keys, *AXES, v, F.lit(float(variance)).alias("_noise"))

    def f(arrays):
        s2 = float(np.nanmax(arrays["_noise"]))
        return {name: bricks.nonlocal_mean(arrays[v], reach, half, s2, rician, MEAN_RATIO, VAR_RATIO)}

    return over_bricks(known, [v, "_noise"], reach + half, f, {name: "double"}, keys).drop("_noise")


#: The seven neighbours of a site that none of the others' seven repeats.
FORWARD = [o for o in product((0, 1), repeat=3) if any(o)]


#: Fixed value: a table of fewer pairs has no distance to others.
LEAST_PAIRS = 120


def cooccurrence(df: DataFrame, intensity: str, magnitude: str, gradient: list[str], ranges: dict[str, tuple[float, float, int]], angles: int, keys: Keys = (), mask: str | None = None) -> DataFrame:
    """(keys, kind, i, j, share, pairs): co-occurrences of intensity bins, gradient bins and angle bins of sites and their forward neighbours.

    ``ranges`` has low, high and number of bins of the intensity and the magnitude; a pair counts only if both sites are inside both and,
    where a boolean column ``mask`` is given, on it. Angle bins part the arc cosine, from 0 to pi, of the dot product of both
    gradients, cut at -1 and 1. Shares are of all ``pairs`` of the grid. Pairs are counted in each brick before they are shuffled.
    """
    keys, values = list(keys), [intensity, magnitude, *gradient, *([mask] if mask else [])]

    def bin_of(a: np.ndarray, low: float, high: float, n: int) -> np.ndarray:
        return np.where((a >= low) & (a < high), np.floor(n * (a - low) / (high - low)), np.nan)

    def run(rows, arrays, places):
        i, g = (bin_of(arrays[c], *ranges[c]) for c in (intensity, magnitude))
        good = np.isfinite(i) & np.isfinite(g) & (arrays[mask] == 1 if mask else True)
        own = np.zeros(good.shape, bool)
        own[places] = True
        found = []
        for o in FORWARD:
            at = own & good & shifted(good, o, False)
            pick = lambda a: (a[at].astype(int), shifted(a, o)[at].astype(int))  # noqa: B023, E731
            dot = sum((arrays[c] * shifted(arrays[c], o))[at] for c in gradient)
            angle = np.minimum(np.floor(np.arccos(np.clip(dot, -1, 1)) * angles / math.pi), angles - 1).astype(int)
            for kind, (a, b) in (("intensity", pick(i)), ("gradient", pick(g)), ("angle", (angle, np.zeros(len(angle), int)))):
                found += [(kind, int(a_), int(b_), int(n)) for (a_, b_), n in zip(*np.unique(np.stack([a, b], axis=1), axis=0, return_counts=True))]
        kinds, firsts, seconds, n = zip(*found) if found else ((), (), (), ())
        same = {k: pa.array([rows[k][0].as_py()] * len(kinds), rows.schema.field(k).type) for k in keys}
        return pa.table({**same, "kind": pa.array(kinds, pa.string()), "i": pa.array(firsts, pa.int32()), "j": pa.array(seconds, pa.int32()), "n": pa.array(n, pa.int64())})

    schema = T.StructType([df.schema[k] for k in keys] + list(T._parse_datatype_string("kind string, i int, j int, n bigint")))
    counts = brick_tables(df if mask is None else df.withColumn(mask, F.col(mask).cast("double")), values, 1, run, schema, keys).groupBy(*keys, "kind", "i", "j").agg(F.sum("n").alias("n"))
    pairs = F.sum("n").over(Window.partitionBy(*keys, "kind"))  # rows of a window are bins
    return counts.select(*keys, "kind", "i", "j", (F.col("n") / pairs).alias("share"), pairs.alias("pairs"))


def cooccurrence_entropy(table: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, kind, entropy): minus the sum of the shares' logarithms. They are not weighed by the shares."""
    return table.groupBy(*keys, "kind").agg((-F.sum(F.log("share"))).alias("entropy"))


def cooccurrence_distance(one: DataFrame, other: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, dist): sum of absolute differences of shares over all kinds and bins; 0 where the first table counts under LEAST_PAIRS pairs."""
    at = [*keys, "kind", "i", "j"]
    met = one.select(*at, "share", "pairs").join(other.select(*at, F.col("share").alias("_share")), at, "full")
    diff = F.sum(F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("_share", F.lit(0.0))))
    return met.groupBy(*keys).agg(F.when(F.max(F.coalesce("pairs", F.lit(0))) < LEAST_PAIRS, 0.0).otherwise(diff).alias("dist"))


def euler(mask: DataFrame, keys: Keys = ()) -> DataFrame:
    """One row a grid: Euler numbers of a mask's sites under 26 and 6 neighbours.

    Under 26, sites are closed cubes: a cube's 27 cells have places in doubled coordinates, shared cells count once, and a cell's sign
    follows the number of its odd coordinates. Under 6, sites are points, and pairs, squares and cubes of them the cells."""
    cells = mask.select(*keys, *[(2 * F.col(a) + 1).alias(a) for a in AXES], _offsets(1)).select(*keys, *[(F.col(a) + F.col(f"_o.d{a}")).alias(a) for a in AXES]).distinct()
    odd = sum((F.pmod(F.col(a), F.lit(2)) for a in AXES), F.lit(0))
    closed = cells.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.pmod(odd, F.lit(2)) == 0, 1).otherwise(-1)), F.lit(0)).cast("bigint").alias("c26"))
    ahead = around(mask.select(*keys, *AXES), [], 1, lambda o: min(o) >= 0, keys)
    near = ahead.groupBy(*keys, *AXES).agg(F.collect_set(F.col("dx") + 2 * F.col("dy") + 4 * F.col("dz")).alias("s"))
    has = lambda *k: F.forall(F.array(*map(F.lit, k)), lambda x: F.array_contains("s", x)).cast("int")
    points = F.lit(1) - has(1) - has(2) - has(4) + has(1, 2, 3) + has(1, 4, 5) + has(2, 4, 6) - has(*range(1, 8))
    points_ = near.groupBy(*keys).agg(F.coalesce(F.sum(points), F.lit(0)).cast("bigint").alias("c6"))
    return closed.join(points_, list(keys)) if keys else closed.join(points_)


def rescale(df: DataFrame, v: str, extent: tuple[int, int, int], to: tuple[int, int, int], keys: Keys = ()) -> DataFrame:
    """Each grid (all of one extent) at ``to`` sites an axis, each at its place times the ratio of the extents, by trilinear interpolation; the last site holds beyond it."""
    from gridstone.operators.relate import grid_extent

    out = grid_extent(df.sparkSession, dict(zip(AXES, to)))
    if keys:
        out = df.select(*keys).distinct().crossJoin(out)  # the rows of the result
    corners = F.explode(F.array(*[F.struct(*[F.lit(k).alias(f"d{a}") for a, k in zip(AXES, o)]) for o in product((0, 1), repeat=3)])).alias("_o")
    place = {a: F.col(a) * (n / m) for a, n, m in zip(AXES, extent, to)}
    out = out.select(*keys, *AXES, *[F.floor(p).cast("int").alias(f"_l{a}") for a, p in place.items()], *[(p - F.floor(p)).alias(f"_f{a}") for a, p in place.items()], corners)
    weight = None
    for a in AXES:
        part = F.when(F.col(f"_o.d{a}") == 1, F.col(f"_f{a}")).otherwise(1 - F.col(f"_f{a}"))
        weight = part if weight is None else weight * part
    out = out.select(*keys, *AXES, weight.alias("_w"), *[F.least(F.col(f"_l{a}") + F.col(f"_o.d{a}"), F.lit(n - 1)).alias(f"_s{a}") for a, n in zip(AXES, extent)])
    held = df.select(*keys, *[F.col(a).alias(f"_s{a}") for a in AXES], F.col(v).alias("_v"))
    return out.join(held, [*keys, *[f"_s{a}" for a in AXES]]).groupBy(*keys, *AXES).agg(F.sum(F.col("_w") * F.col("_v")).alias(v))


def halve(df: DataFrame, v: str, extent: tuple[int, int, int], sigma: float, keys: Keys = ()) -> DataFrame:
    """The next level of a pyramid: smoothed, then at half the sites an axis."""
    smooth = gaussian(df, v, sigma, "_g", keys).select(*keys, *AXES, F.col("_g").alias(v))
    return rescale(smooth, v, extent, tuple(max(1, n // 2) for n in extent), keys)


def insert_plane(df: DataFrame, plane: DataFrame, v: str, z: int, keys: Keys = ()) -> DataFrame:
    """The grid with the values of ``plane`` (keys, x, y, value) at one z."""
    new = plane.select(*keys, "x", "y", F.col(v).alias("_new"), F.lit(z).cast(df.schema["z"].dataType).alias("z"))
    return df.join(new, [*keys, *AXES], "left").withColumn(v, F.coalesce("_new", F.col(v))).drop("_new")


def clear_where(mask: DataFrame, other: DataFrame, name: str, keys: Keys = ()) -> DataFrame:
    """A mask and another: false where the other mask is false or has no row."""
    return mask.join(other.select(*keys, *AXES, F.col(name).alias("_other")), [*keys, *AXES], "left").withColumn(name, F.col(name) & F.coalesce("_other", F.lit(False))).drop("_other")


def invert(mask: DataFrame, name: str) -> DataFrame:
    return mask.withColumn(name, ~F.col(name))
