"""Grids cut into bricks: each site goes to its own brick and to those whose rim it lies in, and a brick is filtered as numpy arrays.

One shuffle moves each site once, and the sites near a face of a brick once more for each brick beside it. A brick holds at most
(edge + 2 halo)^3 sites, whatever the size of a grid, so the grids of an image table, told apart by ``keys``, run side by side
and none meets another. Places without a site, and null values, are NaN in the arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

AXES = ("x", "y", "z")
#: Sites along an edge of a brick, without its rim; a wider rim makes bricks as wide as itself.
EDGE = 32

#: Ratios so near to a bound count as on it, so that rounding does not decide.
SLACK = 1e-9

Arrays = dict[str, np.ndarray]


def dealt(df: DataFrame, values: list[str], halo: int, keys: Iterable[str] = (), edge: int = EDGE) -> DataFrame:
    """Rows of sites with the brick (_bx, _by, _bz) that each one goes to, once for each brick whose rim it lies in. Rows without a place are left out."""
    def bricks(a: str):
        at, place = F.floor(F.col(a) / edge).cast("int"), F.pmod(F.col(a).cast("int"), F.lit(edge))
        return F.array_compact(F.array(at, F.when(place < halo, at - 1), F.when(place >= edge - halo, at + 1)))

    x, y, z = (bricks(a) for a in AXES)
    all_ = F.flatten(F.transform(x, lambda i: F.flatten(F.transform(y, lambda j: F.transform(z, lambda k: F.struct(i.alias("_bx"), j.alias("_by"), k.alias("_bz")))))))
    rows = df.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    return rows.select(*keys, *AXES, *values, F.inline(all_))


def brick_tables(df: DataFrame, values: list[str], halo: int, f: Callable[[pa.Table, Arrays, tuple[np.ndarray, ...]], pa.Table], schema: T.StructType, keys: Iterable[str] = (), edge: int = EDGE) -> DataFrame:
    """``f(rows, arrays, places)`` of each brick that has sites of its own: the rows that it owns, all values with the rim, and the rows' places in the arrays."""
    edge = max(edge, halo)

    def run(table: pa.Table) -> pa.Table:
        place = [table[a].to_numpy().astype(np.int64) for a in AXES]
        begin = [table[f"_b{a}"][0].as_py() * edge for a in AXES]
        own = np.logical_and.reduce([(p >= b) & (p < b + edge) for p, b in zip(place, begin)])
        low = [int(p.min()) for p in place]
        place = [p - m for p, m in zip(place, low)]
        arrays = {}
        for v in values:
            arrays[v] = np.full([int(p.max()) + 1 for p in place], np.nan)
            arrays[v][tuple(place)] = table[v].cast(pa.float64()).to_numpy()
        kept = np.flatnonzero(own)
        if not len(kept):
            return to_arrow_schema(schema).empty_table()
        return f(table.take(pa.array(kept)), arrays, tuple(p[kept] for p in place))

    return dealt(df, values, halo, keys, edge).groupBy(*keys, "_bx", "_by", "_bz").applyInArrow(run, schema)


def over_bricks(df: DataFrame, values: list[str], halo: int, f: Callable[[Arrays], Arrays], made: dict[str, str], keys: Iterable[str] = (), edge: int = EDGE) -> DataFrame:
    """keys, x, y, z and values of each site with the columns ``made`` (name: type) of ``f(arrays)`` at its place.

    ``f`` may read ``halo`` places around a site. A result array has the arrays' shape, with one more axis for a list column.
    """
    keys = list(keys)
    plain = [*keys, *AXES, *dict.fromkeys(v for v in values if v not in keys)]
    schema = T.StructType([df.schema[c] for c in plain] + list(T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in made.items()))))
    types = [pa.list_(pa.float64()) if t.startswith("array") else {"double": pa.float64(), "boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32()}[t] for t in made.values()]

    def run(rows: pa.Table, arrays: Arrays, places: tuple[np.ndarray, ...]) -> pa.Table:
        found, out = f(arrays), [rows[c] for c in plain]
        for n, t in zip(made, types):
            at = found[n][places]
            if at.ndim == 2:
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * at.shape[1], pa.int32()), pa.array(at.ravel())))
            else:
                out.append(pa.array(at).cast(t))
        return pa.table(out, names=schema.names)

    return brick_tables(df, values, halo, run, schema, keys, edge)


# Filters of arrays.

def shifted(a: np.ndarray, o: tuple[int, ...], outside=np.nan) -> np.ndarray:
    """What lies ``o`` further on from each place."""
    out = np.full_like(a, outside)
    to = tuple(slice(max(0, -k), max(0, n - max(0, k))) for k, n in zip(o, a.shape))
    out[to] = a[tuple(slice(max(0, k), max(0, n - max(0, -k))) for k, n in zip(o, a.shape))] if all(abs(k) < n for k, n in zip(o, a.shape)) else out[to]
    return out


def box(half: int) -> list[tuple[int, int, int]]:
    return list(product(range(-half, half + 1), repeat=3))


def box_sum(a: np.ndarray, half: int) -> np.ndarray:
    """Sums over boxes, an axis at a time; ``a`` has no NaN."""
    for axis in range(3):
        step = lambda k: tuple(k if i == axis else 0 for i in range(3))  # noqa: B023, E731
        a = sum((shifted(a, step(k), 0) for k in range(-half, half + 1)), np.zeros_like(a))
    return a


def box_stats(a: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, mean, sample variance) over boxes: squares are summed about each box's own mean, so large values keep their digits."""
    base = np.round(np.nanmean(a)) if np.isfinite(a).any() else 0.0  # whole, so that whole values have exact sums
    held = np.isfinite(a)
    n = box_sum(held.astype(float), half)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = (box_sum(np.where(held, a - base, 0.0), half) + n * base) / n
    s = np.zeros_like(a)
    for o in box(half):
        d = shifted(a, o) - mean
        s += np.where(np.isfinite(d), d * d, 0.0)
    return n, mean, np.where(n > 1, s / np.maximum(n - 1, 1), 0.0)


def medians(a: np.ndarray, half: int) -> np.ndarray:
    near = np.sort(np.stack([shifted(a, o) for o in box(half)]), axis=0)  # NaN last
    n = np.isfinite(near).sum(axis=0)
    pick = lambda k: np.take_along_axis(near, np.maximum(k, 0)[None], axis=0)[0]
    return (pick((n - 1) // 2) + pick(n // 2)) / 2


def inner(a: np.ndarray) -> np.ndarray:
    """Places with a value whose six neighbours have one: those off the border of a full grid."""
    out = np.isfinite(a)
    for axis in range(3):
        for k in (-1, 1):
            out &= np.isfinite(shifted(a, tuple(k if i == axis else 0 for i in range(3))))
    return out


def nonlocal_mean(a: np.ndarray, reach: int, half: int, noise: float, rician: bool, mean_ratio: float, var_ratio: float) -> np.ndarray:
    """Weighted means over the places in reach whose boxes are alike in mean and variance; weights fall with the mean squared difference of the boxes."""
    _, mean, var = box_stats(a, half)
    live = np.isfinite(a) & (mean != 0) & (var != 0)
    mean, var = np.where(live, mean, np.nan), np.where(live, var, np.nan)
    total, weight = np.zeros_like(a), np.zeros_like(a)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        for o in box(reach):
            ratio, spread = mean / shifted(mean, o), var / shifted(var, o)
            take = (ratio >= mean_ratio - SLACK) & (ratio <= 1 / mean_ratio + SLACK) & (spread >= var_ratio - SLACK) & (spread <= 1 / var_ratio + SLACK)
            if not take.any():
                continue
            other = shifted(a, o)
            d = (a - other) ** 2
            both = np.isfinite(d)
            dist = box_sum(np.where(both, d, 0.0), half) / np.maximum(box_sum(both.astype(float), half), 1)
            w = np.where(take, np.exp(-dist / (2 * noise)) if noise > 0 else (dist == 0).astype(float), 0.0)
            total += np.where(take, (other * other if rician else other) * w, 0.0)
            weight += w
        mean = total / weight
    if rician:
        mean = np.sqrt(np.maximum(mean - 2 * noise, 0.0))
    return np.where(weight > 0, mean, a)
