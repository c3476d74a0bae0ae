"""Scalar expressions of one row: masks, clamps, ratios, anisotropy, class probabilities. All stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def binarize(v: Column, low: float, high: float | None = None) -> Column:
    """low <= v < high."""
    return (v >= low) if high is None else (v >= low) & (v < high)


def mask_crop(v: Column, mask: Column, background: float = 0.0) -> Column:
    return F.when(mask, v).otherwise(F.lit(background))


def keep_label(v: Column, label: Column, wanted: int) -> Column:
    return mask_crop(v, label == wanted)


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def almost_equal(a: Column, b: Column, absolute: float = 1e-12, relative: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))


def is_finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def sign(v: Column) -> Column:
    return F.signum(v)


def guarded_log(v: Column, otherwise: float = 0.0) -> Column:
    return F.when(v > 0, F.log(v)).otherwise(F.lit(otherwise))


def normalize_by(v: Column, ref: Column) -> Column:
    """v / ref, 0 where ref is not positive."""
    return F.when(ref > 0, v / ref).otherwise(F.lit(0.0))


def adc(v: Column, ref: Column, b: Column) -> Column:
    """(ln ref - ln v) / b, 0 where a logarithm or the ratio has no value."""
    return F.when((ref > 0) & (v > 0) & (b != 0), (F.log(ref) - F.log(v)) / b).otherwise(F.lit(0.0))


def floor_nonpositive(v: Column, floor: float = 0.01) -> Column:
    return F.when(v <= 0, F.lit(floor)).otherwise(v)


def fa_axisymmetric(lp: Column, lt: Column) -> Column:
    """Anisotropy of eigenvalues (lp, lt, lt); 0 where their mean is 0."""
    mean = (lp + 2 * lt) / 3
    spread = (lp - mean) * (lp - mean) + 2 * (lt - mean) * (lt - mean)
    return F.when((mean == 0) | (lp * lp + 2 * lt * lt == 0), 0.0).otherwise(F.sqrt(1.5 * spread / (lp * lp + 2 * lt * lt)))


def fa_script(lp: Column, lt: Column) -> Column:
    """The analysis scripts' variant, whose denominator is (lp - mean)^2 + lt^2; it can exceed 1."""
    mean = (lp + 2 * lt) / 3
    den = (lp - mean) * (lp - mean) + lt * lt
    return F.when(den == 0, 0.0).otherwise(F.sqrt(1.5 * ((lp - mean) * (lp - mean) + 2 * (lt - mean) * (lt - mean)) / den))


def fa_eigenvalues(a: Column, b: Column, c: Column) -> Column:
    """Anisotropy of three eigenvalues, in 0..1; 0 where their sum of squares is 0.1 or less."""
    mean, den = (a + b + c) / 3, a * a + b * b + c * c
    num = (a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean)
    return F.when(den <= 0.1, 0.0).otherwise(clamp(F.sqrt(1.5 * num / den), 0.0, 1.0))


def flip_gradient(gx: Column, gy: Column, gz: Column, code: int) -> tuple[Column, Column, Column]:
    """Codes 1-3 negate x, y, z; 4-6 negate x and y, x and z, y and z; others leave the direction."""
    return {1: (-gx, gy, gz), 2: (gx, -gy, gz), 3: (gx, gy, -gz), 4: (-gx, -gy, gz), 5: (-gx, gy, -gz), 6: (gx, -gy, -gz)}.get(code, (gx, gy, gz))


def tensor_row(gx: Column, gy: Column, gz: Column, b: Column) -> list[Column]:
    """Row of the tensor design matrix: xx, xy, xz, yy, yz, zz, off-diagonals doubled."""
    return [b * gx * gx, 2 * b * gx * gy, 2 * b * gx * gz, b * gy * gy, 2 * b * gy * gz, b * gz * gz]


def gauss_logprob(v: Column, mu: Column, var: Column, prior: Column) -> Column:
    return F.log(prior) - 0.5 * F.log(2 * math.pi * var) - (v - mu) * (v - mu) / (2 * var)


def log_bin_index(v: Column, start: float, step: float) -> Column:
    """Index of a display bin on a logarithmic axis, from 1."""
    return (F.floor(F.log(v / start) / step) + 1).cast("bigint")


def complex_norm(re: Column, im: Column) -> Column:
    return re * re + im * im


def complex_arg(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def complex_product(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def dot(a: list[Column], b: list[Column]) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def vector_norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def array_ssd(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def kernel_linear(a: Column, b: Column) -> Column:
    return array_dot(a, b)


def kernel_poly(a: Column, b: Column, gain: float = 1.0, shift: float = 1.0, degree: int = 2) -> Column:
    return F.pow(gain * array_dot(a, b) + shift, F.lit(degree))


def kernel_rbf(a: Column, b: Column, gamma: float = 1.0) -> Column:
    return F.exp(-gamma * array_ssd(a, b))


def kernel_sigmoid(a: Column, b: Column, gain: float = 1.0, shift: float = 0.0) -> Column:
    return F.tanh(gain * array_dot(a, b) + shift)


def kernel_inverse_multiquadric(a: Column, b: Column, shift: float = 1.0) -> Column:
    return 1.0 / F.sqrt(array_ssd(a, b) + shift * shift)


def quaternion_product(p: list[Column], q: list[Column]) -> list[Column]:
    """(w, x, y, z) products."""
    (a, b, c, d), (e, f, g, h) = p, q
    return [a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e]


def quaternion_rotate(q: list[Column], v: list[Column]) -> list[Column]:
    """v turned by the unit quaternion q."""
    w, u = q[0], q[1:]
    t = [2 * x for x in cross(u, v)]
    return [a + w * b + c for a, b, c in zip(v, t, cross(u, t))]


def affine_apply(m: list[list[float]], v: list[Column]) -> list[Column]:
    """Homogeneous 4x4 transform of a point."""
    return [sum((F.lit(m[i][j]) * v[j] for j in range(3)), F.lit(m[i][3])) for i in range(3)]


def triangle_area(a: list[Column], b: list[Column], c: list[Column]) -> Column:
    u, v = [y - x for x, y in zip(a, b)], [y - x for x, y in zip(a, c)]
    return 0.5 * vector_norm(cross(u, v))
