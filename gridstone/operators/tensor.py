"""Tensor fits of direction-weighted signals: one small pseudo-inverse on the driver, the rest is generated code on the rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.operators.elementwise import clamp

#: Parts of a symmetric tensor, in the order of the design matrix.
PARTS = ("txx", "txy", "txz", "tyy", "tyz", "tzz")


def design(gradients: list[tuple[float, float, float, float]]) -> np.ndarray:
    """Rows of the design matrix for directions and strengths (x, y, z, b): mixed parts count twice."""
    return np.array([[b * x * x, 2 * b * x * y, 2 * b * x * z, b * y * y, 2 * b * y * z, b * z * z] for x, y, z, b in gradients])


def fit(df: DataFrame, signals: list[str], reference: str, gradients: list[tuple[float, float, float, float]], floor: float = 0.01) -> DataFrame:
    """``df`` with the tensor's parts: the pseudo-inverse of the design times (ln reference - ln signal) / b of each direction.

    Signals at or under 0 count as ``floor``; a row whose reference is not over 0 gets a tensor of 0. Strengths must not be 0."""
    if len(signals) != len(gradients):
        raise ValueError("a signal for each direction")
    inverse = np.linalg.pinv(design(gradients))
    rates = [F.when(F.col(reference) > 0, (F.log(reference) - F.log(F.when(F.col(s) > 0, F.col(s)).otherwise(floor))) / g[3]).otherwise(0.0) for s, g in zip(signals, gradients)]
    held = df.withColumn("_rates", F.array(*rates))
    return held.withColumns({n: sum((F.get("_rates", F.lit(i)) * float(w) for i, w in enumerate(row)), F.lit(0.0)) for n, row in zip(PARTS, inverse)}).drop("_rates")


def anisotropy(df: DataFrame, name: str = "fa") -> DataFrame:
    """Fractional anisotropy of a tensor's parts, in 0 to 1, 0 where the eigenvalues' squares sum to 0.1 or less.

    The trace and the sum of squared entries are the sums of the eigenvalues and of their squares, so none is solved for."""
    xx, xy, xz, yy, yz, zz = map(F.col, PARTS)
    trace, squares = xx + yy + zz, xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz)
    return df.withColumn(name, F.when(squares > 0.1, clamp(F.sqrt(F.greatest(F.lit(0.0), 1.5 * (squares - trace * trace / 3)) / squares), 0.0, 1.0)).otherwise(0.0))
