"""Dense matrices as rows (r, c, v), every place present: products, shifts, parts and edits by joins and index arithmetic.

Decompositions are for matrices of a checked size, which the driver holds as arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def combine(a: DataFrame, b: DataFrame, how) -> DataFrame:
    """Place by place: ``how`` of the two values."""
    return a.join(b.select("r", "c", F.col("v").alias("_b")), ["r", "c"]).select("r", "c", how(F.col("v"), F.col("_b")).alias("v"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    met = a.select("r", F.col("c").alias("_k"), F.col("v").alias("_a")).join(b.select(F.col("r").alias("_k"), "c", F.col("v").alias("_b")), "_k")
    return met.groupBy("r", "c").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("c").alias("r"), F.col("r").alias("c"), "v")


def transpose_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The transpose of the first times the second: both are joined on their rows, so nothing is turned."""
    met = a.select("r", F.col("c").alias("_i"), F.col("v").alias("_a")).join(b.select("r", F.col("c").alias("_j"), F.col("v").alias("_b")), "r")
    return met.groupBy(F.col("_i").alias("r"), F.col("_j").alias("c")).agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def symmetrize(a: DataFrame) -> DataFrame:
    """Half the sum of a square matrix and its transpose."""
    return combine(a, transpose(a), lambda x, y: (x + y) / 2)


def add_to_diagonal(a: DataFrame, d: float) -> DataFrame:
    return a.withColumn("v", F.col("v") + F.when(F.col("r") == F.col("c"), d).otherwise(0.0))


def shift_columns(a: DataFrame, n: int, by: int) -> DataFrame:
    """Columns moved to the right by so many places, round the end."""
    return a.withColumn("c", F.pmod(F.col("c") + by, F.lit(n)).cast(a.schema["c"].dataType))


def part(a: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Rows and columns of half-open ranges, numbered from 0."""
    inside = (F.col("r") >= rows[0]) & (F.col("r") < rows[1]) & (F.col("c") >= cols[0]) & (F.col("c") < cols[1])
    return a.where(inside).withColumns({"r": (F.col("r") - rows[0]).cast(a.schema["r"].dataType), "c": (F.col("c") - cols[0]).cast(a.schema["c"].dataType)})


def swap_rows(a: DataFrame, i: int, j: int) -> DataFrame:
    return a.withColumn("r", F.when(F.col("r") == i, j).when(F.col("r") == j, i).otherwise(F.col("r")).cast(a.schema["r"].dataType))


def delete_row(a: DataFrame, i: int) -> DataFrame:
    return a.where(F.col("r") != i).withColumn("r", (F.col("r") - (F.col("r") > i).cast("int")).cast(a.schema["r"].dataType))


def insert_row(a: DataFrame, i: int, value: Column) -> DataFrame:
    """A row of one value before row i; ``value`` may depend on the column."""
    down = a.withColumn("r", (F.col("r") + (F.col("r") >= i).cast("int")).cast(a.schema["r"].dataType))
    new = a.select("c").distinct().select(F.lit(i).cast(a.schema["r"].dataType).alias("r"), "c", value.cast("double").alias("v"))
    return down.unionByName(new)


def greedy_assignment(a: DataFrame, most: int = 200) -> DataFrame:
    """(r, c, v): the largest entry over 0, then the largest in the rows and columns that are left, and so on.

    Entries that are the largest of both their row and their column are taken at once, which gives the same: ties go to the smaller
    column, then row. Rounds are written to the checkpoint folder; there are as many as the longest chain of entries that wait for each other."""
    from gridstone.operators.graph import _cut

    order = F.struct("v", (-F.col("c")).alias("c"), (-F.col("r")).alias("r"))
    left, taken = _cut(a.where("v > 0")), None
    for _ in range(most):
        by_row = left.groupBy("r").agg(F.max(order).alias("_m"))
        best = by_row.select("r", (-F.col("_m.c")).alias("c"), F.col("_m.v").alias("v"), "_m")
        won = best.withColumn("_top", F.max("_m").over(Window.partitionBy("c"))).where(F.col("_m") == F.col("_top"))
        in_column = left.groupBy("c").agg(F.max(order).alias("_all"))
        now = _cut(won.join(in_column, "c").where(F.col("_m") == F.col("_all")).select(F.col("r").cast(a.schema["r"].dataType).alias("r"), F.col("c").cast(a.schema["c"].dataType).alias("c"), "v"))
        if not now.count():
            return taken if taken is not None else now
        taken = now if taken is None else taken.unionByName(now)
        left = _cut(left.join(now.select("r"), "r", "left_anti").join(now.select("c"), "c", "left_anti"))
    raise RuntimeError(f"entries are left after {most} rounds")


#: Rows and columns of a matrix that is solved on the driver, at most.
SMALL = 2000


def small(a: DataFrame) -> np.ndarray:
    """The matrix as an array; one of over SMALL rows or columns is refused."""
    top = a.agg(F.max("r"), F.max("c"), F.count(F.lit(1))).first()
    if top[2] and max(top[0], top[1]) >= SMALL:
        raise ValueError(f"over {SMALL} rows or columns")
    out = np.zeros((int(top[0]) + 1, int(top[1]) + 1) if top[2] else (0, 0))
    rows = a.select("r", "c", "v").toPandas()
    out[rows["r"].to_numpy(int), rows["c"].to_numpy(int)] = rows["v"].to_numpy(float)
    return out


def table(spark, m: np.ndarray) -> DataFrame:
    """An array as rows (r, c, v)."""
    r, c = np.indices(m.shape)
    return spark.createDataFrame(list(zip(r.ravel().tolist(), c.ravel().tolist(), m.ravel().tolist())), "r int, c int, v double")


def apply(a: DataFrame, f) -> DataFrame:
    """A function of a small matrix, such as np.linalg.inv or np.linalg.pinv, as a matrix table."""
    return table(a.sparkSession, np.atleast_2d(f(small(a))))


def of_eigenvalues(m: np.ndarray, f) -> np.ndarray:
    """A function of a symmetric matrix by its eigenvalues: logarithm, exponential, root."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return (vectors * f(values)) @ vectors.T


def matrix_log(m: np.ndarray, least: float = 1e-12) -> np.ndarray:
    """Eigenvalues under ``least`` count as that."""
    return of_eigenvalues(m, lambda x: np.log(np.maximum(x, least)))


def matrix_exp(m: np.ndarray) -> np.ndarray:
    return of_eigenvalues(m, np.exp)


def matrix_root(m: np.ndarray, inverse: bool = False, least: float = 1e-12) -> np.ndarray:
    return of_eigenvalues(m, lambda x: np.maximum(x, least) ** (-0.5 if inverse else 0.5))


def least_squares(df: DataFrame, features: list[str], target: str) -> np.ndarray:
    """Coefficients of a tall table's least squares: only the products of columns reach the driver. Rows with a null are left out."""
    every = [*features, target]
    held = df.select(*[F.col(c).cast("double").alias(c) for c in every]).dropna()
    pairs = [(a, b) for i, a in enumerate(every) for b in every[i:]]
    sums = held.agg(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).first()
    m = np.zeros((len(every), len(every)))
    for (a, b), x in zip(pairs, sums):
        m[every.index(a), every.index(b)] = m[every.index(b), every.index(a)] = x or 0.0
    return np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
