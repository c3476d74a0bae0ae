"""Sparse linear algebra on (r, c, v) tables: products are joins and sums, which combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.operators.graph import _cut


def add(a: DataFrame, b: DataFrame, sign: float = 1.0) -> DataFrame:
    """a + sign * b over the union of their patterns."""
    return a.select("r", "c", "v").unionByName(b.select("r", "c", (sign * F.col("v")).alias("v"))).groupBy("r", "c").agg(F.sum("v").alias("v"))


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("c").alias("r"), F.col("r").alias("c"), "v")


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    """(i, v) of a times x, x as (i, v)."""
    return a.join(x.select(F.col("i").alias("c"), F.col("v").alias("_x")), "c").groupBy(F.col("r").alias("i")).agg(F.sum(F.col("v") * F.col("_x")).alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("r").alias("c"), F.col("c").alias("_c"), F.col("v").alias("_v"))
    return a.join(right, "c").groupBy("r", F.col("_c").alias("c")).agg(F.sum(F.col("v") * F.col("_v")).alias("v"))


def prune(a: DataFrame, limit: float) -> DataFrame:
    return a.where(F.abs("v") > limit)


def diagonal(a: DataFrame) -> DataFrame:
    return a.where("r = c").select(F.col("r").alias("i"), "v")


def strength(a: DataFrame, theta: float) -> DataFrame:
    """Entries with v^2 >= |theta d_c theta d_r|, d the diagonal; a missing diagonal entry is 0."""
    d = diagonal(a)
    out = a.join(d.select(F.col("i").alias("r"), F.col("v").alias("_r")), "r", "left").join(d.select(F.col("i").alias("c"), F.col("v").alias("_c")), "c", "left")
    return out.where(F.col("v") * F.col("v") >= F.abs(theta * F.coalesce("_c", F.lit(0.0)) * theta * F.coalesce("_r", F.lit(0.0)))).select("r", "c", "v")


def row_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("r").agg(F.sum("v").alias("row_sum"), F.sum(F.when(F.col("r") != F.col("c"), F.col("v")).otherwise(0.0)).alias("row_degree"))


def column_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("c").agg(F.sum("v").alias("col_sum"))


def trace(a: DataFrame) -> DataFrame:
    return a.agg(F.sum(F.when(F.col("r") == F.col("c"), F.col("v")).otherwise(0.0)).alias("trace"))


def norms(a: DataFrame) -> DataFrame:
    """Norms 1 (columns), infinity (rows) and Frobenius."""
    one = a.groupBy("c").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("norm1"))
    inf = a.groupBy("r").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("norm_inf"))
    return one.crossJoin(inf).crossJoin(a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm_f")))


def scale_rows(a: DataFrame, x: DataFrame) -> DataFrame:
    return a.join(x.select(F.col("i").alias("r"), F.col("v").alias("_x")), "r").select("r", "c", (F.col("v") * F.col("_x")).alias("v"))


def join_below(a: DataFrame, b: DataFrame, rows: int) -> DataFrame:
    """b under a, which has so many rows."""
    return a.select("r", "c", "v").unionByName(b.select((F.col("r") + rows).alias("r"), "c", "v"))


def join_right(a: DataFrame, b: DataFrame, columns: int) -> DataFrame:
    return a.select("r", "c", "v").unionByName(b.select("r", (F.col("c") + columns).alias("c"), "v"))


def adat(a: DataFrame, d: DataFrame) -> DataFrame:
    """a diag(d) a'."""
    scaled = a.join(d.select(F.col("i").alias("c"), F.col("v").alias("_d")), "c").select("r", "c", (F.col("v") * F.col("_d")).alias("v"))
    return matmul(scaled, transposed(a))


def dot(x: DataFrame, y: DataFrame) -> float:
    return x.join(y.select("i", F.col("v").alias("_y")), "i").agg(F.sum(F.col("v") * F.col("_y"))).first()[0] or 0.0


def axpy(x: DataFrame, y: DataFrame, alpha: float) -> DataFrame:
    """y + alpha x."""
    return y.select("i", "v").unionByName(x.select("i", (alpha * F.col("v")).alias("v"))).groupBy("i").agg(F.sum("v").alias("v"))


def conjugate_gradient(a: DataFrame, b: DataFrame, tol: float = 1e-6, most: int = 10_000, jacobi: bool = True) -> DataFrame:
    """x of a x = b for symmetric positive definite a, with the diagonal as preconditioner. Only scalars reach the driver."""
    a, b = _cut(a), _cut(b.select("i", "v"))
    d = diagonal(a)
    pre = (lambda r: r.join(d.select("i", F.col("v").alias("_d")), "i").select("i", (F.col("v") / F.col("_d")).alias("v"))) if jacobi else (lambda r: r)
    x, r = b.select("i", F.lit(0.0).alias("v")), b.select("i", "v")
    z = pre(r)
    p, rz, stop = z, dot(r, z), tol * tol * dot(b, b)
    for _ in range(most):
        if dot(r, r) <= stop:
            break
        q = _cut(matvec(a, p))
        alpha = rz / dot(p, q)
        x, r = _cut(axpy(p, x, alpha)), _cut(axpy(q, r, -alpha))
        z = pre(r)
        new = dot(r, z)
        p, rz = _cut(axpy(p, z, new / rz)), new
    return x


def power_iteration(a: DataFrame, n: int, rounds: int = 50) -> float:
    """Largest absolute eigenvalue, by a fixed number of products."""
    x, value = a.sparkSession.range(n).select(F.col("id").alias("i"), F.lit(1.0 / n ** 0.5).alias("v")), 0.0
    for _ in range(rounds):
        y = _cut(matvec(a, x))
        value = dot(y, y) ** 0.5
        if not value:
            return 0.0
        x = y.select("i", (F.col("v") / value).alias("v"))
    return value
