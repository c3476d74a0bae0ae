"""Krylov methods on sparse (r, c, v) tables: eigenpairs of symmetric matrices, and least squares of rectangular ones.

Vectors stay tables: a basis is one array column, so that all its inner products with a new vector are one aggregate. The driver
sees scalars and matrices of as many rows as a basis has vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridstone.operators.graph import _cut
from gridstone.state import Slot, remove, write


def _combined(weights: np.ndarray, of: str = "q") -> Column:
    """Sum of the vectors of a basis with weights."""
    return F.aggregate(F.zip_with(of, F.array(*[F.lit(float(w)) for w in weights]), lambda q, w: q * w), F.lit(0.0), lambda a, x: a + x)


def _dots(df: DataFrame, x: str, size: int) -> np.ndarray:
    """Inner products of a vector with those of the basis, then with itself."""
    row = df.agg(*[F.sum(F.col(x) * F.get("q", F.lit(k))) for k in range(size)], F.sum(F.col(x) * F.col(x))).first()
    return np.array([v or 0.0 for v in row])


class Parts:
    """A sparse (r, c, v) matrix a whose rows are dealt to parts by hash, for a'(a x + f b) in one step, where b is (i, v).

    Each part stays where it is for all steps, and its task multiplies both ways: only a number for each column and part that holds it
    is moved, in both directions, and no row. The parts are as many as shuffle partitions, so more of them make tasks smaller.
    Doubled entries add up; null entries, and entries of no row or column, are left out.
    """

    def __init__(self, a: DataFrame, b: DataFrame | None = None):
        spark = a.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.index = a.schema["c"].dataType
        entries = a.where("r IS NOT NULL AND c IS NOT NULL AND v IS NOT NULL").select("r", "c", F.col("v").cast("double").alias("v"))
        if b is not None:  # in no column
            right = b.where("i IS NOT NULL AND v IS NOT NULL").select(F.col("i").cast(a.schema["r"].dataType).alias("r"), F.lit(None).cast(self.index).alias("c"), F.col("v").cast("double").alias("v"))
            entries = entries.unionByName(right)
        dealt = entries.select(F.pmod(F.xxhash64("r"), F.lit(n)).cast("int").alias("part"), "r", "c", "v")
        self.entries = dealt.repartition(n, "part").sortWithinPartitions("part").persist(StorageLevel.DISK_ONLY)
        columns = self.entries.where("c IS NOT NULL").groupBy(F.col("c").alias("i")).agg(F.collect_set("part").alias("parts"), F.sum(F.col("v") * F.col("v")).alias("own"))
        #: i, the parts that hold the column, and its inner product with itself.
        self.columns, self._path = write(columns)

    def product(self, x: DataFrame, factor: float = 0.0) -> DataFrame:
        """(i, s) of a'(a x + factor b), and with a null i the squared length of a x + factor b, of ``x`` (i, parts, x)."""
        schema = T.StructType([T.StructField("i", self.index), T.StructField("s", T.DoubleType())])

        def run(held: pa.Table, sent: pa.Table) -> pa.Table:
            row = held["r"].combine_chunks().dictionary_encode().indices.to_numpy()
            v, n = held["v"].to_numpy(), int(row.max()) + 1 if len(row) else 0
            right = held["c"].is_null().to_numpy()
            at = pc.fill_null(pc.index_in(held["c"], value_set=sent["i"].combine_chunks()), -1).to_numpy()[~right]
            y = np.bincount(row[~right], weights=v[~right] * sent["x"].to_numpy()[at], minlength=n) if len(at) else np.zeros(n)
            if factor:
                y = y + factor * np.bincount(row[right], weights=v[right], minlength=n)
            s = np.bincount(at, weights=v[~right] * y[row[~right]], minlength=sent.num_rows)
            return pa.table([pa.concat_arrays([sent["i"].combine_chunks(), pa.nulls(1, sent["i"].type)]), pa.array(np.append(s, y @ y))], schema=to_arrow_schema(schema))

        sent = x.select(F.explode("parts").alias("part"), "i", "x")
        return self.entries.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(run, schema).groupBy("i").agg(F.sum("s").alias("s"))

    def without_own(self, x: DataFrame) -> DataFrame:
        """(i, w) of the product of a'a, with zeros in its diagonal, with ``x`` (c, _x)."""
        sent = self.columns.join(x.withColumnsRenamed({"c": "i", "_x": "x"}).hint("merge"), "i")
        s = self.product(sent).where("i IS NOT NULL")
        return sent.join(s.hint("merge"), "i").select("i", (F.col("s") - F.col("own") * F.col("x")).alias("w"))

    def clear(self) -> None:
        self.entries.unpersist()
        remove(self.entries.sparkSession, self._path)


def lanczos(a: DataFrame | Parts, pairs: int, largest: bool = True, size: int = 40, tol: float = 1e-8, restarts: int = 100, seed: int = 0) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((i, which, v), eigenvalues, residual norms) of the ``pairs`` largest or smallest eigenvalues of a symmetric matrix.

    Every new vector is made orthogonal to the whole basis, twice. A full basis of ``size`` vectors shrinks to its best Ritz vectors and goes on.
    A residual is told by the last row of the basis' eigenvectors; all are under ``tol`` times the largest eigenvalue seen, or it is
    an error. Where the basis spans an invariant space a new seeded vector goes on, so equal eigenvalues are found
    as often as they occur, as far as a full basis holds them. ``a`` may be Parts, and stands for a'a with zeros in its diagonal then; they are cleared. Indices are those that have an entry; doubled entries add up, null ones are 0. A matrix of fewer rows has as many pairs as rows.
    """
    if isinstance(a, Parts):
        spark, a_path, sites = a.columns.sparkSession, None, a.columns.select("i")
    else:
        spark = a.sparkSession
        a, a_path = write(a.where(F.col("v").isNotNull()).groupBy("r", "c").agg(F.sum("v").cast("double").alias("v")))
        sites = a.select(F.col("r").alias("i")).unionByName(a.select(F.col("c").alias("i"))).distinct()
    noise = lambda k: F.xxhash64("i", F.lit(seed), F.lit(k)) / float(1 << 63)
    basis, made = Slot(), 0
    start, start_path = write(sites.select("i", noise(0).alias("w"), F.array().cast("array<double>").alias("q")))
    n = start.count()
    pairs, size = min(pairs, n), min(max(size, 2 * pairs + 2), n)
    h, held, work = np.zeros((size, size)), 0, start
    scale, new = 0.0, True  # new: the next vector is a fresh one, with no entry in h
    table = start
    try:
        for _ in range(restarts * size):
            for again in range(2):
                dots = _dots(work, "w", held)
                if again == 0 and not new:
                    h[:held, held - 1] = dots[:held]
                    h[held - 1, :held] = dots[:held]
                    scale = max(scale, float(np.abs(dots[:held]).max()))
                elif not new:
                    h[held - 1, held - 1] += dots[held - 1]
                if held:
                    work = work.withColumn("w", F.col("w") - _combined(dots[:held]))
            norm = math.sqrt(max(float(dots[held] - (dots[:held] ** 2).sum()), 0.0))
            broken = not new and norm <= 1e-12 * max(scale, 1e-300)
            if held and not new:
                values, vectors = np.linalg.eigh(h[:held, :held])
                order = np.argsort(-values if largest else values, kind="stable")
                values, vectors = values[order], vectors[:, order]
                scale = max(scale, float(np.abs(values).max()))
                left = np.abs(vectors[-1]) * (0.0 if broken else norm)
                if held == n or (broken and held == size) or (held >= pairs and not broken and (left[:pairs] <= tol * scale).all()):
                    out = _cut(table.select("i", F.posexplode(F.array(*[_combined(vectors[:, p]) for p in range(pairs)])).alias("which", "v")))
                    return out, values[:pairs], left[:pairs]
                if held == size and not broken:
                    keep = min(pairs + max(2, (size - pairs) // 2), size - 1)
                    work = work.withColumn("q", F.array(*[_combined(vectors[:, p]) for p in range(keep)]))
                    h = np.zeros((size, size))
                    h[range(keep), range(keep)] = values[:keep]
                    held = keep
            if broken or (new and norm <= 1e-9):
                made += 1
                work, new = basis.put(work.select("i", noise(made).alias("w"), "q")), True
                continue
            table = basis.put(work.select("i", F.concat("q", F.array(F.col("w") / norm)).alias("q")))
            held, new = held + 1, False
            last = table.select(F.col("i").alias("c"), F.get("q", F.lit(held - 1)).alias("_x"))
            product = a.without_own(last) if isinstance(a, Parts) else a.join(last, "c").groupBy(F.col("r").alias("i")).agg(F.sum(F.col("v") * F.col("_x")).alias("w"))
            work = _cut(table.join(product, "i", "left").select("i", F.coalesce("w", F.lit(0.0)).alias("w"), "q"))
        raise RuntimeError(f"eigenpairs did not settle in {restarts} restarts")
    finally:
        basis.clear(spark)
        remove(spark, a_path, start_path)
        if isinstance(a, Parts):
            a.clear()


def _turn(a: float, b: float) -> tuple[float, float, float]:
    """Cosine, sine and length of the rotation that takes (a, b) to (length, 0)."""
    r = math.hypot(a, b)
    return (a / r, b / r, r) if r else (1.0, 0.0, 0.0)


def least_squares(a: DataFrame, b: DataFrame, damp: float = 0.0, tol: float = 1e-8, most: int = 10_000) -> tuple[DataFrame, float]:
    """((i, v), norm of a'(b - a x) - damp^2 x over that of a'b) of least squares by bidiagonal steps (LSMR, Fong and Saunders 2011).

    ``b`` is (i, v) and may lack rows, which are 0 then. A vector of the rows is a z + f b, with z of the columns' length, and is
    made anew in each step, which is one product over Parts and one write of the columns' vectors; the norm falls in every step. So
    such a vector is as exact as b's size against what is left of it. Columns are those with an entry; of many solutions the one of least length is found. Null entries are 0.
    """
    spark = a.sparkSession
    parts, p_slot, x_slot = Parts(a, b), Slot(), Slot()

    def product(cols: DataFrame, factor: float) -> tuple[DataFrame, float]:
        p = p_slot.put(parts.product(cols.select("i", "parts", F.col("z").alias("x")), factor))
        return p.where("i IS NOT NULL").withColumnRenamed("s", "_p").hint("merge"), math.sqrt((p.where("i IS NULL").agg(F.sum("s")).first()[0]) or 0.0)

    def length(df: DataFrame) -> float:
        return math.sqrt(df.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0)

    try:
        zero = F.lit(0.0)
        p, size = product(parts.columns.withColumn("z", zero), 1.0)
        beta = size
        first = parts.columns.join(p, "i", "left").select("i", "parts", (F.coalesce("_p", zero) / (beta or 1.0)).alias("v"))
        cols = x_slot.put(first.select("i", "parts", "v", zero.alias("z"), F.col("v").alias("h"), zero.alias("w"), zero.alias("x")))
        alpha = length(cols)
        begin = alpha * beta
        if not begin:
            return _cut(cols.select("i", F.col("x").alias("v"))), 0.0
        # v is kept unscaled, as alpha * v; h starts as v; a row vector of length 1 is a z + factor b
        zeta_bar, alpha_bar, rho, rho_bar, c_bar, s_bar, factor = begin, alpha, 1.0, 1.0, 1.0, 0.0, 1 / beta
        cols = cols.withColumn("h", F.col("h") / alpha)
        for _ in range(most):
            cols = cols.withColumn("z", F.col("v") / alpha - F.col("z") * alpha)
            factor *= -alpha
            p, new_beta = product(cols, factor)
            if new_beta <= 1e-15 * abs(factor) * size:  # rounding only
                new_beta = 0.0
            over = 1 / new_beta if new_beta else 0.0
            factor *= over
            moved = cols.join(p, "i", "left").withColumns({"v": F.coalesce("_p", zero) * over - F.col("v") * (new_beta / alpha), "z": F.col("z") * over}).drop("_p")
            moved = x_slot.put(moved)
            beta, alpha = new_beta, length(moved)
            _, _, alpha_hat = _turn(alpha_bar, damp)
            rho_old, rho_bar_old = rho, rho_bar
            c, s, rho = _turn(alpha_hat, beta)
            theta, alpha_bar = s * alpha, c * alpha
            theta_bar = s_bar * rho
            c_bar, s_bar, rho_bar = _turn(c_bar * rho, theta)
            zeta, zeta_bar = c_bar * zeta_bar, -s_bar * zeta_bar
            w = F.col("h") - F.col("w") * (theta_bar * rho / (rho_old * rho_bar_old))
            step = zeta / (rho * rho_bar) if rho * rho_bar else 0.0
            h = F.col("v") / (alpha or 1.0) - F.col("h") * (theta / rho if rho else 0.0)
            cols = moved.select("i", "parts", "v", "z", h.alias("h"), w.alias("w"), (F.col("x") + w * step).alias("x"))
            if abs(zeta_bar) <= tol * begin or not alpha or not beta:
                return _cut(cols.select("i", F.col("x").alias("v"))), abs(zeta_bar) / begin
        raise RuntimeError(f"least squares did not settle in {most} steps")
    finally:
        p_slot.clear(spark)
        x_slot.clear(spark)
        parts.clear()
