"""Pipelines of several operators: spherical-mean fits, tolerance groups, consensus of masks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tolerance_groups(df: DataFrame, key: str, order: str, v: str, relative: float = 0.1) -> DataFrame:
    """(key, order, v, head): values in order join the first group whose first member is within a share of it, else open one.

    A group's values are folded in one row, as each depends on those before; it suits few distinct values, such as shells.
    """
    listed = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(v).cast("double").alias("v")))).alias("s"))
    empty = F.array().cast("array<double>")
    heads = F.aggregate("s", empty, lambda acc, x: F.when(F.exists(acc, lambda h: F.abs(x.v - h) <= relative * F.abs(h)), acc).otherwise(F.concat(acc, F.array(x.v))))
    rows = listed.withColumn("heads", heads).select(key, "heads", F.explode("s").alias("x"))
    return rows.select(key, F.col("x.o").alias(order), F.col("x.v").alias(v), F.element_at(F.filter("heads", lambda h: F.abs(F.col("x.v") - h) <= relative * F.abs(h)), 1).alias("head"))


def fit_spherical_mean(signals: DataFrame, id_col: str, values: list[str], b: list[float], steps: int = 40, top: float = 3.05) -> DataFrame:
    """(id, lp, lt, ssq): the grid pair lp >= lt with the least squared distance to a row's shell means; rows of zeros give zeros.

    The model's table of steps^2 / 2 pairs is computed once and goes to the tasks as a constant; rows stay where they are.
    """
    from gridstone.functions.special import spherical_mean

    grid = np.linspace(0, 1, steps)
    lp, lt = (x.ravel() for x in np.meshgrid(grid, grid, indexing="ij"))
    keep = lp >= lt
    lp, lt = lp[keep] * top, lt[keep] * top
    model = np.stack([spherical_mean(np.full_like(lp, x), lp, lt) for x in b], axis=1)
    id_type = signals.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                x = np.stack([part[v].to_numpy(zero_copy_only=False) for v in values], axis=1)
                cost = (x ** 2).sum(axis=1)[:, None] - 2 * x @ model.T + (model ** 2).sum(axis=1)[None]
                best = cost.argmin(axis=1)
                live = (x != 0).any(axis=1)
                yield pa.RecordBatch.from_arrays([part[id_col], pa.array(np.where(live, lp[best], 0.0)), pa.array(np.where(live, lt[best], 0.0)), pa.array(np.where(live, np.maximum(cost[np.arange(len(best)), best], 0.0), 0.0))], [id_col, "lp", "lt", "ssq"])

    return signals.select(id_col, *[F.col(v).cast("double").alias(v) for v in values]).mapInArrow(run, f"{id_col} {id_type}, lp double, lt double, ssq double")


def consensus(votes: DataFrame, rounds: int = 10, prior: float = 0.5) -> DataFrame:
    """(site, p): expectation-maximisation over (site, rater, vote 0/1) with a sensitivity and specificity for each rater.

    Raters are few: their two numbers are all that a round brings to the driver.
    """
    rates = {r["rater"]: (0.9, 0.9) for r in votes.select("rater").distinct().collect()}
    for k in range(rounds + 1):
        table = F.create_map(*[x for r, (se, sp) in rates.items() for x in (F.lit(r), F.struct(F.lit(math.log(se)).alias("a"), F.lit(math.log(1 - se)).alias("b"), F.lit(math.log(1 - sp)).alias("c"), F.lit(math.log(sp)).alias("d")))])
        s = F.element_at(table, F.col("rater"))
        one = F.sum(F.when(F.col("vote") == 1, s["a"]).otherwise(s["b"]))
        zero = F.sum(F.when(F.col("vote") == 1, s["c"]).otherwise(s["d"]))
        p = votes.groupBy("site").agg((1 / (1 + F.exp(math.log((1 - prior) / prior) + zero - one))).alias("p"))
        if k == rounds:
            return p
        stats = votes.join(p, "site").groupBy("rater").agg(F.sum(F.col("p") * F.col("vote")).alias("tp"), F.sum("p").alias("pos"), F.sum((1 - F.col("p")) * (1 - F.col("vote"))).alias("tn"), F.sum(1 - F.col("p")).alias("neg")).collect()
        clip = lambda x: min(max(x, 1e-6), 1 - 1e-6)
        rates = {r["rater"]: (clip(r["tp"] / max(r["pos"], 1e-12)), clip(r["tn"] / max(r["neg"], 1e-12))) for r in stats}
    return p


def rank_clusters(points: DataFrame, cluster: str, feature: str, names: list[int]) -> DataFrame:
    """Clusters renamed by the order of their mean feature; the k-th lowest gets names[k]."""
    means = points.groupBy(cluster).agg(F.avg(feature).alias("_m"))
    ranked = means.withColumn("class", F.get(F.array(*[F.lit(n) for n in names]), F.row_number().over(Window.orderBy("_m", cluster)) - 1))
    return points.join(F.broadcast(ranked.select(cluster, "class")), cluster)
