"""Nearest neighbours by a forest of random projection trees.

Trees are fitted on a bounded sample of the rows: each split takes the direction between two random sample rows and cuts at the median
of the sample along it, until a leaf is to hold about ``leaf`` of all rows. The trees are a small table of directions; every
row is sent down all of them in numpy batches, and gets a bucket in each. A query goes to several buckets of each tree, those with the
least distances to the cuts that lie between, and meets the rows there only, by exact distances; the best of all trees are
its neighbours. A bucket of many rows, as of one vector that repeats, is cut into
blocks of rows and of queries, so no task grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of the sample; rows and queries of a block; rows that are sent down the trees at once.
SAMPLE, ROWS, QUERIES, STRETCH = 20_000, 20_000, 2_000, 500

Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def fit_tree(sample: np.ndarray, least: int, rng: np.random.Generator) -> Tree:
    """(directions, cuts, left, right) of a tree's splits; a negative child is leaf -child - 1. Sample rows of one place are not split."""
    directions, cuts, children, leaves = [], [], [], 0
    todo = [(np.arange(len(sample)), None)]
    while todo:
        rows, place = todo.pop()
        at, x = None, sample[rows]
        for _ in range(5):  # two rows may be equal
            if len(rows) < 2 * least or len(rows) < 2:
                break
            a, b = rng.choice(len(rows), 2, replace=False)
            along = x @ (x[a] - x[b])
            cut = np.median(along)
            left = along < cut
            if 0 < left.sum() < len(rows):
                at = len(directions)
                directions.append(x[a] - x[b])
                cuts.append(cut)
                children.append([0, 0])
                todo += [(rows[left], (at, 0)), (rows[~left], (at, 1))]
                break
        if at is None:
            leaves += 1
        if place is not None:
            children[place[0]][place[1]] = -leaves if at is None else at
    dims = max(1, sample.shape[1])
    ends = np.array(children, np.int64).reshape(-1, 2)
    return np.array(directions).reshape(-1, dims), np.array(cuts), ends[:, 0], ends[:, 1]


def leaves(x: np.ndarray, tree: Tree) -> np.ndarray:
    """Leaf of each row, from 0."""
    directions, cuts, left, right = tree
    node = np.zeros(len(x), np.int64) if len(cuts) else np.full(len(x), -1)
    while (live := np.flatnonzero(node >= 0)).size:
        at = node[live]
        along = np.einsum("ij,ij->i", x[live], directions[at])
        node[live] = np.where(along < cuts[at], left[at], right[at])
    return -node - 1


def nearest_leaves(x: np.ndarray, tree: Tree, probes: int) -> np.ndarray:
    """The ``probes`` leaves (or all) of a tree that each row is nearest to: those of the least sum of squared distances to the cuts that lie between."""
    directions, cuts, left, right = tree
    if not len(cuts):
        return np.zeros((len(x), 1), np.int64)
    n_leaves = -int(min(left.min(), right.min()))
    far = np.full((len(x), n_leaves), np.inf)
    todo = [(0, np.zeros(len(x)))]
    while todo:
        node, beyond = todo.pop()
        gap = (x @ directions[node] - cuts[node]) / np.linalg.norm(directions[node])
        for child, behind in ((left[node], gap >= 0), (right[node], gap < 0)):
            there = beyond + np.where(behind, gap * gap, 0.0)
            if child < 0:
                far[:, -child - 1] = there
            else:
                todo.append((child, there))
    return np.argpartition(far, min(probes, n_leaves) - 1, axis=1)[:, :probes].astype(np.int64)


def fit(points: DataFrame, id_col: str, features: str, trees: int, leaf: int, seed: int = 0) -> list[Tree]:
    """The trees, from the rows (about SAMPLE of them) whose hash of the id is under a share of its range."""
    n = points.count()
    few = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(n, 1)))
    rows = points.where(few & F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("f")).toPandas()["f"]
    sample = np.stack(rows.to_list()) if len(rows) else np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    return [fit_tree(sample, max(1, leaf * len(sample) // max(2 * n, 1)), rng) for _ in range(trees)]


def buckets(points: DataFrame, id_col: str, features: str, forest: list[Tree], probes: int | None = None) -> DataFrame:
    """(id, features, tree, leaf): each row once for each tree, or in the ``probes`` nearest leaves of each. Rows without features are left out."""
    schema = T.StructType([T.StructField("id", points.schema[id_col].dataType), T.StructField("f", T.ArrayType(T.DoubleType())), T.StructField("leaves", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for lo in range(0, b.num_rows, STRETCH):
                    part = b.slice(lo, STRETCH)
                    x = np.stack([np.asarray(v, float) for v in part["f"].to_numpy(zero_copy_only=False)])
                    each = [leaves(x, t)[:, None] if probes is None else nearest_leaves(x, t, probes) for t in forest]
                    found = np.concatenate([(k << 32) + f for k, f in enumerate(each)], axis=1)  # tree and leaf in one number
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
                    yield pa.RecordBatch.from_arrays([part["id"], part["f"], lists], schema.names)

    rows = points.where(F.col(features).isNotNull()).select(F.col(id_col).alias("id"), F.col(features).cast("array<double>").alias("f"))
    at = rows.mapInArrow(run, schema).select("id", "f", F.explode("leaves").alias("_at"))
    return at.select("id", "f", F.shiftright("_at", 32).cast("int").alias("tree"), F.col("_at").bitwiseAND(F.lit((1 << 32) - 1)).alias("leaf"))


def forest_knn(points: DataFrame, queries: DataFrame, k: int, id_col: str, features: str, trees: int = 8, leaf: int = 250, probes: int = 24, seed: int = 0) -> DataFrame:
    """(query, id, dist, rank) of the k nearest others, by Euclidean distance, among the rows that share a bucket with the query.

    Distances are exact; a neighbour that shares no bucket is missed. Recall grows with ``trees``, ``leaf`` and ``probes``. Rows of the
    query's own id are no neighbours; ties go to the smaller id. Vectors have one length; null ones take no part. A query whose
    buckets hold fewer than k others gets fewer rows. Empty tables give none.
    """
    forest = fit(points, id_col, features, trees, leaf, seed)
    own, asked = buckets(points, id_col, features, forest), buckets(queries, id_col, features, forest, probes)
    key = ["tree", "leaf"]
    sizes = own.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("np"))
    asks = asked.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("nq"))
    both = sizes.join(asks, key)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    rows = own.join(both, key).select(*key, block("np").alias("p"), spread("nq").alias("q"), "id", "f")
    asking = asked.join(both, key).select(*key, spread("np").alias("p"), block("nq").alias("q"), "id", "f")
    id_type = points.schema[id_col].dataType
    schema = T.StructType([T.StructField("query", queries.schema[id_col].dataType), T.StructField("id", id_type), T.StructField("dist", T.DoubleType())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query": right["id"].slice(0, 0), "id": left["id"].slice(0, 0), "dist": pa.array([], pa.float64())})
        order = left["id"].to_pandas().argsort(kind="stable").to_numpy()
        x = np.stack(left["f"].to_numpy())[order]
        ids, asks_ = left["id"].take(pa.array(order)), right["id"].to_numpy()
        plain = ids.to_numpy()
        who, what, dist = [], [], []
        for i, q in enumerate(np.stack(right["f"].to_numpy())):
            d = np.sqrt(((x - q) ** 2).sum(axis=1))
            d[plain == asks_[i]] = np.inf
            best = np.argsort(d, kind="stable")[:k] if len(d) <= 4 * k else (near := np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]))[np.argsort(d[near], kind="stable")][:k]
            best = best[np.isfinite(d[best])]
            who.append(np.full(len(best), i))
            what.append(best)
            dist.append(d[best])
        return pa.table({"query": right["id"].take(pa.array(np.concatenate(who))), "id": ids.take(pa.array(np.concatenate(what))), "dist": pa.array(np.concatenate(dist))})

    task = [*key, "p", "q"]
    found = rows.groupBy(*task).cogroup(asking.groupBy(*task)).applyInArrow(meet, schema).groupBy("query", "id").agg(F.min("dist").alias("dist"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("dist", "id"))  # trees x probes x blocks x k rows a query at most
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("id", id_col)
