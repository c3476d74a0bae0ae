"""Joins that the grid and point-set operators imply: co-registered tables, masks, remaps, scatters, neighbours."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def combine(a: DataFrame, b: DataFrame, key: str | list[str], expr: Column, name: str) -> DataFrame:
    """1:1 equi-join of co-registered tables and one expression of both."""
    keys = [key] if isinstance(key, str) else key
    return a.join(b, keys).select(*keys, expr.alias(name))


def masked(values: DataFrame, mask: DataFrame, key: str, value: str, background: float = 0.0) -> DataFrame:
    """All rows; the value where the key is in ``mask``, else the background."""
    m = mask.select(key).distinct().withColumn("_in", F.lit(True))
    return values.join(m, key, "left").withColumn(value, F.when(F.col("_in"), F.col(value)).otherwise(F.lit(background))).drop("_in")


def remap(rows: DataFrame, table: DataFrame, key: str, new: str) -> DataFrame:
    """Label by label table; labels that it lacks go. Catalyst broadcasts the table if it is small."""
    return rows.join(table.select(key, new), key)


def repopulate(rows: DataFrame, n: int, idx: str, value: str, absent: float = 0.0) -> DataFrame:
    """A dense column of n places from stored (index, value) rows."""
    space = rows.sparkSession.range(n).withColumnRenamed("id", idx)
    return space.join(rows.select(F.col(idx).cast("bigint").alias(idx), value), idx, "left").withColumn(value, F.coalesce(F.col(value), F.lit(absent)))


def in_list(rows: DataFrame, column: str, text: str, delimiter: str = ",") -> DataFrame:
    """Rows whose value is in a delimited list."""
    return rows.where(F.col(column).isin(*[x.strip() for x in text.split(delimiter) if x.strip()]))


#: Neighbourhoods by size: axis steps of at most 1 with 1, 2 or 3 of them not 0.
def offsets(connectivity: int, dims: int = 3) -> list[tuple[int, ...]]:
    most = {4: 1, 6: 1, 8: 2, 18: 2, 26: 3}[connectivity]
    return [o for o in product((-1, 0, 1), repeat=dims) if 0 < sum(map(abs, o)) <= most]


def neighbours(sites: DataFrame, axes: list[str], value: str, steps: list[tuple[int, ...]], extra: list[str] | None = None) -> DataFrame:
    """(site, value, neighbour's value): the neighbour's row is moved onto the site and met by an equi-join."""
    extra = extra or []
    step = F.explode(F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip(axes, s)]) for s in steps])).alias("_o")
    moved = sites.select(*extra, *[F.col(a).alias(f"_{a}") for a in axes], F.col(value).alias("neighbour"), step)
    moved = moved.select(*extra, *[(F.col(f"_{a}") - F.col(f"_o.{a}")).cast(sites.schema[a].dataType).alias(a) for a in axes], "neighbour")
    return sites.select(*extra, *axes, value).join(moved, [*extra, *axes])


#: Rows that a search by literals takes at most.
MOST_QUERIES = 5000
#: Points and queries of a block of a nearest-neighbour search; queries whose distances are held at once.
POINT_BLOCK, QUERY_BLOCK, CHUNK = 4096, 2048, 64


def knn(points: DataFrame, queries: DataFrame, k: int, id_col: str, features: str) -> DataFrame:
    """(query, id, dist, rank) of the k nearest others by Euclidean distance, exactly; of equal distances the smaller id.

    Points and queries are dealt into blocks by hash, and each block of points meets each block of queries in a task that holds
    these two and gives the k best of each query, so only those are ranked in all. Rows without an id, without features or with a null among them are left out.
    """
    def prepared(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).alias("id"), F.transform(features, lambda x: x.cast("double")).alias("f"))
        return df.where(F.col("id").isNotNull() & F.col("f").isNotNull() & ~F.exists("f", lambda x: x.isNull()))

    def blocks(n: int, size: int) -> int:
        return max(1, -(-n // size))

    p, q = prepared(points), prepared(queries)
    rows, columns = blocks(p.count(), POINT_BLOCK), blocks(q.count(), QUERY_BLOCK)
    place = lambda n: F.pmod(F.xxhash64("id", "f"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = p.withColumn("row", place(rows)).withColumn("column", every(columns))
    q = q.withColumn("column", place(columns)).withColumn("row", every(rows))
    kind = points.schema[id_col].dataType
    schema = T.StructType([T.StructField("query", queries.schema[id_col].dataType), T.StructField(id_col, kind), T.StructField("dist", T.DoubleType())])

    def best(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return to_arrow_schema(schema).empty_table()
        held = held.sort_by("id")
        matrix = lambda t: pc.list_flatten(t["f"]).to_numpy().reshape(t.num_rows, -1)
        x, y = np.ascontiguousarray(matrix(held).T), matrix(asked)
        same = pa.chunked_array([*held["id"].chunks, *asked["id"].cast(held["id"].type).chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        own, other = same[:held.num_rows], same[held.num_rows:]
        who, whom, far = [], [], []
        for lo in range(0, len(y), CHUNK):
            part = y[lo:lo + CHUNK]
            d, step = np.zeros((len(part), x.shape[1])), np.empty((len(part), x.shape[1]))
            for i in range(len(x)):  # a dimension after the other, as a sum over an array goes
                np.subtract(x[i][None, :], part[:, i, None], out=step)
                step *= step
                d += step
            np.sqrt(d, out=d)
            for j in range(len(part)):
                at = np.flatnonzero(own != other[lo + j])
                if len(at) > k:  # all that are as near as the k-th
                    kth = np.partition(d[j, at], k - 1)[k - 1]
                    at = at[~(d[j, at] > kth)]
                at = at[np.argsort(d[j, at], kind="stable")][:k]
                who.append(np.full(len(at), lo + j))
                whom.append(at)
                far.append(d[j, at])
        return pa.table([asked["id"].take(pa.array(np.concatenate(who))), held["id"].take(pa.array(np.concatenate(whom))), pa.array(np.concatenate(far))], schema=to_arrow_schema(schema))

    pairs = p.groupBy("row", "column").cogroup(q.groupBy("row", "column")).applyInArrow(best, schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("dist", id_col))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def radius_join(points: DataFrame, radius: float, id_col: str, axes: list[str]) -> DataFrame:
    """(a, b, dist), a < b, of points within a radius: cells of that size meet by equi-join, then distances are checked."""
    cell = [F.floor(F.col(c) / radius).cast("bigint") for c in axes]
    base = points.select(id_col, *axes, *[c.alias(f"_c{i}") for i, c in enumerate(cell)])
    step = F.explode(F.array(*[F.struct(*[F.lit(d).alias(f"o{i}") for i, d in enumerate(s)]) for s in product((-1, 0, 1), repeat=len(axes))])).alias("_o")
    moved = base.select(F.col(id_col).alias("b"), *[F.col(a).alias(f"_b_{a}") for a in axes], *[F.col(f"_c{i}") for i in range(len(axes))], step)
    moved = moved.select("b", *[f"_b_{a}" for a in axes], *[(F.col(f"_c{i}") + F.col(f"_o.o{i}")).alias(f"_c{i}") for i in range(len(axes))])
    met = base.withColumnRenamed(id_col, "a").join(moved, [f"_c{i}" for i in range(len(axes))]).where("a < b")
    d2 = sum(((F.col(a) - F.col(f"_b_{a}")) ** 2 for a in axes), F.lit(0.0))
    return met.select("a", "b", F.sqrt(d2).alias("dist")).where(F.col("dist") <= radius)


def nearest(points: DataFrame, others: DataFrame, id_col: str, features: str) -> DataFrame:
    """The nearest other of each point, the smaller id of ties; ``others`` is a small table such as centroids, whose rows become literals. Repeated points stay."""
    from gridstone.operators.elementwise import array_ssd

    kind = others.schema[id_col].dataType
    rows = others.orderBy(id_col).limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        raise ValueError(f"over {MOST_QUERIES} others: use knn")
    costs = F.array(*[F.struct(array_ssd(F.col(features), F.lit([float(x) for x in r[features]])).alias("d"), F.lit(r[id_col]).cast(kind).alias("id")) for r in rows])
    best = points.withColumn("_m", F.array_min(costs))
    return best.select(*[c for c in points.columns if c != features], F.col("_m.id").alias("nearest"), F.sqrt("_m.d").alias("dist"))


def grid_extent(spark: SparkSession, sizes: dict[str, int]) -> DataFrame:
    """All sites of a dense grid, from its linear index."""
    n = math.prod(sizes.values())
    out, rest = spark.range(n), F.col("id")
    for name, size in sizes.items():
        out = out.withColumn(name, F.pmod(rest, F.lit(size)).cast("int"))
        rest = F.floor(rest / size)
    return out.drop("id")
