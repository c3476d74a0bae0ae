"""Registered queries of the grid, signal, graph and algebra operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridstone.functions import special
from gridstone.operators import algebra, elementwise, geometry, graph, histograms, learning, mesh, mixture, morphology, reductions, relate, sequence
from gridstone.plans import pipelines
from gridstone.sources import text as text_files

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f
    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


# Tables that several queries derive.

def day_grid(spark: SparkSession, d: str) -> DataFrame:
    """(s, day, v): order totals of each status on every day, 0 where there is none; statuses are lines of a dense grid."""
    o = t(spark, d, "orders").select(F.col("o_orderstatus").alias("s"), F.datediff("o_orderdate", F.lit("1995-01-01")).alias("day"), "o_totalprice")
    sums = o.groupBy("s", "day").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    lines = o.select("s").distinct()
    days = spark.range(2405).select(F.col("id").cast("int").alias("day"))
    return lines.crossJoin(F.broadcast(days)).join(sums, ["s", "day"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


DAY_SQL = """
o AS (SELECT o_orderstatus AS s, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS day, o_totalprice FROM orders),
g AS (SELECT l.s, CAST(d.day AS INTEGER) AS day, coalesce(x.v, 0.0) AS v FROM (SELECT DISTINCT s FROM o) l CROSS JOIN (SELECT unnest(range(2405)) AS day) d
      LEFT JOIN (SELECT s, day, round(sum(o_totalprice), 2) AS v FROM o GROUP BY ALL) x ON x.s = l.s AND x.day = d.day)
"""


def month_grid(spark: SparkSession, d: str) -> DataFrame:
    """(x, y, v): order totals (millions) by customer nation and month of the year, on a dense 25 x 12 grid."""
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sums = o.groupBy(F.col("c_nationkey").alias("x"), (F.month("o_orderdate") - 1).alias("y")).agg(F.round(F.sum("o_totalprice") / 1e6, 6).alias("v"))
    return relate.grid_extent(spark, {"x": 25, "y": 12}).join(sums, ["x", "y"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


MONTH_SQL = """
m AS (SELECT c_nationkey AS x, month(o_orderdate) - 1 AS y, round(sum(o_totalprice) / 1e6, 6) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
g AS (SELECT CAST(a.x AS INTEGER) AS x, CAST(b.y AS INTEGER) AS y, coalesce(m.v, 0.0) AS v FROM (SELECT unnest(range(25)) AS x) a CROSS JOIN (SELECT unnest(range(12)) AS y) b LEFT JOIN m ON m.x = a.x AND m.y = b.y)
"""


def coo(spark: SparkSession, d: str, kind: str = "l_quantity") -> DataFrame:
    """(r, c, v): customer nation by part brand."""
    li = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("bigint") - 1
    return li.groupBy(F.col("c_nationkey").cast("bigint").alias("r"), brand.alias("c")).agg(F.round(F.sum(kind), 4).alias("v"))


def coo_sql(name: str, kind: str = "l_quantity") -> str:
    return f"""{name} AS (SELECT CAST(c_nationkey AS BIGINT) AS r, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) - 1 AS c, round(sum({kind}), 4) AS v
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def nation_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nations, and symmetric edges weighted by orders from customers of one nation served by suppliers of the other."""
    li = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = li.where("c_nationkey != s_nationkey").groupBy(F.least("c_nationkey", "s_nationkey").cast("bigint").alias("src"), F.greatest("c_nationkey", "s_nationkey").cast("bigint").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id")), graph.symmetric(e)


GRAPH_SQL = """
h AS (SELECT CAST(least(c_nationkey, s_nationkey) AS BIGINT) AS a, CAST(greatest(c_nationkey, s_nationkey) AS BIGINT) AS b, CAST(count(*) AS DOUBLE) AS weight
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
e AS (SELECT a AS src, b AS dst, weight FROM h UNION ALL SELECT b, a, weight FROM h)
"""


# Element-wise expressions and filters.

@query("binarize_range", "SELECT l_returnflag, CAST(sum(CASE WHEN l_quantity >= 10 AND l_quantity < 25 THEN 1 ELSE 0 END) AS BIGINT) AS inside, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(elementwise.binarize(F.col("l_quantity"), 10, 25)).alias("inside"), F.count(F.lit(1)).alias("n"))


@query("mask_crop", "SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN o_totalprice ELSE 0 END AS o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    mask = t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return relate.masked(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), mask, "o_custkey", "o_totalprice").select("o_orderkey", "o_totalprice")


@query("label_extract", "SELECT label, round(sum(CASE WHEN label = 2 THEN CAST(embedding[1] AS DOUBLE) ELSE 0 END), 6) AS total, count(*) AS n FROM embeddings GROUP BY 1")
def _(spark, d):
    e = t(spark, d, "embeddings")
    kept = elementwise.keep_label(F.get("embedding", F.lit(0)).cast("double"), F.col("label"), 2)
    return e.groupBy("label").agg(F.round(F.sum(kept), 6).alias("total"), F.count(F.lit(1)).alias("n"))


@query("inlist_filter", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def _(spark, d):
    return relate.in_list(t(spark, d, "events"), "event_type", "click,view").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("image_add", "SELECT l_orderkey, round(sum(l_quantity) + sum(l_tax * 100), 6) AS v FROM lineitem GROUP BY 1")
def _(spark, d):
    li = t(spark, d, "lineitem")
    a, b = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("a")), li.groupBy("l_orderkey").agg(F.sum(F.col("l_tax") * 100).alias("b"))
    return relate.combine(a, b, "l_orderkey", F.round(F.col("a") + F.col("b"), 6), "v")


_FA = "(lp - (lp + 2 * lt) / 3) * (lp - (lp + 2 * lt) / 3)", "2 * (lt - (lp + 2 * lt) / 3) * (lt - (lp + 2 * lt) / 3)"


@query("fa_expr", f"WITH p AS (SELECT l_returnflag AS k, l_quantity AS lp, l_tax * 100 AS lt FROM lineitem) SELECT k, round(avg(CASE WHEN (lp + 2 * lt) / 3 = 0 OR lp * lp + 2 * lt * lt = 0 THEN 0.0 ELSE sqrt(1.5 * ({_FA[0]} + {_FA[1]}) / (lp * lp + 2 * lt * lt)) END), 6) AS fa FROM p GROUP BY 1")
def _(spark, d):
    fa = elementwise.fa_axisymmetric(F.col("l_quantity"), F.col("l_tax") * 100)
    return t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.round(F.avg(fa), 6).alias("fa"))


@query("fa_script_expr", f"WITH p AS (SELECT l_returnflag AS k, l_quantity AS lp, l_tax * 100 AS lt FROM lineitem) SELECT k, round(avg(CASE WHEN {_FA[0]} + lt * lt = 0 THEN 0.0 ELSE sqrt(1.5 * ({_FA[0]} + {_FA[1]}) / ({_FA[0]} + lt * lt)) END), 6) AS fa FROM p GROUP BY 1")
def _(spark, d):
    fa = elementwise.fa_script(F.col("l_quantity"), F.col("l_tax") * 100)
    return t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.round(F.avg(fa), 6).alias("fa"))


@query("safe_log_feature", "SELECT event_id, round(CASE WHEN value > 0 THEN ln(value) ELSE 0 END, 9) AS lv FROM events")
def _(spark, d):
    return t(spark, d, "events").select("event_id", F.round(elementwise.guarded_log(F.col("value")), 9).alias("lv"))


@query("normalize_by_ref", "SELECT l_returnflag, round(sum(CASE WHEN o_totalprice > 0 THEN l_extendedprice / o_totalprice ELSE 0 END), 4) AS share FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, d):
    j = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_returnflag").agg(F.round(F.sum(elementwise.normalize_by(F.col("l_extendedprice"), F.col("o_totalprice"))), 4).alias("share"))


@query("adc_expr", "SELECT l_returnflag, round(avg(CASE WHEN o_totalprice > 0 AND l_extendedprice > 0 THEN (ln(o_totalprice) - ln(l_extendedprice)) / l_linenumber ELSE 0 END), 6) AS adc FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, d):
    j = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_returnflag").agg(F.round(F.avg(elementwise.adc(F.col("l_extendedprice"), F.col("o_totalprice"), F.col("l_linenumber"))), 6).alias("adc"))


@query("artifact_reject", "WITH x AS (SELECT o_orderkey, max(l_extendedprice / o_totalprice) AS worst, sum(l_extendedprice / o_totalprice) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT o_orderkey, round(CASE WHEN worst > 1 THEN 0 ELSE s END, 6) AS ratio FROM x")
def _(spark, d):
    j = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("q", F.col("l_extendedprice") / F.col("o_totalprice"))
    return j.groupBy("o_orderkey").agg(F.round(F.when(F.max("q") > 1, 0.0).otherwise(F.sum("q")), 6).alias("ratio"))


@query("clamp_sign", "SELECT c_custkey, least(greatest(c_acctbal, 0.0), 5000.0) AS clamped, CAST(sign(c_acctbal) AS DOUBLE) AS sgn, isfinite(c_acctbal) AS finite, abs(c_acctbal - round(c_acctbal, 1)) <= greatest(1e-12, 1e-3 * greatest(abs(c_acctbal), abs(round(c_acctbal, 1)))) AS near FROM customer")
def _(spark, d):
    v = F.col("c_acctbal")
    return t(spark, d, "customer").select("c_custkey", elementwise.clamp(v, 0.0, 5000.0).alias("clamped"), elementwise.sign(v).alias("sgn"), elementwise.is_finite(v).alias("finite"), elementwise.almost_equal(v, F.round(v, 1), 1e-12, 1e-3).alias("near"))


@query("index_site", "SELECT l_linenumber AS x, CAST(l_quantity AS INTEGER) AS y, CAST(count(*) AS BIGINT) AS n, CAST((2 * 64 + CAST(l_quantity AS INTEGER)) * 16 + l_linenumber AS BIGINT) AS idx, CAST(((2 * 64 + CAST(l_quantity AS INTEGER)) * 16 + l_linenumber) // 16 % 64 AS BIGINT) AS back_y FROM lineitem GROUP BY ALL")
def _(spark, d):
    from gridstone.model import index_of, site_of

    g = t(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("x"), F.col("l_quantity").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("idx", index_of(F.col("x"), F.col("y"), F.lit(2), 16, 64))
    return g.withColumn("back_y", site_of(F.col("idx"), 16, 64)[1].cast("bigint"))


@query("gradient_flip", "SELECT vec_id, -CAST(embedding[1] AS DOUBLE) AS gx, -CAST(embedding[2] AS DOUBLE) AS gy, -CAST(embedding[3] AS DOUBLE) AS gz FROM embeddings")
def _(spark, d):
    g = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    x = elementwise.flip_gradient(*elementwise.flip_gradient(*g, 1), 6)
    return t(spark, d, "embeddings").select("vec_id", x[0].alias("gx"), x[1].alias("gy"), x[2].alias("gz"))


@query("tensor_design", "WITH g AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings) SELECT vec_id, round(2 * x * x, 9) AS xx, round(4 * x * y, 9) AS xy, round(4 * x * z, 9) AS xz, round(2 * y * y, 9) AS yy, round(4 * y * z, 9) AS yz, round(2 * z * z, 9) AS zz FROM g")
def _(spark, d):
    g = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    return t(spark, d, "embeddings").select("vec_id", *[F.round(c, 9).alias(n) for c, n in zip(elementwise.tensor_row(*g, F.lit(2.0)), ("xx", "xy", "xz", "yy", "yz", "zz"))])


@query("floor_nonpositive", "SELECT s_suppkey, CASE WHEN s_acctbal <= 0 THEN 0.01 ELSE s_acctbal END AS v FROM supplier")
def _(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", elementwise.floor_nonpositive(F.col("s_acctbal")).alias("v"))


@query("fa_eigenvalues", "WITH g AS (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) * 10 AS a, abs(CAST(embedding[2] AS DOUBLE)) * 10 AS b, abs(CAST(embedding[3] AS DOUBLE)) * 10 AS c FROM embeddings), m AS (SELECT *, (a + b + c) / 3 AS m, a * a + b * b + c * c AS q FROM g) SELECT vec_id, round(CASE WHEN q <= 0.1 THEN 0 ELSE least(greatest(sqrt(1.5 * ((a - m) * (a - m) + (b - m) * (b - m) + (c - m) * (c - m)) / q), 0), 1) END, 9) AS fa FROM m")
def _(spark, d):
    g = [F.abs(F.get("embedding", F.lit(i)).cast("double")) * 10 for i in range(3)]
    return t(spark, d, "embeddings").select("vec_id", F.round(elementwise.fa_eigenvalues(*g), 9).alias("fa"))


@query("log_bin_index", "SELECT event_id, CAST(floor(ln(value / 0.01) / 0.01) + 1 AS BIGINT) AS bin FROM events WHERE value > 0")
def _(spark, d):
    return t(spark, d, "events").where("value > 0").select("event_id", elementwise.log_bin_index(F.col("value"), 0.01, 0.01).alias("bin"))


@query("complex_parts", "SELECT c_custkey, round(c_acctbal * c_acctbal + CAST(c_nationkey AS DOUBLE) * c_nationkey, 4) AS norm, round(atan2(CAST(c_nationkey AS DOUBLE), c_acctbal), 9) AS arg FROM customer")
def _(spark, d):
    re, im = F.col("c_acctbal"), F.col("c_nationkey").cast("double")
    return t(spark, d, "customer").select("c_custkey", F.round(elementwise.complex_norm(re, im), 4).alias("norm"), F.round(elementwise.complex_arg(re, im), 9).alias("arg"))


@query("foreground_all_positive", "SELECT l_orderkey, bool_and(l_quantity > 5 AND l_tax > 0) AS fg FROM lineitem GROUP BY 1")
def _(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and((F.col("l_quantity") > 5) & (F.col("l_tax") > 0)).alias("fg"))


@query("clear_last_slice", "SELECT l_linenumber, CAST(sum(CASE WHEN l_linenumber = (SELECT max(l_linenumber) FROM lineitem) THEN 0 ELSE l_quantity END) AS DOUBLE) AS v FROM lineitem GROUP BY 1")
def _(spark, d):
    li = t(spark, d, "lineitem")
    top = li.agg(F.max("l_linenumber").alias("top"))
    return li.crossJoin(F.broadcast(top)).groupBy("l_linenumber").agg(F.sum(F.when(F.col("l_linenumber") == F.col("top"), 0.0).otherwise(F.col("l_quantity"))).alias("v"))


@query("remap_labels", "WITH m AS (SELECT event_type, row_number() OVER (ORDER BY avg(value), event_type) - 1 AS rank FROM events GROUP BY 1) SELECT rank, count(*) AS n FROM events JOIN m USING (event_type) GROUP BY 1")
def _(spark, d):
    ev = t(spark, d, "events")
    ranks = reductions.rank_groups(ev, "event_type", "value")
    return relate.remap(ev, ranks, "event_type", "rank").groupBy(F.col("rank").cast("bigint").alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@query("quaternion_rotate", """WITH g AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)
SELECT vec_id, round(0.28 * x - 0.96 * y, 9) AS rx, round(0.96 * x + 0.28 * y, 9) AS ry, round(z, 9) AS rz FROM g""")
def _(spark, d):
    v = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    q = [F.lit(x) for x in (0.8, 0.0, 0.0, 0.6)]
    return t(spark, d, "embeddings").select("vec_id", *[F.round(c, 9).alias(n) for c, n in zip(elementwise.quaternion_rotate(q, v), ("rx", "ry", "rz"))])


@query("affine_points", "WITH g AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings) SELECT vec_id, round(2 * x + 1, 9) AS x, round(y - z, 9) AS y, round(0.5 * z + 3, 9) AS z FROM g")
def _(spark, d):
    v = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    m = [[2.0, 0.0, 0.0, 1.0], [0.0, 1.0, -1.0, 0.0], [0.0, 0.0, 0.5, 3.0]]
    return t(spark, d, "embeddings").select("vec_id", *[F.round(c, 9).alias(n) for c, n in zip(elementwise.affine_apply(m, v), "xyz")])


@query("triangle_area", """WITH g AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), s AS (SELECT vec_id, e[4]-e[1] AS a, e[5]-e[2] AS b, e[6]-e[3] AS c, e[7]-e[1] AS p, e[8]-e[2] AS q, e[9]-e[3] AS r FROM g)
SELECT vec_id, round(0.5 * sqrt((b*r-c*q)*(b*r-c*q) + (c*p-a*r)*(c*p-a*r) + (a*q-b*p)*(a*q-b*p)), 9) AS area FROM s""")
def _(spark, d):
    v = [F.get("embedding", F.lit(i)).cast("double") for i in range(9)]
    return t(spark, d, "embeddings").select("vec_id", F.round(elementwise.triangle_area(v[:3], v[3:6], v[6:]), 9).alias("area"))


# Reductions.

@query("range_minmax", "SELECT l_returnflag, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1")
def _(spark, d):
    return reductions.value_range(t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("mean_var", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS var FROM lineitem GROUP BY 1")
def _(spark, d):
    return reductions.mean_var(t(spark, d, "lineitem"), ["l_returnflag"], "l_quantity").select("l_returnflag", r6("mean"), r6("var"))


@query("count_nonzero", "SELECT l_returnflag, count(*) FILTER (l_tax <> 0) AS nnz FROM lineitem GROUP BY 1")
def _(spark, d):
    return reductions.count_nonzero(t(spark, d, "lineitem"), ["l_returnflag"], "l_tax")


@query("neg_entropy", "SELECT l_returnflag, round(sum(CASE WHEN l_discount > 0 THEN l_discount * ln(l_discount) ELSE 0 END), 4) AS neg_entropy FROM lineitem GROUP BY 1")
def _(spark, d):
    return reductions.neg_entropy(t(spark, d, "lineitem"), ["l_returnflag"], F.col("l_discount")).select("l_returnflag", r6("neg_entropy", 4))


@query("argmax_first", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS argmax, max(value) AS max FROM events GROUP BY 1")
def _(spark, d):
    return reductions.argmax_first(t(spark, d, "events"), ["user_id"], "value", "event_id")


@query("order_stat_quantiles", """WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS k, count(*) OVER () AS n FROM orders),
p AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS q) SELECT CAST(q AS INTEGER) AS q, v AS value FROM p JOIN r ON k = CASE q WHEN 0 THEN 0 WHEN 1 THEN n // 40 WHEN 2 THEN n // 4 WHEN 3 THEN n // 2 WHEN 4 THEN 3 * n // 4 WHEN 5 THEN 39 * n // 40 ELSE n - 1 END""")
def _(spark, d):
    return reductions.order_quantiles(t(spark, d, "orders"), "o_totalprice")


@query("centroids", "SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL")
def _(spark, d):
    return reductions.centroids(t(spark, d, "embeddings"), "label", "embedding").select("label", "dim", r6("mean"))


@query("class_rank_by_mean", "SELECT event_type, round(avg(value), 6) AS mean, CAST(row_number() OVER (ORDER BY avg(value), event_type) - 1 AS INTEGER) AS rank FROM events GROUP BY 1")
def _(spark, d):
    return reductions.rank_groups(t(spark, d, "events"), "event_type", "value").select("event_type", r6("mean"), F.col("rank").cast("int").alias("rank"))


@query("group_summary", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1")
def _(spark, d):
    return reductions.group_summary(t(spark, d, "events"), ["event_type"], "value").select("event_type", r6("mean"), r6("sd"))


@query("shell_mean", """WITH s AS (SELECT l_partkey, CAST(floor(l_quantity / 10) AS INTEGER) AS shell, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL)
SELECT a.l_partkey, a.shell, round(CASE WHEN b.m > 0 THEN a.m / b.m ELSE 0 END, 6) AS ratio FROM s a LEFT JOIN s b ON a.l_partkey = b.l_partkey AND b.shell = 0 WHERE a.shell > 0""")
def _(spark, d):
    s = t(spark, d, "lineitem").groupBy("l_partkey", F.floor(F.col("l_quantity") / 10).cast("int").alias("shell")).agg(F.avg("l_extendedprice").alias("m"))
    ref = F.max(F.when(F.col("shell") == 0, F.col("m"))).over(Window.partitionBy("l_partkey"))
    return s.withColumn("ref", ref).where("shell > 0").select("l_partkey", "shell", F.round(F.coalesce(elementwise.normalize_by(F.col("m"), F.col("ref")), F.lit(0.0)), 6).alias("ratio"))


@query("linear_cc", "SELECT l_returnflag, round(1 - corr(l_extendedprice, l_quantity), 6) AS distance FROM lineitem GROUP BY 1")
def _(spark, d):
    return reductions.correlation_distance(t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity").select("l_returnflag", r6("distance"))


@query("ssd_masked", "SELECT l_linestatus, round(avg((l_tax - l_discount) * (l_tax - l_discount)), 9) AS ssd FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def _(spark, d):
    return reductions.ssd(t(spark, d, "lineitem").where("l_returnflag = 'A'"), ["l_linestatus"], F.col("l_tax"), F.col("l_discount")).select("l_linestatus", r6("ssd", 9))


@query("dice_jaccard", """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn FROM labels)
SELECT round(2.0 * tp / (2 * tp + fp + fn), 9) AS dice, round(1.0 * tp / (tp + fp + fn), 9) AS jaccard, round(1.0 * tp / (tp + fn), 9) AS sensitivity, round(1.0 * tn / (tn + fp), 9) AS specificity FROM c""")
def _(spark, d):
    o = reductions.overlap(t(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1)
    return o.select(*[r6(c, 9) for c in o.columns])


_SHAPE = "(SELECT p_type, CAST(p_size AS DOUBLE) AS x, CAST(floor(p_retailprice) AS DOUBLE) AS y, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS DOUBLE) AS z FROM part)"


@query("shape_moments", f"SELECT p_type, count(*) AS n, round(avg(x), 6) AS m_x, round(avg(y), 6) AS m_y, round(avg(z), 6) AS m_z, round(covar_pop(x, x), 6) AS c_xx, round(covar_pop(x, y), 6) AS c_xy, round(covar_pop(x, z), 6) AS c_xz, round(covar_pop(y, y), 6) AS c_yy, round(covar_pop(y, z), 6) AS c_yz, round(covar_pop(z, z), 6) AS c_zz FROM {_SHAPE} GROUP BY 1")
def _(spark, d):
    p = t(spark, d, "part").select("p_type", F.col("p_size").cast("double").alias("x"), F.floor("p_retailprice").cast("double").alias("y"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("double").alias("z"))
    m = reductions.shape_moments(p, "p_type", ["x", "y", "z"])
    return m.select("p_type", "n", *[r6(c) for c in m.columns if c[:2] in ("m_", "c_")])


@query("bounding_box", f"SELECT p_type, min(x) - 1 AS x_low, max(x) + 1 AS x_high, min(z) - 1 AS z_low, max(z) + 1 AS z_high FROM {_SHAPE} GROUP BY 1")
def _(spark, d):
    p = t(spark, d, "part").select("p_type", F.col("p_size").cast("double").alias("x"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("double").alias("z"))
    return reductions.bounding_box(p, ["p_type"], ["x", "z"], 1)


@query("region_stats", "SELECT r_name, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, d):
    j = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean"), F.round(F.stddev_samp("c_acctbal"), 6).alias("sd"))


@query("ols_per_group", "SELECT l_partkey % 50 AS k, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def _(spark, d):
    return reductions.regression(t(spark, d, "lineitem").withColumn("k", F.col("l_partkey") % 50), ["k"], "l_extendedprice", "l_quantity").select("k", r6("slope", 4), r6("intercept", 4), r6("r2"))


@query("covariance", "WITH e AS (SELECT [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(covar_pop(e[i + 1], e[j + 1]), 9) AS cov FROM e, (SELECT unnest(range(64)) AS i), (SELECT unnest(range(64)) AS j) GROUP BY ALL")
def _(spark, d):
    return reductions.covariance(t(spark, d, "embeddings"), "embedding", 64).select("i", "j", r6("cov", 9))


@query("within_scatter", "WITH e AS (SELECT label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), s AS (SELECT i, j, label, count(*) * covar_pop(e[i + 1], e[j + 1]) AS s FROM e, (SELECT unnest(range(64)) AS i), (SELECT unnest(range(64)) AS j) GROUP BY ALL) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(s), 6) AS scatter FROM s GROUP BY ALL")
def _(spark, d):
    return reductions.within_scatter(t(spark, d, "embeddings"), "label", "embedding", 64).select("i", "j", r6("scatter"))


# Histograms and distributions.

@query("hist2d_linlog", """SELECT CAST(least(floor((l_quantity - 1) / 49 * 64), 63) AS INTEGER) AS i, CAST(least(floor((ln(l_extendedprice) - ln(500)) / (ln(200000) - ln(500)) * 64), 63) AS INTEGER) AS j, count(*) AS n
FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 AND l_extendedprice BETWEEN 500 AND 200000 GROUP BY ALL""")
def _(spark, d):
    return histograms.hist2d(t(spark, d, "lineitem"), histograms.linear_bin(F.col("l_quantity"), 1.0, 50.0, 64), histograms.log_bin(F.col("l_extendedprice"), 500.0, 200000.0, 64))


@query("hist2d_linlin", """SELECT CAST(least(floor((l_quantity - 1) / 49 * 32), 31) AS INTEGER) AS i, CAST(least(floor(l_extendedprice / 110000 * 64), 63) AS INTEGER) AS j, count(*) AS n
FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 AND l_extendedprice BETWEEN 0 AND 110000 GROUP BY ALL""")
def _(spark, d):
    return histograms.hist2d(t(spark, d, "lineitem"), histograms.linear_bin(F.col("l_quantity"), 1.0, 50.0, 32), histograms.linear_bin(F.col("l_extendedprice"), 0.0, 110000.0, 64))


@query("hist2d_loglog", """WITH l AS (SELECT min(ln(l_extendedprice)) AS a, max(ln(l_extendedprice)) AS b, min(ln(l_quantity)) AS c, max(ln(l_quantity)) AS d FROM lineitem WHERE l_extendedprice >= 1e-6 AND l_quantity >= 1e-6)
SELECT CAST(CASE WHEN l_extendedprice < 1e-6 THEN 0 ELSE least(floor((ln(l_extendedprice) - a) / (b - a) * 64), 63) END AS INTEGER) AS i, CAST(CASE WHEN l_quantity < 1e-6 THEN 0 ELSE least(floor((ln(l_quantity) - c) / (d - c) * 64), 63) END AS INTEGER) AS j, count(*) AS n FROM lineitem, l GROUP BY ALL""")
def _(spark, d):
    b = histograms.data_log_bin(histograms.data_log_bin(t(spark, d, "lineitem").select("l_extendedprice", "l_quantity"), "l_extendedprice", 64, "i"), "l_quantity", 64, "j")
    return b.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


_LINLIN = "CAST(least(floor((l_quantity - 1) / 49 * 16), 15) AS INTEGER) AS i, CAST(least(floor(l_extendedprice / 110000 * 16), 15) AS INTEGER) AS j, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 AND l_extendedprice BETWEEN 0 AND 110000"


def _linlin(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return histograms.hist2d(df, histograms.linear_bin(F.col("l_quantity"), 1.0, 50.0, 16), histograms.linear_bin(F.col("l_extendedprice"), 0.0, 110000.0, 16), keys)


@query("hist2d_slice", f"SELECT {_LINLIN} AND l_linenumber = 3 GROUP BY ALL")
def _(spark, d):
    return _linlin(t(spark, d, "lineitem").where("l_linenumber = 3"))


@query("hist2d_logcount", f"SELECT i, j, n, round(CASE WHEN n = 0 THEN 0 ELSE ln(n) END, 9) AS log_n FROM (SELECT {_LINLIN} GROUP BY ALL)")
def _(spark, d):
    return histograms.log_counts(_linlin(t(spark, d, "lineitem"))).select("i", "j", "n", r6("log_n", 9))


@query("hist_sum_across", f"SELECT {_LINLIN} GROUP BY ALL")
def _(spark, d):
    return histograms.sum_histograms(_linlin(t(spark, d, "lineitem"), ["l_returnflag"]))


@query("histogram_round", """WITH l AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM events) SELECT CAST(floor(255 * (value - lo) / (hi - lo) + 0.5) AS BIGINT) AS bin, round(count(*) / any_value(n), 9) AS p FROM events, l GROUP BY 1""")
def _(spark, d):
    return histograms.histogram_round(t(spark, d, "events"), "value", 256).select("bin", r6("p", 9))


_EMP = """l AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 999 AS w, count(*) AS n FROM orders),
c AS (SELECT CAST(floor((o_totalprice - lo) / w) AS BIGINT) AS bin, count(*) / any_value(n) AS p, any_value(lo) AS lo, any_value(w) AS w FROM orders, l GROUP BY 1),
dist AS (SELECT bin, lo + bin * w AS x, p, sum(p) OVER (ORDER BY bin) AS cdf FROM c)"""


@query("empirical_cdf", f"WITH {_EMP} SELECT bin, round(x, 4) AS x, round(p, 9) AS p, round(cdf, 9) AS cdf FROM dist")
def _(spark, d):
    return histograms.empirical(t(spark, d, "orders"), "o_totalprice").select("bin", r6("x", 4), r6("p", 9), r6("cdf", 9))


@query("empirical_quantile", f"WITH {_EMP} SELECT CAST(q AS DOUBLE) AS q, round(min(x), 4) AS x FROM dist, (SELECT unnest([0.1, 0.5, 0.9]) AS q) WHERE cdf >= q - 1e-12 GROUP BY 1")
def _(spark, d):
    return histograms.empirical_quantile(t(spark, d, "orders"), "o_totalprice", [0.1, 0.5, 0.9]).select("q", r6("x", 4))


@query("empirical_mode", f"WITH {_EMP} SELECT round(x, 4) AS mode FROM dist ORDER BY p DESC, bin LIMIT 1")
def _(spark, d):
    return histograms.empirical_mode(t(spark, d, "orders"), "o_totalprice").select(r6("mode", 4))


@query("nmi_joint", """WITH j AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY ALL), x AS (SELECT a, sum(p) AS pa FROM j GROUP BY 1), y AS (SELECT b, sum(p) AS pb FROM j GROUP BY 1)
SELECT round(2 * (SELECT sum(p * ln(p / (pa * pb))) FROM j JOIN x USING (a) JOIN y USING (b)) / ((SELECT -sum(pa * ln(pa)) FROM x) + (SELECT -sum(pb * ln(pb)) FROM y)), 6) AS nmi""")
def _(spark, d):
    return histograms.nmi(histograms.joint_counts(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus")).select(r6("nmi"))


@query("cooccurrence", "SELECT a, b, count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return histograms.cooccurrence(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("distinct_values", "SELECT DISTINCT l_quantity AS v FROM lineitem")
def _(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_quantity").alias("v")).distinct()


# Windows on signals and dense lines.

def _mirror_sql(half: int, expr: str) -> str:
    """Values at offsets with the mirror rule, as a list v of each user's events by place."""
    return f"""WITH s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v, list(event_id ORDER BY ts, event_id) AS ids FROM events GROUP BY 1),
p AS (SELECT user_id, ids[i + 1] AS event_id, i, len(v) AS n, v FROM s, unnest(range(0, len(v))) AS u(i)),
w AS (SELECT user_id, event_id, [CASE WHEN i + k < 0 THEN CASE WHEN -1 - (i + k) < n THEN v[-(i + k)] ELSE 0 END WHEN i + k >= n THEN CASE WHEN 2 * n - 1 - (i + k) >= 0 THEN v[2 * n - (i + k)] ELSE 0 END ELSE v[i + k + 1] END FOR k IN range(-{half}, {half} + 1)] AS x FROM p)
SELECT user_id, event_id, {expr} FROM w"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events in order of time; the place in time is a struct of time and id."""
    return t(spark, d, "events").select("user_id", "event_id", "value", "event_type", F.struct("ts", "event_id").alias("at"))


@query("moving_average_mirror", _mirror_sql(2, "round(list_sum(x) / 5, 6) AS ma"))
def _(spark, d):
    return sequence.moving_average(_events(spark, d), "user_id", "at", "value", 4).select("user_id", F.col("at.event_id").alias("event_id"), r6("ma"))


@query("fir_filter", _mirror_sql(2, "round(0.1 * x[1] + 0.2 * x[2] + 0.4 * x[3] + 0.2 * x[4] + 0.1 * x[5], 6) AS filtered"))
def _(spark, d):
    return sequence.fir_filter(_events(spark, d), "user_id", "at", "value", [0.1, 0.2, 0.4, 0.2, 0.1]).select("user_id", F.col("at.event_id").alias("event_id"), r6("filtered"))


@query("epoch_average", """WITH s AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
g AS (SELECT user_id, pos AS at FROM s WHERE event_type = 'error' AND pos - 2 >= 1 AND pos + 3 <= n)
SELECT CAST(k AS INTEGER) AS "offset", count(*) AS n, round(avg(value) - avg(avg(value)) OVER (), 6) AS mean FROM g, (SELECT unnest(range(-2, 4)) AS k) JOIN s ON s.user_id = g.user_id AND s.pos = g.at + k GROUP BY 1""")
def _(spark, d):
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("at"))
    return sequence.epoch_average(_events(spark, d).withColumn("pos", pos), "user_id", "pos", "value", F.col("event_type") == "error", 2, 3).select("offset", "n", r6("mean"))


@query("zscore_center", "SELECT event_id, round(value - avg(value) OVER w, 5) AS centered, round(CASE WHEN stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w ELSE 0 END, 6) AS z FROM events WINDOW w AS (PARTITION BY user_id)")
def _(spark, d):
    ev = t(spark, d, "events")
    return sequence.zscore(sequence.center(ev, ["user_id"], "value"), ["user_id"], "value").select("event_id", r6("centered", 5), r6("z"))


@query("argsort_rank", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1 AS INTEGER) AS place FROM customer")
def _(spark, d):
    return sequence.argsort(t(spark, d, "customer"), "c_acctbal", "c_custkey", ["c_nationkey"]).select("c_custkey", F.col("place").cast("int").alias("place"))


@query("box_filters", f"WITH {DAY_SQL} SELECT s, day, round(sum(v) OVER w, 2) AS box_sum, round(avg(v) OVER w, 4) AS box_mean, round(var_samp(v) OVER w, 0) AS box_var FROM g WINDOW w AS (PARTITION BY s ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def _(spark, d):
    return sequence.box(day_grid(spark, d), ["s"], "day", "v", 3).select("s", "day", r6("box_sum", 2), r6("box_mean", 4), r6("box_var", 0))


def _gauss(sigma: float, half: int) -> list[float]:
    """Taps for the SQL, from the definition: exp(-k^2 / 2 sigma^2) over their sum."""
    g = [2.718281828459045 ** (-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    return [x / sum(g) for x in g]


def _gauss_sql(col: str, taps: list[float]) -> str:
    h = len(taps) // 2
    at = [f"(lag({col}, {h - k}) OVER w)" if k < h else f"(lead({col}, {k - h}) OVER w)" if k > h else col for k in range(len(taps))]
    num = " + ".join(f"coalesce({a}, 0) * {g!r}" for a, g in zip(at, taps))
    den = " + ".join(f"(CASE WHEN {a} IS NULL THEN 0 ELSE {g!r} END)" for a, g in zip(at, taps))
    return f"({num}) / ({den})"


@query("gaussian1d", f"WITH {DAY_SQL} SELECT s, day, round({_gauss_sql('v', _gauss(1.5, 4))}, 4) AS smooth FROM g WINDOW w AS (PARTITION BY s ORDER BY day)")
def _(spark, d):
    return sequence.gaussian_filter(day_grid(spark, d), ["s"], "day", "v", 1.5).select("s", "day", r6("smooth", 4))


@query("gradient_laplace", f"WITH {DAY_SQL}, x AS (SELECT s, day, v, lag(v) OVER w AS p, lead(v) OVER w AS q FROM g WINDOW w AS (PARTITION BY s ORDER BY day)) SELECT s, day, round((q - p) / 2, 4) AS gradient, round(q - 2 * v + p, 4) AS laplace FROM x WHERE p IS NOT NULL AND q IS NOT NULL")
def _(spark, d):
    return sequence.gradient_central(day_grid(spark, d), ["s"], "day", "v").select("s", "day", r6("gradient", 4), r6("laplace", 4))


@query("lee_filter", f"""WITH {DAY_SQL}, x AS (SELECT s, day, v, [lag(v, 2) OVER w, lag(v) OVER w, v, lead(v) OVER w, lead(v, 2) OVER w] AS n FROM g WINDOW w AS (PARTITION BY s ORDER BY day))
SELECT s, day, round(list_avg([y FOR y IN n IF y IS NOT NULL AND abs(y - v) < 200000]), 4) AS lee FROM x""")
def _(spark, d):
    return sequence.lee_filter(day_grid(spark, d), ["s"], "day", "v", 2, 200000.0).select("s", "day", r6("lee", 4))


@query("autocorrelation", f"""WITH {DAY_SQL}, c AS (SELECT s, day, v - avg(v) OVER (PARTITION BY s) AS c, row_number() OVER (PARTITION BY s ORDER BY day) AS i, count(*) OVER (PARTITION BY s) AS n FROM g),
k AS (SELECT unnest(range(8)) AS lag), a AS (SELECT a.s, k.lag, sum(a.c * b.c) AS s2 FROM c a, k JOIN c b ON a.s = b.s AND b.i = a.i + k.lag WHERE a.i <= a.n - 8 GROUP BY ALL)
SELECT a.s, CAST(a.lag AS INTEGER) AS lag, round(a.s2 / z.s2, 6) AS acf FROM a JOIN a z ON a.s = z.s AND z.lag = 0""")
def _(spark, d):
    return sequence.autocorrelation(day_grid(spark, d), "s", "day", "v", 8).select("s", "lag", r6("acf"))


@query("iir_filter", f"WITH {DAY_SQL} SELECT a.s, a.day, round(sum(0.2 * pow(CAST(0.8 AS DOUBLE), a.day - b.day) * b.v), 4) AS filtered FROM g a JOIN g b ON a.s = b.s AND b.day <= a.day GROUP BY 1, 2")
def _(spark, d):
    return sequence.iir_filter(day_grid(spark, d), "s", "day", "v", [0.2], [1.0, -0.8]).select("s", "day", r6("filtered", 4))


@query("power_spectrum", f"""WITH {DAY_SQL}, f AS (SELECT s, CAST(k AS INTEGER) AS k, sum(v * cos(2 * pi() * (k * day % 2405) / 2405)) AS re, -sum(v * sin(2 * pi() * (k * day % 2405) / 2405)) AS im FROM g, (SELECT unnest(range(1203)) AS k) GROUP BY 1, 2)
SELECT s, k, round(sqrt(re * re + im * im), 0) AS power, round(CASE WHEN k = 0 THEN 0 ELSE atan2(im, re) END, 4) AS phase FROM f""")
def _(spark, d):
    return sequence.power_spectrum(day_grid(spark, d), "s", "day", "v").select("s", "k", r6("power", 0), r6("phase", 4))


# Geometry.

@query("flip_transpose", f"WITH {MONTH_SQL} SELECT y AS x, 24 - x AS y, v FROM g")
def _(spark, d):
    return geometry.transpose(geometry.flip(month_grid(spark, d), "x", 25), {"x": "y", "y": "x"})


@query("cut_paste", f"WITH {MONTH_SQL}, s AS (SELECT x - 5 + 10 AS x, y - 2 + 6 AS y, v FROM g WHERE x BETWEEN 5 AND 12 AND y BETWEEN 2 AND 5) SELECT g.x, g.y, coalesce(s.v, g.v) AS v FROM g LEFT JOIN s ON g.x = s.x AND g.y = s.y")
def _(spark, d):
    g = month_grid(spark, d)
    return geometry.paste(geometry.cut(g, {"x": 5, "y": 2}, {"x": 12, "y": 5}), g, {"x": 10, "y": 6}, "v").select("x", "y", "v")


@query("interpolate_grid", f"""WITH {MONTH_SQL}, p AS (SELECT s_suppkey, (s_suppkey % 230) / 10.0 AS px, (s_suppkey % 100) / 10.0 AS py FROM supplier),
f AS (SELECT *, CAST(floor(px) AS INTEGER) AS fx, CAST(floor(py) AS INTEGER) AS fy FROM p), c AS (SELECT unnest([0, 0, 1, 1]) AS dx, unnest([0, 1, 0, 1]) AS dy)
SELECT s_suppkey, round(sum((CASE WHEN dx = 1 THEN px - fx ELSE 1 - (px - fx) END) * (CASE WHEN dy = 1 THEN py - fy ELSE 1 - (py - fy) END) * coalesce(g.v, 0)), 5) AS v FROM f CROSS JOIN c LEFT JOIN g ON g.x = fx + dx AND g.y = fy + dy GROUP BY 1""")
def _(spark, d):
    p = t(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 230) / 10.0).alias("x"), ((F.col("s_suppkey") % 100) / 10.0).alias("y"))
    return geometry.interpolate(month_grid(spark, d), p, ["x", "y"], "v", "s_suppkey").select("s_suppkey", r6("v", 5))


@query("noise_estimate", f"""WITH {MONTH_SQL}, n AS (SELECT a.x, a.y, 4 * a.v - sum(b.v) AS r FROM g a JOIN g b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY a.x, a.y, a.v HAVING count(*) = 4) SELECT round(avg(r * r / 20), 6) AS noise FROM n""")
def _(spark, d):
    return geometry.noise_variance(month_grid(spark, d), ["x", "y"], "v").select(r6("noise"))


@query("subsample_scan", "SELECT event_id, value FROM events WHERE event_id % 7 = 0")
def _(spark, d):
    return geometry.subsample(t(spark, d, "events").select("event_id", "value"), ["event_id"], 7)


@query("neighbour_pairs", f"WITH {MONTH_SQL} SELECT a.x, a.y, count(*) AS n, round(max(b.v), 6) AS top FROM g a JOIN g b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y) GROUP BY ALL")
def _(spark, d):
    n = relate.neighbours(month_grid(spark, d), ["x", "y"], "v", relate.offsets(8, 2))
    return n.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("neighbour"), 6).alias("top"))


@query("median_filter", f"WITH {MONTH_SQL} SELECT a.x, a.y, round(median(b.v), 6) AS med FROM g a JOIN g b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL")
def _(spark, d):
    n = relate.neighbours(month_grid(spark, d), ["x", "y"], "v", [*relate.offsets(8, 2), (0, 0)])
    return n.groupBy("x", "y").agg(F.round(F.median("neighbour"), 6).alias("med"))


@query("repopulate_dense", "SELECT CAST(i AS BIGINT) AS idx, coalesce(c_acctbal, 0) AS v FROM (SELECT unnest(range((SELECT max(c_custkey) + 1 FROM customer))) AS i) LEFT JOIN customer ON c_custkey = i AND c_acctbal > 0")
def _(spark, d):
    c = t(spark, d, "customer")
    rows = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("v"))
    return relate.repopulate(rows, c.agg(F.max("c_custkey")).first()[0] + 1, "idx", "v")


# Order and sampling.

@query("topk_mask", "SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def _(spark, d):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t(spark, d, "orders").withColumn("k", k).where("k <= 3").select("o_orderkey", "o_custkey", "o_totalprice")


@query("best_fraction", "SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal), c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE k <= floor(n * 0.75)")
def _(spark, d):
    w = Window.partitionBy("c_nationkey")
    c = t(spark, d, "customer").withColumn("k", F.row_number().over(w.orderBy(F.abs("c_acctbal"), "c_custkey"))).withColumn("n", F.count(F.lit(1)).over(w))
    return c.where(F.col("k") <= F.floor(F.col("n") * 0.75)).select("c_custkey", "c_nationkey")


@query("sample_hash", "SELECT o_orderkey FROM orders ORDER BY (o_orderkey * 7919 + 104729) % 1000003, o_orderkey LIMIT 500")
def _(spark, d):
    return t(spark, d, "orders").select("o_orderkey").orderBy((F.col("o_orderkey") * 7919 + 104729) % 1000003, "o_orderkey").limit(500)


@query("last_channel", "SELECT l_orderkey, max(l_linenumber) AS b0, arg_max(l_quantity, (l_linenumber, l_quantity, l_partkey)) AS v FROM lineitem GROUP BY 1")
def _(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("b0"), F.max_by("l_quantity", F.struct("l_linenumber", "l_quantity", "l_partkey")).alias("v"))


# Sparse algebra.

@query("concat_join_below", f"WITH {coo_sql('a')} SELECT r, c, v FROM a UNION ALL SELECT r + 25, c, v FROM a UNION ALL SELECT r, c + 25, v FROM a")
def _(spark, d):
    a = coo(spark, d)
    return algebra.join_below(a, a, 25).unionByName(a.select("r", (F.col("c") + 25).alias("c"), "v"))


@query("sparse_add", f"WITH {coo_sql('a')}, {coo_sql('b', 'l_discount')} SELECT coalesce(a.r, b.r) AS r, coalesce(a.c, b.c) AS c, round(coalesce(a.v, 0) - coalesce(b.v, 0), 4) AS v FROM a FULL JOIN b ON a.r = b.r AND a.c = b.c")
def _(spark, d):
    return algebra.add(coo(spark, d), coo(spark, d, "l_discount"), -1.0).select("r", "c", r6("v", 4))


@query("sparse_matvec", f"WITH {coo_sql('a')} SELECT r AS i, round(sum(v * (c + 1)), 2) AS v FROM a GROUP BY 1")
def _(spark, d):
    x = spark.range(25).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("v"))
    return algebra.matvec(coo(spark, d), x).select("i", r6("v", 2))


@query("sparse_matmul", f"WITH {coo_sql('a')} SELECT a.r, b.r AS c, round(sum(a.v * b.v), 1) AS v FROM a JOIN a b ON a.c = b.c GROUP BY ALL")
def _(spark, d):
    a = coo(spark, d)
    return algebra.matmul(a, algebra.transposed(a)).select("r", "c", r6("v", 1))


@query("sparse_prune_strength", f"WITH {coo_sql('a')}, p AS (SELECT * FROM a WHERE abs(v) > 100), d AS (SELECT r AS i, v FROM p WHERE r = c) SELECT p.r, p.c, p.v FROM p LEFT JOIN d x ON x.i = p.r LEFT JOIN d y ON y.i = p.c WHERE p.v * p.v >= abs(0.9 * coalesce(y.v, 0) * 0.9 * coalesce(x.v, 0))")
def _(spark, d):
    return algebra.strength(algebra.prune(coo(spark, d), 100.0), 0.9)


@query("row_sums", f"WITH {coo_sql('a')} SELECT r, round(sum(v), 2) AS row_sum, round(sum(CASE WHEN r <> c THEN v ELSE 0 END), 2) AS row_degree FROM a GROUP BY 1")
def _(spark, d):
    return algebra.row_sums(coo(spark, d)).select("r", r6("row_sum", 2), r6("row_degree", 2))


@query("trace_norms", f"WITH {coo_sql('a')} SELECT round((SELECT sum(v) FROM a WHERE r = c), 2) AS trace, round((SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM a GROUP BY c)), 2) AS norm1, round((SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM a GROUP BY r)), 2) AS norm_inf, round((SELECT sqrt(sum(v * v)) FROM a), 2) AS norm_f")
def _(spark, d):
    a = coo(spark, d)
    return algebra.trace(a).crossJoin(algebra.norms(a)).select(*[r6(c, 2) for c in ("trace", "norm1", "norm_inf", "norm_f")])


@query("scaled_gram", f"WITH {coo_sql('a')} SELECT a.r, b.r AS c, round(sum(a.v * b.v / (a.c + 1)), 1) AS v FROM a JOIN a b ON a.c = b.c GROUP BY ALL")
def _(spark, d):
    x = spark.range(25).select(F.col("id").alias("i"), (1.0 / (F.col("id") + 1)).alias("v"))
    return algebra.adat(coo(spark, d), x).select("r", "c", r6("v", 1))


@query("conjugate_gradient")
def _(spark, d):
    a = coo(spark, d)
    gram = algebra.add(algebra.matmul(a, algebra.transposed(a)), spark.range(25).select(F.col("id").alias("r"), F.col("id").alias("c"), F.lit(1.0).alias("v")))
    b = spark.range(25).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))
    return algebra.conjugate_gradient(gram, b, tol=1e-8, most=5).select("i", r6("v", 5))


# Graphs.

@query("graph_links_repair", """WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation), e AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(c_custkey % 30 AS BIGINT) AS dst FROM customer),
k AS (SELECT src, dst FROM e WHERE src <> dst AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)) SELECT src, dst FROM k UNION SELECT dst, src FROM k""")
def _(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))
    e = t(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("src"), (F.col("c_custkey") % 30).alias("dst"))
    return graph.repair_links(n, e)


@query("graph_compact", "SELECT s_suppkey * 3 AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS new FROM supplier WHERE s_acctbal > 0")
def _(spark, d):
    return graph.compact(t(spark, d, "supplier").where("s_acctbal > 0").select((F.col("s_suppkey") * 3).alias("id")))


_PART_EDGES = "SELECT DISTINCT least(a.l_suppkey, b.l_suppkey) AS x, greatest(a.l_suppkey, b.l_suppkey) AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_shipdate = b.l_shipdate AND a.l_suppkey < b.l_suppkey"


@query("connected_components", f"""WITH RECURSIVE e AS ({_PART_EDGES}), b AS (SELECT x AS src, y AS dst FROM e UNION SELECT y, x FROM e), n AS (SELECT s_suppkey AS id FROM supplier),
reach(id, to_id) AS (SELECT id, id FROM n UNION SELECT r.id, b.dst FROM reach r JOIN b ON r.to_id = b.src), roots AS (SELECT id, min(to_id) AS root FROM reach GROUP BY 1) SELECT id, dense_rank() OVER (ORDER BY root) AS label FROM roots""")
def _(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_suppkey")
    # a merge: the three columns' part of the file's compressed size can pass for a table to broadcast
    e = li.join(li.withColumnRenamed("l_suppkey", "dst").hint("merge"), ["l_orderkey", "l_shipdate"]).where("l_suppkey < dst").select(F.col("l_suppkey").alias("src"), "dst").distinct()
    return graph.component_labels(t(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), e)


@query("modularity", f"WITH {GRAPH_SQL}, x AS (SELECT e.*, a.n_regionkey AS ca, b.n_regionkey AS cb FROM e JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst), m AS (SELECT sum(weight) AS m FROM e), p AS (SELECT ca, sum(weight) AS deg, sum(CASE WHEN ca = cb THEN weight ELSE 0 END) AS inside FROM x GROUP BY 1) SELECT round(sum(inside / m - (deg / m) * (deg / m)), 9) AS q FROM p, m")
def _(spark, d):
    _, e = nation_graph(spark, d)
    return graph.modularity(e, t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").alias("community"))).select(r6("q", 9))


@query("contract_graph", f"WITH {GRAPH_SQL} SELECT a.n_regionkey AS a, b.n_regionkey AS b, sum(weight) AS weight FROM e JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst GROUP BY ALL")
def _(spark, d):
    _, e = nation_graph(spark, d)
    return graph.contract(e, t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").alias("community")))


@query("pagerank_20", f"""WITH RECURSIVE {GRAPH_SQL}, o AS (SELECT src, sum(weight) AS s FROM e GROUP BY 1), w AS (SELECT e.src, e.dst, weight / s AS w FROM e JOIN o USING (src)),
p(k, v) AS (SELECT 0, [1.0 / 25 FOR i IN range(25)]::DOUBLE[] UNION ALL SELECT k + 1, (SELECT list(0.15 / 25 + 0.85 * coalesce(g, 0) ORDER BY id) FROM (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation) LEFT JOIN (SELECT dst AS id, sum(w * p.v[src + 1]) AS g FROM w GROUP BY 1) USING (id)) FROM p WHERE k < 20)
SELECT CAST(i AS BIGINT) AS id, round(v[i + 1], 9) AS p FROM p, (SELECT unnest(range(25)) AS i) WHERE k = 20""")
def _(spark, d):
    n, e = nation_graph(spark, d)
    return graph.stationary(n, e, 20).select("id", r6("p", 9))


def _sinkhorn_sql(rounds: int) -> str:
    steps = ["s0 AS (SELECT CAST(c_nationkey AS BIGINT) AS r, c_mktsegment AS c, CAST(count(*) AS DOUBLE) AS v FROM customer GROUP BY ALL)"]
    for k in range(rounds):
        steps.append(f"r{k} AS (SELECT r, c, v / sum(v) OVER (PARTITION BY r) AS v FROM s{k})")
        steps.append(f"s{k + 1} AS (SELECT r, c, v / sum(v) OVER (PARTITION BY c) AS v FROM r{k})")
    return f"WITH {', '.join(steps)} SELECT r, c, round(v, 9) AS v FROM s{rounds}"


@query("sinkhorn_10", _sinkhorn_sql(10))
def _(spark, d):
    m = t(spark, d, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("r"), F.col("c_mktsegment").alias("c")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return graph.sinkhorn(m, 10).select("r", "c", r6("v", 9))


_LP = """c AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey + 1 AS DOUBLE) AS w FROM nation), o AS (SELECT id, w, row_number() OVER (ORDER BY id) AS i, sum(w) OVER (ORDER BY id) AS s, (SELECT sum(w) FROM c) / 4 AS cut FROM c),
walk(i, part, nxt) AS (SELECT i, 0, CASE WHEN s > cut THEN 1 ELSE 0 END FROM o WHERE i = 1 UNION ALL SELECT o.i, walk.nxt, walk.nxt + CASE WHEN o.s > (walk.nxt + 1) * o.cut THEN 1 ELSE 0 END FROM walk JOIN o ON o.i = walk.i + 1),
lp AS (SELECT id, CAST(least(part, 3) AS INTEGER) AS part FROM walk JOIN o USING (i))"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return graph.linear_partition(t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), (F.col("n_nationkey") + 1).cast("double").alias("weight")), 4)


@query("linear_partition", f"WITH RECURSIVE {_LP} SELECT id, part FROM lp")
def _(spark, d):
    return _parts(spark, d)


@query("partition_numbering", f"WITH RECURSIVE {_LP}, x AS (SELECT id, 3 - part AS part FROM lp) SELECT id, CAST(part AS INTEGER) AS part, row_number() OVER (ORDER BY part, id) - 1 AS number FROM x")
def _(spark, d):
    return graph.renumber_by_part(_parts(spark, d).select("id", (3 - F.col("part")).alias("part")))


@query("cut_edges", f"WITH RECURSIVE {GRAPH_SQL}, {_LP} SELECT count(*) FILTER (a.part <> b.part) AS cut FROM e JOIN lp a ON a.id = src JOIN lp b ON b.id = dst")
def _(spark, d):
    return graph.cut_edges(nation_graph(spark, d)[1], _parts(spark, d))


@query("mrf_energy", f"WITH {GRAPH_SQL}, l AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_regionkey AS label FROM nation) SELECT (SELECT sum(0.5::DOUBLE * label) FROM l) + (SELECT 2.0::DOUBLE * count(*) FROM e JOIN l a ON a.id = src JOIN l b ON b.id = dst WHERE dst < src AND a.label <> b.label) AS energy")
def _(spark, d):
    labels = t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").alias("label"))
    unary = labels.select("id").crossJoin(labels.select("label").distinct()).withColumn("cost", 0.5 * F.col("label"))
    return graph.mrf_energy(unary, nation_graph(spark, d)[1], labels, 2.0)


@query("degrees", f"WITH {GRAPH_SQL} SELECT src AS id, count(*) AS degree, sum(weight) AS strength FROM e GROUP BY 1")
def _(spark, d):
    return graph.degrees(nation_graph(spark, d)[1])


@query("max_spanning_forest")
def _(spark, d):
    n, e = nation_graph(spark, d)
    return graph.max_spanning_forest(n, e)


@query("label_communities")
def _(spark, d):
    n, e = nation_graph(spark, d)
    return graph.label_communities(n, e, 4)


@query("one_ring", f"WITH {GRAPH_SQL} SELECT 0::BIGINT AS id UNION SELECT dst FROM e WHERE src = 0")
def _(spark, d):
    e = nation_graph(spark, d)[1]
    return graph.one_ring(e, spark.range(1))


# Points, clusters, tests.

def _vec_sql(n: int) -> str:
    return f"v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding[1:{n}]] AS f FROM embeddings)"


def _vecs(spark: SparkSession, d: str, n: int = 64) -> DataFrame:
    return t(spark, d, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, n), lambda x: x.cast("double")).alias("f"))


def _d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query("knn_exact", f"WITH {_vec_sql(64)}, p AS (SELECT q.vec_id AS query, v.vec_id, sqrt({_d2('v.f', 'q.f')}) AS dist FROM v, v q WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id) SELECT query, vec_id, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, vec_id) AS rank FROM p) WHERE rank <= 5")
def _(spark, d):
    v = _vecs(spark, d)
    return relate.knn(v, v.where("vec_id % 100 = 0"), 5, "vec_id", "f").select("query", "vec_id", r6("dist"), "rank")


@query("knn_mean_dist", f"WITH {_vec_sql(64)}, p AS (SELECT q.vec_id AS query, v.vec_id, sqrt({_d2('v.f', 'q.f')}) AS dist FROM v, v q WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id) SELECT query, round(avg(dist), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, vec_id) AS rank FROM p) WHERE rank <= 5 GROUP BY 1")
def _(spark, d):
    v = _vecs(spark, d)
    return relate.knn(v, v.where("vec_id % 100 = 0"), 5, "vec_id", "f").groupBy("query").agg(F.round(F.avg("dist"), 6).alias("mean"))


def _xyz(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate("xyz")])


@query("radius_join", f"WITH {_vec_sql(3)} SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt({_d2('a.f', 'b.f')}), 6) AS dist FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE sqrt({_d2('a.f', 'b.f')}) <= 0.02")
def _(spark, d):
    return relate.radius_join(_xyz(spark, d), 0.02, "vec_id", ["x", "y", "z"]).select("a", "b", r6("dist"))


_CENT = "c AS (SELECT label AS k, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(f[i]) AS m FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY 1)"




def _nearest(spark: SparkSession, d: str) -> DataFrame:
    v = _vecs(spark, d)
    cents = reductions.centroids(v, "label", "f").groupBy(F.col("label").alias("vec_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("f"))
    return relate.nearest(v, cents, "vec_id", "f")


@query("nearest_centroid", f"WITH {_vec_sql(64)}, {_CENT}, p AS (SELECT vec_id, label, k, {_d2('f', 'c')} AS d FROM v, c) SELECT vec_id, arg_min(k, (round(d, 12), k)) AS nearest FROM p GROUP BY 1")
def _(spark, d):
    return _nearest(spark, d).select("vec_id", "nearest")


@query("mislabel_rate", f"WITH {_vec_sql(64)}, {_CENT}, p AS (SELECT vec_id, label, k, {_d2('f', 'c')} AS d FROM v, c), n AS (SELECT vec_id, any_value(label) AS label, arg_min(k, (round(d, 12), k)) AS nearest FROM p GROUP BY 1) SELECT round(avg(CASE WHEN nearest <> label THEN 1.0 ELSE 0 END), 6) AS rate FROM n")
def _(spark, d):
    return reductions.mislabel_rate(_nearest(spark, d), "nearest", "label").select(r6("rate"))


_K = 4


def _kmeans_sql() -> str:
    steps = [_vec_sql(64), f"c0 AS (SELECT CAST(vec_id AS INTEGER) AS k, f AS c FROM v WHERE vec_id < {_K})"]
    for r in range(3):
        steps.append(f"a{r} AS (SELECT vec_id, any_value(f) AS f, arg_min(k, (d, k)) AS k FROM (SELECT vec_id, f, k, {_d2('f', 'c')} AS d FROM v, c{r}) GROUP BY 1)")
        steps.append(f"c{r + 1} AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, avg(f[i]) AS m FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY 1)")
    return f"WITH {', '.join(steps)} SELECT vec_id, k AS cluster FROM a2"


@query("kmeans_2iter", _kmeans_sql())
def _(spark, d):
    v = _vecs(spark, d)
    init = [r["f"] for r in v.where(F.col("vec_id") < _K).orderBy("vec_id").collect()]
    return learning.kmeans(v, "vec_id", "f", init, 2)[0]


@query("kmeans_fixpoint")
def _(spark, d):
    v = _vecs(spark, d)
    init = [r["f"] for r in v.where(F.col("vec_id") < _K).orderBy("vec_id").collect()]
    return learning.kmeans(v, "vec_id", "f", init)[0]


@query("kernels", f"WITH {_vec_sql(64)} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.f, b.f), 6) AS linear, round(pow(list_dot_product(a.f, b.f) + 1, 2), 6) AS poly, round(exp(-0.5 * {_d2('a.f', 'b.f')}), 6) AS rbf, round(tanh(list_dot_product(a.f, b.f)), 6) AS sigmoid, round(1 / sqrt({_d2('a.f', 'b.f')} + 1), 6) AS imq FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    v = _vecs(spark, d)
    p = v.select(F.col("vec_id").alias("a"), F.col("f").alias("x")).join(v.select(F.col("vec_id").alias("b"), F.col("f").alias("y")), F.col("b") == F.col("a") + 1)
    x, y = F.col("x"), F.col("y")
    ks = {"linear": elementwise.kernel_linear(x, y), "poly": elementwise.kernel_poly(x, y), "rbf": elementwise.kernel_rbf(x, y, 0.5), "sigmoid": elementwise.kernel_sigmoid(x, y), "imq": elementwise.kernel_inverse_multiquadric(x, y)}
    return p.select("a", "b", *[F.round(c, 6).alias(n) for n, c in ks.items()])


def _split_sql(entropy: bool) -> str:
    loss = "-(CASE WHEN {s} > 0 THEN {s} * ln({s} / {n}) ELSE 0 END + CASE WHEN {s} < {n} THEN ({n} - {s}) * ln(1 - {s} / {n}) ELSE 0 END)" if entropy else "({s} - {s} * {s} / {n})"
    return f"""WITH b AS (SELECT CAST(n_chars AS DOUBLE) AS f, CAST(count(*) AS DOUBLE) AS n, CAST(sum(quality) AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id) GROUP BY 1),
r AS (SELECT f, sum(n) OVER w AS nl, sum(s) OVER w AS sl, lead(f) OVER w AS nxt, sum(n) OVER () AS nn, sum(s) OVER () AS ss FROM b WINDOW w AS (ORDER BY f)),
x AS (SELECT (f + nxt) / 2 AS threshold, round({loss.format(s='sl', n='nl')} + {loss.format(s='(ss - sl)', n='(nn - nl)')}, 6) AS loss FROM r WHERE nxt IS NOT NULL) SELECT threshold, loss FROM x ORDER BY loss, threshold LIMIT 1"""


@query("best_split_sqloss", _split_sql(False))
def _(spark, d):
    return learning.best_split(t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id"), "n_chars", "quality")


@query("best_split_entropy", _split_sql(True))
def _(spark, d):
    return learning.best_split(t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id"), "n_chars", "quality", entropy=True)


_THETA = "th AS (SELECT event_type AS class, avg(value) AS mu, var_samp(value) AS var, count(*) / (SELECT count(*) FROM events) AS prior FROM events GROUP BY 1)"


def _theta(ev: DataFrame) -> DataFrame:
    n = ev.agg(F.count(F.lit(1)).alias("n"))
    return ev.groupBy(F.col("event_type").alias("class")).agg(F.avg("value").alias("mu"), F.var_samp("value").alias("var"), F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(n)).select("class", "mu", "var", (F.col("k") / F.col("n")).alias("prior"))


@query("gauss_logprob", f"WITH {_THETA} SELECT event_id, round(ln(prior) - 0.5 * ln(2 * pi() * var) - (value - mu) * (value - mu) / (2 * var), 6) AS lp FROM events JOIN th ON class = event_type")
def _(spark, d):
    ev = t(spark, d, "events")
    j = ev.join(F.broadcast(_theta(ev)), F.col("class") == F.col("event_type"))
    return j.select("event_id", F.round(elementwise.gauss_logprob(F.col("value"), F.col("mu"), F.col("var"), F.col("prior")), 6).alias("lp"))


@query("find_class", f"WITH {_THETA} SELECT event_id, CASE WHEN value <= (SELECT min(mu) FROM th) THEN (SELECT arg_min(class, mu) FROM th) WHEN value >= (SELECT max(mu) FROM th) THEN (SELECT arg_max(class, mu) FROM th) ELSE (SELECT arg_min(class, (value - mu) * (value - mu) / var) FROM th) END AS class FROM events")
def _(spark, d):
    ev = t(spark, d, "events")
    return learning.find_class(ev.select("event_id", "value"), _theta(ev), "value").select("event_id", "class")


@query("bh_adjust", "WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 13 <> 0 THEN ((c_custkey * 7919) % 1009 + 1) / 1010.0 END AS p FROM customer), r AS (SELECT *, row_number() OVER (ORDER BY p, c_custkey) AS k, count(*) OVER () AS n FROM p WHERE p IS NOT NULL) SELECT c_custkey, round(min(least(1.0, p * n / k)) OVER (ORDER BY k DESC), 9) AS q FROM r UNION ALL SELECT c_custkey, NULL FROM p WHERE p IS NULL")
def _(spark, d):
    p = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 13 != 0, ((F.col("c_custkey") * 7919) % 1009 + 1) / 1010.0).alias("p"))
    return learning.bh_adjust(p, "p", "c_custkey").select("c_custkey", r6("q", 9))


@query("medoid_step", f"WITH {_vec_sql(64)}, c AS (SELECT a.label, a.vec_id, round(sum({_d2('a.f', 'b.f')}), 6) AS cost FROM v a JOIN v b ON a.label = b.label GROUP BY ALL) SELECT label, arg_min(vec_id, (cost, vec_id)) AS medoid FROM c GROUP BY 1")
def _(spark, d):
    return learning.medoid_step(_vecs(spark, d), "label", "vec_id", "f")


@query("dbscan", f"""WITH RECURSIVE {_vec_sql(3)}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt({_d2('a.f', 'b.f')}) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE sqrt({_d2('a.f', 'b.f')}) <= 0.04),
core AS (SELECT a AS id FROM p GROUP BY 1 HAVING count(*) + 1 >= 4), ce AS (SELECT a, b FROM p WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(id, z) AS (SELECT id, id FROM core UNION SELECT r.id, ce.b FROM reach r JOIN ce ON r.z = ce.a), roots AS (SELECT id, min(z) AS root FROM reach GROUP BY 1),
border AS (SELECT p.a AS id, arg_min(root, (dist, b)) AS root FROM p JOIN roots ON roots.id = p.b GROUP BY 1) SELECT v.vec_id, coalesce(roots.root, border.root) AS cluster FROM v LEFT JOIN roots ON roots.id = v.vec_id LEFT JOIN border ON border.id = v.vec_id""")
def _(spark, d):
    return learning.dbscan(_xyz(spark, d), "vec_id", ["x", "y", "z"], 0.04, 4)


@query("random_forest")
def _(spark, d):
    v = _vecs(spark, d).select("vec_id", "label", *[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(64)])
    return learning.random_forest(v, v, [f"f{i}" for i in range(64)], "label", 10).select("vec_id", "prediction")


@query("gmm_clusters")
def _(spark, d):
    v = _vecs(spark, d)
    starts = [r["f"] for r in v.where(F.col("vec_id") < _K).orderBy("vec_id").collect()]
    model = mixture.variational_mixture(v, "f", starts, spread=0.02)
    return mixture.classify(v.select("vec_id", "f"), "f", model).select("vec_id", "cluster")


# Masks.

_MASK = f"WITH RECURSIVE {MONTH_SQL}, q AS (SELECT median(v) AS q FROM g), k AS (SELECT x, y FROM g, q WHERE v > q)"


def _mask(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = month_grid(spark, d)
    q = g.agg(F.median("v").alias("q"))
    return g.select("x", "y"), g.crossJoin(F.broadcast(q)).where("v > q").select("x", "y")


@query("dilate", f"{_MASK} SELECT DISTINCT g.x, g.y FROM g JOIN k ON (g.x - k.x) * (g.x - k.x) + (g.y - k.y) * (g.y - k.y) <= 1")
def _(spark, d):
    g, k = _mask(spark, d)
    return morphology.dilate(k, ["x", "y"], 1.0, g)


@query("erode", f"{_MASK}, b AS (SELECT x, y FROM g EXCEPT SELECT x, y FROM k) SELECT x, y FROM k WHERE NOT EXISTS (SELECT 1 FROM b WHERE (b.x - k.x) * (b.x - k.x) + (b.y - k.y) * (b.y - k.y) <= 1)")
def _(spark, d):
    g, k = _mask(spark, d)
    return morphology.erode(k, ["x", "y"], 1.0, g)


@query("mask_boundary", f"{_MASK}, b AS (SELECT x, y FROM g EXCEPT SELECT x, y FROM k) SELECT x, y FROM k WHERE EXISTS (SELECT 1 FROM b WHERE abs(b.x - k.x) + abs(b.y - k.y) = 1)")
def _(spark, d):
    g, k = _mask(spark, d)
    return morphology.boundary(k, ["x", "y"], g, 4)


_REACH = "n AS (SELECT x, y, CAST(x + 25 * y AS BIGINT) AS id FROM k), r(id, z) AS (SELECT id, id FROM n UNION SELECT r.id, b.id FROM r JOIN n a ON a.id = r.z JOIN n b ON abs(a.x - b.x) + abs(a.y - b.y) = 1), roots AS (SELECT n.x, n.y, min(z) AS root FROM r JOIN n ON n.id = r.id GROUP BY ALL)"


@query("mask_label", f"{_MASK}, {_REACH} SELECT x, y, root FROM roots")
def _(spark, d):
    return morphology.label(_mask(spark, d)[1], ["x", "y"], [25, 12], 4)


@query("largest_component", f"{_MASK}, {_REACH} SELECT x, y FROM roots WHERE root = (SELECT arg_max(root, (n, -root)) FROM (SELECT root, count(*) AS n FROM roots GROUP BY 1))")
def _(spark, d):
    return morphology.largest(morphology.label(_mask(spark, d)[1], ["x", "y"], [25, 12], 4), ["x", "y"])


@query("distance_transform", f"{_MASK} SELECT g.x, g.y, round(sqrt(min((g.x - k.x) * (g.x - k.x) + (g.y - k.y) * (g.y - k.y))), 9) AS distance FROM g JOIN k ON (g.x - k.x) * (g.x - k.x) + (g.y - k.y) * (g.y - k.y) <= 16 GROUP BY ALL")
def _(spark, d):
    g, k = _mask(spark, d)
    return morphology.distance_transform(k, ["x", "y"], g, 4).select("x", "y", r6("distance", 9))


# Meshes, quadrature, distributions, text.

def _tri(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.lit(t(spark, d, "embeddings").count())
    return t(spark, d, "customer").select(k.alias("id"), (k % n).alias("a"), ((k * 7 + 1) % n).alias("b"), ((k * 13 + 5) % n).alias("c")).where("a != b and b != c and a != c")


def _vertices(spark: SparkSession, d: str) -> DataFrame:
    return _xyz(spark, d).withColumnRenamed("vec_id", "id")


_TRI = "tri AS (SELECT c_custkey AS id, c_custkey % (SELECT count(*) FROM embeddings) AS a, (c_custkey * 7 + 1) % (SELECT count(*) FROM embeddings) AS b, (c_custkey * 13 + 5) % (SELECT count(*) FROM embeddings) AS c FROM customer WHERE c_custkey % (SELECT count(*) FROM embeddings) <> (c_custkey * 7 + 1) % (SELECT count(*) FROM embeddings) AND (c_custkey * 7 + 1) % (SELECT count(*) FROM embeddings) <> (c_custkey * 13 + 5) % (SELECT count(*) FROM embeddings) AND c_custkey % (SELECT count(*) FROM embeddings) <> (c_custkey * 13 + 5) % (SELECT count(*) FROM embeddings))"
_EDGES = "ed AS (SELECT least(a, b) AS u, greatest(a, b) AS v FROM tri UNION ALL SELECT least(b, c), greatest(b, c) FROM tri UNION ALL SELECT least(a, c), greatest(a, c) FROM tri)"
_VERT = "vx AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


@query("mesh_edges", f"WITH {_TRI}, {_EDGES} SELECT u, v, count(*) AS n FROM ed GROUP BY ALL")
def _(spark, d):
    return mesh.edges(_tri(spark, d))


@query("mesh_euler", f"WITH {_TRI}, {_EDGES}, q AS (SELECT (SELECT count(DISTINCT x) FROM (SELECT unnest([a, b, c]) AS x FROM tri)) AS v, (SELECT count(*) FROM (SELECT DISTINCT u, v FROM ed)) AS e, (SELECT count(*) FROM tri) AS f) SELECT v, e, f, v - e + f AS euler FROM q")
def _(spark, d):
    return mesh.euler(_tri(spark, d))


@query("mesh_faces", f"""WITH {_TRI}, {_VERT}, j AS (SELECT tri.id, b.x - a.x AS p, b.y - a.y AS q, b.z - a.z AS r, c.x - a.x AS s, c.y - a.y AS t, c.z - a.z AS u, (a.x + b.x + c.x) / 3 AS cx FROM tri JOIN vx a ON a.id = tri.a JOIN vx b ON b.id = tri.b JOIN vx c ON c.id = tri.c),
n AS (SELECT id, q * u - r * t AS i, r * s - p * u AS j, p * t - q * s AS k, cx FROM j) SELECT id, round(0.5 * sqrt(i * i + j * j + k * k), 9) AS area, round(i / sqrt(i * i + j * j + k * k), 6) AS nx, round(cx, 9) AS cx FROM n""")
def _(spark, d):
    return mesh.faces(_vertices(spark, d), _tri(spark, d)).select("id", r6("area", 9), r6("nx"), r6("cx", 9))


@query("mesh_laplacian_step", f"WITH {_TRI}, {_EDGES}, {_VERT}, bo AS (SELECT u, v FROM ed UNION SELECT v, u FROM ed), m AS (SELECT u AS id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM bo JOIN vx ON vx.id = bo.v GROUP BY 1) SELECT vx.id, round(x + 0.5 * (coalesce(mx, x) - x), 9) AS x, round(y + 0.5 * (coalesce(my, y) - y), 9) AS y, round(z + 0.5 * (coalesce(mz, z) - z), 9) AS z FROM vx LEFT JOIN m USING (id)")
def _(spark, d):
    return mesh.laplacian_step(_vertices(spark, d), _tri(spark, d), 0.5).select("id", *[r6(c, 9) for c in "xyz"])


@query("quadrature_cc", "SELECT c_nationkey AS k, round(3 + 2.0 / 3 * c_nationkey, 6) AS integral FROM customer GROUP BY 1, c_nationkey")
def _(spark, d):
    nodes, weights = special.clenshaw_curtis(8)
    rule = spark.createDataFrame(list(zip(nodes, weights)), "x double, w double")
    k = t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    f = 1.5 + F.col("k") * F.col("x") * F.col("x") + F.col("x") * F.col("x") * F.col("x")
    return k.crossJoin(F.broadcast(rule)).groupBy("k").agg(F.round(F.sum(F.col("w") * f), 6).alias("integral"))


@query("normal_exponential_pdf", "SELECT event_id, round(exp(-((value - 50) * (value - 50)) / 800) / (20 * sqrt(2 * pi())), 12) AS normal, round(0.02 * exp(-0.02 * value), 12) AS expo, round(1 - exp(-0.02 * value), 9) AS expo_cdf FROM events")
def _(spark, d):
    v = F.col("value")
    return t(spark, d, "events").select("event_id", F.round(special.normal_pdf(v, 50.0, 20.0), 12).alias("normal"), F.round(special.exponential_pdf(v, 0.02), 12).alias("expo"), F.round(special.exponential_cdf(v, 0.02), 9).alias("expo_cdf"))


@query("normal_cdf")
def _(spark, d):
    return t(spark, d, "events").select("event_id", F.round(special.normal_cdf(F.col("value"), 50.0, 20.0), 9).alias("cdf"))


@query("matrix_text", f"WITH h AS (SELECT {_LINLIN} GROUP BY ALL) SELECT j, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ' ' ORDER BY i) AS line FROM (SELECT CAST(i AS INTEGER) AS i, j FROM (SELECT unnest(range(16)) AS i), (SELECT DISTINCT j FROM h)) LEFT JOIN h USING (i, j) GROUP BY 1")
def _(spark, d):
    return text_files.matrix_lines(_linlin(t(spark, d, "lineitem")), 16)


@query("cooccurrence_distance", """WITH s AS (SELECT user_id % 2 AS half, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), c AS (SELECT half, a, b, count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY ALL),
p AS (SELECT half, a, b, n / sum(n) OVER (PARTITION BY half) AS p FROM c) SELECT round(sum(abs(coalesce(x.p, 0) - coalesce(y.p, 0))), 9) AS distance FROM (SELECT * FROM p WHERE half = 0) x FULL JOIN (SELECT * FROM p WHERE half = 1) y ON x.a = y.a AND x.b = y.b""")
def _(spark, d):
    ev = t(spark, d, "events")
    halves = [histograms.cooccurrence(ev.where(F.col("user_id") % 2 == h), ["user_id"], ["ts", "event_id"], "event_type") for h in (0, 1)]
    return histograms.cooccurrence_distance(*halves).select(r6("distance", 9))


@query("masked_gaussian", f"WITH {DAY_SQL}, k AS (SELECT s, day, v, CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END AS m FROM g) SELECT s, day, round(CASE WHEN {{den}} > 0 THEN {{num}} / {{den}} ELSE 0 END, 4) AS smooth FROM k WINDOW w AS (PARTITION BY s ORDER BY day)".format(
    num="(" + " + ".join(f"coalesce({'lag' if i < 3 else 'lead'}(v * m, {abs(i - 3)}) OVER w, 0) * {g!r}" for i, g in enumerate(_gauss(1.0, 3))) + ")",
    den="(" + " + ".join(f"coalesce({'lag' if i < 3 else 'lead'}(m, {abs(i - 3)}) OVER w, 0) * {g!r}" for i, g in enumerate(_gauss(1.0, 3))) + ")"))
def _(spark, d):
    return sequence.gaussian_filter(day_grid(spark, d), ["s"], "day", "v", 1.0, mask=F.col("v") > 0).select("s", "day", r6("smooth", 4))


@query("fill_holes", f"{_MASK}, bg AS (SELECT x, y FROM g EXCEPT SELECT x, y FROM k), o(x, y) AS (SELECT x, y FROM bg WHERE x IN (0, 24) OR y IN (0, 11) UNION SELECT bg.x, bg.y FROM o JOIN bg ON abs(o.x - bg.x) + abs(o.y - bg.y) = 1) SELECT x, y FROM g EXCEPT SELECT x, y FROM o")
def _(spark, d):
    g, k = _mask(spark, d)
    return morphology.fill_holes(k, ["x", "y"], [25, 12], g)


@query("subject_key", "SELECT substr(o_orderpriority || '_' || o_orderstatus, 1, 6) AS subject, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    o = t(spark, d, "orders").select(F.concat_ws("/", F.lit("data"), F.concat_ws("_", "o_orderpriority", "o_orderstatus")).alias("path"))
    return text_files.with_subject(o).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


@query("tolerance_groups")
def _(spark, d):
    s = t(spark, d, "orders").groupBy("o_orderpriority", F.month("o_orderdate").alias("m")).agg(F.round(F.avg("o_totalprice"), 2).alias("v"))
    return pipelines.tolerance_groups(s, "o_orderpriority", "m", "v", 0.02)


@query("spherical_mean_fit")
def _(spark, d):
    e = t(spark, d, "part").select("p_partkey", *[F.exp(-(F.col("p_size") + i) / F.lit(60.0) * (i + 1)).alias(f"s{i}") for i in range(3)])
    return pipelines.fit_spherical_mean(e, "p_partkey", ["s0", "s1", "s2"], [1.0, 2.0, 3.0])


@query("mask_consensus")
def _(spark, d):
    votes = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("site"), F.col("l_linenumber").alias("rater")).agg((F.avg("l_quantity") > 25).cast("int").alias("vote"))
    return pipelines.consensus(votes, 5).select("site", r6("p"))


from gridstone.plans import masks, networks, samples, volumes  # noqa: E402, F401  (they register their queries)
