"""Registered queries of sample measures, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridstone.operators import independent, measures, reductions
from gridstone.plans.bindings import query, r6, t
from gridstone.plans.volumes import _M, _a

_BINS = 200


def _shares(name: str, values: str, low: str = "min(v)", high: str = "max(v)") -> str:
    """Shares by bin of the values of a table expression with a column v."""
    return f"""{name}_l AS (SELECT CAST({low} AS DOUBLE) AS lo, CAST({high} AS DOUBLE) AS hi FROM {values}),
{name}_c AS (SELECT CAST(floor((v - lo) / ((hi - lo) / {_BINS - 1})) AS INTEGER) AS bin, count(*) AS n FROM {values}, {name}_l WHERE v BETWEEN lo AND hi GROUP BY 1),
{name} AS (SELECT bin, n / sum(n) OVER () AS p, lo, hi FROM {name}_c, {name}_l WHERE bin < {_BINS})"""


_PRICES = "x AS (SELECT l_extendedprice AS v, l_returnflag AS f FROM lineitem)"


def _quantile(name: str, q: float) -> str:
    return f"(SELECT lo + bin * (hi - lo) / {_BINS - 1} + ({q} - before) / p * (hi - lo) / {_BINS - 1} FROM (SELECT *, sum(p) OVER (ORDER BY bin) - p AS before FROM {name}) WHERE before + p >= {q} ORDER BY bin LIMIT 1)"


@query("empirical_summary", f"WITH {_PRICES}, {_shares('s', 'x')} SELECT round({_quantile('s', 0.5)}, 3) AS median, round((SELECT (bin + 0.5) * (hi - lo) / {_BINS} + lo FROM s ORDER BY p DESC, bin LIMIT 1), 3) AS mode, round((SELECT -sum(p * ln(p)) - ln({_BINS}) FROM s), 6) AS entropy")
def _(spark, d):
    return measures.summary(t(spark, d, "lineitem"), "l_extendedprice", _BINS).select(r6("median", 3), r6("mode", 3), r6("entropy"))


@query("empirical_distance", f"WITH {_PRICES}, a AS (SELECT * FROM x WHERE f = 'A'), b AS (SELECT * FROM x WHERE f = 'R'), {_shares('p', 'a', 'min(1000)', 'min(50000)')}, {_shares('q', 'b', 'min(1000)', 'min(50000)')} SELECT round(sum(abs(coalesce(p.p, 0) - coalesce(q.p, 0))), 6) AS distance FROM p FULL JOIN q ON p.bin = q.bin")
def _(spark, d):
    p, q = (measures.shares(t(spark, d, "lineitem").where(F.col("l_returnflag") == f), "l_extendedprice", _BINS, 1000.0, 50000.0)[0] for f in "AR")
    return measures.distance(p, q).select(r6("distance"))


@query("bounded_distribution", f"WITH {_PRICES}, {_shares('w', 'x')}, qs AS (SELECT {_quantile('w', 0.1)} AS lo, {_quantile('w', 0.9)} AS hi), c AS (SELECT CAST(floor(round((v - lo) / ((hi - lo) / {_BINS - 1}), 9)) AS INTEGER) AS bin, count(*) AS n FROM x, qs WHERE v BETWEEN lo AND hi GROUP BY 1) SELECT CAST(bin // 20 AS INTEGER) AS part, round(sum(n) / (SELECT sum(n) FROM c WHERE bin < {_BINS}), 3) AS p FROM c WHERE bin < {_BINS} GROUP BY 1")
def _(spark, d):
    p = measures.bounded_shares(t(spark, d, "lineitem"), "l_extendedprice", 0.1, 0.9, _BINS)
    return p.groupBy(F.floor(F.col("bin") / 20).cast("int").alias("part")).agg(F.round(F.sum("p"), 3).alias("p"))


@query("vector_correlation", """WITH e AS (SELECT [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), k AS (SELECT i, e[i] AS a, e[65 - i] * 2 + e[i] AS b FROM e, (SELECT unnest(range(1, 65)) AS i)),
s AS (SELECT i, covar_pop(a, b) * count(*) AS ab, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb FROM k GROUP BY i) SELECT round(1 - sum(ab) / greatest(sqrt(sum(aa) * sum(bb)), 1e-6), 6) AS distance FROM s""")
def _(spark, d):
    e = t(spark, d, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    return measures.vector_correlation_distance(e.withColumn("b", F.zip_with(F.reverse("a"), "a", lambda y, x: y * 2 + x)), "a", "b", 64).select(r6("distance"))


@query("gauss_dist_prob", "WITH th AS (SELECT event_type, avg(value) AS mu, var_samp(value) AS var, count(*) / (SELECT count(*) FROM events) AS prior FROM events GROUP BY 1) SELECT event_id, round((value - mu) * (value - mu) / var, 6) AS dist, round(prior * exp(-(value - mu) * (value - mu) / (2 * var)) / sqrt(2 * pi() * var), 9) AS prob FROM events JOIN th USING (event_type)")
def _(spark, d):
    ev = t(spark, d, "events")
    theta = ev.groupBy("event_type").agg(F.avg("value").alias("mu"), F.var_samp("value").alias("var"), (F.count(F.lit(1)) / F.lit(ev.count())).alias("prior"))
    v, mu, var = F.col("value"), F.col("mu"), F.col("var")
    return ev.join(F.broadcast(theta), "event_type").select("event_id", F.round(measures.gauss_dist(v, mu, var), 6).alias("dist"), F.round(measures.gauss_prob(v, mu, var, F.col("prior")), 9).alias("prob"))


@query("densities", """WITH k AS (SELECT p_partkey, p_size / CAST(10 AS DOUBLE) AS x, p_size / CAST(51 AS DOUBLE) AS u, p_size AS n FROM part)
SELECT p_partkey, round(exp(1.5 * ln(x) - x / 2 - lgamma(2.5) - 2.5 * ln(2)), 9) AS gamma, round(exp(3 * ln(2) - lgamma(3) - 4 * ln(x) - 2 / x), 9) AS inverse_gamma, round(exp(ln(x) - x / 2 - lgamma(2) - 2 * ln(2)), 9) AS chi2,
round(exp(ln(u) + 2 * ln(1 - u) + lgamma(5) - lgamma(2) - lgamma(3)), 9) AS beta, round(exp(lgamma(61) - lgamma(n + 1) - lgamma(61 - n) + n * ln(0.3) + (60 - n) * ln(0.7)), 9) AS binomial,
round(exp(lgamma(3) - lgamma(2.5)) / sqrt(5 * pi()) * pow(1 + x * x / 5, -3), 9) AS student, round(exp(lgamma(5) - lgamma(2) - lgamma(3) + 2 * ln(4 / CAST(6 AS DOUBLE)) + ln(x) - 5 * ln(1 + 4 * x / 6)), 9) AS f FROM k""")
def _(spark, d):
    k = t(spark, d, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("x"), (F.col("p_size") / 51.0).alias("u"), F.col("p_size").alias("n"))
    x, u, n = F.col("x"), F.col("u"), F.col("n")
    made = {"gamma": measures.gamma_pdf(x, 2.5, 2.0), "inverse_gamma": measures.inverse_gamma_pdf(x, 3.0, 2.0), "chi2": measures.chi2_pdf(x, 4.0), "beta": measures.beta_pdf(u, 2.0, 3.0), "binomial": measures.binomial_pmf(n, 60, 0.3), "student": measures.student_pdf(x, 5.0), "f": measures.f_pdf(x, 4.0, 6.0)}
    return k.select("p_partkey", *[F.round(c, 9).alias(name) for name, c in made.items()])


@query("matrix_marginals", f"{_M} SELECT 'row' AS axis, CAST(r AS INTEGER) AS i, sum(v) AS sum, sum(CASE WHEN r <> c THEN v ELSE 0 END) AS off, CAST(arg_max(c, (v, -c)) AS INTEGER) AS largest FROM a GROUP BY r UNION ALL SELECT 'column', CAST(c AS INTEGER), sum(v), sum(CASE WHEN r <> c THEN v ELSE 0 END), CAST(arg_max(r, (v, -r)) AS INTEGER) FROM a GROUP BY c")
def _(spark, d):
    return measures.marginals(_a(spark, d))


@query("argmin_argabs", "WITH s AS (SELECT user_id, event_id, value, value - 40 AS d FROM events) SELECT user_id, arg_min(event_id, (value, event_id)) AS argmin, arg_max(event_id, (abs(d), -event_id)) AS argabs FROM s GROUP BY 1")
def _(spark, d):
    ev = t(spark, d, "events").withColumn("d", F.col("value") - 40)
    low = reductions.argmin_first(ev, ["user_id"], "value", "event_id").select("user_id", "argmin")
    return low.join(measures.abs_argmax(ev, ["user_id"], "d", "event_id").select("user_id", F.col("argmax").alias("argabs")), "user_id")


@query("split_ints", "SELECT p_partkey, i FROM (SELECT p_partkey, unnest(list_transform(string_split(CAST(p_size AS VARCHAR) || ',' || CAST(p_partkey AS VARCHAR) || ',7', ','), lambda x: CAST(x AS BIGINT))) AS i FROM part)")
def _(spark, d):
    text = F.concat_ws(",", "p_size", "p_partkey", F.lit("7"))
    return t(spark, d, "part").select("p_partkey", F.explode(F.transform(F.split(text, ","), lambda x: x.cast("bigint"))).alias("i"))


@query("first_channel", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1")
def _(spark, d):
    order = F.struct("ts", "event_id")
    return t(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", order).alias("first_type"), F.max_by("event_type", order).alias("last_type"))


@query("independent_line_parts")
def _(spark, d):
    """Independent components of quantity, price, discount and tax over all order lines."""
    parts = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("f"))
    found = independent.components(parts, "f", contrast="pow3").sources
    return found.select("l_orderkey", "l_linenumber", *[F.round(F.get("sources", F.lit(k)), 4).alias(f"s{k}") for k in range(4)])
