"""Mixing sources to target weights by soft membership.

A multinomial naive Bayes classifier over hashed words, trained on a labelled table, gives each text posteriors over
domains; its evidence is scaled to EVIDENCE words at most, so that memberships stay soft. Rates r >= floor of the texts are then fitted by
projected gradient descent to the least squares of expected domain tokens against targets,

    minimise  sum_k (Z_k - T_k)^2 / m_k,   Z_k = sum_i r_i * tokens_i * p_ik,   m_k = sum_i tokens_i * p_ik^2,

by projected gradient steps from 1. In the metric of the texts' tokens a step of length 1 / e is r_i = max(floor, 1 - p_i . y), with
K numbers y, and clipping is the true projection. The step is an implicit one: y is the gradient at the point where it ends,
e * m_k * y_k = Z_k(y) - T_k, so a longer step never overshoots, and as e falls to 1e-10 it ends at the least squares, of all
such rates at those nearest to 1, whether or not the targets can be reached. These K equations are the derivative of a convex
function of y; Newton steps with a line search solve them, each by one aggregate over texts grouped by posterior (Z, the
Gram matrix of the texts over the floor, the function). No table of rates is updated: a rate is an expression of y. Copies
of a text are the whole part of its rate, and one more with the chance of the rest, decided by a hash of its id and text.

Training takes at most ``max_rows`` labelled ids of each domain, those with the least hash of the id; their whole texts are
counted on the executors, and only counts by domain and bucket reach the driver. The miss of the targets is told.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstone.llm.common import by_batches, columns, written
from gridstone.llm.textarrays import ALNUM, LOWER, NOT_SPACE, blocks, span_hashes, spans

BUCKETS, EVIDENCE, MAX_ROWS = 1 << 15, 20, 1000
#: A share of all tokens that a miss may be; inverse step lengths, one after the other; what may be left of an equation, in shares of all tokens.
CLOSE, EASE, EXACT = 1e-4, (1e-2, 1e-4, 1e-6, 1e-8, 1e-10), 1e-9
SCALE = 1000


def _words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, buckets of words, bounds of the rows in them, number of words between white space)."""
    for lo, hi, data, offs in blocks(texts):
        a, b, first = spans(data, offs, ALNUM)
        _, _, tokens = spans(data, offs, NOT_SPACE)
        h = span_hashes(LOWER[data], a, b) if len(a) else np.zeros(0, np.uint64)
        yield lo, hi, (h >> np.uint64(49)).astype(np.int64), first, np.diff(tokens)


def count_words(texts: pa.Array, domains: np.ndarray, k: int) -> np.ndarray:
    """Words by bucket and domain (BUCKETS + 1 x domains); the last row has the numbers of texts."""
    counts = np.zeros((BUCKETS + 1, k), np.int64)
    for lo, hi, words, first, _ in _words(texts):
        owner = np.repeat(domains[lo:hi], np.diff(first))
        counts[:BUCKETS] += np.bincount(words[first[0]:first[-1]] * k + owner, minlength=BUCKETS * k).reshape(BUCKETS, k)
    counts[BUCKETS] = np.bincount(domains, minlength=k)
    return counts


def train(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods (buckets x domains) with add-one smoothing, and log priors."""
    smooth = counts + 1.0
    return np.log(smooth[:-1] / smooth[:-1].sum(axis=0)), np.log(smooth[-1] / smooth[-1].sum())


def posteriors(texts: pa.Array, model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors in thousandths that sum to 1000 (texts x domains), and token counts."""
    loglik, prior = model
    k = len(prior)
    out, tokens = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
    for lo, hi, words, first, n in _words(texts):
        sums = np.zeros((len(words) + 1, k))
        np.cumsum(loglik[words], axis=0, out=sums[1:])
        held = np.diff(first)[:, None]
        mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(held, 1)
        z = prior + mean * np.minimum(held, EVIDENCE)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        out[lo:hi] = z / z.sum(axis=1, keepdims=True)
        tokens[lo:hi] = n
    whole = np.floor(out * SCALE + 1e-9).astype(np.int64)
    whole[np.arange(len(whole)), out.argmax(axis=1)] += SCALE - whole.sum(axis=1)
    return whole, tokens


def fit_domains(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """A classifier from a table of (id, domain); null ids and unlisted domains are left out, of several domains of an id the least counts."""
    known = labels.where(F.col(domain_col).isin(domains) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(domain_col).alias("_d"))
    order = [F.xxhash64(F.col("_id").cast("string")), F.col("_id")]
    picked = None
    for d in domains:
        some = known.where(F.col("_d") == d).orderBy(*order).limit(max_rows)
        picked = some if picked is None else picked.unionByName(some)
    number = F.create_map(*[x for i, d in enumerate(domains) for x in (F.lit(d), F.lit(i))])
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id").select("_text", number[F.col("_d")].alias("_k"))
    k = len(domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS + 1, k), np.int64)
        for b in batches:
            total += count_words(b.column(0), b.column(1).to_numpy(), k)
        at, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(d), pa.array(total[at, d])], ["bucket", "domain", "n"])

    found = by_batches(rows, run, "bucket long, domain long, n long").groupBy("bucket", "domain").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS + 1, k))
    counts[found["bucket"].to_numpy(int), found["domain"].to_numpy(int)] = found["n"].to_numpy(float)
    return train(counts)


def _rate(p: Column, y: np.ndarray, floor: float) -> Column:
    """max(floor, 1 - p . y), p in thousandths."""
    dot = sum((F.get(p, F.lit(i)) * float(v / SCALE) for i, v in enumerate(y)), F.lit(0.0))
    return F.greatest(F.lit(float(floor)), 1.0 - dot)


def implicit_step(sums, goal: np.ndarray, m: np.ndarray, total: float) -> np.ndarray:
    """The K numbers of the last step. ``sums(y)``: expected tokens, the Gram matrix of the texts over the floor, and the sum of tokens * h(1 - p . y),
    h being the integral of max(floor, .)."""
    y = np.zeros(len(goal))
    z, gram, h = sums(y)
    for ease in EASE:
        value = lambda y, h: ease * (m * y * y).sum() / 2 + h + goal @ y  # noqa: B023, E731
        while abs(z - goal).max() > CLOSE * total:
            slope = ease * m * y - z + goal
            if abs(slope).max() <= EXACT * total:
                break
            step = -np.linalg.solve(gram + np.diag(ease * m), slope)
            part, now = 1.0, value(y, h)
            if -(slope @ step) <= 1e-13 * abs(now):  # as near as the sums are exact
                break
            while True:
                next_ = sums(y + part * step)
                if value(y + part * step, next_[2]) <= now + 1e-4 * part * (slope @ step) or part < 1e-9:
                    break
                part /= 2
            if part < 1e-9:
                break
            y, (z, gram, h) = y + part * step, next_
    return y


def fit_rates(groups: DataFrame, weights: list[float], floor: float = 0.0, total: float | None = None) -> tuple[np.ndarray, float]:
    """The K numbers that rates follow from, and the largest miss of a target as a share of the total. ``groups`` has p (thousandths), tokens.

    total: of expected tokens; None: as many as there are, or, with a floor of 1, the least that rates of 1 and more can meet."""
    k = len(weights)
    share = np.array(weights, float) / sum(weights)
    part = lambda i: F.get("p", F.lit(i)) / float(SCALE)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        held = groups.select("p", F.col("tokens").cast("double").alias("t"), _rate(F.col("p"), y, floor).alias("r"), (1.0 - sum((part(i) * float(v) for i, v in enumerate(y)), F.lit(0.0))).alias("u"))
        over = F.when(F.col("u") > floor, F.col("t")).otherwise(0.0)
        h = F.col("t") * F.when(F.col("u") > floor, F.col("u") * F.col("u") / 2).otherwise(floor * F.col("u") - floor * floor / 2)
        row = held.agg(*[F.sum(F.col("r") * part(i) * F.col("t")) for i in range(k)], *[F.sum(part(i) * part(j) * over) for i, j in pairs], F.sum(h)).first()
        gram = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[k:]):
            gram[i, j] = gram[j, i] = x or 0.0
        return np.array([x or 0.0 for x in row[:k]]), gram, row[-1] or 0.0

    first = groups.agg(*[F.sum(part(i) * F.col("tokens")) for i in range(k)], *[F.sum(part(i) * part(i) * F.col("tokens")) for i in range(k)]).first()
    z, m = np.array([x or 0.0 for x in first[:k]]), np.maximum(1.0, [x or 0.0 for x in first[k:]])
    if total is None:
        total = float(z.sum()) if floor < 1 else float((z / np.maximum(share, 1e-12)).max())
    y = implicit_step(sums, share * total, m, max(total, 1.0))
    miss = float(abs(sums(y)[0] - share * total).max() / max(total, 1.0))
    if miss > 10 * CLOSE:
        warnings.warn(f"targets are out of reach: the least squares miss one by {miss:.2%} of all tokens", stacklevel=2)
    return y, miss


#: Columns that mix_sources adds.
ADDED = ("n_tokens", "posterior", "rate", "copies")


def mix_sources(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], weights: list[float], id_col: str = "doc_id", text_col: str = "text", floor: float = 0.0, total: float | None = None, keep: bool = True,
                names: dict[str, str] | None = None, told: dict | None = None) -> DataFrame:
    """Each row of ``docs`` (only its id unless ``keep``) with n_tokens, posterior (thousandths), rate and copies.

    ``weights`` are the targets' shares of expected tokens, in the order of the model's domains. A null or empty text has
    no tokens, the labelled table's prior as its posterior and the rate that follows from it. Ids, null ones too, bear on the
    chance of a further copy only, so repeated rows get the same rate and copies. Very long texts count whole. An empty table gives no rows. ``names``: other names
    of the added columns; columns of ``docs`` that have such a name are replaced. ``told`` gets the miss.
    """
    new = {n: (names or {}).get(n, n) for n in (*ADDED, "chance")}
    taken = {n.lower() for n in new.values()}
    held = [(c, f) for c, f in zip(columns(docs), docs.schema.fields) if f.name.lower() not in taken and (keep or f.name in (id_col, text_col))]
    kept = [f for _, f in held]
    at, k = [f.name for f in kept].index(text_col), len(weights)
    schema = T.StructType([*kept, T.StructField(new["n_tokens"], T.LongType()), T.StructField(new["posterior"], T.ArrayType(T.LongType())), T.StructField(new["chance"], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, n = posteriors(b.column(at), model)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * k + 1, k, dtype=np.int32)), pa.array(p.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n), lists, b.column(len(kept))], schema.names)

    chance = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("mix")), 11) / F.lit(float(1 << 53))
    described = by_batches(docs.select(*[c for c, _ in held], chance.alias(new["chance"])), run, schema)
    described = written(described if keep else described.drop(text_col))
    groups = written(described.groupBy(F.col(new["posterior"]).alias("p")).agg(F.sum(new["n_tokens"]).alias("tokens")))
    y, miss = fit_rates(groups, weights, floor, total)
    if told is not None:
        told["miss"] = miss
    rate, u = F.col(new["rate"]), F.col(new["chance"])
    out = described.withColumn(new["rate"], F.round(_rate(F.col(new["posterior"]), y, floor), 9))
    return out.withColumn(new["copies"], (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("long")).drop(new["chance"])
