"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Each window of five bytes gives six triplets: its first byte with each two of the other four. Each is hashed, with a salt of its place,
into one of 128 buckets. A digest is "Q", two hex digits for the length class, two for the quartile ratios, then 64 hex
digits: two bits a bucket, telling in which quartile of the counts it lies. Two digests are compared by the distances of
length, ratios and buckets, whose sum is bounded, so that likeness is a number from 0 (farthest) to 1 (alike).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstone.llm.textarrays import blocks
from gridstone.operators.ordered import rank_among

BUCKETS = 128
#: Places of the two further bytes of each triplet after the first one.
TRIPLETS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]
#: Most that the parts of a difference add to it: length, ratios, buckets.
LENGTH_MOST, RATIO_MOST, WORST = 32, 24, 3 * BUCKETS
#: Different ids that cut points are taken from, about: those whose hash is under a share of its range.
SAMPLE = 20_000

_SALTS = (np.random.default_rng(128).integers(0, 1 << 32, (len(TRIPLETS), 3, 256))).astype(np.uint32)


def bucket_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts (texts x buckets) of the triplets of each text in a block of bytes."""
    n = len(offs) - 1
    out = np.zeros(n * BUCKETS, np.int64)
    w = len(data) - 4
    if w <= 0:
        return out.reshape(n, BUCKETS)
    sizes = np.diff(offs)
    owner = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, sizes)[:w]
    last = np.repeat(offs[1:], sizes)[:w]
    whole = np.arange(w) + 5 <= last
    if not whole.all():
        at = np.flatnonzero(whole)
        owner = owner[at]
    else:
        at = None
    for salts, (i, j) in zip(_SALTS, TRIPLETS):
        h = salts[0][data[:w]] ^ salts[1][data[i:w + i]] ^ salts[2][data[j:w + j]]
        h = ((h * np.uint32(0x9E3779B1)) >> np.uint32(25)).astype(np.int64)
        out += np.bincount((h if at is None else h[at]) + owner, minlength=n * BUCKETS)
    return out.reshape(n, BUCKETS)


def digests(counts: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Digest strings; a text of under five bytes has no triplets and differs from others by its length class only."""
    order = np.sort(counts, axis=1)
    q = order[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, :, None] > q[:, None, :]).sum(axis=2).astype(np.uint8)
    packed = codes[:, 0::4] << 6 | codes[:, 1::4] << 4 | codes[:, 2::4] << 2 | codes[:, 3::4]
    length = np.where(sizes > 0, np.round(np.log(np.maximum(sizes, 1)) / np.log(1.1)), 0).astype(np.int64) % 256
    top = np.maximum(q[:, 2], 1)
    ratios = (q[:, 0] * 15 // top) << 4 | (q[:, 1] * 15 // top)
    return [f"Q{a:02x}{b:02x}{c.tobytes().hex()}" for a, b, c in zip(length.tolist(), ratios.tolist(), packed)]


def _codes(digest: np.ndarray) -> np.ndarray:
    return np.stack([digest >> 6, digest >> 4 & 3, digest >> 2 & 3, digest & 3], axis=-1).reshape(len(digest), -1).astype(np.int64)


def differences(a: list[str], b: list[str]) -> np.ndarray:
    """Difference scores of digests: 0 for equal ones, LENGTH_MOST + RATIO_MOST + WORST at most."""
    if not a:
        return np.zeros(0, np.int64)
    x, y = (np.frombuffer(bytes.fromhex("".join(d[1:] for d in z)), np.uint8).reshape(len(z), -1) for z in (a, b))
    ring = lambda u, v, m: np.minimum((u - v) % m, (v - u) % m)
    u, v = x.astype(np.int64), y.astype(np.int64)
    length = np.minimum(ring(u[:, 0], v[:, 0], 256), LENGTH_MOST)
    ratio = np.minimum(abs((u[:, 1] >> 4) - (v[:, 1] >> 4)) + abs((u[:, 1] & 15) - (v[:, 1] & 15)), RATIO_MOST)
    return length + ratio + abs(_codes(x[:, 2:]) - _codes(y[:, 2:])).sum(axis=1)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """1 for equal digests, falling evenly to 0 at the largest difference that there can be."""
    return 1.0 - differences(a, b) / (LENGTH_MOST + RATIO_MOST + WORST)


def fingerprint_texts(texts: pa.Array) -> list[str]:
    out = []
    for _, _, data, offs in blocks(texts):
        out += digests(bucket_counts(data, offs), np.diff(offs))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id and fingerprint. A null text counts as empty; equal texts have equal digests."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[0], pa.array(fingerprint_texts(b[1]), pa.string())], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def with_next(docs: DataFrame, run, schema: T.StructType, id_col: str = "doc_id", text_col: str = "text", per_part: int = 40_000) -> DataFrame:
    """``run(ids, texts, next_texts)`` over all rows in descending (id, text) order, each with the text that follows it.

    The last row is followed by the first. Ids of any ordered type are dealt into ranges by cut points from a bounded sample
    of them, which bears on the ranges' sizes only; the row that follows a range, one for each, goes along with it as a
    guest. All texts move once. Rows of one id share a range. ``run`` gives a record batch.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    keys = base.select("_id")
    n, different = keys.agg(F.count(F.lit(1)), F.approx_count_distinct("_id")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // per_part))
    id_type = docs.schema[id_col].dataType
    few = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, different)))
    seen = sorted(r[0] for r in keys.where(F.col("_id").isNotNull() & few).distinct().collect()) if parts > 1 else []
    cuts = sorted({seen[i * len(seen) // parts] for i in range(1, parts)}) if seen else []
    # part 0 has the largest ids, as rows go in descending order; null ids come last
    at_or_below = rank_among([F.lit(c).cast(id_type) for c in cuts], F.col("_id"))
    part = F.lit(len(cuts)) - F.when(F.col("_id").isNull(), 0).otherwise(at_or_below)
    dealt = base.withColumn("_part", part)
    tops = dealt.groupBy("_part").agg(F.max("_id").alias("top")).collect()
    used = sorted(r["_part"] for r in tops)
    place = {p: i for i, p in enumerate(used)}
    top = {place[r["_part"]]: r["top"] for r in tops}
    m = len(used)
    if not m:
        return spark.createDataFrame([], schema)
    firsts = spark.createDataFrame([((i - 1) % m, i, p, top[i]) for p, i in place.items()], T.StructType([T.StructField("guest_of", T.LongType()), T.StructField("_slot", T.LongType()), T.StructField("_part", T.IntegerType()), T.StructField("top", id_type)]))
    # the first row of each range: its largest text of its largest id
    heads = dealt.join(F.broadcast(firsts), "_part").where(F.col("_id").eqNullSafe(F.col("top"))).groupBy("guest_of").agg(F.max("_text").alias("_text")).select(F.col("guest_of").alias("_slot"), F.lit(None).cast(id_type).alias("_id"), "_text", F.lit(True).alias("_guest"))
    slots = F.broadcast(firsts.select("_part", "_slot"))
    rows = dealt.join(slots, "_part").select("_slot", "_id", "_text", F.lit(False).alias("_guest")).unionByName(heads)
    rows = rows.repartitionById(m, F.col("_slot").cast("int")).sortWithinPartitions("_slot", "_guest", F.desc_nulls_last("_id"), F.desc("_text"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                t = pa.Table.from_batches([batch.slice(lo, 1000)])
                t = pa.concat_tables([held, t]) if held is not None else t
                t = t.combine_chunks()
                k = t.num_rows - 1
                if k:
                    texts = t["_text"].combine_chunks()
                    yield run(t["_id"].combine_chunks().slice(0, k), texts.slice(0, k), texts.slice(1, k))
                held = t.slice(k)

    return rows.mapInArrow(over, schema)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next row, in descending id order.

    The edited text has its last third (rounded down, code points) replaced by the first as many of the next row's text;
    the last row is followed by the first. Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Null texts count as empty. Rows that tie on the id go by text, largest first; null ids come
    last. A table of one row is its own next. An empty table gives no rows.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
                           T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def run(ids: pa.Array, texts: pa.Array, following: pa.Array) -> pa.RecordBatch:
        import hashlib

        own, after = texts.to_pylist(), following.to_pylist()
        edited = [a[:len(a) - len(a) // 3] + b[:len(a) // 3] for a, b in zip(own, after)]
        prints = fingerprint_texts(texts)
        nexts = prints[1:] + fingerprint_texts(following.slice(len(following) - 1))
        changed = fingerprint_texts(pa.array(edited, pa.string()))
        return pa.RecordBatch.from_arrays([ids, pa.array([len(a) for a in own], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()), pa.array(prints, pa.string()), pa.array(changed, pa.string()), pa.array(likeness(prints, changed)), pa.array(likeness(prints, nexts))], schema.names)

    return with_next(docs, run, schema, id_col, text_col)
