"""URL filters: a blocked Bloom filter of listed URLs in front of an exact hash join.

A listed URL is a rule (host, path, verdict). It fits its host and every subdomain when the page's path starts with the
rule's path. A page's candidate keys are its host suffixes (whole labels) joined to its path prefixes, of the label counts
and path lengths that occur in the list. The Bloom filter, one 64-bit block a key, drops keys that are surely not listed;
what passes meets the list in an equi-join, which removes the false positives. The longest fitting rule wins.

Only DataFrame functions are used. The filter has at most ``MAX_BLOCKS`` words (512 KB) however long the list is; past
about 400,000 rules it lets more keys through, and the join still decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import UPPER

MAX_BLOCKS = 1 << 16
BITS_PER_KEY = 12
#: Bits that a key sets in its block.
PROBES = 4


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    bits = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def build_filter(keys: DataFrame) -> list[int]:
    """Words of the blocked filter over column ``key``; at most ``MAX_BLOCKS`` longs reach the driver."""
    n = keys.count()
    blocks = 16
    while blocks < MAX_BLOCKS and blocks * 64 < n * BITS_PER_KEY:
        blocks *= 2
    words = [0] * blocks
    for r in keys.groupBy(_block(F.col("key"), blocks).alias("b")).agg(F.bit_or(_mask(F.col("key"))).alias("m")).collect():
        words[r.b] = r.m
    return words


def might_contain(words: list[int], key: Column) -> Column:
    mask = _mask(key)
    return F.get(F.lit(words).cast("array<bigint>"), _block(key, len(words))).bitwiseAND(mask) == mask


def url_filters(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule (host + path of the winner or null) and verdict.

    ``rules`` has host, path, verdict. Of rules of one length the one with the longer host wins, then the larger text;
    of two rules with one key "block" wins. A null url, or one without "://", has an empty host and path, meets no rule
    and gets ``default``. Repeated pages stay repeated; ids may be null or tied. Rules with a null part are ignored. An
    empty list allows everything. Other columns are not read.
    """
    listed = rules.where("host is not null and path is not null and verdict is not null").select(
        F.translate("host", UPPER, UPPER.lower()).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    listed = listed.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict")).withColumn("key", F.concat("rule_host", "rule_path"))
    shape = listed.agg(F.max(F.size(F.split("rule_host", r"\.", -1))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    base = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("_url"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    if not shape.labels:
        return base.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    words = build_filter(listed)

    labels = F.split("host", r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), n - shape.labels + 1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    prefixes = F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in sorted(shape.lengths)])
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(prefixes, lambda p: p.isNotNull()), lambda p: F.concat(s, p))))
    base = base.withColumn("_keys", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(keys)))
    base = base.withColumn("_keys", F.filter("_keys", lambda k: might_contain(words, k)))

    hits = base.where(F.size("_keys") > 0).select(id_col, "_url", "host", "path", F.posexplode("_keys").alias("_i", "key"))
    rank = F.when(F.col("rule_verdict").isNotNull(), F.struct(F.length("key").alias("n"), F.length("rule_host").alias("h"), F.col("key").alias("rule"), F.col("rule_verdict").alias("verdict")))
    best = (hits.join(listed, "key", "left").groupBy(id_col, "_url", "host", "path")
            .agg(F.max(rank).alias("_best"), F.sum((F.col("_i") == 0).cast("int")).alias("_copies"))
            .select(id_col, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"), F.explode(F.expr("sequence(1, int(_copies))")).alias("_c")).drop("_c"))
    rest = base.where(F.size("_keys") == 0).select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return rest.unionByName(best)
