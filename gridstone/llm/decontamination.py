"""Benchmark decontamination: a prefix-filtered set join of item windows against texts, in DataFrame functions only.

A window is ``width`` consecutive words of an item (all its words if it has fewer); its set is its shingles of up to three
words, each with its place. A first pass over the texts counts the shingles that items hold, which orders them by rarity. As
containment must be whole, the prefix of a window is its rarest shingle alone, and a second pass keeps the places of
these shingles only. The offset in the window bounds the position (it must not start before the text), the window's
length bounds the end. What is left is verified on the words: the text's words from the place on must be the window's.

Texts are cut into words once, and kept as four bytes a word for the two passes; hashes bear on the candidates only. Shingles that
are surely not asked for go before any shuffle: by a broadcast join with up to ``BROADCAST_SHINGLES`` hashes, by a blocked filter with more. Joins
of places split hot keys by adaptive skew handling; counts combine before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstone.llm.common import ascii_lower, perhaps_listed, removed, written

#: ASCII other than 0-9 and a-z, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
#: Hashes of shingles are broadcast up to so many rows, under 4 MB in all.
BROADCAST_SHINGLES = 100_000


def words(text: Column) -> Column:
    """Lower-cased words; null gives none. The text is trimmed of separators first, so that no empty word arises."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), lambda w: w != "")


def _gram(hashes: list[Column]) -> Column:
    """A shingle's hash from those of its words; their number tells its size."""
    return F.xxhash64(F.lit(len(hashes)), *hashes)


def _grams(hashes: Column, size: int) -> Column:
    n = F.size(hashes) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: _gram([F.get(hashes, i + k) for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def windows(items: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """(win, length, w, items): each distinct window once, however many items hold it."""
    w = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(width))
    w = w.select("item", length.alias("length"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))).alias("w"))
    return w.groupBy(F.array_join("w", " ").alias("win"), "length", "w").agg(F.collect_set("item").alias("items"))


def _hashes(w: Column) -> Column:
    """Four bytes a word, which is enough to find candidates."""
    return F.transform(w, lambda x: F.hash(x))


def _shingles(wins: DataFrame) -> DataFrame:
    """(win, length, size, need, offset, shingle): need is the number of shingles of the window."""
    rows = []
    for size in range(1, GRAM + 1):
        fits = wins.where((F.least("length", F.lit(GRAM)) == size)).withColumn("h", _hashes(F.col("w")))
        rows.append(fits.select("win", "length", F.lit(size).alias("size"), (F.col("length") - size + 1).alias("need"), F.posexplode(_grams(F.col("h"), size)).alias("offset", "shingle")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _places(hashed: DataFrame, sizes: list[int], known: DataFrame, n: int) -> DataFrame:
    """(doc, th, n_words, pos, shingle) of the places of known shingles in the texts; ``n`` is the number of known ones."""
    grams = [_grams(F.col("h"), k) for k in sizes]
    if len(sizes) == 1:
        places = hashed.select("doc", "th", "n_words", F.posexplode(grams[0]).alias("pos", "shingle"))
    else:
        places = hashed.select("doc", "th", "n_words", F.explode(F.array(*grams)).alias("g")).select("doc", "th", "n_words", F.posexplode("g").alias("pos", "shingle"))
    if n <= BROADCAST_SHINGLES:
        return places.join(F.broadcast(known), "shingle", "left_semi")
    return perhaps_listed(places, "shingle", known, "shingle", n).where("_perhaps").drop("_perhaps").join(known.hint("merge"), "shingle", "left_semi")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_hit, n_items, items (sorted ids as strings), spans, contaminated, text_hash.

    ``spans`` has the hit word ranges [start, end). A null or empty text has no words and is clean. Items without words
    are ignored, items with equal texts all count, null item ids do not. A window that occurs many times in one text, or
    in overlapping places, marks each word once. Rows that repeat an id with another text are documents of their own;
    of those that repeat both each gets the result. Very long texts count whole. Only the named columns are read, so names of
    others can't clash. Empty tables give empty results, an empty benchmark leaves every text clean.
    """
    wins = written(windows(items, item_col, item_text, width))
    parts = written(_shingles(wins))
    listed = parts.select("size", "shingle").distinct()
    facts = listed.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    sizes = facts.sizes or [GRAM]

    base = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    hashed, hashed_at = written(base.select("doc", "th", _hashes(words(F.col("text"))).alias("h")).withColumn("n_words", F.size("h")), True)
    texts = written(hashed.select("doc", "th", F.col("n_words").cast("long").alias("n_words")))
    rarity = _places(hashed, sizes, listed.select("shingle"), facts.n).groupBy("shingle").agg(F.count(F.lit(1)).alias("places"))
    prefix = parts.join(rarity, "shingle").groupBy("win", "length").agg(F.count(F.lit(1)).alias("have"), F.first("need").alias("need"), F.min(F.struct("places", "shingle", "offset")).alias("p"))
    # a window with a shingle that no text holds can't occur
    prefix = written(prefix.where("have = need").select("length", F.col("p.shingle").alias("shingle"), F.col("p.offset").alias("offset")).distinct())
    known = prefix.select("shingle").distinct()
    starts = (_places(hashed, sizes, known, known.count()).join(prefix, "shingle").withColumn("start", F.col("pos") - F.col("offset"))
              .where("start >= 0 and start + length <= n_words").groupBy("doc", "th").agg(F.collect_set(F.struct("start", "length")).alias("starts")))
    starts = written(starts.withColumnsRenamed({"doc": "_d", "th": "_t"}))
    removed(docs.sparkSession, hashed_at)
    # the places of a text are at most its words times the lengths of windows, so they are gathered beside it
    held = perhaps_listed(base, "th", starts, "_t").where("_perhaps").dropDuplicates(["doc", "th"]).join(starts.hint("merge"), F.col("doc").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")))
    held = held.select("doc", "th", words(F.col("text")).alias("w"), "starts")
    found = held.select("doc", "th", F.explode(F.transform("starts", lambda s: F.struct(s.start.alias("start"), s.length.alias("length"), F.array_join(F.slice("w", s.start + 1, s.length), " ").alias("win")))).alias("s"))
    occur = written(found.select("doc", "th", "s.*").join(wins.select("win"), "win"))

    of_doc = Window.partitionBy("doc", "th").orderBy("start", "length")
    seen = F.coalesce(F.max(F.col("start") + F.col("length")).over(of_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest("start", seen))
    ranges = occur.withColumn("fresh", fresh).withColumn("opens", (F.col("start") > seen) | (F.row_number().over(of_doc) == 1))
    ranges = ranges.withColumn("range", F.sum(F.col("opens").cast("int")).over(of_doc.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = ranges.groupBy("doc", "th", "range").agg(F.min("start").alias("a"), F.max(F.col("start") + F.col("length")).alias("b"), F.sum("fresh").alias("fresh"))
    hit = ranges.groupBy("doc", "th").agg(F.sum("fresh").cast("long").alias("n_hit"), F.sort_array(F.collect_list(F.struct(F.col("a").alias("start"), F.col("b").alias("end")))).alias("spans"))
    held = (occur.select("doc", "th", "win").distinct().join(wins.select("win", F.explode("items").alias("item")), "win")
            .select("doc", "th", "item").distinct().groupBy("doc", "th").agg(F.sort_array(F.collect_list("item")).alias("items")))
    marked = hit.join(held.withColumnsRenamed({"doc": "_d", "th": "_t"}), F.col("doc").eqNullSafe(F.col("_d")) & F.col("th").eqNullSafe(F.col("_t"))).drop("_d", "_t")
    marked = marked.withColumnsRenamed({"doc": "_d", "th": "_t"})
    out = texts.join(marked, F.col("doc").eqNullSafe(F.col("_d")) & F.col("th").eqNullSafe(F.col("_t")), "left")
    return out.select(F.col("doc").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), F.col("th").alias("text_hash"))
