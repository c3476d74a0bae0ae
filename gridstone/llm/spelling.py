"""Spelling variant grouping by anagram hashing.

A word's key is the sum of the fifth powers of its letters' code points, modulo a prime, so letters in another order have the same key.
Two words that differ by one letter have keys that differ by that letter's value, or by the exchange of one value for another.
The longer word less a letter's value meets the shorter word's key; for an exchange both words go less one value each, and
different letters meet. Keys know no order, so what meets is verified letter by letter.

Many words can share a key. As a single edit leaves either the first or the last half of the shorter word as it is, words
meet under the key together with their first half, or with their last: that splits a key's list and loses no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import apart, ascii_lower, removed, written

#: Modulus of keys, so that words of any length have one.
PRIME = (1 << 61) - 1
#: Runs of A-Z, a-z and the letters from U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]+"


def letter_value(letter: Column) -> Column:
    """Fifth power of a letter's code point."""
    x = F.ascii(letter).cast("long")
    return x * x * x * x * x


def anagram_key(letters: Column) -> Column:
    """Sum of the values of an array of letters."""
    return F.aggregate(letters, F.lit(0).cast("long"), lambda sum_, letter: F.pmod(sum_ + letter_value(letter), F.lit(PRIME)))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = 97, least_letters: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n): letter runs of all texts, lower-cased (A-Z), of ``least_letters`` code points and ``least_n`` occurrences or more.

    Where ``slip`` divides the crc32 of ``id:run``, the run loses the code point at crc32 % length: planted misspellings, none if ``slip`` is
    0. A null text has no words; a null id counts as an empty one.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(key.alias("_key"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(RUN), F.lit(0))).alias("word"))
    if slip:
        crc, at = F.crc32(F.concat("_key", F.lit(":"), "word").cast("binary")), F.pmod(F.col("_crc"), F.char_length("word")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        runs = runs.withColumn("_crc", crc).select(F.when(F.col("_crc") % slip == 0, shorter).otherwise(F.col("word")).alias("word"))
    return runs.where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def _halves(key: Column, size: Column) -> Column:
    """Keys with the first half and with the last half of a word of ``size`` letters, taken from column word."""
    h = F.floor(size / 2).cast("int")
    return F.array(F.xxhash64(F.lit("first"), size, key, F.substring("word", F.lit(1), h)), F.xxhash64(F.lit("last"), size, key, F.right(F.col("word"), size - h)))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two different words of which b is as long as a, or one letter longer, differ by one edit: what follows the first difference must agree.

    The first difference is found by halving, so that very long words take a few passes instead of a table of letter pairs.
    """
    rest = lambda c, at: F.substring(c, at, F.char_length(c))
    steps = F.sequence(F.ceil(F.log2(F.char_length(a) + 1)).cast("int"), F.lit(0), F.lit(-1))
    same = F.aggregate(steps, F.lit(0), lambda at, k: F.when(
        (at + F.call_function("shiftleft", F.lit(1), k) <= F.char_length(a)) & (F.substring(a, at + 1, F.call_function("shiftleft", F.lit(1), k)) == F.substring(b, at + 1, F.call_function("shiftleft", F.lit(1), k))),
        at + F.call_function("shiftleft", F.lit(1), k)).otherwise(at))
    return F.when(F.char_length(a) == F.char_length(b), rest(a, same + 2) == rest(b, same + 2)).otherwise(rest(a, same + 1) == rest(b, same + 2))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): pairs of words, each once, that differ by exactly one inserted, deleted or replaced code point. ``words``: different ones, column word."""
    letters = F.split("word", "")
    # split("") may end in an empty part
    parted = words.select("word", F.char_length("word").alias("size"), F.filter(letters, lambda c: c != "").alias("letters"))
    keyed = parted.select("word", "size", anagram_key(F.col("letters")).alias("key"), F.array_distinct("letters").alias("letters"))
    less = keyed.select("word", "size", F.explode("letters").alias("letter"), "key").withColumn("less", F.pmod(F.col("key") - letter_value(F.col("letter")), F.lit(PRIME)))
    whole = keyed.select(F.col("word").alias("a"), F.explode(_halves(F.col("key"), F.col("size"))).alias("k"))
    removed_ = less.select(F.col("word").alias("b"), F.explode(_halves(F.col("less"), F.col("size") - 1)).alias("k"))
    exchanged = less.select("word", "letter", F.explode(_halves(F.col("less"), F.col("size"))).alias("k"))
    longer = whole.join(apart(removed_), "k").select("a", "b")
    equal = exchanged.withColumnsRenamed({"word": "a", "letter": "x"}).join(apart(exchanged.withColumnsRenamed({"word": "b", "letter": "y"})), "k").where("x < y").select("a", "b")
    return longer.unionByName(equal).where(one_edit(F.col("a"), F.col("b"))).distinct()


def spelling_groups(words: DataFrame, factor: int = 2) -> DataFrame:
    """One row for each row of ``words`` (word, n): word, form, root, n, n_near, form_n.

    n_near counts the near words; form is the near word of largest n (ties: smallest in code-point order) if that n is at least
    ``factor`` times the word's own, else null; form_n is its n. root is where following forms from the word ends; as n
    grows by the factor at each step, a chain has under 64 steps and no circle. Words are different and not null; rows of
    null words are dropped.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more, or chains of forms may not end")
    spark = words.sparkSession
    words, words_at = written(words.where("word IS NOT NULL").select("word", "n"), True)
    pairs, pairs_at = written(near_pairs(words.select("word")), True)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.join(apart(words.withColumnsRenamed({"word": "b", "n": "m"})), "b").groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("best"))
    large = -F.col("best.m") >= factor * F.col("n")
    known = words.join(apart(best), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(large, F.col("best.b")).alias("form"), F.when(large, -F.col("best.m")).alias("form_n"))
    known = written(known)
    removed(spark, words_at, pairs_at)
    # each round doubles the steps that a word has gone: six are enough for any chain of under 64
    to, at = written(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")), True)
    for _ in range(6):
        further = to.join(apart(to.select(F.col("root").alias("next"), F.col("word").alias("root"))), "root", "left")
        last = at
        to, at = written(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), True)
        moved = to.where("moved").limit(1).count()
        to = to.drop("moved")
        removed(spark, last)
        if not moved:
            break
    return known.join(apart(to), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = 0, least_letters: int = 5, least_n: int = 3, factor: int = 2) -> DataFrame:
    """Spelling variants among the words of whole texts: ``spelling_groups`` of ``word_counts``.

    Null and empty texts have no words; repeated rows count as often as they stand there; texts of any length are read whole.
    Only the two columns are read, so names of others can't clash; an empty table gives no rows.
    """
    return spelling_groups(word_counts(docs, id_col, text_col, slip, least_letters, least_n), factor)
