"""Line dedup: winnowing over line hashes, in DataFrame functions only.

The units are the lines of a text that hold a word. A window is the shortest run of units from a line on (or back from a
line) that holds ``min_words`` words.

1. Of each window the place of the line with the least hash is selected, the first of equal ones. As a repeated run of ``min_words`` words holds
   whole windows, both of its places select the same lines, so these minima are guaranteed fingerprints.
2. Fingerprints, one for each place however many windows select it, are joined on their hash. One that has no second
   place goes, and its windows with it: no content is looked at before that.
3. Around each place that is left, the match is extended both ways, line by line, to the ends of the windows that selected it,
   on the lines of the texts that hold one. Windows match if all their lines do, by two hashes of 64 bits.
4. Every window but the first of a content (by doc_id, text hash, line) marks its lines. The forward and backward windows
   inside a repeated run cover the whole run, so exactly the lines of later repeated runs of ``min_words`` words or more go.

All of it is linear in the lines: no pair of places is ever formed, so a line that a third of the texts hold costs no
more than others. Counts by hash combine before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstone.llm.common import perhaps_listed, written

#: Words are runs without ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    """(pos, line) of the lines with a word, in order, without white space around them."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.regexp_replace(x, rf"^{SPACE}|{SPACE}$", "").alias("line")))
    return F.filter(lines, lambda u: u.line != "")


def _windows(base: DataFrame, min_words: int) -> DataFrame:
    """(doc, th, first, last, at, mark): units of each window, and place and hash of its least line; units count from 0."""
    units = base.select("doc", "th", F.posexplode(F.transform(_lines(F.col("text")), lambda u: F.struct(F.xxhash64(u.line).alias("h"), (F.regexp_count(u.line, F.lit(SPACE)) + 1).alias("words")))).alias("unit", "u"))
    units = units.select("doc", "th", "unit", "u.h", F.col("u.words").cast("long").alias("words")).repartition("doc", "th").dropDuplicates(["doc", "th", "unit"])  # rows that repeat an id and a text count once
    of_doc = Window.partitionBy("doc", "th")
    units = units.withColumn("through", F.sum("words").over(of_doc.orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)))
    units = units.withColumn("before", F.col("through") - F.col("words"))
    windows = [F.struct(F.min("unit").over(frame).alias("first"), F.max("unit").over(frame).alias("last"), F.sum("words").over(frame).alias("words"), F.min(F.struct("h", "unit")).over(frame).alias("least"))
               for frame in (of_doc.orderBy("before").rangeBetween(0, min_words - 1), of_doc.orderBy("through").rangeBetween(-(min_words - 1), 0))]
    found = units.select("doc", "th", windows[0].alias("ahead"), windows[1].alias("back")).select("doc", "th", F.explode(F.array("ahead", "back")).alias("w")).where(F.col("w.words") >= min_words)
    return found.select("doc", "th", "w.first", "w.last", F.col("w.least.unit").alias("at"), F.col("w.least.h").alias("mark"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """(doc, th, pos): lines of later repeated runs; th is xxhash64 of the text."""
    base = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    windows = written(_windows(base, min_words).distinct())

    prints = windows.select("doc", "th", "at", "mark").distinct()
    place = F.struct("doc", "th", "at")
    met = prints.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("mark")
    alive = windows.join(met, "mark", "left_semi").groupBy(F.col("doc").alias("_d"), F.col("th").alias("_t")).agg(F.collect_set(F.struct("first", "last")).alias("windows"))
    alive = written(alive)

    # a text's windows are at most twice its lines, so they are gathered beside it
    held = perhaps_listed(base, "th", alive, "_t").where("_perhaps").dropDuplicates(["doc", "th"]).join(alive.hint("merge"), F.col("doc").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")))
    units = F.transform(_lines(F.col("text")), lambda u: F.struct(u.pos.alias("pos"), F.xxhash64(u.line).alias("h"), F.xxhash64(F.lit("2"), u.line).alias("g")))
    held = held.select("doc", "th", "windows", units.alias("units"))
    run = lambda w: F.slice("units", w["first"] + 1, w["last"] - w["first"] + 1)
    content = F.transform("windows", lambda w: F.struct(F.get("units", w["first"]).pos.alias("first"), F.get("units", w["last"]).pos.alias("last"), F.xxhash64(run(w).h).alias("k1"), F.xxhash64(run(w).g).alias("k2")))
    matched = written(held.select("doc", "th", F.explode(content).alias("w")).select("doc", "th", "w.*"))

    origin = F.struct("doc", "th", "first")
    firsts = matched.groupBy("k1", "k2").agg(F.min(origin).alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = matched.join(firsts, ["k1", "k2"]).where(~origin.eqNullSafe(F.col("origin")))
    return later.select("doc", "th", F.explode(F.sequence("first", "last")).alias("pos")).distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """One row for each row of ``docs``: id, text without later repeated runs, n_lines, n_removed.

    A run repeats if an earlier place (smaller id, then text hash, then line; null ids first) holds the same lines, blank
    lines and outer white space of lines aside, with ``min_words`` words or more in all. Blank lines inside a removed run
    go with it. A null text stays null with 0 lines; an empty one has one line and stays. Rows that repeat both id and
    text are one document, and each gets its result. Of equal texts with different ids the first stays whole. Other
    columns are not read; an empty table gives an empty result. A text of one long run that repeats becomes empty.
    """
    gone = repeated_lines(docs, id_col, text_col, min_words)
    of_doc = Window.partitionBy("doc", "th").orderBy("pos")
    runs = (gone.withColumn("run", F.col("pos") - F.row_number().over(of_doc))
            .groupBy("doc", "th", "run").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
            .groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"), F.sum(F.col("b") - F.col("a") + 1).cast("long").alias("gone")))
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_th"))
    joined = base.join(runs, F.col("_id").eqNullSafe(F.col("doc")) & (F.col("_th") == F.col("th")), "left")
    lines = F.split("_text", "\n", -1)
    n = F.size(lines)
    starts = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r.b + 1))
    ends = F.concat(F.transform("runs", lambda r: r.a), F.array(n))
    kept = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s)))
    text = F.when(F.col("runs").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(F.col("_id").alias(id_col), text.alias(text_col), F.when(F.col("_text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.coalesce("gone", F.lit(0).cast("long")).alias("n_removed"))
