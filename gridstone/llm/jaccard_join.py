"""N-gram Jaccard join by set relations: lists skipped by position and size, answers derived from similar sets' answers.

1. A text's set is its distinct shingles as 64-bit hashes; equal sets are one set from here on.
2. Hash space is cut into positions, as many for a size class that two linked sets differ in at most ``gap`` of them and agree
   in SPARE * gap or more. A key is the content of a position. Two filters follow from that, both exact at any size and
   threshold: a set needs so many keys that other sets hold too, or it has no partner in the class; and of these it needs the
   rarest ones only, since two sets' rarest common key is never among those that either leaves out. A passage or a word
   run that many texts share makes a few keys common and is left out so. Sets whose links are one shingle apart at most
   are listed under their hash sum with each shingle left out as well. A set with more empty positions than the filters
   allow is keyed by another cut of hash space besides.
3. Each key names its smallest set, which gives a linear number of pairs; their connected components are families, and
   no link leaves a family. A small family meets in one task. A larger one is cut by size class and then by blocks, and
   only blocks of one class or of neighbouring ones meet: others can't link.
4. In a task the sets are ordered by size and by content, and so are the index lists. Of a list only the stretch between
   the positions that the size bound allows is read. If no list of a set's prefix holds a partner that the bound on
   positions in the sets allows, its other lists are skipped. Else its overlaps are those of the nearest set computed
   before, plus the lists of the shingles that it adds, less those that it lacks. Links are exact,
   100 * intersection >= 100 * threshold * union in integers; a task returns a spanning forest of them and each set's
   number of links.

Two different sets share an id of 64 bits with a probability of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstone.llm.common import by_batches, perhaps_listed, removed, written
from gridstone.llm.components import components
from gridstone.llm.textarrays import BASE, mix, shingle_sets

_U = np.uint64
#: Sets and shingles of one family in a block, on average; a task holds one or two blocks.
BLOCK, BLOCK_SHINGLES = 2000, 1_500_000
#: Positions beyond those that linked sets can differ in, as a part of them.
SPARE = 1 / 3
#: Other cuts of hash space for sets with many empty positions.
CUTS = 6
#: Computed sets that a set's nearest one is looked for among.
KEPT = 8


class Classes:
    """Size classes of a threshold in percent: a set of a class links within it and with the two beside it only."""

    def __init__(self, percent: int):
        self.percent = percent
        self.gap = lambda n: (100 - percent) * 2 * n // (100 + percent)  # shingles that linked sets of at most n differ in
        self.least = next(n for n in range(1, 1 << 20) if 100 * n >= percent * (n + 1)) if percent < 100 else 1 << 62
        self.small = max((n for n in range(1, 1 << 12) if self.gap(n) <= 1), default=0) if percent < 100 else 0
        lows = [self.small + 1]
        while lows[-1] < 1 << 40 and percent < 100:
            lows.append(10_000 * lows[-1] // (percent * percent) + 1)
        self.lows = np.array(lows)

    def of(self, n: int) -> list[int]:
        c = int(np.searchsorted(self.lows, n, side="right")) - 1
        return [at for at in (c, c + 1) if at >= 0 and 100 * n >= self.percent * int(self.lows[at])]

    def positions(self, at: int) -> tuple[int, int]:
        """Positions of a class, and how many of them linked sets agree in at least."""
        gap = self.gap(int(self.lows[at + 1]) - 1)
        more = max(1, int(gap * SPARE))
        return gap + 1 + more, more + 1


def keys(x: np.ndarray, classes: Classes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(group, need, keys) of a set: of a group's keys, it shares ``need`` at least with each set that it links with there."""
    n = len(x)
    if n < classes.least:
        return
    m = mix(x ^ _U(0x5851F42D4C957F2D))
    if n <= classes.small:
        total = np.add.reduce(m)
        yield -1, 1, mix(np.append(total - m, total))
    for at in classes.of(n):
        k, agree = classes.positions(at)
        bounds = ((np.arange(1, k) / k) * 2.0 ** 64).astype(_U)
        for cut in range(CUTS):
            y = x if not cut else np.sort(mix(x + _U(cut * BASE % (1 << 64))))
            ends = np.concatenate([[0], np.searchsorted(y, bounds), [n]])
            sums = np.append(_U(0), np.cumsum(mix(y ^ _U(0x5851F42D4C957F2D))))
            held = np.diff(ends) > 0
            content = (sums[ends[1:]] - sums[ends[:-1]]) ^ mix(_U((at * CUTS + cut) << 32) + np.arange(k, dtype=_U))
            need = agree - int((~held).sum())
            yield at * CUTS + cut, max(1, need), mix(content)[held]
            if need > 0:
                break
        else:  # empty in too many places of every cut: such sets of a class are listed together
            yield at * CUTS, 1, mix(np.array([at], _U) ^ _U(BASE))


def _set_id(x: np.ndarray) -> int:
    return int(np.add.reduce(mix(x)).astype(np.int64)) if len(x) else 0


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids = [], []
            for x in shingle_sets(batch["_text"], width):
                n.append(len(x))
                ids.append(_set_id(x))
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_th"], pa.array(n, pa.int64()), pa.array(ids, pa.int64())], ["id", "th", "n", "set"])
    return run


#: Rows of keys that are sent on at once.
_KEY_ROWS = 200_000


def _keys(width: int, percent: int):
    names = ["set", "at", "need", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen, rows, held = Classes(percent), set(), [], 0

        def batch() -> pa.RecordBatch:
            sizes = [len(k) for *_, k in rows]
            fixed = [np.repeat(np.array([r[i] for r in rows], t), sizes) for i, t in ((0, np.int64), (1, np.int32), (2, np.int32))]
            flat = np.concatenate([k for *_, k in rows]).view(np.int64)
            return pa.RecordBatch.from_arrays([*map(pa.array, fixed), pa.array(flat)], names)

        for b in batches:
            for x in shingle_sets(b["_text"], width):
                s = _set_id(x)
                if s in seen:  # copies in one task send their keys once
                    continue
                seen.add(s)
                for at, need, found in keys(x, classes):
                    rows.append((s, at, need, found))
                    held += len(found)
                if held > _KEY_ROWS:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in shingle_sets(batch["_text"], width)]
            kept = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(found, pa.large_binary()).cast(pa.binary())], [*kept, "shingles"])
    return run


def links(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray | None, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spanning forest (pairs of places) and number of linked documents of each set, the sets being in order of size.

    side: only pairs of unequal sides count, where given."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(flat, kind="stable")  # a list's owners are in order of size
    terms, term = np.unique(flat[order], return_inverse=True)
    entry, place = term * m + owner[order], place[order]
    owner = owner[order]
    rows = [np.searchsorted(terms, x) for x in sets]

    def stretch(at: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries of some lists with owners of lo to hi, and how many each list has."""
        begin = np.searchsorted(entry, at * m + lo)
        lens = np.searchsorted(entry, at * m + hi) - begin
        return np.repeat(begin - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum()), lens

    def overlaps(at: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return np.bincount(owner[stretch(at, lo, hi)[0]] - lo, minlength=hi - lo) if hi > lo else np.zeros(0, np.int64)

    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    forest, n_links = [], np.zeros(m, np.int64)
    kept: list[tuple[int, int, np.ndarray]] = []  # some computed sets, with their overlaps from a place on
    for i in range(m):
        at, size = rows[i], int(sizes[i])
        lo = int(np.searchsorted(sizes, -(-percent * size // 100)))
        if lo >= i:
            continue
        prefix = size - -(-percent * size // 100) + 1
        found, lens = stretch(at[:prefix], lo, i)
        theirs = sizes[owner[found]]
        left = 1 + np.minimum(size - 1 - np.repeat(np.arange(len(lens)), lens), theirs - 1 - place[found])
        if not ((100 + percent) * left >= percent * (size + theirs)).any():
            continue
        known = None
        if kept:
            shared = [len(np.intersect1d(at, rows[j], assume_unique=True)) for j, _, _ in kept]
            j, low, counts = kept[int(np.argmax(shared))]
            if size + len(rows[j]) - 2 * max(shared) < size:
                lacks, adds = np.setdiff1d(rows[j], at, assume_unique=True), np.setdiff1d(at, rows[j], assume_unique=True)
                known = np.concatenate([counts[lo - low:] + overlaps(adds, lo, j) - overlaps(lacks, lo, j), overlaps(at, max(lo, j), i)]) if lo < j else None
        if known is None:
            known = overlaps(at, lo, i)
        kept = [*kept[1 - KEPT:], (i, lo, known)]
        near = lo + np.flatnonzero(100 * known >= percent * (size + sizes[lo:i] - known))
        if side is not None:
            near = near[side[near] != side[i]]
        n_links[i] += copies[near].sum()
        np.add.at(n_links, near, copies[i])
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                forest.append((i, j))
    return forest, n_links


def _task(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids, n = table["set"].to_numpy(), table.num_rows
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        order = sorted(range(n), key=lambda i: (len(sets[i]), sets[i][:4].tolist(), ids[i]))
        order = [i for k, i in enumerate(order) if not k or ids[i] != ids[order[k - 1]]]
        side = table["side"].to_numpy()[order]
        copies = table["copies"].to_numpy()[order]
        forest, n_links = links([sets[i] for i in order], copies, side if len(set(side.tolist())) > 1 else None if table["alone"][0].as_py() else np.zeros(len(order), np.int64), percent)
        ids = ids[order]
        a = np.array([i for i, _ in forest] + list(range(len(order))), np.int64)
        b = np.array([j for _, j in forest] + list(range(len(order))), np.int64)
        count = np.append(np.zeros(len(forest), np.int64), n_links)
        return pa.table({"a": ids[a], "b": ids[b], "n_links": count})
    return run


def _families(base: DataFrame, width: int, percent: int) -> DataFrame:
    """(set, family) of the sets that may link with another."""
    spark = base.sparkSession
    rows = by_batches(base.select("_text"), _keys(width, percent), "set long, at int, need int, key long")
    of_key, of_group = Window.partitionBy("key"), Window.partitionBy("set", "at")
    met = rows.withColumns({"low": F.min("set").over(of_key), "high": F.max("set").over(of_key), "n": F.count(F.lit(1)).over(of_key)}).where("low != high")
    shared, path = written(met.select("key", "set", "at", "need", "n").distinct(), True)
    have = shared.withColumn("have", F.count(F.lit(1)).over(of_group)).where("have >= need")
    rare = have.withColumn("rank", F.row_number().over(of_group.orderBy("n", "key"))).where("rank <= have - need + 1").select("key", "set")
    pairs = rare.withColumn("low", F.min("set").over(of_key)).where("set != low").select(F.col("set").alias("a"), F.col("low").alias("b")).distinct()
    found = components(pairs).withColumnsRenamed({"node": "set", "root": "family"})
    removed(spark, path)
    return found


def _tasks(members: DataFrame, percent: int) -> DataFrame:
    """``members`` (family, set, n and others) with the tasks that each set is sent to: task, side (of the two that meet), alone (one block with itself).

    A family of one block is one task. Of a larger one each size class has blocks of its own, and blocks meet in one class and with those of the next."""
    size = F.floor(F.log(F.col("n").cast("double")) / (F.log(F.lit(100 / percent)) * (1 + 1e-9))).cast("int") if percent < 100 else F.col("n").cast("int")
    sizes = members.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("whole"))
    large = members.join(sizes, "family").withColumn("size", F.when(F.col("whole") > 1, size).otherwise(F.lit(0)))
    blocks = large.groupBy("family", "size").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    near = blocks.select("family", "size", "blocks")
    beside = (near.join(near.select("family", (F.col("size") - 1).alias("size"), F.col("blocks").alias("above")), ["family", "size"], "left")
              .join(near.select("family", (F.col("size") + 1).alias("size"), F.col("blocks").alias("below")), ["family", "size"], "left").na.fill(0, ["above", "below"]))
    dealt = large.drop("whole").join(beside, ["family", "size"]).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    count = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda a, i, b, j, side: F.struct(a.alias("size_a"), i.alias("block_a"), b.alias("size_b"), j.alias("block_b"), side.cast("long").alias("side"))
    s, b = F.col("size"), F.col("block")
    tasks = F.concat(F.transform(count("blocks"), lambda o: at(s, F.least(b, o), s, F.greatest(b, o), F.when(b <= o, 0).otherwise(1))),
                     F.transform(count("above"), lambda o: at(s, b, s + 1, o, F.lit(0))), F.transform(count("below"), lambda o: at(s - 1, o, s, b, F.lit(1))))
    sent = dealt.withColumn("t", F.explode(tasks)).withColumn("alone", F.expr("t.size_a = t.size_b and t.block_a = t.block_b"))
    return sent.select(*members.columns, F.struct("t.size_a", "t.block_a", "t.size_b", "t.block_b").alias("task"), "t.side", "alone")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id (smallest id linked to it, directly or not), n_links,
    text_hash (xxhash64 of the text) and component_hash (the least text_hash of the rows of that smallest id in the component).

    ``n_links`` counts the other documents that the document itself links with. Texts are lower-cased (A-Z) and cut at
    ASCII white space; with fewer words than ``width`` the whole sequence is the one shingle; a text without words, or
    null, has an empty set, links with nothing and is its own component. Null ids are passed through, count as smaller
    than others, and a component of null ids only has a null id. Rows that repeat an id count as documents of their own.
    Very long texts are sets like others. Only the two columns are read, so names of others can't clash; an empty table
    gives no rows. ``threshold`` counts in whole percent.
    """
    percent = round(100 * threshold)
    id_type = docs.schema[id_col].dataType
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    schema = T.StructType([T.StructField("id", id_type), T.StructField("th", T.LongType()), T.StructField("n", T.LongType()), T.StructField("set", T.LongType())])
    described = written(by_batches(base, _describe(width), schema))
    sets = written(described.where("n > 0").groupBy("set").agg(F.min(F.struct("id", "th")).alias("first"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")))

    families = written(_families(base, width, percent).join(sets, "set").select("set", "family", "n", "copies", F.col("first.id").alias("id"), F.col("first.th").alias("th")))
    tasks = written(_tasks(families, percent))
    # most texts are in no family and need not be shuffled
    texts = perhaps_listed(base, "_th", families, "th").where("_perhaps").join(families.select("set", "id", "th").hint("merge"), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th"))).select("set", "_text")
    sent = texts.dropDuplicates(["set"]).join(tasks.hint("merge"), "set").select("family", "task", "side", "alone", "set", "copies", "_text")
    sent = by_batches(sent, _sets(width), T.StructType([*sent.drop("_text").schema.fields, T.StructField("shingles", T.BinaryType())]))
    found = written(sent.groupBy("family", "task").applyInArrow(_task(percent), "a long, b long, n_links long"))

    linked = components(found.where("a != b").select("a", "b"))
    counts = found.groupBy(F.col("a").alias("set")).agg(F.sum("n_links").alias("n_links"))
    per_set = sets.select("set", "copies", F.col("first").alias("low"))
    per_set = per_set.join(linked.withColumnRenamed("node", "set"), "set", "left").join(counts, "set", "left").withColumn("root", F.coalesce("root", "set"))
    lowest = per_set.groupBy("root").agg(F.min("low").alias("low"))
    per_set = per_set.drop("low").join(lowest, "root").select("set", "low", (F.coalesce("n_links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"))
    out = described.where("n > 0").join(per_set, "set").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("low.id").alias("component_id"), "n_links", F.col("th").alias("text_hash"), F.col("low.th").alias("component_hash"))
    alone = described.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.col("th").alias("text_hash"), F.col("th").alias("component_hash"))
    return out.unionByName(alone)
