"""SimHash near-dedup by multi-index hashing.

1. A text's fingerprint has a bit where over half the XXH64 hashes of its shingles, repeats included, have it.
2. Fingerprints are cut into segments. Of two within the distance, some segment differs in at most distance // segments bits, so
   each fingerprint is listed under its segments and looks up all values in a small Hamming ball around each of them. The
   complete distance of what it meets is verified.
3. A segment value under which more than CROWD fingerprints are listed would give pairs by the square. Those that meet there
   go to tasks of one or two blocks each instead; a task walks the links from one fingerprint to the next and takes each
   one that it reaches off the list, so it returns a spanning forest, and a dense group shrinks with the first steps.
4. Equal fingerprints are one from the start; connected components of the links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstone.llm.common import apart, removed, written
from gridstone.llm.components import components
from gridstone.llm.textarrays import LOWER, NOT_SPACE, blocks, spans

_U = np.uint64
#: Fingerprints listed under one segment value from which on they are walked in tasks, and those of a block of a task.
CROWD, BLOCK = 16, 4096
#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Shingles whose bits are spread out at once.
SPREAD = 1 << 16


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return x << _U(by) | x >> _U(64 - by)


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each span of bytes: those under 32 bytes side by side, longer ones by the library."""
    n = ends - starts
    out = np.zeros(len(n), np.uint64)
    short, whole = np.flatnonzero(n < 32), memoryview(data)
    for i in np.flatnonzero(n >= 32).tolist():
        out[i] = xxhash.xxh64_intdigest(whole[starts[i]:ends[i]], seed)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    at, n = starts[short].copy(), n[short]
    h = n.astype(np.uint64) + (_U(seed) + P5)
    for k in range(3):
        live = np.flatnonzero(n >= 8 * (k + 1))
        h[live] = _turn(h[live] ^ _turn(lanes[at[live]] * P2, 31) * P1, 27) * P1 + P4
        at[live] += 8
    live = np.flatnonzero(n & 4)
    h[live] = _turn(h[live] ^ (lanes[at[live]] & _U(0xFFFFFFFF)) * P1, 23) * P2 + P3
    at[live] += 4
    for k in range(3):
        live = np.flatnonzero((n & 3) > k)
        h[live] = _turn(h[live] ^ (lanes[at[live]] & _U(0xFF)) * P5, 11) * P1
        at[live] += 1
    h = (h ^ h >> _U(33)) * P2
    h = (h ^ h >> _U(29)) * P3
    out[short] = h ^ h >> _U(32)
    return out


def fingerprint_texts(texts: pa.Array, width: int, seed: int) -> np.ndarray:
    """Fingerprints (unsigned) of whole texts; zero for one without words."""
    out = [np.zeros(0, np.uint64)]
    for _, _, data, offs in blocks(texts):
        starts, ends, first = spans(data, offs, NOT_SPACE)
        # the words of the block, lower-cased, each with one space behind it
        sizes = ends - starts
        until = np.cumsum(sizes + 1) - 1
        line = np.full(int(until[-1]) + 1 if len(until) else 0, 0x20, np.uint8)
        inside = np.ones(len(line), bool)
        inside[until] = False
        line[inside] = LOWER[data[NOT_SPACE[data]]]
        begin, words = until - sizes, np.diff(first)
        count = np.where(words >= width, words - width + 1, np.minimum(words, 1))
        upto = np.cumsum(count)
        owner = np.repeat(np.arange(len(words)), count)
        low = np.arange(len(owner)) - (upto - count)[owner] + first[:-1][owner]
        high = np.minimum(low + width, first[1:][owner]) - 1
        sums = np.zeros((len(words), 64), np.int64)
        for lo in range(0, len(owner), SPREAD):
            part = slice(lo, lo + SPREAD)
            h = xxh64(line, begin[low[part]], until[high[part]], seed)
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            own = owner[part]
            opens = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            sums[own[opens]] += np.add.reduceat(bits, opens, axis=0, dtype=np.int32)
        out.append(np.packbits(2 * sums > count[:, None], axis=1, bitorder="little").view("<u8").ravel())
    return np.concatenate(out)


def simhashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """One row for each row of ``docs``: id and print, its fingerprint as a signed 64-bit integer. A null text counts as empty."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("print", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[0], pa.array(fingerprint_texts(b[1], width, seed).view(np.int64))], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def walked(prints: np.ndarray, within: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among different fingerprints (unsigned)."""
    left, forest = prints, []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            near = np.bitwise_count(left ^ x) <= within
            if near.any():
                found, left = left[near], left[~near]
                forest += [(x, y) for y in found]
                reached += list(found)
    return forest


def _walk(within: int):
    def run(table: pa.Table) -> pa.Table:
        prints = np.unique(table["print"].to_numpy().view(np.uint64))
        pairs = np.array(walked(prints, within), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})
    return run


def near_links(prints: DataFrame, within: int, segments: int) -> DataFrame:
    """(a, b): links between different fingerprints (column print) that join just those that all links within the distance join.

    A written table: it can be read more than once."""
    if not 1 <= segments <= 16 or 64 % segments:
        raise ValueError("segments must be 1, 2, 4, 8 or 16")
    wide, radius = 64 // segments, within // segments
    ball = [sum(1 << i for i in on) for k in range(radius + 1) for on in combinations(range(wide), k)]
    segment = [F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("print", i * wide).bitwiseAND(F.lit((1 << wide) - 1 if wide < 64 else -1)).alias("v")) for i in range(segments)]
    listed, at = written(prints.select("print", F.inline(F.array(*segment))), True)
    keys = listed.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("low"), F.max("print").alias("high"))
    looks = listed.select("print", "i", F.explode(F.transform(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in ball]), lambda m: m.bitwiseXOR(F.col("v")))).alias("v"))
    # a look-up of a value that nothing else is listed under ends here; each pair is verified from its smaller side
    met, met_at = written(looks.join(apart(keys), ["i", "v"]).where(~((F.col("low") == F.col("print")) & (F.col("n") == 1))).select("i", "v", "n", "print", "high"), True)
    theirs = listed.select("i", "v", F.col("print").alias("b"))
    light = met.where((F.col("n") <= CROWD) & (F.col("print") < F.col("high"))).join(apart(theirs), ["i", "v"]).where("print < b").where(F.bit_count(F.col("print").bitwiseXOR(F.col("b"))) <= within).select(F.col("print").alias("a"), "b")
    heavy = met.where(F.col("n") > CROWD).select("i", "v", "print")
    sizes = heavy.groupBy("i", "v").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y")))
    sent = heavy.join(apart(sizes), ["i", "v"]).select("i", "v", "print", F.explode(tasks).alias("task"))
    crowded = sent.groupBy("i", "v", "task").applyInArrow(_walk(within), "a long, b long")
    out = written(light.unionByName(crowded).distinct())
    removed(prints.sparkSession, at, met_at)
    return out


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, within: int = 3, segments: int = 2, seed: int = 42) -> DataFrame:
    """One row for each row of ``docs``: id, print (signed 64-bit fingerprint), component_id (smallest id linked to it, directly or not).

    Texts are lower-cased (A-Z) and cut at ASCII white space; with fewer words than ``width`` the whole sequence is the one
    shingle; without words, or null, the fingerprint is zero, and such rows link like any others. Fingerprints link
    at ``within`` or fewer differing bits. Repeated rows are rows of their own with equal answers. Null ids are kept and
    never a component_id, but where a component has no other. Very long texts are hashed whole, in bounded stretches. Only
    the two columns are read, so names of others can't clash; an empty table gives no rows.
    """
    described = written(simhashes(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text", width, seed))
    prints = written(described.groupBy("print").agg(F.min("_id").alias("low")))
    roots = components(near_links(prints.select("print"), within, segments))
    per_print = prints.join(apart(roots.withColumnRenamed("node", "print")), "print", "left").withColumn("root", F.coalesce("root", "print"))
    lowest = per_print.groupBy("root").agg(F.min("low").alias("component_id"))
    answers = per_print.select("print", "root").join(apart(lowest), "root").select("print", "component_id")
    return described.join(apart(answers), "print").select(F.col("_id").alias(id_col), "print", "component_id")
