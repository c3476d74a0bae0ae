"""Token-ID output: shards of equal-length sequences and masks in Arrow's stream format, for zero-copy random access.

Texts go in ascending id order into ranges, one shard each. A shard is an Arrow IPC stream whose record batches all hold
``rows`` sequences (the last one fewer): ``ids``, a fixed-size list of unsigned integers (16 bits if the vocabulary allows),
and ``mask``, a fixed-size list of booleans, false on the padding that ends a shard. As the batches have one size, sequence
i of a mapped shard lies at a computed place: header + i // rows * stride. Beside the shards is an index, a Parquet table of
(id, part, offset, n_tokens) in tokens of the shard, each text closed by the end id.

Tokenizing: a text is cut where the byte-level pre-tokenizer surely cuts (before white space, between letters, digits and
signs, never beside bytes beyond ASCII or after an apostrophe), pieces are hashed in numpy, and the tokenizers library sees
each different piece once a worker; token ids are then gathered by array operations. Texts with white space beyond ASCII or
with what looks like a special token are encoded whole. Other pre-tokenizers than byte-level are encoded whole as well.

A shard is written under a name of its own attempt, then renamed, so that a task that runs again leaves the same file.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstone.llm.common import by_batches, qualified, written
from gridstone.llm.textarrays import blocks, span_hashes

LENGTH, ROWS = 2048, 512
#: Pieces that a worker remembers; about 30 MB.
REMEMBERED = 1 << 21
ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\|")

#: Bytes: 0 space, 1 other ASCII white space, 2 letter, 3 digit, 4 other ASCII, 5 beyond ASCII.
KIND = np.full(256, 4, np.uint8)
KIND[0x20] = 0
KIND[0x09:0x0E] = 1
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 2
KIND[0x30:0x3A] = 3
KIND[0x80:] = 5


def cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether a piece surely starts at each byte."""
    k = KIND[data]
    cut = np.zeros(len(k), bool)
    if not len(k):
        return cut
    prev, cur = k[:-1], k[1:]
    space, was = cur < 2, prev < 2
    word = (prev != cur) & (prev > 1) & (cur > 1) & (prev < 5) & (cur < 5) & (data[:-1] != ord("'"))
    cut[1:] = (~was & space) | ((prev == 1) & ~space) | word
    # the last of a run of white space that a text goes on after is a piece of its own, or begins the next
    last = np.zeros(len(k), bool)
    last[:-1] = (k[:-1] < 2) & (k[1:] > 1)
    ends = offs[1:][offs[1:] > offs[:-1]] - 1
    last[ends] = False
    cut |= last
    cut[offs[:-1][offs[:-1] < len(k)]] = True
    return cut


class PieceEncoder:
    """Token ids of whole texts by way of their different pieces."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and all(t["content"].startswith("<|") for t in spec.get("added_tokens", []))
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.end_id = end_id
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.first, self.n = np.array([self.end_id], self.dtype), np.array([0, 1]), 1

    def _encode(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        words = [p.decode("utf-8", "replace") for p in pieces]
        # pieces without line ends can share one call: a lone line end between them is a token of its own
        plain = [i for i, w in enumerate(words) if not w.isspace() and "\n" not in w and w[0] not in "\t\r\x0b\x0c"]
        found: list[np.ndarray | None] = [None] * len(words)
        if len(self.newline) == 1 and plain:
            for lo in range(0, len(plain), 20_000):
                some = plain[lo:lo + 20_000]
                ids = np.array(self.tokenizer.encode_batch_fast(["\n".join([words[i] for i in some])], add_special_tokens=False)[0].ids, self.dtype)
                parts = np.split(ids, np.flatnonzero(ids == self.newline[0]))
                for j, (i, part) in enumerate(zip(some, parts, strict=True)):
                    found[i] = part[1:] if j else part
        rest = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(rest, self._encode([words[i] for i in rest])):
            found[i] = x
        if self.n + len(found) > REMEMBERED:
            raise MemoryError
        place = self.n + np.arange(len(found))
        self.first = np.append(self.first, self.first[-1] + np.cumsum([len(x) for x in found]))
        self.ids = np.concatenate([self.ids, *found])
        self.n += len(found)
        order = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at = np.insert(self.hashes, order, hashes), np.insert(self.at, order, place)

    def _block(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(cuts(data, offs))
        ends = np.append(starts[1:], len(data))
        hashes, sample, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            pieces = [raw[a:b] for a, b in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist())]
            try:
                self._learn(hashes[new], pieces)
            except MemoryError:
                self._forget()
                pieces = [raw[a:b] for a, b in zip(starts[sample].tolist(), ends[sample].tolist())]
                self._learn(hashes, pieces)
            at = np.searchsorted(self.hashes, hashes)
        piece = self.at[at][inverse] if len(at) else np.zeros(0, np.int64)
        bounds = np.searchsorted(starts, offs[1:])
        piece = np.insert(piece, bounds, 0)  # the end id
        lens = self.first[piece + 1] - self.first[piece]
        total = np.cumsum(lens)
        take = np.repeat(self.first[piece] - (total - lens), lens) + np.arange(total[-1] if len(total) else 0)
        return self.ids[take], np.diff(np.append(0, total[bounds + np.arange(len(bounds))]))

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some texts in order, number of ids of each), the end id included."""
        for lo, hi, data, offs in blocks(texts):
            if self.by_piece and not ODD_SPACE.search(data):
                try:
                    yield self._block(data, offs)
                    continue
                except MemoryError:  # more different pieces than are remembered: text by text
                    self._forget()
            ids = []
            for a, b in zip(offs[:-1], offs[1:]):
                part = data[a:b]
                try:
                    pieces = self._block(part, np.array([0, b - a]))[0] if self.by_piece and not ODD_SPACE.search(part) else None
                except MemoryError:
                    pieces = None
                    self._forget()
                if pieces is not None:
                    ids.append(pieces)
                else:
                    whole = self.tokenizer.encode(part.tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids
                    ids.append(np.append(np.array(whole, self.dtype), np.array([self.end_id], self.dtype)))
            yield np.concatenate(ids), np.array([len(x) for x in ids])


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, end_id: int = 0) -> PieceEncoder:
    """The worker's encoder of a vocabulary; what it has learnt serves later tasks too."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = PieceEncoder(path, end_id)
    return _encoders[path, end_id]


class ShardWriter:
    """Appends token ids to a shard; whole batches are written as they fill."""

    def __init__(self, sink, length: int, rows: int, dtype):
        self.length, self.rows, self.dtype = length, rows, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = 0

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        size = self.length * self.rows
        if self.n >= size:
            flat = np.concatenate(self.held)
            whole = len(flat) // size * size
            for lo in range(0, whole, size):
                self._write(flat[lo:lo + size], size)
            self.held, self.n = [flat[whole:]], len(flat) - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.held)
            pad = -len(flat) % self.length
            self._write(np.append(flat, np.zeros(pad, self.dtype)), len(flat))
        self.out.close()


class Shard:
    """Random access to a shard. A local file is mapped, so that sequences are views of it."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        reader = pa.ipc.MessageReader.open_stream(self.source)
        self.schema = pa.ipc.read_schema(reader.read_next_message())
        self.header = self.source.tell()
        self.length = self.schema.field("ids").type.list_size
        try:
            reader.read_next_message()
        except StopIteration:
            self.stride = self.rows = 0
            return
        self.stride = self.source.tell() - self.header
        self.last: tuple[int, pa.RecordBatch] | None = None
        self.rows = self._batch(0).num_rows

    def _batch(self, k: int) -> pa.RecordBatch:
        if self.last is None or self.last[0] != k:  # texts follow each other, and so do their batches
            self.source.seek(self.header + k * self.stride)
            self.last = k, pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        return self.last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence i."""
        b = self._batch(i // self.rows)
        r = i % self.rows
        return b["ids"].values.to_numpy()[r * self.length:(r + 1) * self.length], b["mask"].values.slice(r * self.length, self.length)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n token ids from a place in the shard on, across sequences."""
        out, size = [], self.rows * self.length
        while n > 0:
            k, at = divmod(start, size)
            part = self._batch(k)["ids"].values.to_numpy()[at:at + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Writes shards to ``path`` (a URI of a shared folder) and returns the index: id, part, offset, n_tokens.

    A null text counts as empty and has the end id only. Rows go by id, then text, null ids first; repeated rows are
    repeated. A text of any length is encoded whole. An empty table gives an empty index and no shard. Other columns are not read. The index is read from its
    table, so the shards are whole once this returns.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = base.repartitionByRange(parts, F.asc_nulls_first(id_col), F.xxhash64("_text")).sortWithinPartitions(F.asc_nulls_first(id_col), F.xxhash64("_text"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("part", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType())])
    root = qualified(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, enc, writer, offset = task.partitionId(), None, None, 0
        fs, folder = pafs.FileSystem.from_uri(root)
        trial = f"{folder}/.part-{part:06d}-{task.taskAttemptId()}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                enc = encoder(vocabulary, end_id)
                fs.create_dir(folder, recursive=True)
                sink = fs.open_output_stream(trial)
                writer = ShardWriter(sink, length, rows, enc.dtype)
            counts = []
            for ids, n in enc.encode(batch.column(1)):
                writer.append(ids)
                counts.append(n)
            counts = np.concatenate(counts)
            starts = offset + np.cumsum(counts) - counts
            offset += int(counts.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(counts), part)), pa.array(starts), pa.array(counts)], schema.names)
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(trial, f"{folder}/{shard_name(part)}")

    return written(by_batches(base, run, schema))


def shard_name(part: int) -> str:
    return f"part-{part:06d}.arrows"


def read_tokens(index: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Each text of an index, from the shards: id, start (ids of all texts before it), n_tokens, ids_crc32 (of 32-bit ids)."""
    spark = index.sparkSession
    root = qualified(spark, path)
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each shard
    before, bases = 0, []
    for r in totals:
        bases.append((r["part"], before))
        before += r["n"]
    bases = spark.createDataFrame(bases, "part long, base long")
    placed = index.join(F.broadcast(bases), "part").select(id_col, (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "part", "offset")
    schema = T.StructType([T.StructField(id_col, index.schema[id_col].dataType), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, Shard] = {}
        for b in batches:
            sums = []
            for part, offset, n in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(2).to_pylist()):
                if part not in shards:
                    shards = {part: Shard(f"{root}/{shard_name(part)}")}
                sums.append(zlib.crc32(shards[part].tokens(offset, n).astype("<u4")))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums, pa.int64())], schema.names)

    return placed.mapInArrow(run, schema)
