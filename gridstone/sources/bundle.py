"""Bundles: self-describing records of a tag, attributes and a block of numbers, as rows and as files.

A file is a list of records: a line ``BUNDLE <tag> <number of attributes> <bytes>``, a line ``key<TAB>value`` for each attribute,
then the bytes. Numbers are stored high byte first; bits are packed from the highest. Narrow types clamp what they are
given. A reader splits a directory by file; a writer gives each task a file of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

REPRESENTATIONS = {"bit": None, "byte": ("u1", 0, 255), "short": (">i2", -32768, 32767), "int": (">i4", -2147483648, 2147483647), "float": (">f4", None, None)}
MANDATORY = ("repn", "ncolumns", "nrows", "nbands", "nframes", "length")


def encode(values: np.ndarray, repn: str) -> bytes:
    if repn == "bit":
        return np.packbits(np.asarray(values) != 0).tobytes()
    kind, low, high = REPRESENTATIONS[repn]
    v = np.asarray(values, float)
    return (v if low is None else np.clip(np.rint(v), low, high)).astype(kind).tobytes()


def decode(data: bytes, repn: str, n: int) -> np.ndarray:
    if repn not in REPRESENTATIONS:
        raise ValueError(f"unknown representation {repn!r}")
    if repn == "bit":
        return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(float)
    return np.frombuffer(data, REPRESENTATIONS[repn][0], count=n).astype(float)


def write_records(records: list[tuple[str, dict[str, str], bytes]]) -> bytes:
    out = []
    for tag, attrs, data in records:
        out.append(f"BUNDLE {tag} {len(attrs)} {len(data)}\n".encode())
        out += [f"{k}\t{v}\n".encode() for k, v in attrs.items()]
        out += [data, b"\n"]
    return b"".join(out)


def read_records(raw: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    at = 0
    while at < len(raw):
        end = raw.index(b"\n", at)
        word, tag, n, size = raw[at:end].decode().split(" ")
        if word != "BUNDLE":
            raise ValueError("not a bundle file")
        at, attrs = end + 1, {}
        for _ in range(int(n)):
            end = raw.index(b"\n", at)
            k, _, v = raw[at:end].decode().partition("\t")
            attrs.setdefault(k, v)  # the first one counts
            at = end + 1
        yield tag, attrs, raw[at:at + int(size)]
        at += int(size) + 1


class BundleSource(DataSource):
    """``spark.read.format("bundle").load(path)`` and ``df.write.format("bundle").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return "file string, seq int, tag string, attrs map<string,string>, data binary"

    def reader(self, schema) -> "BundleReader":
        return BundleReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> "BundleWriter":
        return BundleWriter(self.options["path"], overwrite)


class BundleReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        f, p = _place(self.path)
        info = f.get_file_info(p)
        files = [info] if info.is_file else f.get_file_info(fs.FileSelector(p))
        return [InputPartition(x.path) for x in sorted(files, key=lambda x: x.path) if x.is_file and not x.base_name.startswith((".", "_"))]

    def read(self, partition: InputPartition):
        with _place(self.path)[0].open_input_file(partition.value) as file:
            for seq, (tag, attrs, data) in enumerate(read_records(file.read())):
                yield partition.value, seq, tag, attrs, data


def _place(path: str):
    """File system and folder of a path; one without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Name of the file that a task wrote; empty if it had no rows."""

    name: str


class BundleWriter(DataSourceWriter):
    """Tasks write files that readers don't see; the commit shows one file of each task, however often tasks were run."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows) -> WriterCommitMessage:
        f, p = _place(self.path)
        f.create_dir(p, recursive=True)
        raw = write_records([(r["tag"], dict(r["attrs"]), bytes(r["data"])) for r in rows])
        name = uuid.uuid4().hex if raw else ""
        if raw:
            with f.open_output_stream(f"{p}/_{self.job}-{name}") as out:
                out.write(raw)
        return Written(name)

    def commit(self, messages) -> None:
        from pyarrow import fs

        f, p = _place(self.path)
        if self.overwrite:
            for x in f.get_file_info(fs.FileSelector(p, allow_not_found=True)):
                if x.is_file and not x.base_name.startswith((".", "_")):
                    f.delete_file(x.path)
        for m in messages:
            if m is not None and m.name:
                f.move(f"{p}/_{self.job}-{m.name}", f"{p}/{m.name}")
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        """Files of attempts that were not committed go."""
        from pyarrow import fs

        f, p = _place(self.path)
        for x in f.get_file_info(fs.FileSelector(p, allow_not_found=True)):
            if x.base_name.startswith(f"_{self.job}-"):
                f.delete_file(x.path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BundleSource)


def voxels(bundles: DataFrame) -> DataFrame:
    """(file, seq, idx, x, y, z, value) of image bundles; a missing representation is an error, missing extents count 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                attrs = dict(r["attrs"])
                if "repn" not in attrs:
                    raise ValueError(f"{r['file']} {r['seq']}: no representation")
                nx, ny, nz = (int(attrs.get(k, 1)) for k in ("ncolumns", "nrows", "nbands"))
                v = decode(r["data"], attrs["repn"], nx * ny * nz)
                i = np.arange(len(v))
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(v)), pa.array(np.full(len(v), r["seq"], np.int32)), pa.array(i), pa.array((i % nx).astype(np.int32)), pa.array((i // nx % ny).astype(np.int32)), pa.array((i // (nx * ny)).astype(np.int32)), pa.array(v)],
                                                 ["file", "seq", "idx", "x", "y", "z", "value"])

    return bundles.where("tag = 'image'").select("file", "seq", "attrs", "data").mapInArrow(run, "file string, seq int, idx long, x int, y int, z int, value double")


def images(vox: DataFrame, key: str, extent: tuple[int, int, int], repn: str = "float") -> DataFrame:
    """One image bundle for each key of (key, idx, value); absent sites are 0."""
    import pandas as pd

    nx, ny, nz = extent

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros(nx * ny * nz)
        v[pdf["idx"].to_numpy()] = pdf["value"].to_numpy()
        data = encode(v, repn)
        attrs = {"repn": repn, "ncolumns": str(nx), "nrows": str(ny), "nbands": str(nz), "nframes": "1", "length": str(len(data))}
        return pd.DataFrame({"tag": ["image"], "attrs": [attrs], "data": [data]})

    return vox.select(key, "idx", "value").groupBy(key).applyInPandas(run, "tag string, attrs map<string,string>, data binary")


def attribute(attrs: str, key: str):
    """A text attribute, null if absent."""
    return F.try_element_at(F.col(attrs), F.lit(key))


def attribute_number(attrs: str, key: str):
    """The whole number that an attribute starts with, without its sign; 0 if absent."""
    return F.coalesce(F.abs(F.regexp_extract(attribute(attrs, key), r"^\s*([-+]?[0-9]+)", 1).try_cast("bigint")), F.lit(0).cast("bigint"))
