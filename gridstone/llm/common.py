"""Helpers that several operators share: shared folders, table reads, batches for Python, ASCII case, prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh path under the cluster's shared folder, ``spark.checkpoint.dir``; a temporary one only where none is set."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridstone-"))
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme that Spark's file systems give it; one without a scheme is on the default file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file:///" + whole.removeprefix("file:").lstrip("/") if whole.startswith("file:") else whole


def written(df: DataFrame, tell: bool = False):
    """The rows as a table in the shared folder: lineage ends there, and any executor can read it again. ``tell``: its path, too."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return (table, path) if tell else table


def apart(df: DataFrame) -> DataFrame:
    """For a side of a join that grows with the input: both sides are shuffled and merged, whatever size Spark believes it has.

    Spark takes a written table's compressed size, and what an explode makes of it, for its size in memory, so that a table of far more
    than the broadcast limit would be built on the driver.
    """
    return df.hint("merge")


#: Bytes of a batch of rows for Python, where the session has no limit of its own.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def by_batches(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` for rows with whole texts, in batches of BATCH_BYTES and one row more at most.

    Spark's own limit is 10,000 rows, so a whole partition of texts would be one batch, which the executor and the worker hold in
    several copies outside the Java heap and keep as free memory afterwards. The limit holds for the session from then on.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH, None) is None:
        conf.set(BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of ``written`` that no result depends on any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(col: Column) -> Column:
    """A-Z only; other letters keep their case. Pure ASCII takes the byte-wise path."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


#: Rows of a blocked filter where the length of the list is not told, and at most: 16 MB of broadcast data.
FILTER_BLOCKS, MOST_BLOCKS = 1 << 16, 1 << 20


def _filter_mask(h: Column) -> Column:
    bits, one = F.xxhash64(h, F.lit("bits")), F.lit(1).cast("long")
    at = [F.call_function("shiftleft", one, F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    return at[0].bitwiseOR(at[1]).bitwiseOR(at[2]).bitwiseOR(at[3])


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column has it in any case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def columns(df: DataFrame) -> list[Column]:
    """All columns of a table, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def perhaps_listed(df: DataFrame, column: str, listed: DataFrame, listed_column: str, n: int | None = None, flag: str = "_perhaps") -> DataFrame:
    """``df`` with a boolean column ``flag``: false only if the value of ``column`` is surely not listed.

    A blocked Bloom filter as a broadcast table, of eight values a row for a list of ``n`` values, of MOST_BLOCKS rows at most. A longer
    list lets more rows through, so an exact join must follow; it saves shuffling the rows that can't match. Null values are
    not listed.
    """
    size = FILTER_BLOCKS if n is None else min(MOST_BLOCKS, max(1 << 10, 1 << (max(1, n // 8) - 1).bit_length()))
    at, word = fresh(df.columns, "_block"), fresh(df.columns, "_word")
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
    words = listed.where(F.col(listed_column).isNotNull()).groupBy(block(F.col(listed_column)).alias(at)).agg(F.bit_or(_filter_mask(F.col(listed_column))).alias(word))
    mask = _filter_mask(F.col(column))
    joined = df.join(F.broadcast(words), F.when(F.col(column).isNotNull(), block(F.col(column))) == F.col(at), "left")
    return joined.withColumn(flag, F.coalesce(F.col(word).bitwiseAND(mask) == mask, F.lit(False))).drop(at, word)
