"""Tables that loops keep between their rounds, in the cluster's shared folder ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder; where none is set, a temporary one on a single machine, and an error on a cluster."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if sc.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridstone-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def write(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a table and its path: lineage ends there, any executor can read it again, and Spark knows its size."""
    path = f"{shared_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str | None) -> None:
    """Deletes tables that no result depends on any more."""
    for path in paths:
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Slot:
    """One table that is replaced round by round; the one before goes once the next is written."""

    def __init__(self):
        self.path: str | None = None

    def put(self, df: DataFrame) -> DataFrame:
        table, path = write(df)
        remove(df.sparkSession, self.path)
        self.path = path
        return table

    def clear(self, spark: SparkSession) -> None:
        remove(spark, self.path)
        self.path = None
