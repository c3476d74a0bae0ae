"""Text formats: Matrix Market, whitespace pairs, trigger lists, matrices as text. All are plain DataFrame readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(r, c, v) from 0 of a coordinate file: % lines are comments, the size line is left out, indices start from 1.

    The size line is told from entries by its place: the first line that is no comment of the file.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = lines.where("value != '' and not startswith(value, '%')")
    first = lines.groupBy("file").agg(F.min(F.struct("block", "n")).alias("first"))
    parts = F.split("value", r"\s+")
    rows = lines.join(F.broadcast(first), "file").where(F.struct("block", "n") != F.col("first"))
    return rows.select((F.get(parts, F.lit(0)).cast("bigint") - 1).alias("r"), (F.get(parts, F.lit(1)).cast("bigint") - 1).alias("c"), F.coalesce(F.get(parts, F.lit(2)).cast("double"), F.lit(1.0)).alias("v"))


def write_matrix_market(coo: DataFrame, path: str, rows: int, columns: int, least: float = 1e-12) -> None:
    """One file with indices from 1; entries below ``least`` are dropped. The header and the sorted entries are one partition's text."""
    kept = coo.where(F.abs("v") >= least)
    n = kept.count()
    head = coo.sparkSession.createDataFrame([(-2, 0, "%%MatrixMarket matrix coordinate real general"), (-1, 0, f"{rows} {columns} {n}")], "r long, c long, value string")
    body = kept.select("r", "c", F.format_string("%d %d %s", F.col("r") + 1, F.col("c") + 1, F.col("v").cast("string")).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("r", "c").select("value").write.mode("overwrite").text(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(idx, class) of a file of two whole numbers a line, between white space."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) != ''").select(F.get(parts, F.lit(0)).cast("bigint").alias("idx"), F.get(parts, F.lit(1)).cast("bigint").alias("class"))


def read_triggers(spark: SparkSession, path: str) -> DataFrame:
    """(sample, condition); # starts a comment."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    parts = F.split(line, r"\s+")
    return spark.read.text(path).where(line != "").select(F.get(parts, F.lit(0)).cast("bigint").alias("sample"), F.get(parts, F.lit(1)).alias("condition"))


def matrix_lines(hist: DataFrame, columns: int, value: str = "n", delimiter: str = " ") -> DataFrame:
    """(j, line): each row j of (i, j, value) as text, 0 where there is no entry."""
    cells = hist.groupBy("j").agg(F.map_from_entries(F.collect_list(F.struct("i", F.col(value).cast("string")))).alias("m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("0")))
    return cells.select("j", F.array_join(at, delimiter).alias("line"))


def with_subject(df: DataFrame, path: str = "path", length: int = 6) -> DataFrame:
    """Adds ``subject``, the first characters of a file's name: the key that companion files share."""
    return df.withColumn("subject", F.substring(F.element_at(F.split(path, "/"), -1), 1, length))
