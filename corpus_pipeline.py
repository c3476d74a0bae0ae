"""A corpus pipeline in stages: toxic texts go, near copies go, leaked passages go, sources are mixed, tokens are written.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; run() writes what a stage returns as Parquet in the shared
folder and reads it as the next one's input. All stages but the last return the columns of documents; columns that a stage
needs meanwhile get names that no column has, so names can't clash. Null, empty, very long and repeated texts and empty tables
get what the operators' docstrings say: a null or empty text is neither toxic, nor a copy, nor a leak, and stays.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.llm.common import columns, fresh, perhaps_listed, shared_dir, table, written
from gridstone.llm.decontamination import decontaminate
from gridstone.llm.jaccard_join import jaccard_join
from gridstone.llm.mixing import fit_domains, mix_sources
from gridstone.llm.queries import vocabulary
from gridstone.llm.token_output import read_tokens, write_tokens
from gridstone.llm.toxicity import fit, toxicity

#: Domains and the shares of expected tokens that they are mixed to; every text stays, so shares are met by repeating.
TARGETS = {"de": 0.2, "en": 0.5, "es": 0.12, "fr": 0.18}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not mark. It learns from the labels that op4 learns from."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    score, mark = fresh(docs.columns, "score"), fresh(docs.columns, "predicted")
    return toxicity(docs, model, score_col=score, predicted_col=mark).where(F.col(mark) == 0).select(*columns(docs))


def _without(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text hash are not in ``listed`` (id, th, once); of those listed with once = true, one row of each id and text stays."""
    names = [fresh(docs.columns, n) for n in ("th", "perhaps", "id", "listed_th", "once")]
    th, perhaps, at, listed_th, once = names
    listed = listed.select(F.col("id").alias(at), F.col("th").alias(listed_th), F.col("once").alias(once))
    marked = perhaps_listed(docs.withColumn(th, F.xxhash64("text")), th, listed, listed_th, flag=perhaps)
    met = marked.where(F.col(perhaps)).join(listed.hint("merge"), F.col("doc_id").eqNullSafe(F.col(at)) & (F.col(th) == F.col(listed_th)), "left")
    kept = columns(docs)
    repeated = met.where(F.col(once)).dropDuplicates(["doc_id", th])
    return marked.where(~F.col(perhaps)).select(*kept).unionByName(met.where(F.col(listed_th).isNull()).select(*kept)).unionByName(repeated.select(*kept))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at a similarity of 0.8: the one with the smallest doc_id, of several
    with that id the one with the smallest text hash, of repeated rows any. Null ids count as smaller than others."""
    found = jaccard_join(docs).where("n_shingles > 0").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th"), F.expr("doc_id <=> component_id and text_hash = component_hash").alias("stays"))
    listed = found.groupBy("id", "th").agg(F.first("stays").alias("once"), F.count(F.lit(1)).alias("n")).where("not once or n > 1")
    return _without(docs, written(listed))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no window of a benchmark item."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    return _without(docs, written(found.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th"), F.lit(False).alias("once")).distinct()))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated so often that the expected tokens of the domains meet their shares; each row stays at least once."""
    labels = table(spark, sf_dir, "labels").select("doc_id").join(docs.select("doc_id", F.col("lang").alias("domain")), "doc_id")
    domains = list(TARGETS)
    names = {n: fresh(docs.columns, n) for n in ("n_tokens", "posterior", "rate", "copies", "chance")}
    mixed = mix_sources(docs, fit_domains(docs, labels, domains), list(TARGETS.values()), floor=1.0, names=names, told=(told := {}))
    logging.getLogger(__name__).info("mixing misses a target by %.4f of all tokens", told["miss"])
    copy = fresh(docs.columns, "copy")
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(names["copies"]).cast("int")))).select(*columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids in the shared folder; a row for each text with its place, read back from them."""
    path = shared_dir(spark)
    return read_tokens(write_tokens(docs, path, vocabulary()), path)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix), ("token output", tokens)]

#: SQL can't express the classifiers, so the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
