"""Joins of sides that grow with the input must not build a table on the driver, however small Spark believes them to be, and
training runs on an executor. Texts go to Python in small batches, and training makes no wide copies."""

import os
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstone.llm import components, simhash, spelling, toxicity


def plans_of(monkeypatch, module, run):
    seen = []

    def recorded(df, *rest):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, *rest)

    written = module.written
    monkeypatch.setattr(module, "written", recorded)
    out = run()
    return seen + [out._jdf.queryExecution().executedPlan().toString()]


def simhashes(spark):
    return simhash.simhash_dedup(spark.createDataFrame([(i, f"one two three w{i}") for i in range(20)], "doc_id long, text string"))


def variants(spark):
    return spelling.spelling_groups(spark.createDataFrame([("window", 9), ("windw", 3), ("wimdow", 3)], "word string, n long"))


def linked(spark):
    return components.components(spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long"))


@pytest.mark.parametrize("module, run", [(simhash, simhashes), (spelling, variants), (components, linked)])
def test_growing_sides_are_not_broadcast(spark, monkeypatch, module, run):
    plans = plans_of(monkeypatch, module, lambda: run(spark))
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastHashJoin" in p]


def test_training_runs_in_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a plain text"), (2, "an idiot"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "train", lambda packed, owner, labels: (np.arange(4.0), float(os.getpid()), float(len(labels) + 10 * labels.sum())))
    weights, process, seen = toxicity.fit(docs, labels)
    assert weights.tolist() == [0, 1, 2, 3] and process != os.getpid() and seen == 23
    assert toxicity.fit(docs, labels.limit(0))[2] == 0


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 800).alias("text")).coalesce(1)
    monkeypatch.setattr(toxicity, "score_texts", lambda texts, model: np.full(len(texts), float(texts.nbytes)))
    found = toxicity.toxicity(docs, None).agg(F.count(F.lit(1)).alias("rows"), F.max("score").alias("most")).first()
    assert found.rows == 3000 and found.most < 3e6


def test_training_makes_no_wide_copies():
    draw = np.random.default_rng(1)
    letters = draw.integers(1, 27, (12_000, 8)).astype(np.uint64)
    packed = sum(letters[:, i] << np.uint64(5 * i) for i in range(8))
    owner = np.repeat(np.arange(400), 30)
    tracemalloc.start()
    try:
        toxicity.train(packed, owner, np.arange(400) % 2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 85e6  # 240 landmarks of 32,768 numbers are 31 MB, and twice that as doubles
