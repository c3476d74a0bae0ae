"""Exact nearest neighbours in blocks: small blocks, ties, copies and odd rows against all pairs; no task ranks all pairs."""

import math
import random

import pytest

from gridstone.operators import relate


@pytest.mark.parametrize("kind", ["long", "string"])
def test_blocks_find_the_nearest_of_all(spark, monkeypatch, kind):
    monkeypatch.setattr(relate, "POINT_BLOCK", 7)
    monkeypatch.setattr(relate, "QUERY_BLOCK", 3)
    rng = random.Random(3)
    key = (lambda i: i) if kind == "long" else str
    rows = [(key(i), [float(rng.randrange(3)), float(rng.randrange(3))]) for i in range(40)] + [(key(99), None), (None, [0.0, 0.0]), (key(98), [None, 1.0])]
    points = spark.createDataFrame(rows, f"id {kind}, f array<double>")
    asked = points.where("id in ('3', '8', '11', '20', '33', '99')")
    got = sorted((r["query"], r["rank"], r["id"], r["dist"]) for r in relate.knn(points, asked, 6, "id", "f").collect())
    whole = dict(rows[:40])
    want = []
    for q in map(key, (3, 8, 11, 20, 33)):
        near = sorted((math.dist(whole[q], f), i) for i, f in whole.items() if i != q)[:6]
        want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert got == sorted(want)


def test_only_the_best_of_blocks_are_ranked(spark):
    points = spark.createDataFrame([(i, [float(i)]) for i in range(30)], "id long, f array<double>")
    plan = relate.knn(points, points.where("id < 3"), 2, "id", "f")._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Window [row_number()", 1)[1]
    assert "FlatMapCoGroupsInArrow" in below and "BroadcastNestedLoopJoin" not in below
