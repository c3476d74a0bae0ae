"""Sides that grow with the tables are merged, however small Spark believes them to be."""

import random

import pytest

from gridstone.operators import bricks, graph, mincut, volume
from gridstone.plans import bindings

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_component_rounds_broadcast_nothing_and_leave_one_table(spark, monkeypatch):
    seen = []
    put = graph.Slot.put
    monkeypatch.setattr(graph.Slot, "put", lambda self, df: (seen.append(plan(df)), put(self, df))[1])
    edges = spark.createDataFrame([(k, k + 1) for k in range(30) if k != 12], "src long, dst long")
    got = {r["id"]: r["root"] for r in graph.component_roots(spark.range(32), edges).collect()}
    assert got == {k: 0 if k < 13 else 13 if k < 31 else 31 for k in range(32)}
    assert len(seen) > 3 and not [p for p in seen if "Broadcast" in p]


def test_connected_components_merges_lines(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(graph, "component_labels", lambda nodes, edges: kept.append(edges) or nodes)
    bindings.queries()["connected_components"](spark, DIR)
    assert "SortMergeJoin" in plan(kept[0]) and "Broadcast" not in plan(kept[0])


def counted(df, spark):
    """``df`` whose rows add up in an accumulator each time that they are made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), made


@pytest.mark.parametrize("run", [
    lambda n, e: graph.stationary(n, e, 4).collect(),
    lambda n, e: graph.label_communities(n, e, 2).collect(),
    lambda n, e: mincut.expansion(n.crossJoin(n.sparkSession.createDataFrame([("a", 1.0), ("b", 2.0)], "label string, cost double")), e, n.selectExpr("id", "'a' AS label")),
], ids=["stationary", "label_communities", "expansion"])
def test_edges_are_made_once(spark, run):
    edges, made = counted(spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 3.0), (2, 1, 3.0)], "src long, dst long, weight double"), spark)
    run(spark.range(3), edges)
    assert made.value <= 8  # a checkpoint may make them twice


def test_grid_sums_are_merged(spark):
    from gridstone.plans.volumes import vol

    p = plan(vol(spark, DIR))
    assert "SortMergeJoin" in p and "BroadcastHashJoin" not in p


@pytest.mark.parametrize("half", [1, 2])
def test_patch_distances_of_a_grid_with_holes(spark, half):
    """Boxes are met as arrays, not a row for each of their places; absent sites, null values and pairs beside the grid are as by definition."""
    rng = random.Random(half)
    grid = {(x, y, z): None if rng.random() < 0.2 else float(rng.randint(0, 9)) for x in range(5) for y in range(4) for z in range(30, 35) if rng.random() < 0.7}
    pairs = [tuple(rng.randint(a, b) for a, b in ((-1, 5), (-1, 4), (29, 35)) * 2) for _ in range(150)]
    pairs = [*dict.fromkeys(pairs), (90, 90, 90, 0, 0, 30)]
    want = {}
    for p in pairs:
        met = [(grid[s], grid[t]) for o in bricks.box(half) for s, t in [(tuple(a + b for a, b in zip(p[:3], o)), tuple(a + b for a, b in zip(p[3:], o)))] if s in grid and t in grid]
        if met:
            known = [(a - b) ** 2 for a, b in met if a is not None and b is not None]
            want["k", *p] = round(sum(known) / len(known), 9) if known else None
    df = spark.createDataFrame([("k", *at, v) for at, v in grid.items()], "im string, x int, y int, z int, v double")
    asked = spark.createDataFrame([("k", *p) for p in pairs], "im string, x int, y int, z int, tx int, ty int, tz int")
    got = volume.patch_distance(asked, df, "v", half, ["im"])
    assert "explode(" not in plan(got)
    assert {tuple(r)[:-1]: r["dist"] if r["dist"] is None else round(r["dist"], 9) for r in got.collect()} == want


def test_lines_of_orders_are_merged(spark):
    from gridstone.plans.networks import supplier_graph

    p = plan(supplier_graph(spark, DIR)[1])
    assert "SortMergeJoin" in p and "Broadcast" not in p


def test_noise_meets_sites_without_a_shuffle_by_grid(spark):
    import re

    sites = spark.createDataFrame([(k, x, 0, 0, float(x % 3)) for k in "ab" for x in range(6)], "im string, x int, y int, z int, v double")
    assert not re.search(r"SortMergeJoin \[im#\d+\]", plan(volume.nonlocal_means(sites, "v", 1, 1, keys=["im"])))


def test_a_distance_of_two_grids_leaves_out_the_third(spark, monkeypatch):
    from gridstone.plans import volumes

    made, plain = [], volume.gradients

    def seen(*rest):
        df, n = counted(plain(*rest), spark)
        made.append(n)
        return df

    monkeypatch.setattr(volume, "gradients", seen)
    bindings.queries()["cooccurrence_distance_3d"](spark, DIR).collect()
    assert 0 < made[0].value <= volumes.vol(spark, DIR).where("im in ('A', 'N')").count()
