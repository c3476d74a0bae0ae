"""The neighbour forest against brute force, and the queries of cuts and communities on the smallest tables."""

import numpy as np
import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.01"


def brute(x, ids, query, k):
    d = np.sqrt(((x - x[ids == query][0]) ** 2).sum(axis=1))
    order = np.lexsort((ids, d))
    return [(int(ids[i]), d[i]) for i in order if ids[i] != query][:k]


def test_recall_on_the_given_vectors(spark):
    from gridstone.plans import bindings

    e = pq.read_table(f"{SF}/embeddings.parquet").to_pandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    got = {}
    for r in bindings.queries()["knn_forest"](spark, SF).collect():
        got.setdefault(r.query, []).append((r.rank, r.vec_id, r.dist))
    asked = [int(i) for i in ids if i % 100 == 0]
    hits = 0
    for q in asked:
        want = brute(x, ids, q, 10)
        hits += len({v for _, v, _ in got[q]} & {v for v, _ in want})
        assert [r for r, *_ in sorted(got[q])] == list(range(1, 11)) and all(d >= w - 1e-5 for (_, _, d), (_, w) in zip(sorted(got[q]), want))
    assert hits / (10 * len(asked)) >= 0.9


def test_small_leaves_blocks_and_repeated_vectors(spark, monkeypatch):
    from gridstone.operators import projections

    monkeypatch.setattr(projections, "ROWS", 50)
    monkeypatch.setattr(projections, "QUERIES", 7)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(i, 0.3, (80, 6)) for i in range(5)] + [np.full((200, 6), 9.0)])
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)] + [(10_000, None)], "id bigint, f array<double>").repartition(6)
    rows = projections.forest_knn(df, df.where("id % 20 = 0"), 5, "id", "f", trees=10, leaf=120, probes=3).collect()
    hits = total = 0
    for q in range(0, len(x), 20):
        mine, want = sorted((r["rank"], r.id, r.dist) for r in rows if r.query == q), brute(x, ids, q, 5)
        assert len(mine) == 5
        hits, total = hits + sum(d <= want[-1][1] + 1e-9 for *_, d in mine), total + 5
    assert hits / total >= 0.95
    assert projections.forest_knn(df.limit(0), df, 5, "id", "f").count() == 0 and projections.forest_knn(df, df.limit(0), 5, "id", "f").count() == 0


def test_nearest_leaves_hold_the_own_one():
    from gridstone.operators.projections import fit_tree, leaves, nearest_leaves

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    tree = fit_tree(x, 20, rng)
    own, near = leaves(x, tree), nearest_leaves(x, tree, 4)
    assert len(set(own.tolist())) >= 8 and (near == own[:, None]).any(axis=1).all() and all(len(set(r)) == 4 for r in near.tolist())
    assert (np.sort(nearest_leaves(x, tree, 99), axis=1) == np.arange(len(set(own.tolist())))).all()


def test_cut_of_nations(spark):
    from gridstone.plans import bindings, networks
    from tests.test_cuts import cut_value, max_flow

    nodes, edges = networks.trade(spark, SF)
    cap = {r.id: r.cap for r in nodes.collect()}
    arcs = [(r.src, r.dst, r.cap) for r in edges.collect() if r.src in cap and r.dst in cap]
    caps = [cap.get(i, 0.0) for i in range(25)]
    got = bindings.queries()["min_cut_nations"](spark, SF).collect()
    assert len(got) == len(cap) and got[0].flow == pytest.approx(max_flow(25, caps, arcs)) == pytest.approx(cut_value({r.id for r in got if r.source}, caps, arcs))


def test_expansion_and_communities_of_given_tables(spark):
    from gridstone.operators import graph
    from gridstone.plans import bindings, networks

    labels = bindings.queries()["expansion_nations"](spark, SF).collect()
    assert {r.id for r in labels} == set(range(25)) and {r.label for r in labels} <= {"A", "N", "R"}
    nodes, edges = networks.supplier_graph(spark, SF)
    found = bindings.queries()["louvain_suppliers"](spark, SF).cache()
    q = graph.modularity(edges, found).first().q
    assert found.count() == nodes.count() and q > 0
    assert all(c <= i for i, c in found.collect())


def plain_mcd(x, ratio, starts, rng):
    best = None
    for _ in range(starts):
        s = x[rng.choice(len(x), 2 * (x.shape[1] + 1), replace=False)]
        last = np.inf
        while True:
            m, c = s.mean(axis=0), np.cov(s.T, bias=True)
            det = np.linalg.det(c)
            if len(s) > len(x) / 2 and last - det <= 1e-9 * last:
                break
            last = det if len(s) > len(x) / 2 else np.inf
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            s = x[np.argsort(d, kind="stable")[:int(np.ceil(ratio * len(x)))]]
        if best is None or det < best[0]:
            best = det, m, c
    return best


def test_minimum_covariance(spark):
    from gridstone.operators.robust import minimum_covariance

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.multivariate_normal([1e6, 2, 3], [[2, 1, 0], [1, 3, 0.5], [0, 0.5, 1]], 400), rng.normal(0, 0.3, (100, 3)) + [1e6 + 40, 30, -30]])
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "f array<double>").repartition(5)
    mean, cov = minimum_covariance(df, "f", 0.7)
    det, m, c = plain_mcd(x, 0.7, 30, rng)
    assert np.linalg.det(cov) <= det * 1.02 and np.allclose(mean, [1e6, 2, 3], atol=0.3) and np.allclose(cov, c, atol=0.2)
    with pytest.raises(ValueError):
        minimum_covariance(df.limit(3), "f")


def test_distances_of_a_batch_are_mahalanobis_ones():
    import numpy as np
    import pyarrow as pa

    from gridstone.operators import robust

    x = np.random.default_rng(5).normal(size=(20, 3))
    batch = pa.RecordBatch.from_arrays([pa.array(x.tolist())], ["f"])
    assert np.array_equal(robust._matrix(batch), x) and np.array_equal(robust._matrix(batch.slice(4, 5)), x[4:9])
    m, c = x.mean(axis=0), np.cov(x.T)
    want = [(r - m) @ np.linalg.inv(c) @ (r - m) for r in x]
    assert np.allclose(robust._distances(x, [(m, c)])[:, 0], want)
