"""Minimum cuts, expansion and swap moves, and communities, against brute force and plain algorithms."""

from collections import deque
from itertools import combinations, product

import numpy as np
import pytest


def max_flow(n, caps, arcs):
    """Shortest augmenting paths; caps: from the source where positive, to the sink where negative."""
    r = {}
    for u, v, c in [*arcs, *[(n, i, c) if c > 0 else (i, n + 1, -c) for i, c in enumerate(caps) if c]]:
        r[u, v] = r.get((u, v), 0) + c
        r.setdefault((v, u), 0)
    beside = {}
    for u, v in r:
        beside.setdefault(u, []).append(v)
    total = 0
    while True:
        last, todo = {n: None}, deque([n])
        while todo and n + 1 not in last:
            u = todo.popleft()
            for v in beside.get(u, []):
                if v not in last and r[u, v] > 1e-12:
                    last[v] = u
                    todo.append(v)
        if n + 1 not in last:
            return total
        way, v = [], n + 1
        while last[v] is not None:
            way.append((last[v], v))
            v = last[v]
        f = min(r[a] for a in way)
        total += f
        for u, v in way:
            r[u, v] -= f
            r[v, u] += f


def cut_value(source, caps, arcs):
    return sum(c for i, c in enumerate(caps) if c > 0 and i not in source) + sum(-c for i, c in enumerate(caps) if c < 0 and i in source) + sum(c for u, v, c in arcs if u in source and v not in source)


@pytest.mark.parametrize("seed", [0, 1])
def test_min_cut(spark, seed):
    from gridstone.operators.mincut import min_cut

    rng = np.random.default_rng(seed)
    n = 14
    caps = [float(c) for c in rng.integers(-9, 10, n)]
    arcs = [(int(u), int(v), float(rng.integers(1, 6))) for u, v in rng.integers(0, n, (40, 2)) if u != v] if seed else [(i, i + 1, 3.0) for i in range(n - 1)]
    nodes, edges = spark.createDataFrame(list(enumerate(caps)), "id bigint, cap double"), spark.createDataFrame([*arcs, (3, 3, 9.0), (99, 1, 5.0)], "src bigint, dst bigint, cap double")
    side, flow = min_cut(nodes, edges)
    source = {r.id for r in side.collect() if r.source}
    assert np.isclose(flow, max_flow(n, caps, arcs)) and np.isclose(flow, cut_value(source, caps, arcs))


def test_expansion_and_swaps(spark):
    from gridstone.operators import mincut

    rng = np.random.default_rng(4)
    n, k = 7, 3
    cost = rng.integers(0, 10, (n, k)).astype(float)
    pairs = [(i, j, float(rng.integers(1, 4))) for i, j in combinations(range(n), 2) if rng.random() < 0.5]
    unary = spark.createDataFrame([(i, a, float(cost[i, a])) for i in range(n) for a in range(k)], "id bigint, label int, cost double")
    edges, start = spark.createDataFrame(pairs, "src bigint, dst bigint, weight double"), spark.createDataFrame([(i, 0) for i in range(n)], "id bigint, label int")
    total = lambda f: sum(cost[i, a] for i, a in enumerate(f)) + sum(w for i, j, w in pairs if f[i] != f[j])
    for moves, reach in ((mincut.expansion, lambda f: ([a if x else f[i] for i, x in enumerate(xs)] for a in range(k) for xs in product((0, 1), repeat=n))),
                         (mincut.swaps, lambda f: ([(a if x else b) if f[i] in (a, b) else f[i] for i, x in enumerate(xs)] for a, b in combinations(range(k), 2) for xs in product((0, 1), repeat=n)))):
        labels, energy = moves(unary, edges, start)
        f = [r.label for r in labels.orderBy("id").collect()]
        assert np.isclose(total(f), energy) and energy <= min(map(total, reach(f))) + 1e-6
        assert energy <= 2 * min(map(total, product(range(k), repeat=n)))


def quality(weights, label):
    w = np.array(weights)
    d, total, label = w.sum(axis=1), w.sum(), np.array(label)
    return sum(w[np.ix_(label == c, label == c)].sum() / total - (d[label == c].sum() / total) ** 2 for c in set(label.tolist()))


def test_louvain(spark):
    from gridstone.operators import graph
    from gridstone.operators.communities import louvain

    rng = np.random.default_rng(5)
    n, w = 36, np.zeros((36, 36))
    for i, j in combinations(range(n), 2):
        if rng.random() < (0.8 if i // 9 == j // 9 else 0.06):
            w[i, j] = w[j, i] = 1 + (i + j) % 3
    w[7, 7] = 2.0
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i, j in np.ndindex(w.shape) if w[i, j]], "src bigint, dst bigint, weight double")
    nodes = spark.range(n + 2).select("id")  # two without edges
    found = {r.id: r.community for r in louvain(nodes, edges).collect()}
    assert [found[i] for i in range(n)] == [9 * (i // 9) for i in range(n)] and (found[n], found[n + 1]) == (n, n + 1)
    label = [found[i] for i in range(n)]
    q = graph.modularity(edges, spark.createDataFrame(list(found.items()), "id bigint, community bigint")).first().q
    assert np.isclose(q, quality(w, label))
    assert all(quality(w, [c if k == i else x for k, x in enumerate(label)]) <= q + 1e-6 for i in range(n) for c in set(label))
    assert {tuple(r) for r in louvain(nodes.limit(3), edges.limit(0)).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_louvain_of_a_full_graph(spark):
    """Unlike weights between all pairs: groups come from weights alone; several tries keep the best."""
    from gridstone.operators.communities import louvain

    w = np.full((12, 12), 1.0) + 4.0 * (np.arange(12)[:, None] % 2 == np.arange(12) % 2)
    np.fill_diagonal(w, 0)
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i, j in np.ndindex(w.shape) if i != j], "src bigint, dst bigint, weight double")
    assert {r.id: r.community for r in louvain(spark.range(12), edges, tries=2).collect()} == {i: i % 2 for i in range(12)}


@pytest.mark.parametrize("held", [1 << 16, 30, 0])
def test_louvain_takes_few_jobs_on_even_weights(spark, monkeypatch, held):
    """No job a round where a task holds the level; in rounds, or in rounds until it does, it ends at a local optimum, too."""
    from gridstone.operators import communities

    monkeypatch.setattr(communities, "HELD_NODES", held)
    rng = np.random.default_rng(8)
    n = 60 if held > 60 else 36
    w = np.triu(rng.integers(1, 4, (n, n)) * (rng.random((n, n)) < 0.7), 1).astype(float)
    w += w.T
    w[3, 3] = 2.0
    name = lambda i: 7 * i - 100
    edges = spark.createDataFrame([(name(i), name(j), float(w[i, j])) for i, j in np.ndindex(w.shape) if w[i, j]], "src bigint, dst bigint, weight double").repartition(3)
    spark.sparkContext.setJobGroup(f"louvain {held}", "")
    found = {r.id: r.community for r in communities.louvain(spark.range(n).selectExpr("7 * id - 100 AS id"), edges).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"louvain {held}"))
    spark.sparkContext.setJobGroup("", "")
    label = [found[name(i)] for i in range(n)]
    assert all(found[c] == c and c <= i for i, c in found.items()) and quality(w, label) > 0.03
    if held > n:
        assert jobs < 40
        assert all(quality(w, [c if k == i else x for k, x in enumerate(label)]) <= quality(w, label) + 0.01 for i in range(n) for c in set(label))


def test_sweeps_gain_what_modularity_gains():
    from gridstone.operators.communities import _by_source, _sweeps

    rng = np.random.default_rng(2)
    w = np.triu(rng.random((40, 40)) * (rng.random((40, 40)) < 0.3))
    w[np.arange(40), np.arange(40)] += 0.1
    src, dst = (x.astype(np.int32) for x in np.nonzero(w))
    starts, ends, weights = _by_source(src, dst, w[src, dst], 40)
    both = w + np.triu(w, 1).T
    assert all((both[i, ends[a:b]] == weights[a:b]).all() and b - a == (both[i] > 0).sum() for i, (a, b) in enumerate(zip(starts, starts[1:])))
    c, gain = _sweeps(starts, ends, weights, both.sum(), 1e-6, rng.permutation(40))
    assert gain > 0.1 and np.isclose(quality(both, c) - quality(both, range(40)), gain)
    assert all(quality(both, [to if k == i else x for k, x in enumerate(c)]) <= quality(both, c) + 1e-6 for i in range(40) for to in set(c.tolist()))


@pytest.mark.parametrize(("rows", "columns"), [(5, 5), (3, 6), (6, 3)])
def test_auction(spark, rows, columns):
    from itertools import permutations

    from gridstone.operators.assignment import auction

    v = np.random.default_rng(rows).integers(-20, 20, (rows, columns)).astype(float)
    got = auction(spark.createDataFrame([(i, j, float(v[i, j])) for i, j in np.ndindex(v.shape)] + [(0, 0, -99.0), (None, 1, 5.0)], "r bigint, c bigint, v double")).collect()
    small = v if rows <= columns else v.T
    best = max(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(small.shape[1]), len(small)))
    assert sum(r.v for r in got) == best and all(v[r.r, r.c] == r.v for r in got)
    assert len(got) == min(rows, columns) == len({r.r for r in got}) == len({r.c for r in got})


def test_auction_without_an_assignment(spark):
    from gridstone.operators.assignment import auction

    with pytest.raises(ValueError):
        auction(spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (2, 0, 2.0), (2, 1, 1.0), (2, 2, 1.0)], "r bigint, c bigint, v double"))
    assert auction(spark.createDataFrame([], "r bigint, c bigint, v double")).count() == 0
