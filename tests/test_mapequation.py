"""Map equation against its definition on small graphs."""

import math

import numpy as np
import pytest

from gridstone.operators import graph, mapequation

ALPHA = 0.15


def tables(spark, n, edges):
    return spark.range(n).select("id"), spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, weight double")


def walk(n, edges):
    """Chances of each step, and the stationary shares, by numpy."""
    m = np.zeros((n, n))
    for a, b, w in edges:
        m[a, b] += w
    out = m.sum(axis=1)
    step = np.where(out[:, None] > 0, (1 - ALPHA) * m / np.where(out > 0, out, 1)[:, None] + ALPHA / n, 1 / n)
    p = np.full(n, 1 / n)
    for _ in range(500):
        p = p @ step
    return step, p


def length(step, p, label):
    """Code length of a labelling: flows over module borders by their definition, pair by pair."""
    f = lambda v: v * math.log(v) if v > 0 else 0.0
    x = {m: sum(p[a] * step[a, b] for a in range(len(p)) for b in range(len(p)) if label[a] == m != label[b]) for m in set(label)}
    inside = {m: sum(p[a] for a in range(len(p)) if label[a] == m) for m in set(label)}
    return f(sum(x.values())) - 2 * sum(map(f, x.values())) + sum(f(x[m] + inside[m]) for m in x) - sum(map(f, p))


def cliques(sizes, seed=0):
    """Cliques in a ring, joined by one edge each, in both directions."""
    edges, first = [], 0
    starts = np.cumsum([0, *sizes[:-1]])
    for k, (s, size) in enumerate(zip(starts, sizes)):
        edges += [(int(s + a), int(s + b), 1) for a in range(size) for b in range(size) if a != b]
        t = int(starts[(k + 1) % len(sizes)])
        edges += [(int(s + 1), t, 1), (t, int(s + 1), 1)]
    return int(sum(sizes)), edges


def labels_of(df):
    rows = df.collect()
    return {r.id: r.module for r in rows}, rows[0].length if rows else None


def test_cliques_are_modules(spark):
    n, edges = cliques([5, 4, 6])
    got, told = labels_of(mapequation.infomap(*tables(spark, n, edges)))
    assert got == {i: 0 if i < 5 else 5 if i < 9 else 9 for i in range(n)}
    assert told == pytest.approx(length(*walk(n, edges), [got[i] for i in range(n)]), abs=1e-8)


def test_directed_with_dangling_nodes_ends_where_no_move_helps(spark):
    rng = np.random.default_rng(3)
    n = 12
    edges = [(int(a), int(b), int(rng.integers(1, 6))) for a in range(n - 1) for b in range(n) if rng.random() < (0.6 if a // 4 == b // 4 else 0.08)]
    got, told = labels_of(mapequation.infomap(*tables(spark, n, edges)))
    step, p = walk(n, edges)
    label = [got[i] for i in range(n)]
    assert told == pytest.approx(length(step, p, label), abs=1e-8)
    for i in range(n):
        for m in set(label) - {label[i]}:
            assert length(step, p, label[:i] + [m] + label[i + 1:]) > told - 1e-9
    assert told <= min(length(step, p, list(range(n))), length(step, p, [0] * n)) + 1e-9


def test_gains_are_exact(spark):
    n, edges = cliques([3, 4])
    edges.append((0, 5, 3))
    nodes, links = tables(spark, n, edges)
    base, flows = mapequation.flow(nodes, links)
    step, p = walk(n, edges)
    assert np.allclose([r.p for r in base.orderBy("id").collect()], p, atol=1e-9)
    label = [0, 0, 1, 1, 1, 5, 5]
    labels = spark.createDataFrame(list(enumerate(label)), "id long, c long")
    modules = mapequation._modules(base, flows, labels, ALPHA)
    now = length(step, p, label)
    assert mapequation.code_length(base, flows, labels) == pytest.approx(now, abs=1e-8)
    moves = mapequation._moves(base, flows, labels, modules, mapequation._length(modules)[1], ALPHA).collect()
    assert moves
    for r in moves:
        moved = label[: r.id] + [r.to] + label[r.id + 1:]
        assert r.gain == pytest.approx(now - length(step, p, moved), abs=1e-8)


def test_odd_graphs(spark):
    nodes, edges = tables(spark, 3, [(0, 1, 0), (7, 1, 2)])
    got, _ = labels_of(mapequation.infomap(nodes, edges))
    assert set(got) == {0, 1, 2}
    assert mapequation.infomap(nodes.limit(0), edges).count() == 0
    with pytest.raises(ValueError):
        mapequation.infomap(*tables(spark, 2, [(0, 1, -1)]))


def test_walk_ends_at_tolerance(spark):
    n, edges = cliques([4, 4])
    nodes, links = tables(spark, n, edges)
    a, b = (graph.stationary(nodes, links, k, tol=t).orderBy("id").collect() for k, t in ((200, 1e-8), (60, 0.0)))
    assert np.allclose([r.p for r in a], [r.p for r in b], atol=1e-7)
