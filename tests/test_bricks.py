"""Three-dimensional filters over bricks: several images, holes, large values, faces of bricks, against plain numpy loops."""

from itertools import product

import numpy as np
import pytest

from gridstone.operators import volume

SCHEMA = "im string, x int, y int, z int, v double"


def table(spark, images, holes=()):
    rows = [(im, x, y, z, float(a[x, y, z])) for im, a in images.items() for x, y, z in np.ndindex(a.shape) if (x, y, z) not in holes]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def at(df, name, im="a"):
    return {(r.x, r.y, r.z): r[name] for r in df.where(f"im = '{im}'").collect()}


def near(a, s, half, holes=()):
    """(place, value) of the box around a site."""
    for o in product(range(-half, half + 1), repeat=3):
        t = tuple(i + k for i, k in zip(s, o))
        if all(0 <= i < n for i, n in zip(t, a.shape)) and t not in holes:
            yield t, a[t]


def test_images_do_not_meet(spark):
    two = table(spark, {"a": np.full((3, 3, 3), 100.0), "b": np.full((3, 3, 3), 200.0)})
    for df, name in ((volume.box_stats(two, "v", 1, ["im"]), "mean"), (volume.median(two, "v", keys=["im"]), "median"), (volume.gaussian(two, "v", 1.0, keys=["im"]), "smooth"), (volume.lee(two, "v", 1, 500.0, keys=["im"]), "lee")):
        assert df.count() == 54 and np.allclose(list(at(df, name).values()), 100) and np.allclose(list(at(df, name, "b").values()), 200)
    assert {(r.im, r.noise) for r in volume.noise(two, "v", ["im"]).collect()} == {("a", 0.0), ("b", 0.0)}


def test_holes_and_large_values(spark):
    a = 1e9 + np.random.default_rng(1).integers(0, 2, (4, 4, 4))
    holes = {(1, 1, 1), (1, 2, 1), (0, 0, 3)}
    df = table(spark, {"a": a}, holes)
    stats = volume.box_stats(df, "v", 1, ["im"]).cache()
    n, mean, var, median = at(stats, "n"), at(stats, "mean"), at(stats, "var"), at(volume.median(df, "v", keys=["im"]), "median")
    assert len(n) == 61
    for s in n:
        v = np.array([x for _, x in near(a, s, 1, holes)])
        assert n[s] == len(v) and np.isclose(mean[s], v.mean(), rtol=1e-15) and np.isclose(var[s], v.var(ddof=1), atol=1e-6) and median[s] == np.median(v)


def brute_nlm(a, reach, half, rician):
    inner = [s for s in np.ndindex(a.shape) if all(0 < i < n - 1 for i, n in zip(s, a.shape))]
    s2 = np.mean([(6 * a[s] - sum(a[tuple(np.add(s, o))] for o in product((-1, 0, 1), repeat=3) if sum(map(abs, o)) == 1)) ** 2 for s in inner]) / 42
    box = {s: np.array([v for _, v in near(a, s, half)]) for s in np.ndindex(a.shape)}
    mean, var = {s: b.mean() for s, b in box.items()}, {s: b.var(ddof=1) for s, b in box.items()}
    out = {}
    for s in box:
        total = weight = 0.0
        if mean[s] and var[s]:
            for t, v in near(a, s, reach):
                if mean[t] and var[t] and 0.95 <= mean[s] / mean[t] <= 1 / 0.95 and 0.5 <= var[s] / var[t] <= 2:
                    moved = [(x, tuple(np.add(u, np.subtract(t, s)))) for u, x in near(a, s, half)]
                    d = [(x - a[p]) ** 2 for x, p in moved if all(0 <= i < n for i, n in zip(p, a.shape))]
                    w = np.exp(-np.mean(d) / (2 * s2))
                    total, weight = total + w * (v * v if rician else v), weight + w
        out[s] = a[s] if not weight else np.sqrt(max(0, total / weight - 2 * s2)) if rician else total / weight
    return out


@pytest.mark.parametrize("rician", [False, True])
def test_nonlocal_means_over_faces_of_bricks(spark, rician):
    rng = np.random.default_rng(2)
    a = np.where(np.arange(38)[:, None, None] > 20, 60.0, 20.0) + rng.normal(0, 2, (38, 5, 4))
    a[:3] = 0
    got = at(volume.nonlocal_means(table(spark, {"a": a, "b": a * 0 + 5}), "v", 2, 1, keys=["im"], rician=rician), "denoised")
    want = brute_nlm(a, 2, 1, rician)
    assert got.keys() == want.keys() and all(np.isclose(got[s], want[s], rtol=1e-9, atol=1e-9) for s in want)


def test_gradients_and_angles(spark):
    a = np.random.default_rng(3).integers(0, 9, (35, 4, 4)).astype(float)
    df = table(spark, {"a": a})
    g = volume.gradients(df, "v", ["im"]).cache()
    gx, gxy, lap = at(g, "gx"), at(g, "gxy"), at(g, "laplace")
    assert gx[0, 1, 1] == gxy[34, 1, 1] == lap[5, 0, 1] == 0
    for s in ((1, 1, 1), (31, 2, 2), (32, 1, 2), (33, 2, 1)):
        x, y, z = s
        assert gx[s] == (a[x + 1, y, z] - a[x - 1, y, z]) / 2 and gxy[s] == a[x - 1, y - 1, z] - a[x + 1, y - 1, z] + a[x + 1, y + 1, z] - a[x - 1, y + 1, z]
    found = {(r.kind, r.i, r.j): (r.share, r.pairs) for r in volume.cooccurrence(g, "v", "magnitude", ["gx", "gy", "gz"], {"v": (0.0, 9.0, 3), "magnitude": (0.0, 50.0, 2)}, 4, ["im"]).collect()}
    whole = {n: np.zeros(a.shape) for n in ("gx", "gy", "gz")}
    for r in g.collect():
        for n, b in whole.items():
            b[r.x, r.y, r.z] = r[n]
    angles, pairs = np.zeros(4), 0
    for s in np.ndindex(a.shape):
        for o in product((0, 1), repeat=3):
            t = tuple(np.add(s, o))
            if any(o) and all(i < n for i, n in zip(t, a.shape)):
                angles[min(3, int(np.arccos(np.clip(sum(b[s] * b[t] for b in whole.values()), -1, 1)) * 4 / np.pi))] += 1
                pairs += 1
    assert [found.get(("angle", k, 0), (0, 0))[0] for k in range(4)] == pytest.approx(list(angles / pairs)) and found["angle", 0, 0][1] == pairs
    table_ = volume.cooccurrence(g, "v", "magnitude", ["gx", "gy", "gz"], {"v": (0.0, 9.0, 3), "magnitude": (0.0, 50.0, 2)}, 4, ["im"])
    assert {r.kind: r.entropy for r in volume.cooccurrence_entropy(table_, ["im"]).collect()}["angle"] == pytest.approx(-sum(np.log(x / pairs) for x in angles if x))
    assert volume.cooccurrence_distance(table_, table_, ["im"]).first().dist == 0


def test_masks_empty_tables_and_nulls(spark):
    a = np.arange(27.0).reshape(3, 3, 3)
    df = table(spark, {"a": a}).selectExpr("*", "v % 2 = 0 AS m")
    smooth = at(volume.gaussian(df, "v", 0.5, keys=["im"], mask="m"), "smooth")
    assert smooth[0, 0, 1] == 1.0 and smooth[1, 1, 1] == pytest.approx(13.0)
    assert volume.box_stats(df.limit(0), "v", 1, ["im"]).count() == 0
    odd = spark.createDataFrame([("a", 0, 0, 0, None), ("a", 1, 0, 0, 4.0), ("a", None, 0, 0, 9.0), ("a", -1, 0, 0, 8.0)], SCHEMA)
    assert {(r.x, r.n, r["mean"]) for r in volume.box_stats(odd, "v", 1, ["im"]).collect()} == {(0, 2, 6.0), (1, 1, 4.0), (-1, 1, 8.0)}


def test_draws(spark):
    from gridstone.operators import draws

    df = spark.range(500).selectExpr("id", "id * 2 AS other")
    places = {r.id: r.place for r in draws.permutation(df, "id", 3).collect()}
    assert sorted(places.values()) == list(range(500)) and places == {r.id: r.place for r in draws.permutation(df.repartition(7), "id", 3).collect()}
    assert places != {r.id: r.place for r in draws.permutation(df, "id", 4).collect()} and [places[i] for i in range(500)] != sorted(places.values())
    assert draws.sample(df, "id", 40, 1).count() == 40 and draws.sample(df, "id", 9999, 1).count() == 500
    hits = [r.draws for r in draws.bootstrap(df, "id", 2).collect()]
    assert sum(hits) == 500 and 270 < len(hits) < 360 and draws.bootstrap(df.limit(0), "id", 2).count() == 0


def test_rank_among_cuts(spark):
    from pyspark.sql import functions as F

    from gridstone.operators.ordered import rank_among

    for n in (0, 1, 2, 5, 17, 100):
        cuts = [3 * i for i in range(n)]
        got = spark.range(-4, 3 * n + 4).select("id", rank_among([F.lit(c).cast("long") for c in cuts], F.col("id")).alias("r")).collect()
        assert all(r.r == sum(c <= r.id for c in cuts) for r in got)


def test_samples_rank_only_the_rows_of_small_draws(spark, monkeypatch):
    import hashlib

    from gridstone.operators import draws

    seen, plain = [], draws.running
    monkeypatch.setattr(draws, "running", lambda df, *rest: (seen.append(df.count()), plain(df, *rest))[1])
    drawn = sorted(range(3000), key=lambda i: (int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:15], 16), i))
    got = draws.sample(spark.range(3000), "id", 100, 7)
    assert {r["id"] for r in got.collect()} == set(drawn[:100]) and got.columns == ["id"] and 100 <= seen[-1] < 300
    one = spark.range(300).selectExpr("id", "'k' AS key")  # all or none are under a bound
    assert draws.sample(one, "key", 20, 7).count() == 20 and draws.sample(one, "key", 0, 7).count() == 0
