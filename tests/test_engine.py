"""Queries against their SQL on the smallest tables, and hand-worked values of single operators."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from gridstone.operators import elementwise, geometry, graph, histograms, reductions, sequence
from gridstone.plans import bindings

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    show = lambda v: None if v is None else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((repr([show(r[c]) for c in columns]) for r in rows))


@pytest.mark.parametrize("name", sorted(bindings.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = bindings.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(bindings.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert plain([r.asDict() for r in got.collect()], columns) == plain([dict(zip(names, r)) for r in want.fetchall()], columns)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_elementwise_values(spark):
    df = spark.createDataFrame([(2.0, 0.5)], "lp double, lt double")
    a, b = df.select(elementwise.fa_axisymmetric(F.col("lp"), F.col("lt")), elementwise.fa_script(F.col("lp"), F.col("lt"))).first()
    assert math.isclose(a, math.sqrt(0.5), rel_tol=1e-9) and math.isclose(b, math.sqrt(1.8), rel_tol=1e-9)
    v = spark.createDataFrame([(float(i),) for i in range(4)], "v double")
    assert [r[0] for r in v.select(elementwise.binarize(F.col("v"), 1, 3)).collect()] == [False, True, True, False]
    assert [r.p for r in histograms.histogram_round(v, "v", 4).collect()] == [0.25] * 4


def test_quantile_picks(spark):
    v = spark.createDataFrame([(float(i),) for i in range(1, 9)], "v double")
    assert [r.value for r in reductions.order_quantiles(v, "v").orderBy("q").collect()] == [1, 1, 3, 5, 7, 8, 8]


def test_moving_average(spark):
    s = spark.createDataFrame([(0, i, float(i + 1)) for i in range(4)], "c int, t int, v double")
    for length in (2, 3):
        got = [r.ma for r in sequence.moving_average(s, "c", "t", "v", length).orderBy("t").collect()]
        assert np.allclose(got, [4 / 3, 2, 3, 11 / 3])


def test_noise(spark):
    g = spark.createDataFrame([(x, y, z, float((x, y, z) == (1, 1, 1))) for x in range(3) for y in range(3) for z in range(3)], "x int, y int, z int, v double")
    assert math.isclose(geometry.noise_variance(g, ["x", "y", "z"], "v").first().noise, 36 / 42)


def test_graph_values(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id long")
    e = spark.createDataFrame([(0, 1), (3, 4)], "src long, dst long")
    assert [r.label for r in graph.component_labels(nodes, e).orderBy("id").collect()] == [1, 1, 2, 3, 3]
    w = spark.createDataFrame([(0, 1, 3.0), (1, 2, 2.0), (0, 2, 1.0)], "src long, dst long, weight double")
    assert sorted(tuple(r)[:2] for r in graph.max_spanning_forest(nodes.where("id < 3"), w).collect()) == [(0, 1), (1, 2)]
    joint = spark.createDataFrame([("a", "x", 5), ("b", "y", 5)], "a string, b string, n long")
    assert math.isclose(histograms.nmi(joint).first().nmi, 1.0)
    m = spark.createDataFrame([(r, c, 1.0) for r in (0, 1) for c in (0, 1)], "r long, c long, v double")
    assert {r.v for r in graph.sinkhorn(m, 3).collect()} == {0.5}


def test_conjugate_gradient(spark):
    from gridstone.operators.algebra import conjugate_gradient

    a = np.array([[4.0, 1, 0], [1, 3, 1], [0, 1, 5]])
    coo = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(3) for j in range(3) if a[i, j]], "r long, c long, v double")
    x = conjugate_gradient(coo, spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "i long, v double"), most=6)
    assert np.allclose([r.v for r in x.orderBy("i").collect()], np.linalg.solve(a, [1, 2, 3]))


def test_matrix_market_round_trip(spark, tmp_path):
    from gridstone.sources.text import read_matrix_market, read_pairs, read_triggers, write_matrix_market

    rows = [(0, 0, 1.5), (2, 1, -3.0), (1, 2, 1e-14)]
    write_matrix_market(spark.createDataFrame(rows, "r long, c long, v double"), f"{tmp_path}/m", 3, 3)
    assert sorted(tuple(r) for r in read_matrix_market(spark, f"{tmp_path}/m").collect()) == [(0, 0, 1.5), (2, 1, -3.0)]
    (tmp_path / "pairs").write_text("3 1\n 5   2\n\n")
    assert sorted(tuple(r) for r in read_pairs(spark, f"{tmp_path}/pairs").collect()) == [(3, 1), (5, 2)]
    (tmp_path / "trig").write_text("# all\n100 go\n250 stop # end\n")
    assert sorted(tuple(r) for r in read_triggers(spark, f"{tmp_path}/trig").collect()) == [(100, "go"), (250, "stop")]


@pytest.mark.parametrize("repn", ["bit", "byte", "short", "int", "float"])
def test_bundle_round_trip(spark, tmp_path, repn):
    from gridstone.sources import bundle

    bundle.register(spark)
    vox = spark.createDataFrame([(k, i, float(i % 2 if repn == "bit" else 300 * i)) for k in (1, 2) for i in range(12)], "k int, idx long, value double")
    bundle.images(vox, "k", (3, 2, 2), repn).write.format("bundle").mode("append").save(f"{tmp_path}/b")
    assert any(not f.startswith(".") for f in os.listdir(tmp_path / "b"))
    back = bundle.voxels(spark.read.format("bundle").load(f"{tmp_path}/b")).collect()
    want = [min(300 * i, 255) if repn == "byte" else i % 2 if repn == "bit" else 300 * i for i in range(12)]
    assert sorted(r.value for r in back) == sorted(float(x) for x in want * 2)
    assert {(r.x, r.y, r.z) for r in back if r.idx == 10} == {(1, 1, 1)}


def test_special_functions(spark):
    from gridstone.functions import special

    assert np.allclose(special.gamma_p(2.0, np.array([0.5, 2.0, 6.0])), [0.0902040104, 0.5939941503, 0.9826487347])
    assert np.allclose(special.digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649, -1.9635100260, 2.2517525890])
    assert np.allclose(special.beta_i(2.0, 3.0, np.array([0.2, 0.5, 0.9])), [0.1808, 0.6875, 0.9963])
    assert np.allclose(special.student_cdf(np.array([0.0, 1.0]), 1.0), [0.5, 0.75])
    x, w = special.clenshaw_curtis(8)
    assert math.isclose(sum(b * a ** 4 for a, b in zip(x, w)), 2 / 5, rel_tol=1e-12)
    df = spark.createDataFrame([(0.0,), (1.96,)], "x double")
    assert np.allclose([r[0] for r in df.select(special.normal_cdf(F.col("x"))).collect()], [0.5, 0.9750021])


def test_streams(spark, tmp_path):
    from gridstone.streaming.incremental import stream_hist2d, stream_iir

    rows = spark.createDataFrame([(c, t, float(t)) for c in (0, 1) for t in range(6)], "c int, t int, v double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = stream_hist2d(stream, F.col("c"), F.col("t") % 2).writeStream.outputMode("complete").format("memory").queryName("hist_test").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM hist_test").first()[0] == 12
    q = stream_iir(stream, "c", "t", "v", 0.5, 0.5).writeStream.outputMode("append").format("memory").queryName("iir_test").start()
    q.processAllAvailable()
    q.stop()
    y = 0.0
    for t in range(6):
        y = 0.5 * t + 0.5 * y
    assert math.isclose(spark.sql("SELECT filtered FROM iir_test WHERE c = 1 AND t = 5").first()[0], y)


def test_flip_codes(spark):
    signs = {0: "+++", 1: "-++", 2: "+-+", 3: "++-", 4: "--+", 5: "-+-", 6: "+--"}
    for code, want in signs.items():
        got = elementwise.flip_gradient(F.lit(1.0), F.lit(2.0), F.lit(3.0), code)
        assert "".join("-" if "negative" in str(c) else "+" for c in got) == want


def test_kernel_widths_and_sums():
    assert [len(sequence.gaussian_taps(s)) for s in (0.3, 0.5, 1.0, 1.5, 2.0)] == [3, 3, 7, 9, 13]
    assert all(abs(sum(sequence.gaussian_taps(1.5, k)) - 1) < 1e-12 for k in (0, 2))
    assert abs(sum(-k * x for k, x in zip(range(-4, 5), sequence.gaussian_taps(1.5, 1))) - 1) < 1e-12


def test_sequence_rules(spark):
    flat = spark.createDataFrame([("a", i, 5.0) for i in range(9)] + [("b", i, float(i % 3)) for i in range(9)], "s string, t int, v double")
    acf = {(r.s, r.lag): r.acf for r in sequence.autocorrelation(flat, "s", "t", "v", 3).collect()}
    assert [acf["a", k] for k in range(3)] == [1.0, 1.0, 1.0]
    c = [i % 3 - 1 for i in range(9)]  # by the definition: sums over t < n - m
    sums = [sum(c[t] * c[t + k] for t in range(6)) for k in range(3)]
    assert np.allclose([acf["b", k] for k in range(3)], [x / sums[0] for x in sums])
    lee = {r.t: r.x for r in sequence.lee_filter(flat.where("s = 'b'"), ["s"], "t", "v", 1, 1.0, "x").collect()}
    assert lee[0] == 0.0 and lee[4] == 1.0  # a difference of just 1 is not under 1
    epochs = {r.offset: r["mean"] for r in sequence.epoch_average(flat.where("s = 'b'"), "s", "t", "v", flat.t == 4, 1, 1).collect()}
    assert epochs == {-1: -1.0, 0: 0.0, 1: 1.0}


def test_class_of_a_value(spark):
    from gridstone.operators import learning

    theta = spark.createDataFrame([(0, 1.0, 1.0), (1, 5.0, 16.0), (2, 9.0, 1.0)], "class int, mu double, var double")
    rows = [(-3.0,), (1.0,), (2.0,), (2.0,), (3.0,), (7.0,), (8.0,), (9.0,), (50.0,)]
    got = [(r.v, r["class"]) for r in learning.find_class(spark.createDataFrame(rows, "v double"), theta, "v").collect()]
    assert sorted(got) == [(-3.0, 0), (1.0, 0), (2.0, 1), (2.0, 1), (3.0, 1), (7.0, 1), (8.0, 1), (9.0, 2), (50.0, 2)]


def brute_parts(weights, parts):
    out, s, p, cut = [], 0.0, 0, sum(weights) / parts
    for w in weights:
        out.append(min(p, parts - 1))
        s += w
        p += s > (p + 1) * cut
    return out


@pytest.mark.parametrize(("weights", "parts"), [([1.0] * 4, 2), ([1.0] * 10, 3), ([9.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0], 4), ([0.0, 0.0, 5.0, 0.0, 1.0], 3), ([2.0], 3)])
def test_linear_partition_values(spark, weights, parts):
    nodes = spark.createDataFrame([(10 * i, w) for i, w in enumerate(weights)], "id bigint, weight double").repartition(3)
    assert [r.part for r in graph.linear_partition(nodes, parts).orderBy("id").collect()] == brute_parts(weights, parts)


def test_running_values_without_exchange_reuse(spark):
    from gridstone.operators.ordered import running

    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = graph.compact(spark.range(0, 60_000, 3).select("id")).agg(F.countDistinct("new").alias("n"), F.max("new").alias("top"), F.sum((F.col("id") == F.col("new") * 3).cast("int")).alias("right")).first()
        assert (got.n, got.top, got.right) == (20_000, 19_999, 20_000)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    rng = np.random.default_rng(3)
    rows = [(int(k), i, float(x)) for i, (k, x) in enumerate(zip(rng.integers(0, 40, 500), rng.normal(size=500)))]
    df = spark.createDataFrame(rows, "k int, i int, x double")
    order = sorted(rows)
    up = {r.i: (r.s, r.m) for r in running(df, ["k", "i"], {"s": F.col("x")}, {"m": F.col("x")}).collect()}
    down = {r.i: r.m for r in running(df, ["k", "i"], least={"m": F.col("x")}, ascending=False).collect()}
    for n, (_, i, _) in enumerate(order):
        assert np.isclose(up[i][0], sum(x for *_, x in order[:n + 1])) and up[i][1] == min(x for *_, x in order[:n + 1]) and down[i] == min(x for *_, x in order[n:])
    assert running(df.where("k > 99"), ["k"], {"s": F.col("x")}).count() == 0


def grid(spark, values):
    """Rows of a small array indexed [z][y][x]."""
    a = np.asarray(values, float)
    return spark.createDataFrame([(x, y, z, float(a[z, y, x])) for z in range(a.shape[0]) for y in range(a.shape[1]) for x in range(a.shape[2])], "x int, y int, z int, v double")


def test_volume_values(spark):
    from gridstone.operators import volume

    at = lambda df, name: {(r.z, r.y, r.x): r[name] for r in df.collect()}
    a = np.arange(27.0).reshape(3, 3, 3) ** 1.5
    df = grid(spark, a)
    boxes = at(volume.box_stats(df, "v", 1), "mean")
    assert np.isclose(boxes[0, 0, 0], a[:2, :2, :2].mean()) and np.isclose(boxes[1, 1, 1], a.mean())
    assert np.isclose(at(volume.box_stats(df, "v", 1), "var")[0, 1, 2], a[:2, :, 1:].var(ddof=1))
    assert np.allclose(list(at(volume.gaussian(grid(spark, np.full((3, 4, 5), 7.0)), "v", 1.0), "smooth").values()), 7.0)
    sub = at(volume.subimage(df, "v"), "sub")
    assert sub[0, 0, 0] == sub[1, 1, 0] == [0.0] * 27 and sub[1, 1, 1] == a.ravel().tolist()
    flat = volume.nonlocal_means(grid(spark, np.full((3, 3, 3), 4.0)), "v", 1, 1, 1.0)
    assert set(at(flat, "denoised").values()) == {4.0}
    same = volume.rescale(df, "v", (3, 3, 3), (3, 3, 3))
    assert np.allclose([at(same, "v")[z, y, x] - a[z, y, x] for z in range(3) for y in range(3) for x in range(3)], 0)
    half = at(volume.rescale(grid(spark, np.arange(8.0).reshape(1, 1, 8)), "v", (8, 1, 1), (4, 1, 1)), "v")
    assert [half[0, 0, x] for x in range(4)] == [0.0, 2.0, 4.0, 6.0]


@pytest.mark.parametrize(("sites", "c26", "c6"), [([(0, 0, 0)], 1, 1), ([(0, 0, 0), (1, 1, 1)], 1, 2), ([(0, 0, 0), (5, 5, 5)], 2, 2), ([(x, y, z) for x in range(3) for y in range(3) for z in range(3)], 1, 1),
                                                  ([(x, y, z) for x in range(3) for y in range(3) for z in range(3) if (x, y, z) != (1, 1, 1)], 2, 2), ([(x, y, 0) for x in range(3) for y in range(3) if (x, y) != (1, 1)], 0, 0)])
def test_euler_values(spark, sites, c26, c6):
    from gridstone.operators import volume

    row = volume.euler(spark.createDataFrame(sites, "x int, y int, z int")).first()
    assert (row.c26, row.c6) == (c26, c6)


def test_bundle_commit(spark, tmp_path):
    from gridstone.sources import bundle

    bundle.register(spark)
    rows = spark.createDataFrame([("a", {"k": "1"}, bytearray(b"x")), ("b", {"k": "2"}, bytearray(b"yy"))], "tag string, attrs map<string,string>, data binary")
    path = str(tmp_path / "b")
    rows.write.format("bundle").mode("append").save(path)
    rows.write.format("bundle").mode("append").save(path)
    assert spark.read.format("bundle").load(path).count() == 4
    rows.limit(1).write.format("bundle").mode("overwrite").save(path)
    assert spark.read.format("bundle").load(path).count() == 1 and not [x for x in os.listdir(path) if x.startswith("_")]
    late = bundle.BundleWriter(path, False)
    lost, kept = (late.write(iter([{"tag": "c", "attrs": {}, "data": b"z"}])) for _ in range(2))  # a task that ran twice
    late.commit([kept])
    assert spark.read.format("bundle").load(path).count() == 2 and lost.name not in os.listdir(path) and len(os.listdir(path)) == 2


def test_variational_mixture(spark):
    from gridstone.operators import mixture

    rng = np.random.default_rng(4)
    centres = np.array([[0.0, 0.0, 0.0], [6.0, 0.0, 0.0], [0.0, 7.0, 3.0]])
    label = rng.integers(0, 3, 900)
    x = centres[label] + rng.normal(size=(900, 3)) * [1.0, 0.5, 0.8]
    df = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(label, x))] + [(9000, 0, None)], "id int, label int, f array<double>").repartition(3)
    model = mixture.variational_mixture(df, "f", [[1.0, 1.0, 0.0], [5.0, 0.0, 1.0], [0.0, 6.0, 2.0], [40.0, 40.0, 40.0]])
    assert len(model.alpha) == 3 and np.allclose(sorted(model.mean.tolist()), sorted(centres.tolist()), atol=0.2)  # the far class is removed
    out = mixture.classify(df, "f", model).toPandas()
    assert out[out.id == 9000].cluster.tolist() == [-1]
    seen = out[out.id < 9000]
    names = {k: g.cluster.mode()[0] for k, g in seen.groupby("label")}
    assert len(set(names.values())) == 3 and (seen.label.map(names) == seen.cluster).mean() > 0.98
    # a round by the definition, point by point: the fitted parameters are its fixpoint
    r = model.responsibilities(x)[0]
    n_k, mean = r.sum(axis=0), (r.T @ x) / r.sum(axis=0)[:, None]
    m = (x.mean(axis=0) + n_k[:, None] * mean) / (1 + n_k[:, None])
    scale = np.eye(3) * 3
    for k in range(3):
        w = scale + sum(r[i, k] * np.outer(x[i] - mean[k], x[i] - mean[k]) for i in range(900)) + n_k[k] / (1 + n_k[k]) * np.outer(mean[k] - x.mean(axis=0), mean[k] - x.mean(axis=0))
        assert np.allclose(w, model.scale[k], rtol=1e-3) and np.allclose(m[k], model.mean[k], atol=1e-3)
    ranked = {r["label"]: r["rank"] for r in mixture.rank_classes(df.where("f is not null").selectExpr("label", "f[1] as v"), "label", "v").collect()}
    assert ranked[2] == 2 and sorted(ranked.values()) == [0, 1, 2]


def test_tensor_values(spark):
    from gridstone.operators import tensor

    rng = np.random.default_rng(2)
    directions = [(*(v / np.linalg.norm(v)).tolist(), 1.0) for v in rng.normal(size=(12, 3))]
    d = np.array([[1.7, 0.2, 0.1], [0.2, 0.4, -0.1], [0.1, -0.1, 0.3]])
    signals = [float(80 * np.exp(-np.array(g[:3]) @ d @ np.array(g[:3]))) for g in directions]
    names = [f"s{i}" for i in range(12)]
    rows = spark.createDataFrame([(80.0, *signals), (0.0, *signals)], ["b0", *names])
    out = tensor.anisotropy(tensor.fit(rows, names, "b0", directions)).orderBy("b0").collect()
    assert np.allclose([out[1][n] for n in tensor.PARTS], [1.7, 0.2, 0.1, 0.4, -0.1, 0.3]) and out[0].fa == 0.0
    e = np.linalg.eigvalsh(d)
    assert np.isclose(out[1].fa, np.sqrt(1.5 * ((e - e.mean()) ** 2).sum() / (e ** 2).sum()))


def test_greedy_assignment_brute_force(spark):
    from gridstone.operators import dense

    rng = np.random.default_rng(5)
    for m in (rng.integers(0, 6, (7, 5)).astype(float), np.zeros((2, 2)), rng.random((4, 6))):
        left, want = m.copy(), set()
        while left.max() > 0:
            c, r = divmod(int(left.T.argmax()), left.shape[0])  # column by column
            want.add((r, c, m[r, c]))
            left[r], left[:, c] = 0, 0
        assert {tuple(x) for x in dense.greedy_assignment(dense.table(spark, m)).collect()} == want


def test_small_matrices(spark):
    from gridstone.operators import dense

    rng = np.random.default_rng(6)
    a = rng.normal(size=(5, 5))
    m = a @ a.T + np.eye(5)
    assert np.allclose(dense.small(dense.apply(dense.table(spark, m), np.linalg.inv)) @ m, np.eye(5))
    assert np.allclose(dense.matrix_root(m) @ dense.matrix_root(m), m) and np.allclose(dense.matrix_root(m, True) @ dense.matrix_root(m), np.eye(5))
    assert np.allclose(dense.matrix_exp(dense.matrix_log(m)), m)
    with pytest.raises(ValueError):
        dense.small(spark.createDataFrame([(5000, 0, 1.0)], "r int, c int, v double"))
