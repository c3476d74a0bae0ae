"""Queries over all 64 dimensions, against their SQL or a brute-force version."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["covariance", "within_scatter", "nearest_centroid", "mislabel_rate", "medoid_step"])
def test_whole_vectors_equal_sql(spark, name):
    from gridstone.plans import bindings

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = bindings.queries()[name](spark, SF).toPandas()
    want = con.execute(bindings.oracle_sql()[name]).df()[list(got.columns)]
    by = list(got.columns)[:2] if len(want) > 1 else []
    a, b = (x.sort_values(by).to_numpy(float) if by else x.to_numpy(float) for x in (got, want))
    assert a.shape == b.shape and np.allclose(a, b, atol=1e-6)
    assert name not in ("covariance", "within_scatter") or len(got) == 64 * 64


def test_comoments_nulls(spark):
    from gridstone.operators.reductions import covariance, within_scatter

    df = spark.createDataFrame([(1, [1.0, None]), (1, [2.0, 3.0]), (None, [4.0, 7.0]), (None, None), (1, [6.0, 8.0])], "label int, f array<double>").repartition(3)
    cov = {(r.i, r.j): r["cov"] for r in covariance(df, "f", 3).collect()}
    assert np.isclose(cov[0, 0], np.var([1, 2, 4, 6])) and np.isclose(cov[0, 1], np.cov([2, 4, 6], [3, 7, 8], bias=True)[0, 1]) and cov[2, 2] is None
    within = {(r.i, r.j): r.scatter for r in within_scatter(df, "label", "f", 2).collect()}
    assert np.isclose(within[1, 1], 12.5) and np.isclose(within[0, 1], 10.0)


def test_kmeans_fixpoint(spark):
    from gridstone.plans import bindings

    e = pq.read_table(f"{SF}/embeddings.parquet").to_pandas().sort_values("vec_id")
    x = np.stack(e.embedding).astype(float)
    cents, last = x[e.vec_id.to_numpy() < 4], None
    while True:
        k = ((x[:, None] - cents) ** 2).sum(2).argmin(1)
        if last is not None and (k == last).all():
            break
        cents, last = np.stack([x[k == c].mean(0) if (k == c).any() else np.zeros(64) for c in range(4)]), k
    got = bindings.queries()["kmeans_fixpoint"](spark, SF).toPandas().sort_values("vec_id")
    assert (got.cluster.to_numpy() == k).all()


def test_random_forest_reads_all_dimensions(spark, tmp_path):
    from gridstone.plans import bindings

    rng = np.random.default_rng(1)
    label = np.arange(600) % 4
    x = rng.normal(0, 0.1, (600, 64))
    x[np.arange(600), 40 + label] += 5  # the first 8 dimensions tell nothing
    pq.write_table(pa.table({"vec_id": np.arange(600), "embedding": pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32())), "label": label.astype(np.int32)}), tmp_path / "embeddings.parquet")
    forest = bindings.queries()["random_forest"](spark, str(tmp_path)).toPandas()
    assert (forest.prediction == forest.vec_id % 4).mean() > 0.95
