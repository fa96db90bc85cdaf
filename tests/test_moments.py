"""R2 and R6 from mergeable moments against dense numpy solutions."""

import numpy as np
from pyspark.sql import functions as F

from routelake.operators import moments as M
from routelake.operators import routers as RT


def rows(n=300, d=6, seed=1):
    r = np.random.RandomState(seed)
    x = r.randn(n, d) @ np.diag(np.arange(1, d + 1)) + np.arange(d)
    y = np.where(x[:, 0] > 0, "a", np.where(x[:, 1] > 2, "b", "c"))
    return x, y


def frame(spark, x, y):
    bad = [(-1, None, "a"), (-2, [float("nan")] * x.shape[1], "a"), (-3, [1.0], "b"), (-4, [None] * x.shape[1], "c")]
    return spark.createDataFrame([(i, v.tolist(), str(k)) for i, (v, k) in enumerate(zip(x, y))] + bad, "query_id long, embedding array<double>, ground_truth string").repartition(7)


def test_moments_merge_over_partitions(spark):
    x, y = rows()
    m = M.moments(frame(spark, x, y), "embedding", "ground_truth")
    one = np.hstack([np.ones((len(x), 1)), x])
    assert m.n == len(x) and np.allclose(m.gram, one.T @ one) and np.allclose(m.covariance(), np.cov(x.T))
    assert set(m.labels) == {"a", "b", "c"} and all(np.allclose(m.labels[k], one[y == k].sum(axis=0)) for k in m.labels)
    assert M.moments(frame(spark, x, y).where("query_id < -3"), "embedding") is None


def test_all_linear_routers_from_one_scan(spark):
    x, y = rows()
    df = frame(spark, x, y)
    cands = df.where("query_id >= -3").select("query_id", F.explode(F.array(*map(F.lit, "abcz"))).alias("candidate_name"))
    out = {r.query_id: (r.predicted, r.predicted_score) for r in RT.linear_router(df, df, cands).collect()}
    one = np.hstack([np.ones((len(x), 1)), x])
    ridge = 0.01 * len(x) * np.diag([0.0] + [1.0] * x.shape[1])
    s = {k: one @ np.linalg.solve(one.T @ one + ridge, one.T @ (y == k)) for k in "abc"}
    best = [max("abc", key=lambda k: s[k][i]) for i in range(len(x))]
    assert set(out) == set(range(len(x)))
    assert all(out[i][0] == k and abs(out[i][1] - s[k][i]) < 1e-9 for i, k in enumerate(best))


def test_one_scan_and_no_loop_over_models(spark, monkeypatch):
    scans = []
    real = RT.moments
    monkeypatch.setattr(RT, "moments", lambda *a: scans.append(a) or real(*a))
    x, y = rows()
    df = frame(spark, x, np.array([f"m{i % 40}" for i in range(len(x))]))
    RT.linear_router(df, df, df.select("query_id", F.col("ground_truth").alias("candidate_name")))
    assert len(scans) == 1


def test_components_have_fixed_signs(spark):
    x, y = rows()
    out = {r.query_id: r.reduced for r in RT.pca_reduce(frame(spark, x, y), k=3).collect()}
    values, vectors = np.linalg.eigh(np.cov(x.T))
    v = vectors[:, np.argsort(-values)[:3]]
    v *= np.sign(v[np.abs(v).argmax(axis=0), range(3)])
    assert all(np.allclose(out[i], (x[i] - x.mean(axis=0)) @ v) for i in range(len(x)))
    assert all(out[i] is None for i in (-1, -2, -3, -4))
    flipped = {r.query_id: r.reduced for r in RT.pca_reduce(frame(spark, x, y).repartition(2), k=3).collect()}
    assert all(np.allclose(out[i], flipped[i]) for i in range(len(x)))


def test_rebuilding_error_is_what_is_left_of_the_variance(spark):
    x, y = rows()
    r = RT.pca_report(frame(spark, x, y), k=2).first()
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert r.vectors == len(x) and np.isclose(r.total_variance, values.sum()) and np.isclose(r.kept_variance, values[:2].sum())
    assert np.isclose(r.mean_sq_error, values[2:].sum())
    assert RT.pca_reduce(frame(spark, x, y).where("query_id = -1"), k=2).first().reduced is None
