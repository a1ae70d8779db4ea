import numpy as np
from pyspark.sql import functions as F

from momentlake.operators import anomalies, approximate


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(4)


def test_recall_is_measured_and_reached(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(60, 12)), 25, axis=0) + 0.3 * rng.normal(size=(1500, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    true = -np.sort(-s, axis=1)[:, 4]
    df = frame(spark, x)
    got = approximate.approximate_neighbours(df, 5, block=150, at_once=2).toPandas()
    assert (got.groupby("a").size() == 5).all() and got.a.nunique() == 1500
    assert np.allclose(got.distance, 1 - s[got.a, got.b]) and not (got.a == got.b).any() and not got.duplicated(["a", "b"]).any()
    found = (s[got.a, got.b] >= true[got.a] - 1e-9).mean()
    assert got.recall[0] >= 0.9 and found >= 0.87  # the sample's and that of all rows
    one = approximate.approximate_neighbours(df, 5, block=150, at_once=1, most_tables=1).first()
    assert 0 < one.recall < 0.9


def test_a_sweep_completes_what_the_tables_missed(spark):
    x = np.random.default_rng(5).normal(size=(900, 24))
    x[100:140] = x[100]  # more equal ones than neighbours
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = frame(spark, x)
    tables = approximate.approximate_neighbours(df, 5, block=100, at_once=1, most_tables=1).first()
    assert tables.recall < 0.9
    got = approximate.approximate_neighbours(df, 5, block=100, at_once=1, complete=True).orderBy("a", "rank").toPandas()
    want = anomalies.neighbours(df, 5).orderBy("a", "rank").toPandas()
    assert (got.recall == 1).all() and np.allclose(got.distance, want.distance) and len(got) == 4500
    single = ~got.a.between(100, 139)
    assert (got.b[single] == want.b[single]).all()


def test_many_equal_vectors(spark):
    x = np.repeat([[1.0, 0.0], [0.0, 1.0]], [900, 100], axis=0)
    got = approximate.approximate_neighbours(frame(spark, x), 3, block=100).toPandas()
    assert (got.groupby("a").size() == 3).all() and (got.distance < 1e-12).all() and got.recall[0] == 1


def test_modes_and_small_tables(spark):
    x = np.random.default_rng(1).normal(size=(40, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = frame(spark, x)
    both = [approximate.knn_scores(df, 3, exact_rows=n).orderBy("id").toPandas() for n in (0, 40)]
    assert [set(t["mode"]) for t in both] == [{"approximate"}, {"exact"}] and np.allclose(both[0].score, both[1].score)
    lof = [approximate.lof_scores(df, 3, exact_rows=0).orderBy("id").toPandas(), anomalies.lof_scores(df, 3).orderBy("id").toPandas()]
    assert np.allclose(lof[0].score, lof[1].score)
    assert approximate.any_neighbours(df.limit(0), 3).count() == 0 and approximate.approximate_neighbours(df.limit(1), 3).count() == 0
    odd = df.limit(5).unionByName(spark.createDataFrame([(90, None), (91, [float("nan"), 0.0, 0.0, 1.0])], df.schema))
    assert approximate.approximate_neighbours(odd, 9).select(F.max("rank"), F.count("*")).first()[:] == (4, 20)
