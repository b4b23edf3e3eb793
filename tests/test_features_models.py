import numpy as np
from pyspark.sql import functions as F

from panelkit.operators import features as fe
from panelkit.operators import models as md
from panelkit.operators.evaluate import regression_metrics


def test_hash_split_is_deterministic_and_complete(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "k")
    a = fe.hash_split(df, "k", 229)
    b = fe.hash_split(df.repartition(7), "k", 229)
    assert a.exceptAll(b).count() == 0
    n_train = a.where("part = 'train'").count()
    assert a.count() == 5000 and 3800 < n_train < 4200
    folds = fe.kfold(df, "k", 5, 229).groupBy("fold").count().collect()
    assert sorted(r.fold for r in folds) == [0, 1, 2, 3, 4]


def test_one_hot_unseen_is_zero(spark):
    train = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    test = spark.createDataFrame([("b",), ("z",)], "c string")
    cats = fe.fit_categories(train, "c")
    out = fe.one_hot(test, "c", cats).orderBy("c").collect()
    assert [(r.c_is_a, r.c_is_b) for r in out] == [(0, 1), (0, 0)]
    assert fe.unseen_rows(test, train, "c").count() == 1


def test_scaler_population_std_and_constant(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (3.0, 3.0)], "x double, c double")
    st = fe.fit_scaler(df, ["x", "c"])
    assert abs(st["x"][1] - np.std([1, 2, 3])) < 1e-12 and st["c"][1] == 1.0


def test_ols_and_ridge_closed_form(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(400, 2))
    y = 3 + X @ np.array([2.0, -1.0]) + rng.normal(scale=0.5, size=400)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(X, y)], "x1 double, x2 double, y double")
    m = md.ols_fit(df, ["x1", "x2"], "y").stages[-1]
    A = np.c_[np.ones(400), X]
    beta = np.linalg.lstsq(A, y, rcond=None)[0]
    assert np.allclose([m.intercept, *m.coefficients], beta, atol=1e-8)
    # ridge: sklearn-style alpha on z-scored X, mapped to regParam = alpha * sd(y) / n
    Z = (X - X.mean(0)) / X.std(0)
    alpha = 10.0
    yc = y - y.mean()
    w = np.linalg.solve(Z.T @ Z + alpha * np.eye(2), Z.T @ yc)
    zdf = spark.createDataFrame([(float(a), float(b), float(c), i % 5) for i, ((a, b), c) in enumerate(zip(Z, y))],
                                "z1 double, z2 double, y double, fold int")
    from pyspark.ml.regression import LinearRegression
    data = md.assembler(["z1", "z2"])[0].transform(zdf)
    lr = LinearRegression(regParam=md.ridge_reg_param(alpha, float(np.std(y)), 400), elasticNetParam=0.0,
                          standardization=False, solver="normal", labelCol="y").fit(data)
    assert np.allclose(lr.coefficients.toArray(), w, atol=1e-6)


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 1.5), (3.0, 3.5)], "y double, p double")
    r = regression_metrics(df, "y", "p").first()
    sse = 0.25 * 3
    assert abs(r.r2 - (1 - sse / 2.0)) < 1e-12 and abs(r.rmse - (sse / 3) ** 0.5) < 1e-12
    assert F is not None


def test_random_places_are_a_permutation(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    p = md.random_place(df, "k", 3, 5000, bucket_rows=700).toPandas()
    assert sorted(p["_place"]) == list(range(5000))
    assert abs(np.corrcoef(p["k"], p["_place"])[0, 1]) < 0.06


def test_permutation_importance_of_a_known_model(spark):
    """y = 3 a + b + noise: the drops agree with permutations made row by row."""
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 3))
    y = 3 * x[:, 0] + x[:, 1] + r.normal(size=4000)
    df = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "k long, a double, b double, c double, y double")
    m = md.ols_fit(df, ["a", "b", "c"], "y")
    got = md.permutation_importance(m, df, ["a", "b", "c"], "y", key="k", repeats=10).toPandas()
    assert sorted(zip(got.feature, got["repeat"])) == [(f, i) for f in "abc" for i in range(10)]
    w, b = m.stages[-1].coefficients.toArray(), m.stages[-1].intercept

    def r2(z):
        return 1 - ((y - z @ w - b) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    for k, f in enumerate("abc"):
        drops = []
        for _ in range(60):
            z = x.copy()
            z[:, k] = r.permutation(z[:, k])
            drops.append(r2(x) - r2(z))
        own = got[got.feature == f].r2_drop
        assert abs(own.mean() - np.mean(drops)) < 4 * np.std(drops) / 10 ** 0.5 + 1e-4
        assert own.std() < 3 * np.std(drops) + 1e-4


def test_one_fit_scores_all_tree_counts_and_depths(spark):
    r = np.random.default_rng(6)
    x = r.uniform(0, 1, (600, 2))
    rows = [(float(a), float(b), float(np.sin(9 * a) + b * b + r.normal(0, 0.1))) for a, b in x]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    fit = md.forest_fit(df, ["a", "b"], "y", numTrees=12, maxDepth=6, featureSubsetStrategy="all")
    trees = md.tree_tables(spark, fit.stages[-1])
    got = md.forest_errors(df.repartition(3), ["a", "b"], "y", trees, [1, 5, 12], [0, 3, 6])
    pred = fit.transform(df).select("y", "prediction").toPandas()
    assert got[None] == 600 and np.isclose(got[12, 6], ((pred.y - pred.prediction) ** 2).sum())
    assert got[12, 0] > got[12, 3] > got[12, 6] and got[1, 6] > got[12, 6]

    def cut(t, row, depth):
        n = 0
        for _ in range(depth):
            if t[n, 0] >= 0:
                n = int(t[n, 2] if row[int(t[n, 0])] <= t[n, 1] else t[n, 3])
        return t[n, 4]
    by_hand = sum((np.mean([cut(t, v, 3) for t in trees[:5]]) - v[2]) ** 2 for v in rows)
    assert np.isclose(got[5, 3], by_hand)


def test_halving_finds_the_planted_setting(spark):
    """Only deep trees can follow the steps of y; halving agrees with the full search."""
    r = np.random.default_rng(7)
    rows = [(i, float(a), float(b), float(int(a * 16) % 2 * 10 + b)) for i, (a, b) in enumerate(r.uniform(0, 1, (1600, 2)))]
    df = fe.kfold(spark.createDataFrame(rows, "k long, a double, b double, y double"), "k", k=3)
    grid = {"numTrees": [4, 8], "maxDepth": [1, 2, 7], "featureSubsetStrategy": ["all"]}
    settings = md.sample_grid(grid, 6, seed=1)
    halved = md.forest_halving(df, ["a", "b"], "y", settings, [(0.25, 2), (1.0, 1)])
    whole = md.forest_halving(df, ["a", "b"], "y", settings, [(1.0, 1)])
    assert len(halved) == 6 and sorted(s["rung"] for s in halved) == [0] * 4 + [1] * 2
    best, full = md.best_of_search(halved), md.best_of_search(whole)
    assert best["maxDepth"] == full["maxDepth"] == 7 and best["cv_rmse"] <= 1.02 * full["cv_rmse"]


def test_empty_inputs_do_not_raise(spark):
    from panelkit.operators.contrast import value_shares
    df = spark.createDataFrame([(1, False), (2, False)], "v int, ext boolean")
    assert value_shares(df, "v", "ext").count() == 0
    e = spark.createDataFrame([], "y double, p double")
    assert regression_metrics(e, "y", "p").count() == 1
