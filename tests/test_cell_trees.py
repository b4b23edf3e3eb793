import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from panelkit.operators import cell_trees as ct
from panelkit.operators import features as fe
from panelkit.operators import models as md
from panelkit.plans import ml_queries as mq

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def df(spark):
    r = np.random.default_rng(2)
    x = np.column_stack([r.integers(0, 20, 4000), r.integers(0, 7, 4000), r.integers(0, 2, 4000)]).astype(float)
    y = np.sin(x[:, 0] / 3) * 4 + x[:, 1] * x[:, 2] + r.normal(0, 1, 4000)
    rows = [(i, *map(float, v), float(t), ["fit", "fit", "fit", "stop", "score"][i % 5]) for i, (v, t) in enumerate(zip(x, y))]
    return fe.kfold(spark.createDataFrame(rows, "k long, a double, b double, c double, y double, role string"), "k").cache()


@pytest.fixture
def cells_only(monkeypatch):
    monkeypatch.setattr(ct, "FEW_ROWS", 0)


def test_a_tree_from_cells_is_the_tree_from_rows(df):
    cells = ct.fit_cells(df, X)
    n, s, _ = ct.cell_sums(df.withColumn("g", F.lit(0)), cells, "y", "g")[0]
    for depth, least, gain in ((3, 1, 0.0), (6, 1, 0.0), (6, 60, 0.02)):
        own = ct.grow(cells.bins(), cells.sizes, n, s, depth, 3, np.random.default_rng(0), least, gain)
        got = ct.CellModel(cells, own[-1]).transform(df).toPandas().sort_values("k").prediction.to_numpy()
        tree = DecisionTreeRegressor(maxDepth=depth, labelCol="y", minInstancesPerNode=least, minInfoGain=gain)
        rows = md.assembler(X)[0].transform(df)
        want = tree.fit(rows).transform(rows).toPandas().sort_values("k").prediction.to_numpy()
        assert np.allclose(got, want)
    assert np.allclose(own[0], s.sum() / n.sum())


def test_bootstrap_draws_rows(df):
    """Counts and sums of a tree's draws have the moments of a Poisson(1) weight for every row."""
    cells = ct.fit_cells(df, ["c"])
    got = ct.bootstrap_sums(df, cells, "y", F.lit(0), 300, 5).groupBy("tree", "code").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toPandas()
    rows = df.toPandas()
    for code, t in got.groupby("code"):
        y = rows.y[rows.c == code].to_numpy()
        assert len(t) == 300
        assert abs(t.n.mean() - len(y)) < 5 * np.sqrt(len(y) / 300) and abs(t.n.var() / len(y) - 1) < 0.45
        assert abs(t.s.mean() - y.sum()) < 5 * np.sqrt((y * y).sum() / 300) and abs(t.s.var() / (y * y).sum() - 1) < 0.45


def test_forest_search_from_cells_scores_like_the_rows(df, monkeypatch):
    settings = [{"numTrees": t, "maxDepth": d, "featureSubsetStrategy": s} for t in (4, 30) for d in (1, 3, 6) for s in ("all", "onethird")]
    rows = md.forest_cv(df, X, "y", settings)
    monkeypatch.setattr(ct, "FEW_ROWS", 0)
    monkeypatch.setattr(md, "_forest_on_rows", None)  # no fit on the rows
    cells = md.forest_cv(df, X, "y", settings)
    for a, b in zip(rows, cells):
        chance = a["featureSubsetStrategy"] == "onethird"  # one random feature a node
        assert abs(a["cv_rmse"] - b["cv_rmse"]) < (1.0 if chance else 0.25), (a, b)
    model = md.forest_fit(df, X, "y", numTrees=30, maxDepth=6, featureSubsetStrategy="all")
    scored = model.transform(df).toPandas()
    assert len(scored) == 4000 and np.sqrt(np.mean((scored.y - scored.prediction) ** 2)) < 1.1
    assert ct.subset_size("0.5", 3) == 2 and ct.subset_size("log2", 3) == 2 and ct.subset_size("onethird", 3) == 1


def test_boosted_trees_from_cells_are_those_from_rows(df, monkeypatch):
    rows = md.gbt_fit(df, X, "y", maxDepth=4, stepSize=0.3, maxIter=5)
    want = rows.transform(df).toPandas().sort_values("k").prediction.to_numpy()
    curve = md.boosting_curve(rows, df, "y")
    monkeypatch.setattr(ct, "FEW_ROWS", 0)
    cells = md.gbt_fit(df, X, "y", maxDepth=4, stepSize=0.3, maxIter=5)
    assert len(cells.stages) == 3
    assert np.allclose(cells.transform(df).toPandas().sort_values("k").prediction.to_numpy(), want)
    assert np.allclose(md.boosting_curve(cells, df, "y"), curve)
    assert np.allclose(cells.stages[-1].featureImportances.toArray(), rows.stages[-1].featureImportances.toArray())


def test_boosted_search_from_cells_is_the_search_on_rows(df, monkeypatch):
    """Without random choices the same rounds and errors; with them, close ones."""
    trials = [{"maxDepth": 3, "maxIter": m, "stepSize": s, "minInstancesPerNode": 5} for s, m in ((0.01, 30), (0.4, 30), (0.2, 30), (0.3, 3))]
    rows = md.gbt_prune(df, X, "y", "role", trials, [2, 6])
    drawn = [dict(t, subsamplingRate=r, featureSubsetStrategy="0.7") for t, r in zip(trials, (0.9, 0.5, 0.6, 0.5))]
    rows_drawn = md.gbt_prune(df, X, "y", "role", drawn, [6])
    monkeypatch.setattr(ct, "FEW_ROWS", 0)
    monkeypatch.setattr(md, "GBTRegressor", None)
    cells = md.gbt_prune(df, X, "y", "role", trials, [2, 6])
    for a, b in zip(rows, cells):
        assert (a["rounds"], a["best_round"]) == (b["rounds"], b["best_round"])
        assert abs(a["rmse"] - b["rmse"]) < 1e-9 and abs(a["stop_rmse"] - b["stop_rmse"]) < 1e-9
    for a, b in zip(rows_drawn, md.gbt_prune(df, X, "y", "role", drawn, [6])):
        assert a["rounds"] == b["rounds"] and abs(a["rmse"] - b["rmse"]) < 0.25


def test_cells_refuse_nulls_and_cut_many_values_at_quantiles(spark, cells_only):
    r = np.random.default_rng(0)
    many = spark.createDataFrame([(float(v), 1.0, float(v)) for v in r.normal(size=3000)], "a double, b double, y double")
    cells = ct.fit_cells(many, ["a", "b"])
    assert cells.sizes == [32, 1] and many.groupBy(cells.column()).count().agg(F.min("count")).first()[0] > 60
    fit = md.gbt_fit(many, ["a", "b"], "y", maxDepth=5, maxIter=3, stepSize=0.3)
    assert md.boosting_curve(fit, many, "y")[-1] < 0.3
    bad = many.unionByName(spark.createDataFrame([(None, 1.0, 2.0)], many.schema))
    with pytest.raises(ValueError):
        md.forest_fit(bad, ["a", "b"], "y", numTrees=2, maxDepth=2, featureSubsetStrategy="all")
    model = md.forest_fit(many, ["a", "b"], "y", numTrees=2, maxDepth=2, featureSubsetStrategy="all")
    with pytest.raises(Exception, match="NULL or NaN"):
        model.transform(bad).collect()


def test_shares_draw_each_row_at_its_rate():
    """By round and rate: a row is drawn with exactly the rate's probability, and a higher rate's rows hold a lower one's."""
    y = np.random.default_rng(1).normal(3, 1, 4000)
    rates = np.array([0.1234567, 0.5, 0.5000001, 1.0])
    n, s = ct.share_sums(y, rates, 400, np.random.Generator(np.random.SFC64(3)))
    assert n.shape == s.shape == (400, 4) and (np.diff(n, axis=1) >= 0).all()
    assert (n[:, 3] == 4000).all() and np.allclose(s[:, 3], y.sum())
    assert (abs(n.mean(axis=0) / 4000 - rates) < 5 * np.sqrt(rates * (1 - rates) / 4000 / 400) + 1e-9).all()
    assert (abs(s.mean(axis=0) - rates * y.sum()) < 5 * np.sqrt((y * y).sum() * rates * (1 - rates) / 400) + 1e-6).all()
    assert abs(n[:, 1].var() / 1000 - 1) < 0.45 and abs(np.corrcoef(n[:-1, 1], n[1:, 1])[0, 1]) < 0.25


def test_unpruned_trials_boost_all_their_rounds(df, monkeypatch):
    """Nothing but the median stops a trial, however many rounds it has; going on from a
    checkpoint is the same as never having stopped there."""
    monkeypatch.setattr(ct, "MANY_TREES", 0)
    base = {"maxDepth": 2, "stepSize": 0.1, "minInstancesPerNode": 5}
    lone = md.gbt_prune(df, X, "y", "role", [dict(base, maxIter=550)], mq.GBT_CHECKPOINTS)[0]
    assert lone["rounds"] == 550 and lone["best_round"] > 16
    trials = [dict(base, maxIter=m) for m in (30, 50, 60, 50)]
    got = md.gbt_prune(df, X, "y", "role", trials, mq.GBT_CHECKPOINTS)
    assert [t["rounds"] for t in got] == [30, 50, 60, 50]
    for a, b in zip(got, md.gbt_prune(df, X, "y", "role", trials, [7, 8, 60])):
        if b["rounds"] == a["rounds"]:
            assert a["best_round"] == b["best_round"] and abs(a["rmse"] - b["rmse"]) < 1e-9
    assert mq.GBT_CHECKPOINTS[0] >= 200 and mq.GBT_CHECKPOINTS[-1] >= md.GBT_SPACE["maxIter"][1]


def test_the_best_trial_has_the_lowest_score_whatever_its_rounds(spark):
    base = {"maxDepth": 3, "best_round": 40, "stop_rmse": 1.0}
    log = md.trial_log(spark, "gbt", [dict(base, rounds=r, rmse=e) for r, e in ((550, 3.0), (60, 2.0), (400, 2.5), (70, 2.0))])
    assert md.best_trial(log).first().trial == 1


def test_permutations_on_cells_are_those_on_rows(spark, df, monkeypatch):
    """Blocks of cells give the drops that the rows themselves give, with several buckets and blocks."""
    cells = ct.fit_cells(df, X)
    model = ct.CellModel(cells, np.sin(np.arange(cells.n)) * 3)
    data = df.withColumn("y", F.when(F.col("k") % 50 == 7, None).otherwise(F.col("y")))
    monkeypatch.setattr(ct, "BLOCK", 300)
    places = md._places
    monkeypatch.setattr(md, "_places", lambda key, seed, n, bucket_rows=1500: places(key, seed, n, min(bucket_rows, 1500)))
    got = {(r.feature, r["repeat"]): r.r2_drop for r in md.permutation_importance(model, data, X, "y", key="k").collect()}

    class Rows:
        transform = staticmethod(model.transform)
    monkeypatch.setattr(md, "random_place", lambda d, key, seed, n, f=md.random_place: f(d, key, seed, n, 1500))
    want = {(r.feature, r["repeat"]): r.r2_drop for r in md.permutation_importance(Rows(), data, X, "y", key="k").collect()}
    assert got.keys() == want.keys() and len(got) == 30
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_the_forest_search_scores_every_draw_on_all_rows_and_trees(df, monkeypatch):
    assert mq.FOREST_RUNGS == [(1.0, 1)]
    seen = []
    real = ct.forest_cv_errors
    monkeypatch.setattr(ct, "forest_cv_errors", lambda part, held, *a: seen.append((part.count(), sum(h[0].sum() for h in held.values()), a[5])) or real(part, held, *a))
    settings = [{"numTrees": t, "maxDepth": 2, "featureSubsetStrategy": "all"} for t in (150, 200)]
    rows = md.forest_halving(df, X, "y", settings, mq.FOREST_RUNGS)  # 1,000 trees: cells, though the rows are few
    assert [r["rung"] for r in rows] == [0, 0] and seen == [(4000, 4000.0, [150, 200])]
