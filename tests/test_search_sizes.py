import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import features as fe
from panelkit.operators import models as md
from panelkit.plans import ml_queries as mq

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def xy(spark):
    r = np.random.default_rng(11)
    x = r.normal(0, 1, (400, 3))
    y = 50 + x @ [4.0, -2.0, 0.1] + r.normal(0, 3, 400)
    df = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "k long, a double, b double, c double, y double")
    return fe.kfold(df, "k").cache()


@pytest.mark.parametrize("ratio", [0.0, 0.3, 1.0])
def test_fits_from_moments_equal_the_row_wise_ones(xy, ratio):
    rows, names = xy.toPandas(), ["a", "b", "c"]
    alphas = [0.01, 0.5, 3.0]
    settings = [{"ridge": a} if ratio == 0 else {"l1": a * ratio, "l2": a * (1 - ratio)} for a in alphas]
    got = [s["cv_rmse"] for s in md.cross_validate_moments(xy.sparkSession, md.fold_moments(xy, names, "y"), settings)]
    for a, rmse in zip(alphas, got):
        errors = []
        for f in range(5):
            tr, te = rows[rows.fold != f], rows[rows.fold == f]
            x, y = tr[names].to_numpy() - tr[names].to_numpy().mean(axis=0), tr.y.to_numpy() - tr.y.mean()
            b, n = np.zeros(3), len(tr)
            l1, l2 = (0.0, a / n) if ratio == 0 else (a * ratio, a * (1 - ratio))
            for _ in range(3000):  # proximal gradient on the rows
                step = b - 0.3 * (-(x.T @ (y - x @ b)) / n + l2 * b) / (1 + l2)
                b = np.sign(step) * np.maximum(np.abs(step) - 0.3 * l1 / (1 + l2), 0)
            errors.append(np.sqrt(np.mean((te.y - tr.y.mean() - (te[names].to_numpy() - tr[names].to_numpy().mean(axis=0)) @ b) ** 2)))
        assert abs(np.mean(errors) - rmse) < 1e-6


def test_moments_refuse_nulls(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, None, 1.0)], "fold int, a double, y double")
    with pytest.raises(ValueError):
        md.fold_moments(df, ["a"], "y")


def test_linear_searches_run_the_whole_grid(spark):
    assert {round(float(np.log10(r.alpha))) for r in mq.ridge_cv(spark, SF).collect()} == set(range(-7, 2))
    assert mq.lasso_cv(spark, SF).distinct().count() == 100
    rows = mq.elastic_net_cv(spark, SF).collect()
    assert len({(r.reg_param, r.elastic_net) for r in rows}) == len(rows) == 1100 and all(np.isfinite(r.cv_rmse) for r in rows)


def test_forest_search_draws_a_quarter_of_the_reference_grid():
    assert int(np.prod([len(v) for v in mq.FOREST_GRID.values()])) == 72 and mq.FOREST_DRAWS == 54
    assert mq.FOREST_RUNGS[-1][0] == 1.0  # the last rung sees all rows and trees
    assert len(md.sample_grid(mq.FOREST_GRID, mq.FOREST_DRAWS, seed=229)) == 54


def test_forest_predict_refits_the_best_of_the_search(spark, monkeypatch):
    seen = {}
    trials = [{"numTrees": 2, "maxDepth": 2, "featureSubsetStrategy": "sqrt", "cv_rmse": 0.1, "rung": 0},
              {"numTrees": 3, "maxDepth": 2, "featureSubsetStrategy": "sqrt", "cv_rmse": 1.0, "rung": 1},
              {"numTrees": 4, "maxDepth": 3, "featureSubsetStrategy": "log2", "cv_rmse": 0.5, "rung": 1}]
    monkeypatch.setattr(mq, "_SEARCHED", {})
    monkeypatch.setattr(mq.md, "forest_halving", lambda *a, **k: trials)
    real = mq.md.forest_fit
    monkeypatch.setattr(mq.md, "forest_fit", lambda *a, **k: seen.update(k) or real(*a, **k))
    assert mq.forest_predict(spark, SF).count() == 1
    assert seen == {"numTrees": 4, "maxDepth": 3, "featureSubsetStrategy": "log2"}


def test_forest_search_uses_five_folds(spark, monkeypatch):
    monkeypatch.setattr(mq, "_SEARCHED", {})
    monkeypatch.setattr(mq, "FOREST_GRID", {"numTrees": [2], "maxDepth": [2], "featureSubsetStrategy": ["sqrt"]})
    monkeypatch.setattr(mq, "FOREST_RUNGS", [(1.0, 1)])
    train, _ = mq._tree_data(spark, SF)
    assert {r.fold for r in train.select("fold").distinct().collect()} == set(range(5))
    assert mq.forest_search(spark, SF).count() == 1


def test_permutation_importance_repeats_ten_times_on_the_best_forest(spark, monkeypatch):
    monkeypatch.setattr(mq, "_best_forest", lambda *a: "best")
    monkeypatch.setattr(mq.md, "permutation_importance", lambda model, *a, repeats=10, **k: (model, repeats))
    assert mq.permutation_importance(spark, SF) == ("best", 10)


def test_sparse_moments_equal_the_dense_ones(spark):
    """A category's 0/1 columns, an unseen value and a NULL included."""
    r = np.random.default_rng(3)
    rows = [(i, int(i % 3), float(r.normal()), float(r.normal()), "c%d" % min(r.integers(12), r.integers(12)) if i % 17 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, fold int, a double, y double, c string")
    ids, size = fe.category_ids(df.where("k < 400"), "c", bucket_values=5)
    table = {x.value: (x.id, x.n) for x in ids.collect()}
    assert sorted(i for i, _ in table.values()) == list(range(size))
    assert [n for _, n in sorted(table.values())] == sorted((n for _, n in table.values()), reverse=True)
    extra = spark.createDataFrame([(900, 0, 1.0, 2.0, "new")], df.schema)
    coded = fe.encode_ids(df.unionByName(extra), ids, "c", size, "cid").cache()
    assert {x.cid for x in coded.where("c = 'new' or c is null").collect()} == {size}
    vectors = {x.k: x.v for x in fe.sparse_one_hot(coded, "cid", size, "v").collect()}
    assert vectors[900].size == size and vectors[900].numNonzeros() == 0 and vectors[1].numNonzeros() == 1
    got = md.fold_moments(coded, ["a"], "y", category="cid", size=size)
    p = coded.toPandas()
    x = np.column_stack([np.ones(len(p)), p.a, np.eye(size + 1)[p.cid.astype(int)][:, :size], p.y - p.y.mean()])
    for f in range(3):
        own = x[p.fold == f]
        assert np.allclose(got[f], own.T @ own)


def test_paths_meet_the_optimality_conditions():
    """At the minimum the gradient is l1 sign(b) where b isn't 0, and at most l1 elsewhere."""
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 60))
    x[:, 20:] = np.eye(40)[r.integers(40, size=400)]
    x[:, 59] = x[:, 58]  # two equal columns
    y = x[:, :3] @ [3.0, -2.0, 1.0] + x[:, 30] + r.normal(size=400)
    z = np.column_stack([np.ones(400), x, y])
    m = z.T @ z
    l1 = np.concatenate([np.geomspace(1.0, 1e-3, 20), [0.0]])
    l2 = np.concatenate([np.geomspace(0.5, 1e-3, 20), [0.7]])
    b = md.penalised_paths(m, l1, l2)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    for k in range(len(l1)):
        gradient = xc.T @ (yc - xc @ b[:, k]) / 400 - l2[k] * b[:, k]
        on = b[:, k] != 0
        assert np.allclose(gradient[on], l1[k] * np.sign(b[on, k]), atol=1e-6)
        assert (np.abs(gradient[~on]) <= l1[k] + 1e-6).all()


def test_wide_search_covers_all_penalties(spark):
    rows = mq.linear_wide_cv(spark, SF).collect()
    assert len(rows) == 9 + 11 * 100 and all(np.isfinite(r.cv_rmse) for r in rows)
    assert {r.columns for r in rows} == {18 + 10}  # sf0.001 has ten suppliers


def test_boosted_trials_are_pruned_by_the_stop_rows(spark):
    """A step too small to learn anything is pruned; the scoring rows choose nothing."""
    r = np.random.default_rng(9)
    rows = [(float(a), float(b), float(5 * a + np.sin(8 * b) + r.normal(0, 0.1)), ["fit", "fit", "fit", "stop", "score"][i % 5])
            for i, (a, b) in enumerate(r.uniform(0, 1, (800, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, y double, role string")
    base = {"maxDepth": 3, "maxIter": 30, "minInstancesPerNode": 2}
    trials = [dict(base, stepSize=s) for s in (0.001, 0.4, 0.002, 0.3)] + [dict(base, stepSize=0.5, maxIter=3)]
    got = md.gbt_prune(df, ["a", "b"], "y", "role", trials, [2, 6, 12])
    assert [t["rounds"] for t in got][0] == 2 and got[2]["rounds"] == 2
    assert got[4]["rounds"] <= 3  # its own maxIter
    assert max(t["rounds"] for t in got) == 12 and all(1 <= t["best_round"] <= t["rounds"] for t in got)
    wrong = df.withColumn("y", F.when(F.col("role") == "score", -F.col("y")).otherwise(F.col("y")))
    other = md.gbt_prune(wrong, ["a", "b"], "y", "role", trials, [2, 6, 12])
    assert [(t["rounds"], t["best_round"], t["stop_rmse"]) for t in other] == [(t["rounds"], t["best_round"], t["stop_rmse"]) for t in got]
    log = md.trial_log(spark, "gbt", got)
    assert log.count() == 5 and "stepSize" in log.first().params and "rounds" not in log.first().params
    best = md.best_trial(log).first()
    assert best.rounds == 12 and best.trial in (1, 3)


def test_boosted_search_has_the_reference_sizes():
    trials = md.gbt_trials(mq.GBT_DRAWS, seed=24)
    assert len(trials) == 100 and len({str(t) for t in trials}) == 100
    assert all(3 <= t["maxDepth"] <= 10 and 50 <= t["maxIter"] <= 550 and 0.01 <= t["stepSize"] <= 1 for t in trials)


def test_the_chain_runs_on_the_tuned_forest(spark, monkeypatch):
    """One search; its forest's residuals are contrasted and its metrics ranked."""
    calls = []
    trials = [{"numTrees": 5, "maxDepth": 3, "featureSubsetStrategy": "all", "cv_rmse": 0.5, "rung": 1}]
    monkeypatch.setattr(mq, "_SEARCHED", {})
    monkeypatch.setattr(mq.md, "forest_halving", lambda *a, **k: calls.append(1) or trials)
    contrast = {r.feature: r for r in mq.forest_contrast(spark, SF).collect()}
    assert set(contrast) == {"abs_residual", *mq.X3} and contrast["abs_residual"].extreme > contrast["abs_residual"].others
    board = {r.model: r for r in mq.fitted_leaderboard(spark, SF).collect()}
    assert set(board) == {"mean", "least squares", "ridge", "lasso", "boosted trees", "forest"} and len(calls) == 1
    forest = mq.forest_predict(spark, SF).first()
    assert len({r.n for r in board.values()}) == 1 and forest.n == board["forest"].n
    ols = mq.multiple_ols(spark, SF).first()
    assert ols.intercept and board["least squares"].rmse <= board["mean"].rmse * 1.05
