"""Model queries: KNN (exact grid join), least squares, penalised linear models,
forests, boosted trees, searches, importances, trial log."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import category_paths as cp
from ..operators import contrast as ct
from ..operators import features as fe
from ..operators import knn
from ..operators import models as md
from ..operators.evaluate import regression_metrics
from ..session import cut_lineage
from .common import synth_lat, synth_lon, table
from .model_queries import SEED, Y, model_table

KNN_KS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 15, 20, 25, 40, 50]
X3 = ["l_quantity", "l_discount", "l_tax"]


def _knn_table(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    c = c.select("c_custkey", "c_acctbal", synth_lat(F.col("c_custkey")).alias("lat"),
                 synth_lon(F.col("c_custkey"), 7).alias("lon"))
    c = fe.hash_split(c, "c_custkey", SEED)
    stats = fe.fit_scaler(c.where(F.col("part") == fe.TRAIN), ["lat", "lon"])
    z = fe.apply_scaler(c, stats)
    return z.select("c_custkey", "c_acctbal", "part", F.round("z_lat", 6).alias("zl"),
                    F.round("z_lon", 6).alias("zo"))


def knn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 + T7: mean balance of the 5 nearest training customers (z-scored
    location), for every test customer."""
    z = _knn_table(spark, sf_dir)
    train, test = z.where(F.col("part") == fe.TRAIN), z.where(F.col("part") == fe.TEST)
    nb = knn.knn_join(test, train.withColumnRenamed("c_custkey", "rid"), qid="c_custkey", rid="rid",
                      features=["zl", "zo"], k=5, payload=["c_acctbal"])
    p = knn.knn_regress(nb, "c_custkey", "c_acctbal", 5)
    return p.select("c_custkey", F.round("prediction", 6).alias("prediction"), "n_neighbours")


def knn_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 + A16: 5-fold CV error for 15 values of k from one neighbour pass
    (k = 50); folds are blocks, each fold's reference is the other four."""
    z = _knn_table(spark, sf_dir).where(F.col("part") == fe.TRAIN)
    z = fe.kfold(z, "c_custkey", k=5, seed=42)
    ref = (z.select(F.col("c_custkey").alias("rid"), "zl", "zo", F.col("c_acctbal").alias("y_ref"),
                    F.explode(F.filter(F.array(*[F.lit(i) for i in range(5)]), lambda f: f != F.col("fold")))
                     .alias("qfold")))
    q = z.select("c_custkey", "zl", "zo", F.col("fold").alias("qfold"))
    nb = knn.knn_join(q, ref, qid="c_custkey", rid="rid", features=["zl", "zo"], k=max(KNN_KS),
                      payload=["y_ref"], block=["qfold"])
    nb = nb.join(z.select("c_custkey", F.col("c_acctbal").alias("y")), "c_custkey").withColumnRenamed("qfold", "fold")
    return _curve_with_best(knn.knn_cv_curve(nb, "c_custkey", "y", "y_ref", KNN_KS))


def _curve_with_best(curve: DataFrame) -> DataFrame:
    # 15 rows: the global window is bounded by the number of k values
    best = F.min_by(F.col("k"), F.struct(F.round("cv_mse", 2), F.col("k"))).over(Window.partitionBy())
    return curve.select(F.col("k").cast("int").alias("k"), F.round("cv_mse", 2).alias("cv_mse"),
                        (F.col("k") == best).alias("is_best"))


WIDE = 25


def _wide_table(spark, sf_dir):
    """25 numeric features and a target per row: the leading vector components."""
    e = table(spark, sf_dir, "embeddings")
    e = e.select("vec_id", F.col("label").cast("double").alias("y"),
                 *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(WIDE)])
    return fe.kfold(fe.hash_split(e, "vec_id", SEED), "vec_id", k=5, seed=42)


def knn_wide_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 + T7 on 25 features: mean target of the 5 nearest training rows."""
    z = _wide_table(spark, sf_dir)
    train, test = z.where(F.col("part") == fe.TRAIN), z.where(F.col("part") == fe.TEST)
    nb = knn.knn_join(test, train.withColumnRenamed("vec_id", "rid"), qid="vec_id", rid="rid",
                      features=[f"x{i}" for i in range(WIDE)], k=5, payload=["y"])
    p = knn.knn_regress(nb, "vec_id", "y", 5)
    return p.select("vec_id", F.round("prediction", 6).alias("prediction"), "n_neighbours")


def knn_wide_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 + A16 on 25 features: 5-fold CV error for 15 values of k. One search: the
    fold is excluded inside it, so no row is copied to the other folds."""
    z = _wide_table(spark, sf_dir).where(F.col("part") == fe.TRAIN)
    nb = knn.knn_join(z, z.select(F.col("vec_id").alias("rid"), F.col("y").alias("y_ref"), "fold", *[f"x{i}" for i in range(WIDE)]),
                      qid="vec_id", rid="rid", features=[f"x{i}" for i in range(WIDE)], k=max(KNN_KS), payload=["y_ref"], exclude="fold")
    nb = nb.join(z.select("vec_id", "y", "fold"), "vec_id")
    return _curve_with_best(knn.knn_cv_curve(nb, "vec_id", "y", "y_ref", KNN_KS))


def multiple_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: least squares of price on quantity and discount (training part)."""
    tr = model_table(spark, sf_dir).where(F.col("part") == fe.TRAIN)
    m = md.ols_fit(tr, ["l_quantity", "l_discount"], Y).stages[-1]
    spark_ = tr.sparkSession
    c = m.coefficients
    return spark_.createDataFrame(
        [(round(float(m.intercept), 4), round(float(c[0]), 4), round(float(c[1]), 4))],
        "intercept double, b_l_quantity double, b_l_discount double")


def _linear_data(spark, sf_dir):
    mt = model_table(spark, sf_dir)
    train = mt.where(F.col("part") == fe.TRAIN)
    stats = fe.fit_scaler(train, X3)
    z = fe.apply_scaler(mt, stats)
    z = fe.kfold(z, "row_id", k=5, seed=SEED)
    return z, [f"z_{c}" for c in X3]


def _cv_table(spark, rows):
    return spark.createDataFrame([(float(r["regParam"]), float(r["elasticNetParam"]), float(r["alpha"]), float(r["cv_rmse"])) for r in rows],
                                 "reg_param double, elastic_net double, alpha double, cv_rmse double")


# The reference's penalties and L1 ratios.
RIDGE_ALPHAS = [10.0 ** e for e in range(-7, 2)]
L1_RATIOS = [0.01, 0.1, 0.3, 0.5, 0.65, 0.8, 0.9, 0.95, 0.975, 0.99, 1.0]


def ridge_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: ridge over nine penalties, 1e-7 to 10, 5-fold CV."""
    z, zf = _linear_data(spark, sf_dir)
    tr = z.where(F.col("part") == fe.TRAIN)
    st = tr.agg(F.stddev_pop(Y).alias("sd"), F.count(F.lit(1)).alias("n")).first()
    # a fold's fit sees four of the five folds' rows
    settings = [{"alpha": a, "ridge": a, "regParam": md.ridge_reg_param(a, st["sd"], st["n"] * 4 / 5), "elasticNetParam": 0.0}
                for a in RIDGE_ALPHAS]
    return _cv_table(spark, md.cross_validate_moments(spark, md.fold_moments(tr, zf, Y), settings))


def lasso_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: lasso along 100 alphas (alpha_max .. 1e-3 alpha_max), 5-fold CV."""
    z, zf = _linear_data(spark, sf_dir)
    tr = z.where(F.col("part") == fe.TRAIN)
    settings = [{"alpha": a, "l1": a, "l2": 0.0, "regParam": a, "elasticNetParam": 1.0} for a in md.lasso_path(tr, zf, Y)]
    return _cv_table(spark, md.cross_validate_moments(spark, md.fold_moments(tr, zf, Y), settings))


def elastic_net_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: 11 l1-ratios x 100 alphas, 5-fold CV."""
    z, zf = _linear_data(spark, sf_dir)
    tr = z.where(F.col("part") == fe.TRAIN)
    sd = tr.agg(F.stddev_samp(Y)).first()[0]
    path = md.lasso_path(tr, zf, Y)  # of ratio 1; a ratio's path is this one over the ratio
    settings = [{"alpha": a / r, "l1": a, "l2": a / r * (1 - r), **md.elastic_net_params(a / r, r, sd)} for r in L1_RATIOS for a in path]
    return _cv_table(spark, md.cross_validate_moments(spark, md.fold_moments(tr, zf, Y), settings))


def _wide_linear(spark, sf_dir):
    """18 z-scored numeric columns and a category with one 0/1 column per supplier
    seen in training: (training part with folds, numeric names, number of suppliers)."""
    day = F.dayofyear("ship_date") / F.lit(366.0)
    mt = model_table(spark, sf_dir).withColumn("day", day)
    base = [*X3, "day"]
    made = {f"{a}_{b}": F.col(a) * F.col(b) for i, a in enumerate(base) for b in base[i:]}
    made |= {f"{f}{k}": getattr(F, f)(F.col("day") * F.lit(2 * math.pi * k)) for f in ("sin", "cos") for k in (1, 2)}
    mt = mt.select("row_id", "part", Y, "l_suppkey", *base, *[c.alias(n) for n, c in made.items()])
    names = [*base, *made]
    train = mt.where(F.col("part") == fe.TRAIN)
    ids, size = fe.category_ids(train, "l_suppkey")
    z = fe.kfold(fe.apply_scaler(train, fe.fit_scaler(train, names)), "row_id", k=5, seed=SEED)
    z = fe.encode_ids(z, ids, "l_suppkey", size, "supplier")
    return cut_lineage(z.select("fold", Y, "supplier", *[f"z_{c}" for c in names])), [f"z_{c}" for c in names], size


DENSE_CATEGORIES = 512  # up to here all moments are one small matrix a fold


def linear_wide_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7-M9 at the reference's width: 18 numeric and all supplier columns, nine ridge
    penalties and 11 L1 ratios x 100 alphas, 5 folds, from one set of moments."""
    tr, names, size = _wide_linear(spark, sf_dir)
    narrow = size <= DENSE_CATEGORIES
    if narrow:
        folds = md.fold_moments(tr, names, Y, category="supplier", size=size)
    else:
        folds = md.fold_moments(tr, names, Y)
        sums = cp.category_sums(tr, names, Y, tr.agg(F.avg(Y)).first()[0], "supplier", size, "fold")
    total = sum(folds.values())
    path = md.alpha_path(total) if narrow else md.alphas_below(cp.largest_product(sums, total))
    sd = float(np.sqrt((total[-1, -1] / total[0, 0] - (total[0, -1] / total[0, 0]) ** 2) * total[0, 0] / (total[0, 0] - 1)))
    n = total[0, 0]
    settings = [{"alpha": a, "ridge": a, "regParam": md.ridge_reg_param(a, sd, n * 4 / 5), "elasticNetParam": 0.0} for a in RIDGE_ALPHAS]
    settings += [{"alpha": a / r, "l1": a, "l2": a / r * (1 - r), **md.elastic_net_params(a / r, r, sd)} for r in L1_RATIOS for a in path]
    rows = md.cross_validate_moments(spark, folds, settings) if narrow else cp.cross_validate_category(folds, sums, settings)
    return _cv_table(spark, rows).withColumn("columns", F.lit(len(names) + size))


# The reference's forest search space (its criterion is dropped: MLlib has variance only).
FOREST_GRID = {"numTrees": [100, 200, 300, 400], "maxDepth": [5, 6, 7, 8, 9, 10], "featureSubsetStrategy": ["onethird", "sqrt", "log2"]}
FOREST_DRAWS = 54
# one rung: every draw is cross-validated on all rows with all of its trees, as in the reference
FOREST_RUNGS = [(1.0, 1)]


def _tree_table(spark, sf_dir):
    mt = fe.kfold(model_table(spark, sf_dir), "row_id", k=5, seed=SEED)
    if mt.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        mt = mt.repartition("row_id")  # a small file would be one partition and one task of every fit
    return mt


def _parts(mt: DataFrame) -> tuple[DataFrame, DataFrame]:
    return mt.where(F.col("part") == fe.TRAIN), mt.where(F.col("part") == fe.TEST)


def _tree_data(spark, sf_dir):
    return _parts(_tree_table(spark, sf_dir))


def _stored_tree_table(spark, sf_dir, *more: str):
    """The rows of both parts, their keys' hashes worked out once for all passes of a query."""
    return md._Cached(_tree_table(spark, sf_dir), ["part", "fold", Y, *X3, *more])


#: Searches made by this process, by kind, application and table folder: the
#: queries that go on from a search's result run it once.
_SEARCHED: dict[tuple[str, str, str], list[dict]] = {}


def _once(kind: str, spark: SparkSession, sf_dir: str, search) -> list[dict]:
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _SEARCHED:
        _SEARCHED[key] = search()
    return _SEARCHED[key]


def _forest_trials(spark: SparkSession, sf_dir: str, tr: DataFrame, stored: bool = False) -> list[dict]:
    return _once("forest", spark, sf_dir, lambda: md.forest_halving(
        tr, X3, Y, md.sample_grid(FOREST_GRID, FOREST_DRAWS, seed=229), FOREST_RUNGS, stored=stored))


def forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random search: 54 seeded draws of the forest grid, each with 5-fold CV on all rows and trees."""
    with _stored_tree_table(spark, sf_dir) as mt:
        rows = _forest_trials(spark, sf_dir, _parts(mt)[0], True)
    return spark.createDataFrame([(r["numTrees"], r["maxDepth"], r["featureSubsetStrategy"], r["rung"], r["cv_rmse"])
                                  for r in rows], "num_trees int, max_depth int, feature_subset string, rung int, cv_rmse double")


def _best_forest(spark: SparkSession, sf_dir: str, tr: DataFrame, stored: bool = False):
    """The search's best forest, refit on the whole training part."""
    best = md.best_of_search(_forest_trials(spark, sf_dir, tr, stored))
    return md.forest_fit(tr, X3, Y, 6, stored, **{k: best[k] for k in FOREST_GRID})


def _test_metrics(pred: DataFrame, model_name: str) -> DataFrame:
    return regression_metrics(pred, Y, "prediction").withColumn("model", F.lit(model_name))


def forest_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refit the search's best forest on the whole training part, score the test part."""
    with _stored_tree_table(spark, sf_dir) as mt:
        tr, te = _parts(mt)
        got = _test_metrics(_best_forest(spark, sf_dir, tr, True).transform(te), "random_forest")
        return spark.createDataFrame(got.collect(), got.schema)  # a row


def forest_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 + A6 on the tuned model: medians of the features among the worst 10 % of
    the best forest's test residuals and among the rest."""
    with _stored_tree_table(spark, sf_dir, "row_id") as mt:
        tr, te = _parts(mt)
        scored = _best_forest(spark, sf_dir, tr, True).transform(te.select("row_id", Y, *X3))
        scored = cut_lineage(scored.select("row_id", *X3, F.abs(F.col(Y) - F.col("prediction")).alias("abs_residual")))
    worst = ct.flag_worst_fraction(scored, "abs_residual", "row_id", 0.1)
    return ct.median_contrast(worst, ["abs_residual", *X3], "is_extreme")


def fitted_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted models side by side on the test part: mean, least squares, the
    ridge and lasso of least CV error, boosted trees, the tuned forest."""
    tr, te = (cut_lineage(d.select("row_id", "fold", Y, *X3)) for d in _tree_data(spark, sf_dir))
    stats = fe.fit_scaler(tr, X3)
    zf = [f"z_{c}" for c in X3]
    z, zt = fe.apply_scaler(tr, stats), fe.apply_scaler(te, stats)
    folds = md.fold_moments(z, zf, Y)
    total, mean = sum(folds.values()), z.agg(F.avg(Y)).first()[0]
    grids = {"least squares": [{"ridge": 0.0}], "ridge": [{"ridge": a} for a in RIDGE_ALPHAS],
             "lasso": [{"l1": a, "l2": 0.0} for a in md.alpha_path(total)]}
    scored = zt.select(Y, F.lit(mean).alias("prediction"), F.lit("mean").alias("model"))
    for name, grid in grids.items():
        best = min(md.cross_validate_moments(spark, folds, grid), key=lambda s: s["cv_rmse"])
        b = md.penalised_fit(total, *md.penalties(best, total[0, 0]))
        value = sum((F.lit(float(w)) * F.col(c) for w, c in zip(b, zf)), F.lit(float(mean - b @ total[0, 1:-1] / total[0, 0])))
        scored = scored.unionByName(zt.select(Y, value.alias("prediction"), F.lit(name).alias("model")))
    fitted = {"boosted trees": md.gbt_fit(tr, X3, Y, maxDepth=6, stepSize=0.3, maxIter=5), "forest": _best_forest(spark, sf_dir, tr)}
    for name, m in fitted.items():
        scored = scored.unionByName(m.transform(te).select(Y, "prediction", F.lit(name).alias("model")))
    return regression_metrics(scored, Y, "prediction", ["model"])


def gbt_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees, depth 6, step 0.3, 5 rounds."""
    tr, te = _tree_data(spark, sf_dir)
    m = md.gbt_fit(tr, X3, Y, maxDepth=6, stepSize=0.3, maxIter=5)
    return _test_metrics(m.transform(te), "gbt_default")


GBT_DRAWS = 100
# every trial boosts 200 rounds or all of its own; of those with more to come, the ones up
# to the median go on, at last to the end of the longest (see GBT_SPACE's maxIter)
GBT_CHECKPOINTS = [200, 400, 550]


def _gbt_trials(spark, sf_dir):
    """Of the training part 60 % fit, 20 % stop and prune, 20 % score (hash split, seed 42)."""
    def search():
        draw = fe.hash_bucket(F.col("row_id"), 42, 100)
        mt = _tree_table(spark, sf_dir).withColumn("role", F.when(draw < 20, "stop").when(draw < 40, "score").otherwise("fit"))
        with md._Cached(mt, ["part", "role", Y, *X3]) as t:
            return md.gbt_prune(_parts(t)[0], X3, Y, "role", md.gbt_trials(GBT_DRAWS, seed=24), GBT_CHECKPOINTS, stored=True)

    return md.trial_log(spark, "gbt", _once("boosting", spark, sf_dir, search))


def gbt_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 seeded draws of boosted-tree settings with median pruning; a trial that isn't
    pruned boosts all of its own 50 to 550 rounds."""
    return _gbt_trials(spark, sf_dir)


def trial_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial log -> best setting per model."""
    return md.best_trial(_gbt_trials(spark, sf_dir))


def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE after each boosting round on the training and the test part."""
    tr, te = _tree_data(spark, sf_dir)
    pm = md.gbt_fit(tr, X3, Y, maxDepth=4, stepSize=0.3, maxIter=5)
    e_tr, e_te = (md.boosting_curve(pm, d, Y) for d in (tr, te))
    return spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(zip(e_tr, e_te))],
                                 "iteration int, train_rmse double, test_rmse double")


def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M18 + T5: model importances with assembler names, top 15."""
    tr, _ = _tree_data(spark, sf_dir)
    g = md.gbt_fit(tr, X3, Y, maxDepth=4, stepSize=0.3, maxIter=5).stages[-1]
    imp = g.featureImportances.toArray()
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(X3, imp)], "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(15)


def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop in test R^2 of the search's best forest when one feature is permuted, 10 repeats."""
    with _stored_tree_table(spark, sf_dir, "row_id") as mt:
        tr, te = _parts(mt)
        return md.permutation_importance(_best_forest(spark, sf_dir, tr, True), te, X3, Y, key="row_id")
