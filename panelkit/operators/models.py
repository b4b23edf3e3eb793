"""Model fitting with MLlib: least squares, penalised linear models with
cross-validation, forests, boosted trees, searches and importances.

Folds and splits are hash columns (see ``features``), passed to
``CrossValidator(foldCol=...)`` so fold membership is reproducible.
"""

from __future__ import annotations

import json
import random
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_dir
from . import cell_trees as ct
from .evaluate import regression_metrics
from .features import hash_bucket


def assembler(features: list[str], out: str = "features"):
    """Stage turning numeric and vector columns into one vector. A NULL or NaN
    feature is an error, never a dropped row (drop such rows before the fit)."""
    return [VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")]


class _Cached:
    """Persist only the columns a fit needs for the fit's several passes
    (MEMORY_AND_DISK; a lost block is recomputed from lineage), then release.
    ``stored``: the caller has persisted the rows, they aren't stored twice."""

    def __init__(self, df: DataFrame, cols: list[str], stored: bool = False):
        self.df, self.stored = df.select(*dict.fromkeys(cols)), stored
        if not stored:
            self.df = self.df.persist(StorageLevel.MEMORY_AND_DISK)

    def __enter__(self) -> DataFrame:
        return self.df

    def __exit__(self, *exc):
        if not self.stored:
            self.df.unpersist()


def ols_fit(train: DataFrame, features: list[str], label: str):
    """Exact multiple least squares (normal equations, no penalty)."""
    lr = LinearRegression(featuresCol="features", labelCol=label, solver="normal", regParam=0.0)
    with _Cached(train, [*features, label]) as t:
        return Pipeline(stages=assembler(features) + [lr]).fit(t)


def ridge_reg_param(alpha: float, sd_y: float, n: int) -> float:
    """A penalty ``alpha`` on the plain sum of squares, expressed as MLlib's
    regParam on unstandardised (already z-scored) features."""
    return alpha * sd_y / n


def elastic_net_params(alpha: float, ratio: float, sd_y: float) -> dict:
    """An L1 weight alpha * ratio and an L2 weight alpha * (1 - ratio) as MLlib's
    parameters; MLlib divides the L2 part by the label's deviation."""
    reg = alpha * ratio + alpha * (1 - ratio) * sd_y
    return {"regParam": reg, "elasticNetParam": alpha * ratio / reg if reg else 0.0}


def lasso_path(train: DataFrame, zfeatures: list[str], label: str, n_alphas: int = 100,
               eps: float = 1e-3, ratio: float = 1.0) -> list[float]:
    """Geometric path from alpha_max = max_j |x_j . (y - mean y)| / n over the
    L1 ratio down to eps * alpha_max -- one aggregation pass for every feature."""
    ym = train.agg(F.avg(label)).first()[0]
    r = train.agg(F.count(F.lit(1)).alias("n"),
                  *[F.sum(F.col(c) * (F.col(label) - F.lit(ym))).alias(c) for c in zfeatures]).first()
    amax = max(abs(r[c]) for c in zfeatures) / (r["n"] * ratio)
    return [float(a) for a in np.geomspace(amax, amax * eps, n_alphas)]


MOST_WIDTH = 4096  # columns of a design whose moments may reach the driver (128 MB a fold)


def fold_moments(train: DataFrame, zfeatures: list[str], label: str, fold_col: str = "fold",
                 category: str | None = None, size: int = 0) -> dict[int, np.ndarray]:
    """Sums of products of (1, features, [0/1 columns of a category], label - its mean)
    per fold, at most `MOST_WIDTH` columns. A NULL or NaN value is an error, never
    a dropped row.

    ``category``: an id column, 0 .. size - 1, or ``size`` for no column (see
    `features.encode_ids`). Its 0/1 columns are never built: their products are
    the counts and sums by fold and id, one grouped aggregation, and the
    numeric block is one more.
    """
    ym = train.agg(F.avg(label)).first()[0]
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in zfeatures], F.col(label).cast("double") - F.lit(ym)]
    if len(cols) + size > MOST_WIDTH:
        raise ValueError(f"{len(cols) + size} columns are over {MOST_WIDTH}")
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    bad = F.lit(False)
    for c in cols[1:]:
        bad = bad | c.isNull() | F.isnan(c)
    out, q, width = {}, len(cols), len(cols) + size
    place = [*range(q - 1), width - 1]  # the label comes last
    for r in train.groupBy(fold_col).agg(F.count_if(bad).alias("bad"), *[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i, j in pairs]).collect():  # one row a fold
        if r["bad"]:
            raise ValueError(f"{r['bad']} rows have a NULL or NaN feature or label")
        m = np.zeros((width, width))
        for i, j in pairs:
            m[place[i], place[j]] = m[place[j], place[i]] = r[f"s{i}_{j}"]
        out[r[fold_col]] = m
    if category:
        known = train.where(F.col(category) < size)
        for r in known.groupBy(fold_col, category).agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]).collect():  # folds x size rows
            m, k = out[r[fold_col]], q - 1 + int(r[category])
            for i in range(q):
                m[place[i], k] = m[k, place[i]] = r[f"s{i}"]
            m[k, k] = r["s0"]
    return out


def alpha_path(m: np.ndarray, n_alphas: int = 100, eps: float = 1e-3) -> list[float]:
    """`lasso_path` from the moments of all rows."""
    return alphas_below(float(np.abs(_centred(m)[1]).max()), n_alphas, eps)


def alphas_below(most: float, n_alphas: int = 100, eps: float = 1e-3) -> list[float]:
    return [float(a) for a in np.geomspace(most, most * eps, n_alphas)]


def _centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, means = m[0, 0], m[0, 1:] / m[0, 0]
    c = m[1:, 1:] / n - np.outer(means, means)
    return c[:-1, :-1], c[:-1, -1]


def _feature_sign(g: np.ndarray, r: np.ndarray, x: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """The minimum of x g x / 2 - r x + l1 |x|_1 + l2 |x|^2 / 2, from a start x
    (feature-sign search: Lee, Battle, Raina and Ng 2007).

    Coordinates at zero whose gradient exceeds l1 join the support with its
    sign; the linear system of the support and its signs is solved; of the
    points on the way there where a coordinate changes sign, the best is taken.
    Every step lowers the objective, so no support comes twice.
    """
    x, slack = x.copy(), 1e-9 * max(l1, float(np.abs(r).max(initial=0)))
    sign, widest = np.sign(x), 0.25
    for _ in range(50 * len(r) + 100):
        gradient = r - g @ x - l2 * x
        off = np.flatnonzero((x == 0) & (np.abs(gradient) > l1 + slack))
        on = x != 0
        settled = (np.abs(gradient - l1 * np.sign(x))[on] <= slack).all()
        if settled and not len(off):
            break
        if settled:
            sign = np.sign(x)
            join = off[np.argsort(-np.abs(gradient[off]))[:max(1, int(widest * len(off)))]]
            sign[join] = np.sign(gradient[join])
        live = np.flatnonzero(sign)
        h = g[np.ix_(live, live)] + l2 * np.eye(len(live))
        h[np.diag_indices(len(live))] += 1e-13 * np.trace(h) / len(live)
        goal = np.linalg.solve(h, r[live] - l1 * sign[live])
        here, move = x[live], goal - x[live]
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = -here / move
        stops = np.unique(np.append(cross[(cross > 0) & (cross < 1)], 1.0))
        points = here[:, None] + move[:, None] * stops
        points[np.abs(points) <= 1e-14 * np.abs(goal).max(initial=0)] = 0
        cost = 0.5 * (points * (h @ points)).sum(axis=0) - r[live] @ points + l1 * np.abs(points).sum(axis=0)
        now = 0.5 * here @ h @ here - r[live] @ here + l1 * np.abs(here).sum()
        best = int(cost.argmin())
        if cost[best] >= now:  # several new coordinates pulled against each other, or rounding
            if widest == 0:
                break
            widest, sign = 0, np.sign(x)
            continue
        x[live] = points[:, best]
        sign = np.sign(x)
    return x


def penalised_paths(m: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """Coefficients (columns) of `penalised_fit` for many (l1, l2), each started from
    the one with the next larger l1. Settings without an L1 part are linear systems."""
    g, r = _centred(m)
    b, x = np.zeros((len(r), len(l1))), np.zeros(len(r))
    for k in np.argsort(-l1, kind="stable"):
        if l1[k] > 0:
            b[:, k] = x = _feature_sign(g, r, x, l1[k], l2[k])
        else:
            b[:, k] = np.linalg.lstsq(g + l2[k] * np.eye(len(r)), r, rcond=None)[0]
    return b


def penalised_fit(m: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Coefficients that minimise RSS / 2n + l1 |b|_1 + l2 |b|^2 / 2 with a free
    intercept, from the moments of (1, features, label)."""
    return penalised_paths(m, np.array([l1]), np.array([l2]))[:, 0]


def penalties(s: dict, n: float) -> tuple[float, float]:
    return (0.0, s["ridge"] / n) if "ridge" in s else (s["l1"], s["l2"])


def cross_validate_moments(spark: SparkSession, folds: dict[int, np.ndarray], settings: list[dict], group: int = 100) -> list[dict]:
    """Mean held-out RMSE of every setting; l1 and l2 as in `penalised_fit`, or `ridge`,
    a penalty on the plain sum of squares. No further pass over the rows: each
    (fold, `group` settings) is one task that solves its settings together."""
    total, names = sum(folds.values()), sorted(folds)
    shared = spark.sparkContext.broadcast([(total - folds[f], folds[f]) for f in names])  # at most MOST_WIDTH squared numbers a fold
    jobs = [(f, i) for f in range(len(names)) for i in range(0, len(settings), group)]

    def run(batches):
        for batch in batches:
            for f, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m, held = shared.value[f]
                l1, l2 = np.array([penalties(s, m[0, 0]) for s in settings[first:first + group]]).T
                b = penalised_paths(m, l1, l2)
                intercept = (m[0, -1] - m[0, 1:-1] @ b) / m[0, 0]
                v = np.concatenate([-intercept[None], -b, np.ones((1, len(l1)))])
                rmse = np.sqrt(np.maximum(((held @ v) * v).sum(axis=0), 0) / held[0, 0])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(l1))), pa.array(rmse)], ["setting", "rmse"])

    tasks = spark.createDataFrame(jobs, "fold int, first int").repartition(len(jobs), "fold", "first")
    got = tasks.mapInArrow(run, "setting long, rmse double").groupBy("setting").agg(F.avg("rmse").alias("rmse")).collect()  # a row per setting
    score = {r["setting"]: r["rmse"] for r in got}
    return [dict(s, cv_rmse=float(score[i])) for i, s in enumerate(settings)]


def sample_grid(grid: dict[str, list], n: int, seed: int) -> list[dict]:
    """A seeded random subset of a full parameter grid (random search)."""
    keys = sorted(grid)
    full = [dict(zip(keys, vals)) for vals in _product([grid[k] for k in keys])]
    rnd = random.Random(seed)
    return rnd.sample(full, min(n, len(full)))


def _product(lists):
    if not lists:
        yield ()
        return
    for v in lists[0]:
        for rest in _product(lists[1:]):
            yield (v, *rest)


def tree_tables(spark: SparkSession, model) -> list[np.ndarray]:
    """A fitted forest's trees as arrays of nodes (feature or -1, threshold, left,
    right, prediction), read from its saved form. The model is bounded by its
    settings (trees x 2^depth nodes) and lives on the driver anyway."""
    path = scratch_dir(spark, "forest")
    model.write().save(path)
    n = F.col("nodeData")
    rows = spark.read.parquet(path + "/data").select(
        "treeID", n["id"].alias("id"), n["split"]["featureIndex"].alias("feature"), n["split"]["leftCategoriesOrThreshold"].alias("cut"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["prediction"].alias("prediction")).toPandas()
    trees = []
    for _, t in sorted(rows.groupby("treeID"), key=lambda x: x[0]):
        t = t.sort_values("id")
        leaf = t["left"].to_numpy() < 0
        cut = np.array([c[0] if len(c) else 0.0 for c in t["cut"]])
        trees.append(np.stack([np.where(leaf, -1, t["feature"]), cut, t["left"], t["right"], t["prediction"]], axis=1).astype(float))
    return trees


def forest_errors(rows: DataFrame, features: list[str], label: str, trees: list[np.ndarray], counts: list[int], depths: list[int]) -> dict:
    """{(trees, depth): squared error} of a forest's first trees cut at a depth, and
    the row count under None, from one pass.

    MLlib grows a forest level by level from one seed per tree, so a smaller or
    shallower forest is a prefix of a larger one (up to its random choice of
    features per node): one fit scores every such setting.
    """
    offsets = np.cumsum([0] + [len(t) for t in trees])
    nodes = np.concatenate(trees)
    feature, cut, value = nodes[:, 0].astype(int), nodes[:, 1], nodes[:, 4]
    shift = np.repeat(offsets[:-1], np.diff(offsets))
    left, right = (np.where(feature >= 0, nodes[:, c].astype(int) + shift, np.arange(len(nodes))) for c in (2, 3))
    root, feature = offsets[:-1], np.maximum(feature, 0)

    def run(batches):
        total, n = np.zeros((len(depths), len(counts))), 0
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                x = np.stack([b.column(f).to_numpy(zero_copy_only=False) for f in features], axis=1).astype(float)
                y, at = b.column(label).to_numpy(zero_copy_only=False).astype(float), np.tile(root, (b.num_rows, 1))
                for depth in range(max(depths) + 1):
                    if depth:
                        go_left = np.take_along_axis(x, feature[at], 1) <= cut[at]
                        at = np.where(go_left, left[at], right[at])
                    if depth in depths:
                        mean = np.cumsum(value[at], axis=1)[:, [c - 1 for c in counts]] / counts
                        total[depths.index(depth)] += ((mean - y[:, None]) ** 2).sum(axis=0)
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["n", "sse"])

    parts = rows.select(*features, label).mapInArrow(run, "n long, sse array<double>")
    cells = [(c, d) for d in depths for c in counts]
    r = parts.agg(F.sum("n").alias("n"), *[F.sum(F.get("sse", F.lit(i))).alias(f"s{i}") for i in range(len(cells))]).first()
    return {None: r["n"], **{cell: r[f"s{i}"] for i, cell in enumerate(cells)}}


def forest_cv(train: DataFrame, features: list[str], label: str, settings: list[dict], fold_col: str = "fold", seed: int = 6,
              parallelism: int = 4, share: float = 1.0, stored: bool = False) -> list[dict]:
    """Mean held-out RMSE over the folds of every setting (numTrees, maxDepth,
    featureSubsetStrategy). Settings that differ only in trees and depth share
    one fit per fold. `share` fits on that part of the rows (by hash) with that
    part of the trees; the held-out rows are always all of a fold. Tables with
    more rows than cells, or many trees, grow from cells' sums (see `cell_trees`)."""
    trees_of = {s["numTrees"]: max(1, round(s["numTrees"] * share)) for s in settings}
    strategies = sorted({s["featureSubsetStrategy"] for s in settings})
    if share < 1:
        train = train.select(*features, label, fold_col, F.pmod(F.xxhash64(*features, label, fold_col, F.lit("share")), F.lit(1 << 20)).alias("_draw"))
    drawn = F.col("_draw") < int(share * (1 << 20)) if share < 1 else F.lit(True)
    with _Cached(train, [*features, label, fold_col, *(["_draw"] if share < 1 else [])], stored and share == 1) as t:
        folds = [r[0] for r in t.select(fold_col).distinct().sort(fold_col).collect()]
        jobs = [(strategy, f) for strategy in strategies for f in folds]
        if cells := ct.worth_cells(t, features, label, max(trees_of.values()) * len(jobs)):
            errors = ct.forest_cv_errors(t.where(drawn), ct.cell_sums(t, cells, label, fold_col), cells, label, fold_col, folds,
                                         strategies, sorted(set(trees_of.values())), sorted({s["maxDepth"] for s in settings}), seed)
            return [dict(s, cv_rmse=float(np.mean([errors[s["featureSubsetStrategy"], f][trees_of[s["numTrees"]], s["maxDepth"]] for f in folds])))
                    for s in settings]

        def one(job):
            strategy, f = job
            own = [s for s in settings if s["featureSubsetStrategy"] == strategy]
            part = t.where((F.col(fold_col) != f) & drawn)
            fit = _forest_on_rows(part, features, label, seed, numTrees=max(trees_of[s["numTrees"]] for s in own),
                                  maxDepth=max(s["maxDepth"] for s in own), featureSubsetStrategy=strategy)
            got = forest_errors(t.where(F.col(fold_col) == f), features, label, tree_tables(train.sparkSession, fit.stages[-1]),
                                sorted({trees_of[s["numTrees"]] for s in own}), sorted({s["maxDepth"] for s in own}))
            return {(trees, depth): (sse / got[None]) ** 0.5 for (trees, depth), sse in ((c, v) for c, v in got.items() if c)}

        with ThreadPool(parallelism) as pool:
            errors = dict(zip(jobs, pool.map(inheritable_thread_target(train.sparkSession)(one), jobs, chunksize=1)))
    return [dict(s, cv_rmse=float(np.mean([errors[s["featureSubsetStrategy"], f][trees_of[s["numTrees"]], s["maxDepth"]] for f in folds])))
            for s in settings]


def forest_halving(train: DataFrame, features: list[str], label: str, settings: list[dict],
                   rungs: list[tuple[float, int]], **options) -> list[dict]:
    """Successive halving: each rung (share, keep) scores the settings left by
    `forest_cv` on a share of rows and trees and keeps the best `keep`. Each
    setting comes back with its last rung (from 0) and score. [(1.0, 1)] is the
    exact full search."""
    left, out = list(range(len(settings))), [dict(s) for s in settings]
    for k, (share, keep) in enumerate(rungs):
        scored = forest_cv(train, features, label, [settings[i] for i in left], share=share, **options)
        for i, s in zip(left, scored):
            out[i].update(rung=k, cv_rmse=s["cv_rmse"])
        left = sorted(left, key=lambda i: (out[i]["cv_rmse"], i))[:keep]
    return out


def best_of_search(rows: list[dict]) -> dict:
    """The best setting among those that reached the last rung."""
    return min(rows, key=lambda r: (-r["rung"], r["cv_rmse"]))


def forest_fit(train: DataFrame, features: list[str], label: str, seed: int = 6, stored: bool = False, **params):
    """A fitted forest with `transform`: from cells' sums where the rows outnumber the
    cells and only trees, depth and subset are set, else MLlib's pipeline on the rows."""
    if set(params) == {"numTrees", "maxDepth", "featureSubsetStrategy"}:
        with _Cached(train, [*features, label], stored) as t:
            if cells := ct.worth_cells(t, features, label):
                return ct.forest_model(t, cells, label, params["numTrees"], params["maxDepth"], params["featureSubsetStrategy"], seed)
    return _forest_on_rows(train, features, label, seed, **params)


def _forest_on_rows(train: DataFrame, features: list[str], label: str, seed: int, **params):
    rf = RandomForestRegressor(featuresCol="features", labelCol=label, seed=seed, **params)
    with _Cached(train, [*features, label]) as t:
        return Pipeline(stages=assembler(features) + [rf]).fit(t)


def gbt_fit(train: DataFrame, features: list[str], label: str, seed: int = 42,
            validation_col: str | None = None, **params):
    """Boosted trees; with ``validation_col`` (boolean) those rows only measure
    the validation error and boosting stops once it no longer improves.

    Where the rows outnumber the cells (see `cell_trees`), the trees are fitted on
    the cells' mean labels weighted by their rows, which gives the same splits."""
    if set(params) <= {"maxDepth", "stepSize", "maxIter"} and not validation_col:
        with _Cached(train, [*features, label]) as t:
            if cells := ct.worth_cells(t, features, label):
                return _gbt_on_cells(t, cells, label, seed, params)
    if validation_col:
        params["validationIndicatorCol"] = validation_col
    gbt = GBTRegressor(featuresCol="features", labelCol=label, seed=seed, **params)
    with _Cached(train, [*features, label, *([validation_col] if validation_col else [])]) as t:
        return Pipeline(stages=assembler(features) + [gbt]).fit(t)


def _gbt_on_cells(rows: DataFrame, cells: ct.Cells, label: str, seed: int, params: dict) -> PipelineModel:
    bins = [f"_bin_{f}" for f in cells.features]
    # a bucket holds its lower end, a cell's bin its upper end; a constant feature has one bin
    splits = [[-np.inf, *(np.nextafter(c, np.inf).tolist() if c else [np.finfo(float).max]), np.inf] for c in cells.cuts]
    stages = [Bucketizer(inputCols=cells.features, outputCols=bins, splitsArray=splits), *assembler(bins)]
    # as many bins as make MLlib look at every cell for its cuts
    gbt = GBTRegressor(featuresCol="features", labelCol=label, seed=seed, weightCol="_n", maxBins=192, **params)
    table = stages[1].transform(_by_bins(stages[0].transform(rows), bins, label)).select("features", label, "_n")
    with _Cached(table, table.columns) as t:
        return PipelineModel(stages=[*stages, gbt.fit(t)])


def _by_bins(rows: DataFrame, bins: list[str], label: str) -> DataFrame:
    """One row per combination of bins: rows, mean label and squared deviation from it."""
    y = F.col(label).cast("double")
    # without Bucketizer's metadata, which would make the bins categories
    return rows.groupBy(*[F.col(b).alias(b, metadata={}) for b in bins]).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg(y).alias(label),
                                   (F.var_pop(y) * F.count(F.lit(1))).alias("_within"))


def boosting_curve(fit: PipelineModel, rows: DataFrame, label: str) -> list[float]:
    """RMSE after each boosting round of `gbt_fit`'s model."""
    first, model = fit.stages[0], fit.stages[-1]
    if not isinstance(first, Bucketizer):
        return [float(e) ** 0.5 for e in model.evaluateEachIteration(fit.transform(rows), "squared")]
    trees, weights = model.trees, model.treeWeights
    data = fit.stages[1].transform(_by_bins(first.transform(rows), first.getOutputCols(), label)).select("features", label, "_n", "_within")
    at = F.lit(0.0)
    errors = []
    with _Cached(data, data.columns) as t:
        for k, (tree, w) in enumerate(zip(trees, weights)):
            t = tree.setPredictionCol(f"_p{k}").setFeaturesCol("features").transform(t)
            at = at + F.lit(float(w)) * F.col(f"_p{k}")
            errors.append(F.sum(F.col("_within") + F.col("_n") * (F.col(label) - at) * (F.col(label) - at)).alias(f"e{k}"))
        r = t.agg(F.sum("_n").alias("n"), *errors).first()
    return [(r[f"e{k}"] / r["n"]) ** 0.5 for k in range(len(trees))]


# The reference's boosted-tree search space (name -> (low, high, kind));
# its L1 and L2 weights have no counterpart in MLlib.
GBT_SPACE = {
    "maxDepth": (3, 10, "int"),
    "stepSize": (0.01, 1.0, "log"),
    "maxIter": (50, 550, "int"),
    "minInstancesPerNode": (4, 11, "int"),
    "minInfoGain": (1e-8, 1.0, "log"),
    "subsamplingRate": (0.5, 1.0, "log"),
    "featureSubsetStrategy": (0.5, 1.0, "share"),
}


def gbt_trials(n: int, seed: int) -> list[dict]:
    """Seeded random draws from ``GBT_SPACE`` (int / log-float / feature share)."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        t = {}
        for k, (lo, hi, kind) in GBT_SPACE.items():
            if kind == "int":
                t[k] = rnd.randint(lo, hi)
            else:
                v = float(np.exp(rnd.uniform(np.log(lo), np.log(hi))))
                t[k] = f"{v:.3f}" if kind == "share" else v
        out.append(t)
    return out


def gbt_prune(rows: DataFrame, features: list[str], label: str, role: str, trials: list[dict], checkpoints: list[int],
              seed: int = 42, parallelism: int = 8, stored: bool = False) -> list[dict]:
    """Boosted-tree trials with median pruning.

    ``role`` marks the rows that fit ('fit'), stop ('stop') and score ('score').
    At each checkpoint every live trial has boosted that many rounds (or its own
    maxIter); its curve is the error on the stop rows after each round, and it
    goes on if its best error so far is no worse than the median of the live
    trials. The rounds it keeps are those up to its best; only then do the
    score rows rate it, so they neither stop nor choose anything. Returns each
    trial with `rounds` (really run), `best_round`, `stop_rmse` and `rmse`.
    Where the rows outnumber the cells or the rounds are many (see `cell_trees`),
    the trees grow from the cells' sums of each round's rows, by the same rule.
    """
    most = max(checkpoints)
    with _Cached(rows, [*features, label, role], stored) as t:
        if cells := ct.worth_cells(t, features, label, sum(min(most, x["maxIter"]) for x in trials)):
            with ct.Boosting(t, cells, label, role, trials, seed) as boosting:
                return _prune_curves(trials, boosting.advance, checkpoints)
    out: list[dict] = [{} for _ in trials]
    models: dict[int, object] = {}
    live = list(range(len(trials)))
    data = assembler(features)[0].transform(rows).select("features", label, role)
    with _Cached(data, data.columns) as t:
        fit_rows, stop_rows, score_rows = (t.where(F.col(role) == r) for r in ("fit", "stop", "score"))

        def boost(job: tuple[int, int]) -> None:
            i, most = job
            rounds = min(most, trials[i]["maxIter"])
            gbt = GBTRegressor(featuresCol="features", labelCol=label, seed=seed, **{**trials[i], "maxIter": rounds})
            m = gbt.fit(fit_rows)
            curve = _ten_digits(m.evaluateEachIteration(stop_rows, "squared"))
            best = int(np.argmin(curve))
            models[i] = m
            out[i] = {"rounds": rounds, "best_round": best + 1, "stop_rmse": curve[best] ** 0.5}

        def rate(i: int) -> None:
            curve = models[i].evaluateEachIteration(score_rows, "squared")
            out[i]["rmse"] = float(curve[out[i]["best_round"] - 1]) ** 0.5

        with ThreadPool(parallelism) as pool:
            for most in checkpoints:
                pool.map(inheritable_thread_target(rows.sparkSession)(boost), [(i, most) for i in live], chunksize=1)
                middle = float(np.median([out[i]["stop_rmse"] for i in live]))
                live = [i for i in live if out[i]["stop_rmse"] <= middle and trials[i]["maxIter"] > most]
                if not live:
                    break
            pool.map(inheritable_thread_target(rows.sparkSession)(rate), list(models), chunksize=1)
    return [dict(t, **o) for t, o in zip(trials, out)]


def _ten_digits(curve: list[float]) -> list[float]:
    """The tasks' sums come in any order, and equal rows must give equal choices."""
    return [float(f"{e:.10g}") for e in curve]


def _prune_curves(trials: list[dict], advance, checkpoints: list[int]) -> list[dict]:
    """The rule of `gbt_prune` on the (stop, score) curves that `advance` goes on with."""
    out: list[dict] = [{} for _ in trials]
    curves: list[tuple[list[float], list[float]]] = [([], []) for _ in trials]
    live = list(range(len(trials)))
    for before, most in zip([0, *checkpoints], checkpoints):
        for i, more in advance(live, before, most).items():
            for curve, errors in zip(curves[i], more):
                curve.extend(errors)
        for i in live:
            stop, score = _ten_digits(curves[i][0]), curves[i][1]
            best = int(np.argmin(stop))
            out[i] = {"rounds": len(stop), "best_round": best + 1, "stop_rmse": float(stop[best]) ** 0.5, "rmse": float(score[best]) ** 0.5}
        middle = float(np.median([out[i]["stop_rmse"] for i in live]))
        live = [i for i in live if out[i]["stop_rmse"] <= middle and trials[i]["maxIter"] > most]
        if not live:
            break
    return [dict(t, **o) for t, o in zip(trials, out)]


def trial_log(spark, model_name: str, trials: list[dict]) -> DataFrame:
    """One row per trial: its drawn parameters, the rounds really run and its errors."""
    result = ("rounds", "best_round", "stop_rmse", "rmse")
    return spark.createDataFrame([(model_name, i, json.dumps({k: v for k, v in t.items() if k not in result}, sort_keys=True),
                                   t["rounds"], t["best_round"], t["stop_rmse"], t["rmse"]) for i, t in enumerate(trials)],
                                 "model string, trial int, params string, rounds int, best_round int, stop_rmse double, rmse double")


def best_trial(log: DataFrame) -> DataFrame:
    """Per model the trial with the lowest score (ties: lowest trial number)."""
    return log.groupBy("model").agg(
        F.min_by(F.struct("trial", "params", "rounds", "best_round", "rmse"), F.struct("rmse", "trial")).alias("b")).select(
        "model", "b.trial", "b.params", "b.rounds", "b.best_round", "b.rmse")


def _places(key: str, seed: int, n: int, bucket_rows: int = 100_000) -> list:
    """A row's bucket and its order within it."""
    return [hash_bucket(F.col(key), seed, max(1, -(-n // bucket_rows))), hash_bucket(F.col(key), seed + 1, 1 << 30)]


def random_place(df: DataFrame, key: str, seed: int, n: int, bucket_rows: int = 100_000) -> DataFrame:
    """Adds _place, a gapless random place from 0: rows are numbered within hash
    buckets of about `bucket_rows` rows, and the buckets' counts give the offsets."""
    bucket, order = _places(key, seed, n, bucket_rows)
    d = df.withColumn("_b", bucket).withColumn("_h", order)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    offsets = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_b").orderBy("_h", key)
    return d.join(offsets, "_b").withColumn("_place", F.col("_before") + F.row_number().over(within) - 1).drop("_b", "_h", "_before")


def permutation_importance(model, test: DataFrame, features: list[str], label: str, key: str,
                           repeats: int = 10, seed: int = 24) -> DataFrame:
    """Drop in R^2 when one feature is permuted, per feature and repeat.

    One deal serves all: rows get random places in a circle, and in a repeat a
    row takes the values of the row a random number of places ahead, a
    permutation of all rows. Every row sends its feature values to its takers
    in one shuffle; the rows with one feature replaced are scored together, and
    one aggregation gives every R^2. A model that sees only cells gets the same
    places, but blocks of cells are sent (see `cell_trees.permuted_errors`).
    """
    spark = test.sparkSession
    rows = test.select(key, label, *features)
    n = rows.count()
    if n < 2:
        raise ValueError("a permutation needs at least two rows")
    ahead = random.Random(seed).sample(range(1, n), repeats) if n > repeats else [1 + i % (n - 1) for i in range(repeats)]
    if isinstance(model, ct.CellModel) and sorted(features) == sorted(model.cells.features):
        order = [*_places(key, seed, n), F.col(key)]
        sst = test.agg(F.var_pop(label) * F.count(label)).first()[0]
        sse = ct.permuted_errors(model, rows, label, order, ahead)
        return spark.createDataFrame([(f, k, (sse[f, k] - sse["", -1]) / sst) for f in features for k in range(repeats)],
                                     "feature string, repeat int, r2_drop double")
    placed = cut_lineage(random_place(rows, key, seed, n))
    values = F.struct(*[F.col(f) for f in features])
    sent = placed.select(values.alias("_v"), F.posexplode(F.array(*[F.pmod(F.col("_place") - F.lit(a), F.lit(n)) for a in ahead]))
                         .alias("repeat", "_place"))
    dealt = sent.join(placed, "_place")
    swapped = [F.struct(F.lit(f).alias("feature"), *[(F.col("_v")[g] if g == f else F.col(g)).alias(g) for g in features]) for f in features]
    every = dealt.select("repeat", label, F.explode(F.array(*swapped)).alias("_s")).select("repeat", label, "_s.*")
    plain = placed.select(F.lit(-1).alias("repeat"), label, F.lit("").alias("feature"), *features)
    r2 = regression_metrics(model.transform(every.unionByName(plain)), label, "prediction", ["feature", "repeat"])
    got = {(r["feature"], r["repeat"]): r["r2"] for r in r2.collect()}  # features x repeats + 1 rows
    base = got["", -1]
    return spark.createDataFrame([(f, k, float(base - got[f, k])) for f in features for k in range(repeats)],
                                 "feature string, repeat int, r2_drop double")
