"""Queries for features, evaluation and residual contrast over lineitem.

The stand-in model table: one row per lineitem (``row_id`` = 60-bit md5 of
the business key; joins use (l_orderkey, row_id), which stays unique even
where 60-bit hashes would collide at 10^11+ rows), response ``l_extendedprice``, split 80/20 by key hash (seed 229).
Two closed-form predictors are fitted on the training part only: least
squares on ``l_quantity`` and the training mean per ``l_returnflag``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contrast as ct
from ..operators import evaluate as ev
from ..operators import features as fe
from ..operators.clean import null_profile
from ..session import cut_lineage, scratch_dir
from .common import table

SEED = 229
Y = "l_extendedprice"
NUMERIC = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    base = li.select("l_orderkey", row_key(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).alias("row_id"),
                     "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice",
                     "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("ship_date"))
    return fe.hash_split(base, "row_id", SEED)


def row_key(cols: list[str]):
    """Stable row id from the business key: the first 15 hex digits of md5."""
    txt = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(txt), 1, 15), 16, 10).cast("long")


JOIN_KEY = ["l_orderkey", "row_id"]


def _ols_coef(train: DataFrame, x: str, y: str) -> tuple[float, float]:
    r = train.agg(F.round(F.regr_slope(y, x), 6).alias("b"), F.round(F.regr_intercept(y, x), 6).alias("a")).first()
    return r["a"], r["b"]


def _ols_prediction_col(mt: DataFrame):
    """The fitted model as a column expression (coefficients are two literals)."""
    a, b = _ols_coef(mt.where(F.col("part") == fe.TRAIN), "l_quantity", Y)
    return F.lit(a) + F.lit(b) * F.col("l_quantity")


def _ols_predictions(mt: DataFrame) -> DataFrame:
    return mt.select(*JOIN_KEY, _ols_prediction_col(mt).alias("prediction"))


def _group_mean_predictions(mt: DataFrame) -> DataFrame:
    gm = (mt.where(F.col("part") == fe.TRAIN).groupBy("l_returnflag")
            .agg(F.round(F.avg(Y), 2).alias("prediction")))
    return mt.select(*JOIN_KEY, "l_returnflag").join(gm, "l_returnflag", "inner").select(*JOIN_KEY, "prediction")


def hash_split_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return fe.hash_split(o, "o_orderkey", SEED).withColumn(
        "bucket", fe.hash_bucket(F.col("o_orderkey"), SEED, 100))


def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: shuffled folds (hash of key and seed) and unshuffled contiguous
    folds in key order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    o = fe.kfold(o, "o_orderkey", k=5, seed=SEED)
    return fe.kfold_contiguous(o, "o_orderkey", k=5, col="fold_contiguous")


def one_hot_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fe.hash_split(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", SEED)
    cats = fe.fit_categories(c.where(F.col("part") == fe.TRAIN), "c_mktsegment")
    return fe.one_hot(c, "c_mktsegment", cats, prefix="seg_is_").drop("c_mktsegment")


def unseen_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14 + A12: share of test rows whose category (name/brand) is unseen in training."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_name", "p_brand").alias("cat"))
    p = fe.hash_split(p, "p_partkey", SEED)
    train, test = p.where(F.col("part") == fe.TRAIN), p.where(F.col("part") == fe.TEST)
    unseen = fe.unseen_rows(test, train, "cat").select("p_partkey", F.lit(1).alias("u"))
    t = test.join(unseen, "p_partkey", "left")
    return t.agg(F.count(F.lit(1)).alias("n_test"), F.count("u").alias("n_unseen"),
                 F.round(F.avg(F.coalesce(F.col("u"), F.lit(0))), 6).alias("unseen_share"))


def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    mt = model_table(spark, sf_dir)
    cols = ["l_quantity", "l_discount", "l_tax"]
    stats = fe.fit_scaler(mt.where(F.col("part") == fe.TRAIN), cols)
    z = fe.apply_scaler(mt.select("row_id", "part", *cols), stats)
    return z.select("row_id", "part", *[F.round(f"z_{c}", 6).alias(f"z_{c}") for c in cols])


def simple_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr = model_table(spark, sf_dir).where(F.col("part") == fe.TRAIN)
    return tr.agg(F.count(F.lit(1)).alias("n"),
                  F.round(F.regr_slope(Y, "l_quantity"), 6).alias("slope"),
                  F.round(F.regr_intercept(Y, "l_quantity"), 6).alias("intercept"),
                  F.round(F.regr_r2(Y, "l_quantity"), 6).alias("r2"))


def residuals_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 + M19: predictions go to a keyed table, come back, and join on row_id."""
    mt = model_table(spark, sf_dir)
    path = scratch_dir(spark, "predictions")
    _ols_predictions(mt).write.mode("overwrite").parquet(path)
    preds = spark.read.parquet(path)
    test = mt.where(F.col("part") == fe.TEST).select(*JOIN_KEY, Y)
    return ev.residuals(test, preds, JOIN_KEY, Y).select("row_id", Y, "prediction", "residual")


def _test_residuals(spark, sf_dir):
    """Test rows with prediction and residual. The prediction is a function of
    the row's own columns, so it is a projection -- no join back."""
    # several passes follow (fit, flag thresholds, output): read the narrow
    # model table from the checkpoint folder instead of re-hashing every row
    mt = cut_lineage(model_table(spark, sf_dir))
    pred = _ols_prediction_col(mt)
    test = mt.where(F.col("part") == fe.TEST)
    return (test.withColumn("prediction", pred)
                .withColumn("residual", F.col(Y) - F.col("prediction"))
                .withColumn("abs_residual", F.abs("residual")))


def regression_metrics_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    mt = model_table(spark, sf_dir)
    r = mt.withColumn("prediction", _ols_prediction_col(mt))
    m = ev.regression_metrics(r, Y, "prediction", ["part"])
    return m.select("part", "n", *[F.round(c, 6).alias(c) for c in ("r2", "rmse", "mae", "mape")])


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    mt = model_table(spark, sf_dir)
    test = mt.where(F.col("part") == fe.TEST)
    ols = test.select(Y, _ols_prediction_col(mt).alias("prediction"), F.lit("ols_quantity").alias("model"))
    gm = (test.select(*JOIN_KEY, Y).join(_group_mean_predictions(mt), JOIN_KEY)
              .select(Y, "prediction", F.lit("mean_by_flag").alias("model")))
    long = ols.unionByName(gm)
    m = ev.regression_metrics(long, Y, "prediction", ["model"])
    return m.select("model", "n", *[F.round(c, 6).alias(c) for c in ("r2", "rmse", "mae")])


def worst_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 + T2: the worst 10 % by absolute residual, and the contrast group as
    the bottom floor(0.9 n) rows (with n not divisible by 10 a row can be in
    neither group)."""
    r = ct.flag_contrast_groups(_test_residuals(spark, sf_dir), "abs_residual", "row_id", 0.1,
                                complement="bottom")
    return r.select("row_id", F.round("abs_residual", 6).alias("abs_residual"), "is_extreme", "is_other")


def worst_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _test_residuals(spark, sf_dir)
    return (r.orderBy(F.col("abs_residual").desc(), F.col("row_id").asc()).limit(1)
             .select("row_id", "l_quantity", "l_returnflag", F.round("residual", 6).alias("residual")))


def _flagged(spark, sf_dir):
    return ct.flag_worst_fraction(_test_residuals(spark, sf_dir), "abs_residual", "row_id", 0.1)


def value_shares_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ct.value_shares(_flagged(spark, sf_dir), "ship_date", "is_extreme")
    return s.select("ship_date", "n_extreme", "n_all", F.round("share_extreme", 6).alias("share_extreme"),
                    F.round("share_all", 6).alias("share_all"))


def share_lift_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ct.share_lift(_flagged(spark, sf_dir), "l_suppkey", "is_extreme", top=25)
    return s.select("l_suppkey", "n_extreme", "n_all", F.round("lift", 6).alias("lift"))


def median_contrast_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ct.median_contrast(_flagged(spark, sf_dir), NUMERIC, "is_extreme", round_to=4)
    return m.select("feature", "extreme", "others", F.round("pct_diff", 6).alias("pct_diff"))


def histogram_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = ct.histogram(_test_residuals(spark, sf_dir), "residual", bins=20)
    return h.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


def category_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


def null_profile_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lab = table(spark, sf_dir, "labels")
    return null_profile(d.join(lab, "doc_id", "left"))
