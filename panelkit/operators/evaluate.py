"""Regression metrics and residuals, each one aggregation pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the smallest positive double step at 1.0, the guard of the
# percentage error denominator.
EPS = 2.220446049250313e-16


def regression_metrics(df: DataFrame, y: str, pred: str, group_cols: list[str] | None = None) -> DataFrame:
    """n, R^2 (total sum of squares about the evaluated set's own mean), RMSE,
    MAE and MAPE (denominator max(|y|, eps)) per group, over the rows where both
    values are known (n counts those)."""
    e = F.col(y) - F.col(pred)
    aggs = [F.count(e).alias("n"),
            F.sum(e * e).alias("_sse"),
            (F.var_pop(F.when(e.isNotNull(), F.col(y))) * F.count(e)).alias("_sst"),
            F.avg(F.abs(e)).alias("mae"),
            F.avg(F.abs(e) / F.greatest(F.abs(F.col(y)), F.lit(EPS))).alias("mape")]
    g = df.groupBy(*group_cols) if group_cols else df
    m = g.agg(*aggs)
    return m.select(*(group_cols or []), "n",
                    (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("r2"),
                    F.sqrt(F.try_divide(F.col("_sse"), F.col("n").cast("double"))).alias("rmse"), "mae", "mape")


def residuals(df: DataFrame, preds: DataFrame, key, y: str, pred: str = "prediction") -> DataFrame:
    """Observed minus predicted, aligned by the row key (never by position)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(preds.select(*keys, pred), keys, "inner").withColumn("residual", F.col(y) - F.col(pred))
