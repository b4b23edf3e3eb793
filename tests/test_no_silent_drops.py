"""Nothing is dropped or changes with size without a message."""

import math

import pytest

from panelkit.operators import contrast as ct
from panelkit.operators import models as md
from panelkit.operators.evaluate import regression_metrics
from panelkit.operators.rank import exact_order_stats


def test_order_statistics_in_long_runs_of_ties(spark):
    df = spark.createDataFrame([(1.0,)] * 3000 + [(2.0,)] * 3000, "v double")
    ranks = [1, 3, 3000, 3001, 3003, 6000]
    got = exact_order_stats(df, "v", [(f"r{r}", (), r) for r in ranks], exact_limit=500)
    assert [got[f"r{r}"] for r in ranks] == [1.0, 1.0, 1.0, 2.0, 2.0, 2.0]


def test_metrics_count_only_known_pairs(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 2.0), (9.0, None), (None, 4.0)], "y double, p double")
    r = regression_metrics(df, "y", "p").first()
    assert r.n == 2 and math.isclose(r.rmse, math.sqrt(0.5)) and math.isclose(r.r2, 0.5)


def test_null_features_are_an_error(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (4.0, 9.0)], "x double, y double")
    with pytest.raises(Exception):
        md.ols_fit(df, ["x"], "y").transform(df).count()


def test_empty_bins_are_listed(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (10.0,)], "v double")
    rows = {r.bin: r.n for r in ct.histogram(df, "v", bins=5).collect()}
    assert rows == {0: 2, 1: 0, 2: 0, 3: 0, 4: 1}


def test_elastic_net_parameters_match_coordinate_descent(spark):
    import numpy as np
    from pyspark.ml.regression import LinearRegression
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 3))
    x = (x - x.mean(0)) / x.std(0)
    y = x @ [700.0, -400.0, 600.0] + r.normal(0, 900, 300)
    a, ratio, w = 2.0, 0.2, np.zeros(3)
    for _ in range(500):
        for j in range(3):
            rho = x[:, j] @ (y - y.mean() - x @ w + x[:, j] * w[j]) / 300
            w[j] = np.sign(rho) * max(abs(rho) - a * ratio, 0) / (x[:, j] @ x[:, j] / 300 + a * (1 - ratio))
    df = spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, y)], "a double, b double, c double, y double")
    data = md.assembler(["a", "b", "c"])[0].transform(df)
    fit = LinearRegression(labelCol="y", standardization=False, tol=1e-10, maxIter=500,
                           **md.elastic_net_params(a, ratio, float(np.std(y, ddof=1)))).fit(data)
    assert np.allclose(fit.coefficients.toArray(), w, rtol=0.01, atol=2)
