import numpy as np
from pyspark.sql import functions as F

from panelkit.operators import category_paths as cp
from panelkit.operators import models as md
from panelkit.plans import ml_queries as mq


def test_a_category_by_its_sums_gives_the_dense_fits(spark, monkeypatch):
    """Categories in one fold only, an unknown one, and numeric columns that depend on the category."""
    monkeypatch.setattr(cp, "CHUNK", 16)
    r = np.random.default_rng(5)
    cat = np.minimum(r.integers(0, 41, 900), r.integers(0, 41, 900))  # 40: unknown
    x = r.normal(size=(900, 3)) + cat[:, None] % 3
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    y = x @ [2.0, -1.0, 0.0] + np.where(cat % 5 == 0, 3, 0) + r.normal(size=900) + 70
    fold = np.where(cat == 39, 1, r.integers(0, 4, 900))
    df = spark.createDataFrame([(*map(float, a), float(t), int(c), int(f)) for a, t, c, f in zip(x, y, cat, fold)],
                               "a double, b double, c double, y double, cat int, fold int").cache()
    settings = [{"ridge": a} for a in (1e-7, 0.1, 10.0)]
    settings += [{"l1": a * q, "l2": a * (1 - q)} for q in (0.1, 0.9, 1.0) for a in np.geomspace(1.5, 1e-3, 8)]
    dense = md.fold_moments(df, ["a", "b", "c"], "y", category="cat", size=40)
    want = [s["cv_rmse"] for s in md.cross_validate_moments(spark, dense, settings)]
    folds = md.fold_moments(df, ["a", "b", "c"], "y")
    sums = cp.category_sums(df, ["a", "b", "c"], "y", df.agg(F.avg("y")).first()[0], "cat", 40, "fold")
    got = [s["cv_rmse"] for s in cp.cross_validate_category(folds, sums, settings)]
    assert np.allclose(got, want, rtol=1e-6), np.abs(np.array(got) / want - 1).max()
    assert np.isclose(md.alphas_below(cp.largest_product(sums, sum(folds.values())))[0], md.alpha_path(sum(dense.values()))[0])


def test_wide_search_takes_more_suppliers_than_a_matrix_has_columns(spark, monkeypatch):
    rows = [(i, float(i % 7), float(i % 11), i % 5000, i % 5) for i in range(15000)]
    table = spark.createDataFrame(rows, f"row_id long, z_a double, {mq.Y} double, supplier int, fold int").cache()
    monkeypatch.setattr(mq, "_wide_linear", lambda *a: (table, ["z_a"], 5000))
    monkeypatch.setattr(mq, "L1_RATIOS", [0.5])
    got = mq.linear_wide_cv(spark, "").collect()
    assert len(got) == 9 + 100 and all(np.isfinite(r.cv_rmse) for r in got) and got[0].columns == 5001
