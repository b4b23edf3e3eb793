"""Lookback window: 0, 1, 4, 5 days; day 0 never counted; one null day."""

import datetime as dt

from pyspark.sql import functions as F

from panelkit.operators import lookback as lb

D = dt.date(2024, 1, 10)


def _frames(spark):
    daily_rows = []
    # user 1: 5 full days; user 2: 4 days; user 3: 1 day; user 4: none;
    # user 5: days -4..0 (day 0 present, so only 4 count); user 6: 5 days, one null
    for k in range(1, 6):
        daily_rows.append((1, D - dt.timedelta(days=k), 1.0 * k, 2.0 * k, 3.0))
        daily_rows.append((6, D - dt.timedelta(days=k), 1.0, 2.0, None if k == 3 else 1.0))
    for k in range(1, 5):
        daily_rows.append((2, D - dt.timedelta(days=k), 1.0, 1.0, 1.0))
    daily_rows.append((3, D - dt.timedelta(days=2), 1.0, 1.0, 1.0))
    for k in range(0, 5):
        daily_rows.append((5, D - dt.timedelta(days=k), 1.0, 1.0, 1.0))
    daily = spark.createDataFrame(daily_rows, "user_id long, day date, a double, b double, c double")
    anchors = spark.createDataFrame([(10 + u, u, D) for u in range(1, 7)] + [(99, 1, D)],
                                    "row_id long, user_id long, anchor_date date")
    return daily, anchors


def test_classes(spark):
    daily, anchors = _frames(spark)
    out = lb.completeness_class(anchors, daily, row_id="row_id", entity="user_id", anchor_date="anchor_date",
                                value_cols=["a", "b", "c"])
    got = {r.row_id: (r.n_days, r.completeness) for r in out.collect()}
    assert got == {11: (5, "complete"), 99: (5, "complete"), 12: (4, "partial"), 13: (1, "partial"),
                   14: (0, "missing"), 15: (4, "partial"), 16: (5, "has_nulls")}


def test_lag_pivot(spark):
    daily, anchors = _frames(spark)
    out = lb.lag_features(anchors, daily, row_id="row_id", entity="user_id", anchor_date="anchor_date",
                          value_cols=["a", "b"])
    r = {x.row_id: x for x in out.collect()}
    assert [r[11][f"a_lag{k}"] for k in range(5, 0, -1)] == [5.0, 4.0, 3.0, 2.0, 1.0]
    assert r[13]["a_lag2"] == 1.0 and r[13]["a_lag1"] is None
    assert r[14]["completeness"] == "missing" and r[14]["a_lag1"] is None
    assert r[15]["a_lag5"] is None and r[15]["a_lag1"] == 1.0


def test_donor_fill_and_copy(spark):
    daily, anchors = _frames(spark)
    coords = spark.createDataFrame([(u, 38.0 + u * 0.01, -122.0) for u in range(1, 7)], "user_id long, lat double, lon double")
    cls = lb.completeness_class(anchors, daily, row_id="row_id", entity="user_id", anchor_date="anchor_date",
                                value_cols=["a", "b", "c"])
    long = lb.lookback_join(anchors, daily, row_id="row_id", entity="user_id", anchor_date="anchor_date")
    donors = lb.donor_assign(cls, coords, row_id="row_id", entity="user_id", anchor_date="anchor_date",
                             need=["has_nulls", "missing"])
    d = {r.row_id: r.donor_row_id for r in donors.collect()}
    # user 6 (lat 38.06) and user 4 (38.04): nearest complete anchor is user 1's
    # (two anchors at the same spot: the lower row id wins)
    assert d == {16: 11, 14: 11}
    filled = lb.donor_fill(long, donors, row_id="row_id", value_cols=["a", "b", "c"])
    f = {r.offset: r for r in filled.where("row_id = 16").collect()}
    assert f[3].c == 3.0 and f[3].from_donor and f[3].approximated and f[3].source_row_id == 16
    assert f[2].c == 1.0 and not f[2].from_donor and f[2].approximated
    copied = lb.donor_copy(long, donors, row_id="row_id", value_cols=["a"])
    assert sorted((r.offset, r.a) for r in copied.where("row_id = 14").collect()) == [(k, 1.0 * k) for k in range(1, 6)]
    assert copied.where(F.col("approximated") == F.lit(False)).count() == 0


def test_anchors_with_null_keys_or_no_place_are_kept(spark):
    daily, anchors = _frames(spark)
    none = spark.createDataFrame([(201, None, D), (202, 1, None), (203, None, None)], anchors.schema)
    every = anchors.unionByName(none)
    key = dict(row_id="row_id", entity="user_id", anchor_date="anchor_date")
    cls = lb.completeness_class(every, daily, value_cols=["a", "b", "c"], **key)
    got = {r.row_id: (r.n_days, r.n_null_days, r.completeness) for r in cls.collect()}
    assert len(got) == every.count() and all(got[i] == (0, 0, "missing") for i in (201, 202, 203)) and got[11][2] == "complete"
    lags = {r.row_id: r for r in lb.lag_features(every, daily, value_cols=["a", "b", "c"], **key).collect()}
    assert set(lags) == set(got) and all(lags[i].completeness == "missing" and lags[i].a_lag1 is None for i in (201, 202, 203))
    assert lags[11].a_lag1 == 1.0
    coords = spark.createDataFrame([(u, 36.0 + u / 100, -120.0) for u in (1, 2, 3, 6)], "user_id long, lat double, lon double")
    need = [lb.MISSING, lb.PARTIAL, lb.HAS_NULLS]
    donors = {r.row_id: r.donor_row_id for r in lb.donor_assign(cls, coords, need=need, **key).collect()}
    assert set(donors) == {i for i, v in got.items() if v[2] != "complete"}
    assert all(donors[i] is None for i in (14, 15, 201, 202, 203)) and donors[12] == 11
