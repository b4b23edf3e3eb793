"""Sibling imputation: distinct texts, the source's joined texts, hot and missing siblings."""

import datetime as dt

from panelkit.operators.impute import sibling_impute

T0 = dt.datetime(2020, 1, 1)


def filled(spark, **options):
    h = dt.timedelta(hours=1)
    rows = [(1, "BELL-1", T0, T0 + 2 * h, 120.0, "b"), (2, "BELL-22", T0 + 2 * h, T0 + 6 * h, 240.0, "a"), (3, "BELL 7", T0 + h, T0 + h, 0.0, "b"),
            (4, "BELL-9", None, None, None, None), (5, "OAK-1", None, None, None, None), (6, "OAK-2", dt.datetime(1999, 1, 1), T0, 9.0, "z"),
            (7, "ELM-1", T0, T0, 5.0, "only"), (8, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, name string, s timestamp_ntz, e timestamp_ntz, m double, t string").repartition(3)
    return {r.id: r for r in sibling_impute(df, name="name", start="s", end="e", duration="m", text="t", **options).collect()}


def test_distinct_and_all_texts(spark):
    got = filled(spark)
    assert (got[4].s, got[4].m, got[4].t, got[4].imputed) == (T0 + dt.timedelta(hours=1), 120.0, "a, b", True)
    assert filled(spark, all_texts_by="id")[4].t == "b, a, b"
    assert got[5].s is None and not got[5].imputed and got[8].s is None and len(got) == 8
    assert got[7].t == "only" and got[1].t == "b" and not got[1].imputed
