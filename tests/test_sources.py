"""Sources, sinks and header rules on small inline files."""

import os

from pyspark.sql import functions as F

from panelkit.operators.clean import normalise_headers, null_profile
from panelkit.sources.batches import union_batches
from panelkit.sources.csv import cast_columns, read_quoted_csv, read_text_csv, read_with_path_keys
from panelkit.sources.sinks import split_rejects


import pytest


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_text_csv_keeps_quoted_newlines_and_casts_safely(spark, tmp_path, eol):
    p = tmp_path / "r.csv"
    p.write_bytes(('Circuit Name,"Start Date and\r\nTime",Total' + eol +
                   '"SONOMA 1107*","10/14/18 20:05","1,234"' + eol +
                   'BELL,n/a,x' + eol).encode())
    cols = ["circuit", "start", "total"]
    df = read_text_csv(spark, str(p), cols, use=["circuit", "total"])
    assert df.columns == ["circuit", "total"]
    rows = cast_columns(df, {"total": "double"}).orderBy("circuit").collect()
    assert [(r.circuit, r.total) for r in rows] == [("BELL", None), ("SONOMA 1107*", None)]
    raw = read_text_csv(spark, str(p), cols).orderBy("circuit").collect()
    assert raw[1].start == "10/14/18 20:05" and raw[1].total == "1,234"


def test_path_keys_with_spaces(spark, tmp_path):
    d = tmp_path / "daily"
    d.mkdir()
    for name in ["weather_12_APPLE HILL_2020-09-08.csv", "weather_7_BELL_2019-10-26.csv"]:
        (d / name).write_text("time,tmin\n2020-09-07,1.5\n")
    df = read_with_path_keys(spark, str(d), ["time", "tmin"], {
        "row_index": r"weather_(\d+)_", "circuit": r"weather_\d+_(.+)_\d{4}-\d{2}-\d{2}\.csv$"})
    got = sorted((r.row_index, r.circuit) for r in df.collect())
    assert got == [("12", "APPLE HILL"), ("7", "BELL")]
    assert os.path.isdir(str(d))


def test_header_order_strip_suffix_synonym_conditional(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF(
        " Total Customers", "Start Date and Time", "Counties")
    out = normalise_headers(df, {"Total": "total_affected", "Start Date and Time": "start"},
                            drop_suffix=" Customers", conditional={"Counties": "Key Communities"})
    assert out.columns == ["total_affected", "start", "Key Communities"]
    both = spark.createDataFrame([(1, 2)], "a int, b int").toDF("Key Communities", "Counties")
    kept = normalise_headers(both, {}, conditional={"Counties": "Key Communities"})
    assert kept.columns == ["Key Communities", "Counties"]


def test_union_with_missing_columns_and_rejects(spark):
    a = spark.createDataFrame([(1, "x")], "id int, p string")
    b = spark.createDataFrame([(2, "y")], "id int, q string")
    u = union_batches([a, b]).orderBy("id").collect()
    assert [(r.id, r.p, r.q) for r in u] == [(1, "x", None), (2, None, "y")]
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, -1.0)], "id int, v double")
    good, bad = split_rejects(df, F.col("v") > 0)
    assert [r.id for r in good.collect()] == [1] and sorted(r.id for r in bad.collect()) == [2, 3]


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (None, None)], "k int, s string")
    got = {r.column_name: (r.dtype, r.non_null, r.nulls) for r in null_profile(df).collect()}
    assert got == {"k": ("int", 2, 1), "s": ("string", 1, 2)}


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
@pytest.mark.parametrize("size", ["61", "700"])
def test_quoted_line_breaks_across_splits(spark, tmp_path, eol, size):
    """Files in many splits equal the one-task read; a record may cross several."""
    import random
    rnd = random.Random(int(size))

    def field():
        t = "".join(rnd.choice(['a', 'b c', ',', '""', "\r\n", "\n", "é", "x" * 20]) for _ in range(rnd.randrange(9)))
        return f'"{t}"' if rnd.random() < 0.7 else "plain"
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        rows = [f"{k}-{i},{field()},{field()}" for i in range(60)]
        (folder / f"f{k}.csv").write_bytes((f'key,"first{eol}part","o""k"{eol}' + eol.join(rows) + (eol if k else "")).encode())
    cols = ["key", "a", "b"]
    want = sorted(((r.key, r.a, r.b) for r in read_text_csv(spark, str(folder), cols).collect()), key=repr)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        df = read_quoted_csv(spark, str(folder), cols)
        got = sorted(((r.key, r.a, r.b) for r in df.collect()), key=repr)
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 8
        assert [r.a for r in read_quoted_csv(spark, str(folder), cols, use=["a"]).collect()].count(None) == [a for _, a, _ in want].count(None)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 180 and got == want
