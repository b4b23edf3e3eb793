"""Read-only check over a folder of archived daily weather files (one CSV per
event row, named weather_<row>_<circuit>_<date>.csv): keys from file names,
lookback pivot. Set ARCHIVED_DAILY_DIR to the folder; skipped otherwise."""

import os

from pyspark.sql import functions as F

from panelkit.operators.lookback import lag_pivot
from panelkit.sources.csv import read_with_path_keys

import pytest

DIR = os.environ.get("ARCHIVED_DAILY_DIR", "")
COLS = ["time", "tavg", "tmin", "tmax", "prcp", "snow", "wdir", "wspd", "wpgt", "pres", "tsun",
        "circuit_name", "deenergize_time", "source_circuit_name", "source_deenergize_time", "approximated"]

pytestmark = pytest.mark.skipif(not DIR or not os.path.isdir(DIR), reason="ARCHIVED_DAILY_DIR not set")


def test_file_keys_and_pivot(spark):
    df = read_with_path_keys(spark, DIR, COLS, {
        "row_index": r"weather_(\d+)_", "file_circuit": r"weather_\d+_(.+)_\d{4}-\d{2}-\d{2}\.csv$",
        "event_date": r"_(\d{4}-\d{2}-\d{2})\.csv$"})
    assert df.count() == 3085
    assert df.select("row_index").distinct().count() == 617
    assert df.where(F.col("file_circuit") != F.col("circuit_name")).count() == 0
    daily = df.select(F.col("row_index").cast("long").alias("row_id"),
                      F.datediff(F.to_date("event_date"), F.to_date("time")).alias("offset"),
                      *[F.col(c).try_cast("double").alias(c) for c in ("tmin", "tmax", "wspd")])
    offs = {r.offset: r["count"] for r in daily.groupBy("offset").count().collect()}
    assert offs == {0: 2, 1: 617, 2: 617, 3: 617, 4: 617, 5: 615}
    wide = lag_pivot(daily.where(F.col("offset").between(1, 5)), row_id="row_id",
                     value_cols=["tmin", "tmax", "wspd"])
    assert wide.count() == 617
    assert wide.where(F.col("tmin_lag5").isNull()).count() == 2
    assert wide.where(F.col("tmin_lag1").isNull() | F.col("wspd_lag1").isNull()).count() == 0
