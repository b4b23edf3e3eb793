from pyspark.sql import functions as F

from panelkit.operators.lookback import daily_rollup
from panelkit.plans.stream_queries import stream_daily_rollup

SF = "/root/testdata/sf0.001"


def test_daily_rollup_of_a_folder_of_part_files_has_every_day(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = stream_daily_rollup(spark, str(tmp_path)).select("user_id", "day", "n_events")
    want = daily_rollup(events, "user_id", "ts", {"n_events": F.count(F.lit(1))})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_daily_rollup_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    assert stream_daily_rollup(spark, str(tmp_path)).count() == 0
