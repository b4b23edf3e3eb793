"""Streaming form of the report cleaning: orders arrive as a file stream."""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import minutes_between
from ..operators.lookback import daily_rollup
from ..operators import clean as cl
from ..session import scratch_dir
from ..streaming.clean_stream import daily_rollup_stream, read_stream, run_incremental
from .clean_queries import _report_times
from .common import table


def stream_clean_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as a file stream; report times parsed, sentinel rows
    dropped, customer segment attached by a stream-static left join, appended
    exactly once to a Parquet table, which is returned."""
    schema = table(spark, sf_dir, "orders").schema
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    stream = read_stream(spark, f"{sf_dir}/orders.parque[t]", schema)  # a pattern: a file or a folder of part files

    def clean(df: DataFrame) -> DataFrame:
        t = _report_times(df, keep=("o_custkey",))
        kept = t.where(cl.after_sentinel(F.col("start_time")) & cl.after_sentinel(F.col("end_time"))
                       & F.col("total").isNotNull())
        return (kept.join(cust, "o_custkey", "left")
                    .select("o_orderkey", "total", "c_mktsegment",
                            F.round(minutes_between("start_time", "end_time"), 6).alias("time_out_min")))

    base = scratch_dir(spark, "stream_clean")
    run_incremental(stream, clean, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


def stream_daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily rollup of the lookback slice as a stateful stream: events
    arrive as files, one-day event-time windows per user under a watermark one
    day behind the newest event, appended to a Parquet table as days close.
    The days still open (the newest one or two) are rolled up from the table
    itself, so the result holds every day."""
    events = table(spark, sf_dir, "events")
    stream = read_stream(spark, f"{sf_dir}/events.parque[t]", events.schema)
    measures = {
        "v_min": F.min("value"), "v_max": F.max("value"),
        "v_click": F.round(F.avg(F.when(F.col("event_type") == "click", F.col("value"))), 6),
        "n_events": F.count(F.lit(1))}

    base = scratch_dir(spark, "stream_daily")
    run_incremental(stream, lambda df: daily_rollup_stream(df, "user_id", "ts", measures, lateness="1 day"),
                    f"{base}/out", f"{base}/checkpoint")
    newest = events.agg(F.max("ts")).first()[0]
    if newest is None:
        return daily_rollup(events, "user_id", "ts", measures)
    # closed: days that end at or before the watermark, newest - 1 day
    open_from = datetime.combine((newest - timedelta(days=1)).date(), time())
    still_open = daily_rollup(events.where(F.col("ts") >= F.lit(str(open_from)).cast("timestamp_ntz")), "user_id", "ts", measures)
    closed = spark.read.schema(still_open.schema).parquet(f"{base}/out")
    return closed.unionByName(still_open)
