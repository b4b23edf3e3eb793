"""Structured Streaming wiring for the stateless operators.

The reference reads each report once; nothing in it keeps state across
records. Every cleaning rule, filter and the dimension enrich (a
stream-static left join) are stateless, so the same Column expressions run
unchanged on a streaming DataFrame. New report files dropped into a folder
are cleaned incrementally; the checkpoint folder (under the cluster's shared
``spark.checkpoint.dir``) makes the sink exactly-once across restarts and
executor loss.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
                glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder)


def run_incremental(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out_path: str,
                    checkpoint: str, partition_by: list[str] | None = None) -> None:
    """Apply a stateless ``transform`` and append to a Parquet table; processes
    everything available now, then stops (``availableNow``), so it suits both
    scheduled batch runs and tests. Rerunning picks up only new files."""
    w = (transform(stream).writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def utc_instant(ntz):
    """TIMESTAMP_NTZ wall clock -> TIMESTAMP instant at UTC, without the session
    zone (watermarks need an instant; tumbling windows align to the epoch, so
    day windows are UTC days = the wall-clock days of the NTZ values)."""
    from pyspark.sql import functions as F
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ntz))


def instant_to_date(ts):
    """Inverse of ``utc_instant`` followed by a date cut, zone-free."""
    from pyspark.sql import functions as F
    return F.to_date(F.timestamp_add("MICROSECOND", F.unix_micros(ts),
                                     F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))


def daily_rollup_stream(stream: DataFrame, entity: str, ts: str, measures: dict, lateness: str = "1 day",
                        day: str = "day") -> DataFrame:
    """Streaming daily rollup: tumbling one-day event-time windows per entity
    with a watermark. Append mode emits a day once the watermark (latest event
    time minus ``lateness``) has passed its end; state for finished days is
    dropped, so state stays bounded by the open days x entities."""
    from pyspark.sql import functions as F
    ev = stream.withColumn("_et", utc_instant(F.col(ts))).withWatermark("_et", lateness)
    agg = ev.groupBy(F.col(entity), F.window("_et", "1 day").alias("_w")).agg(
        *[m.alias(n) for n, m in measures.items()])
    return agg.select(entity, instant_to_date(F.col("_w.start")).alias(day), *measures.keys())
