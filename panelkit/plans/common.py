"""Shared derivations of the driver tables used by several queries.

Analogy to the source domain: user = circuit, event day = weather day,
``value`` = a daily measurement, ``signup`` = the anchoring event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookback import daily_rollup
from ..session import read_table

VALUE_COLS = ["v_min", "v_max", "v_click"]
DAYS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return daily_rollup(ev, "user_id", "ts", {
        "v_min": F.min("value"),
        "v_max": F.max("value"),
        # NULL on days without a click: the natural source of incomplete windows
        "v_click": F.round(F.avg(F.when(F.col("event_type") == "click", F.col("value"))), 6),
    })


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return (ev.where(F.col("event_type") == "signup")
              .select(F.col("event_id").alias("row_id"), "user_id",
                      F.to_date("ts").alias("anchor_date")))


def synth_lat(key: Column, mult: int = 1) -> Column:
    return F.lit(36.0) + F.pmod(key * mult, F.lit(500)) / F.lit(100.0)


def synth_lon(key: Column, mult: int) -> Column:
    return F.lit(-123.0) + F.pmod(key * mult, F.lit(400)) / F.lit(100.0)


def user_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic location per user (same rule as for customers)."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    return u.select("user_id", synth_lat(F.col("user_id")).alias("lat"),
                    synth_lon(F.col("user_id"), 7).alias("lon"))
