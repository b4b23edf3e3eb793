"""Queries over the lookback slice (flagship): events -> daily -> window -> class -> lags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookback as lb
from ..session import cut_lineage
from .common import DAYS, VALUE_COLS, anchors, daily, user_coords

KEY = dict(row_id="row_id", entity="user_id", anchor_date="anchor_date")


def lookback_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lb.lookback_join(anchors(spark, sf_dir), daily(spark, sf_dir), days=DAYS, **KEY)
    return out.select("row_id", "user_id", "anchor_date", "offset", "day", *VALUE_COLS)


def completeness_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.completeness_class(anchors(spark, sf_dir), daily(spark, sf_dir),
                                 value_cols=VALUE_COLS, days=DAYS, **KEY)


def lag_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lb.lookback_join(anchors(spark, sf_dir), daily(spark, sf_dir), days=DAYS, **KEY)
    return lb.lag_pivot(long, row_id="row_id", value_cols=VALUE_COLS, days=DAYS)


def lag_features_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.lag_features(anchors(spark, sf_dir), daily(spark, sf_dir),
                           value_cols=VALUE_COLS, days=DAYS, **KEY)


def _classes_and_long(spark, sf_dir):
    a, d = anchors(spark, sf_dir), daily(spark, sf_dir)
    cls = lb.completeness_class(a, d, value_cols=VALUE_COLS, days=DAYS, **KEY)
    long = lb.lookback_join(a, d, days=DAYS, **KEY)
    return cls, long


def donor_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    cls, _ = _classes_and_long(spark, sf_dir)
    out = lb.donor_assign(cls, user_coords(spark, sf_dir), entity="user_id", row_id="row_id",
                          anchor_date="anchor_date", need=[lb.MISSING, lb.PARTIAL, lb.HAS_NULLS])
    return out.withColumn("distance_mi", F.round("distance_mi", 6))


def _donors(spark, sf_dir, need):
    cls, long = _classes_and_long(spark, sf_dir)
    # both feed several jobs (donor search levels, copies, fills): materialise
    # them once in the shared checkpoint folder instead of re-aggregating events
    cls, long = cut_lineage(cls), cut_lineage(long)
    donors = lb.donor_assign(cls, user_coords(spark, sf_dir), entity="user_id", row_id="row_id",
                             anchor_date="anchor_date", need=need)
    return cls, long, donors


def donor_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, long, donors = _donors(spark, sf_dir, [lb.MISSING, lb.PARTIAL])
    return lb.donor_copy(long, donors, row_id="row_id", value_cols=VALUE_COLS)


def donor_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, long, donors = _donors(spark, sf_dir, [lb.HAS_NULLS])
    return lb.donor_fill(long, donors, row_id="row_id", value_cols=VALUE_COLS)


def repair_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete windows as they are + donor copies for missing/partial + donor
    fills for has_nulls: the repaired long panel (one row per anchor and day)."""
    cls, long, donors = _donors(spark, sf_dir, [lb.MISSING, lb.PARTIAL, lb.HAS_NULLS])
    donors = donors.join(cls.select("row_id", "completeness"), "row_id")
    complete = (long.join(cls.where(F.col("completeness") == lb.COMPLETE).select("row_id"), "row_id", "left_semi")
                    .select("row_id", "offset", *VALUE_COLS, F.col("row_id").alias("source_row_id"),
                            F.lit(False).alias("approximated"), F.lit(False).alias("from_donor")))
    copied = lb.donor_copy(long, donors.where(F.col("completeness").isin(lb.MISSING, lb.PARTIAL)),
                           row_id="row_id", value_cols=VALUE_COLS)
    filled = lb.donor_fill(long, donors.where(F.col("completeness") == lb.HAS_NULLS),
                           row_id="row_id", value_cols=VALUE_COLS)
    return complete.unionByName(copied).unionByName(filled)
