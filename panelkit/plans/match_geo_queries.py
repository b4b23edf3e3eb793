"""Queries for the fuzzy match, the geo-nearest donor and point-in-polygon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators.fuzzy import fuzzy_best_match
from ..operators.geo import nearest_within, point_in_polygon
from .common import synth_lat, synth_lon, table

MATCH_THRESHOLD = 80


def fuzzy_best_match_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 + F16 + T6 + P12: every part row's cleaned name against the other
    part names (an identical normalised name is not a match)."""
    p = table(spark, sf_dir, "part")
    left = p.select("p_partkey", tx.match_key_left(F.upper("p_name")).alias("match_text"))
    right = p.select(F.col("p_partkey").alias("match_partkey"), F.col("p_name").alias("match_name"),
                     tx.match_key_right(F.upper("p_name")).alias("station_text"))
    out = fuzzy_best_match(left, right, left_key="match_text", right_key="station_text",
                           right_order="match_partkey", right_cols=["match_partkey", "match_name"],
                           threshold=MATCH_THRESHOLD, exclude_same=True)
    return out.select("p_partkey", "match_text", "match_score", "match_partkey", "match_name")


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.col("c_nationkey").alias("nationkey"), "c_acctbal",
                    synth_lat(F.col("c_custkey")).alias("lat"), synth_lon(F.col("c_custkey"), 7).alias("lon"))


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", F.col("s_nationkey").alias("nationkey"),
                    synth_lat(F.col("s_suppkey"), 13).alias("lat"), synth_lon(F.col("s_suppkey"), 29).alias("lon"))


def geo_nearest_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 + F17 + T6: each customer's nearest supplier of the same nation within
    60 miles (ties: lowest supplier key); otherwise a reject."""
    res = nearest_within(customer_points(spark, sf_dir), supplier_points(spark, sf_dir),
                         left_id="c_custkey", right_id="s_suppkey", block=["nationkey"], cap_miles=60.0)
    return res.select("c_custkey", "s_suppkey", F.round("distance_mi", 6).alias("distance_mi"),
                      F.when(F.col("s_suppkey").isNull(), F.lit("rejected")).otherwise(F.lit("matched"))
                       .alias("status"))


# The stand-in county map (lon, lat rings); polygon 2 is concave.
POLYGONS = [
    (1, "county_a", [(-123.0, 36.0), (-121.0, 36.0), (-121.0, 38.0), (-123.0, 38.0)]),
    (2, "county_b", [(-121.0, 36.0), (-119.0, 36.0), (-119.0, 39.0), (-120.0, 39.0),
                     (-120.0, 37.0), (-121.0, 37.0)]),
    (3, "county_c", [(-123.0, 38.0), (-121.0, 38.0), (-122.0, 41.0)]),
    (4, "county_d", [(-121.0, 38.0), (-119.5, 39.5), (-119.5, 41.0), (-121.0, 41.0), (-121.5, 39.5)]),
]


def polygon_edges(spark: SparkSession) -> DataFrame:
    rows = []
    for pid, _name, ring in POLYGONS:
        for i, (x1, y1) in enumerate(ring):
            x2, y2 = ring[(i + 1) % len(ring)]
            rows.append((pid, x1, y1, x2, y2))
    schema = T.StructType([T.StructField("poly_id", T.IntegerType())] +
                          [T.StructField(n, T.DoubleType()) for n in ("x1", "y1", "x2", "y2")])
    return spark.createDataFrame(rows, schema)


def polygon_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(pid, name) for pid, name, _ in POLYGONS], "poly_id int, county string")


def _shifted_points(spark, sf_dir):
    # shifted off the grid lines so that no point lies on a polygon edge
    return customer_points(spark, sf_dir).select(
        "c_custkey", "c_acctbal", (F.col("lat") + 0.003).alias("lat"), (F.col("lon") + 0.003).alias("lon"))


def point_in_polygon_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """County of every customer point (NULL outside every polygon)."""
    pts = _shifted_points(spark, sf_dir)
    res = point_in_polygon(pts, polygon_edges(spark), point_id="c_custkey", x="lon", y="lat")
    return res.join(F.broadcast(polygon_names(spark)), "poly_id", "left").select("c_custkey", "poly_id", "county")


def region_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 + J13 + A3: balance summed per county, left-joined onto the county
    list (empty counties stay), with the largest county total alongside."""
    pts = _shifted_points(spark, sf_dir)
    inside = point_in_polygon(pts, polygon_edges(spark), point_id="c_custkey", x="lon", y="lat")
    sums = (inside.where(F.col("poly_id").isNotNull()).join(pts, "c_custkey")
                  .groupBy("poly_id").agg(F.count(F.lit(1)).alias("n_points"),
                                          F.round(F.sum("c_acctbal"), 2).alias("total_balance")))
    out = polygon_names(spark).join(sums, "poly_id", "left")
    # the county list is a fixed-size dimension, so a global window over it is tiny
    return out.select("poly_id", "county", "n_points", "total_balance",
                      F.max("total_balance").over(Window.partitionBy()).alias("max_total"))
