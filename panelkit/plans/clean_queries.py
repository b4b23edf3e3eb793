"""Queries for sources, cleaning rules, filters and the simple joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import text as tx
from ..functions.dates import minutes_between, parse_time
from ..operators import clean as cl
from ..operators.impute import sibling_impute
from ..session import scratch_dir
from ..sources import csv as csvsrc
from ..sources.batches import load_batches
from ..sources.sinks import write_split
from .common import synth_lon, table


def typed_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + S5: write customer as CSV, scan it back as all-string with a column
    subset, cast in one declared pass."""
    cust = table(spark, sf_dir, "customer")
    path = scratch_dir(spark, "typed_csv_scan")
    csvsrc.write_csv(cust, path)
    raw = csvsrc.read_text_csv(spark, path, cust.columns, use=["c_custkey", "c_name", "c_acctbal"])
    return csvsrc.cast_columns(raw, {"c_custkey": "bigint", "c_acctbal": "double"})


def file_name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + S6: one folder per (priority, year); keys come back out of the path."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderpriority", F.year("o_orderdate").alias("order_year"))
    path = scratch_dir(spark, "file_name_keys")
    csvsrc.write_csv(o, path, partition_by=["o_orderpriority", "order_year"])
    df = csvsrc.read_with_path_keys(
        spark, path, ["o_orderkey", "o_totalprice"],
        {"o_orderpriority": r"o_orderpriority=([^/]+)/", "order_year": r"order_year=(\d+)/"})
    return df.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
                     F.col("o_totalprice").cast("double").alias("o_totalprice"),
                     "o_orderpriority", F.col("order_year").cast("int").alias("order_year"))


# The three report batches of the stand-in (declared strftime
# format, and the Spark pattern the text was rendered with).
BATCHES = [
    {"batch": 0, "start": "%m/%d/%y %H:%M", "render": "M/d/yyyy H:mm", "header": "Start Date and Time"},
    {"batch": 1, "start": "%d/%m/%y %H:%M", "render": "d/M/yy H:mm",
     "header": " De-Energization Date and Time (PDT)"},
    {"batch": 2, "start": "%Y-%m-%d %H:%M:%S", "render": "yyyy-MM-dd HH:mm:ss",
     "header": "DeEnergization Date and Time"},
]

# Header variants of the start time and their canonical name.
START_SYNONYMS = {
    "Start Date and Time": "start_text",
    "De-Energization Date and Time (PDT)": "start_text",
    "DeEnergization Date and Time": "start_text",
}


def _batch_reader(spark, sf_dir):
    o = table(spark, sf_dir, "orders")

    def read(cfg):
        b = o.where(F.pmod(F.col("o_orderkey"), F.lit(3)) == cfg["batch"])
        txt = F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(
            F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 7 HOURS 5 MINUTES"), cfg["render"]))
        cols = [F.col("o_orderkey"), F.lit(cfg["batch"]).alias("batch"), txt.alias(cfg["header"])]
        if cfg["batch"] == 1:
            cols.append(F.col("o_orderpriority"))
        if cfg["batch"] == 2:
            cols.append(F.col("o_orderstatus"))
        return b.select(*cols)
    return read


def batch_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + U1 + P1 + F4/F5: per-batch header variants normalised, per-batch
    formats (with the 4-digit-year fallback and sentinels), stacked with
    unionByName(allowMissingColumns)."""
    df = load_batches(BATCHES, _batch_reader(spark, sf_dir), {"start_text": "start"},
                      normalise=lambda b: cl.normalise_headers(b, START_SYNONYMS))
    return df.select("o_orderkey", "batch", "o_orderpriority", "o_orderstatus",
                     F.date_format("start_text", "yyyy-MM-dd HH:mm:ss").alias("start_time"))


def reject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + P7: documents left join labels; labelled rows go to the main table,
    unlabelled rows to the reject table; both are read back with a status."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    base = scratch_dir(spark, "reject_split")
    write_split(j, F.col("quality").isNotNull(), base, good="labelled")
    return spark.read.parquet(base)


# Messy report headers and their canonical names.
MESSY_PART_HEADERS = [" Part Key", "Part Name Customers", "Kind ", "Counties", "Brand"]
PART_SYNONYMS = {"Part Key": "part_key", "Part Name": "part_name", "Kind": "part_type",
                 "Brand": "brand"}


def header_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
    messy = p.toDF(*MESSY_PART_HEADERS)
    out = cl.normalise_headers(messy, PART_SYNONYMS, drop_suffix=" Customers",
                               conditional={"Counties": "communities"})
    return out.withColumn("communities", F.col("communities").cast("int"))


def columns_by_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.columns_matching(table(spark, sf_dir, "customer"), r"key$")


def optional_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                                  "l_linestatus")
    return cl.optional_filter(li, "l_linestatus", "F")


def name_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 + F3 + F15 over supplier names (decorated like report names)."""
    s = table(spark, sf_dir, "supplier")
    raw = F.concat(F.upper(F.regexp_replace("s_name", "#", " ")),
                   F.when(F.pmod("s_suppkey", F.lit(7)) == 0, F.lit(" LINE"))
                    .when(F.pmod("s_suppkey", F.lit(5)) == 0, F.lit(" TAP &\r\n 2"))
                    .otherwise(F.lit(" NO.  1")))
    named = s.select("s_suppkey", tx.collapse_ws(raw).alias("name"))
    return (named.where(cl.name_ok(F.col("name")))
                 .select("s_suppkey", "name", tx.match_key_left("name").alias("key_left"),
                         tx.match_key_right("name").alias("key_right")))


def _report_times(o: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    start_txt = F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(
        F.date_format("o_orderdate", "M/d/yy H:mm"))
    end_ts = F.col("o_orderdate") + F.make_dt_interval(F.lit(1), F.lit(0), F.pmod("o_orderkey", F.lit(1440)))
    end_txt = F.when(F.pmod("o_orderkey", F.lit(17)) == 0, F.lit("13/45/19 9:00")).otherwise(
        F.date_format(end_ts, "M/d/yyyy H:mm"))
    total = F.when(F.pmod("o_orderkey", F.lit(19)) == 0, F.lit(None).cast("double")).otherwise(
        F.col("o_totalprice"))
    return o.select("o_orderkey", *keep, parse_time(start_txt, "%m/%d/%y %H:%M").alias("start_time"),
                    parse_time(end_txt, "%m/%d/%y %H:%M").alias("end_time"), total.alias("total"))


def sentinel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 + F4: parse, then keep rows with both times after 2000-01-01 and a total."""
    t = _report_times(table(spark, sf_dir, "orders"))
    kept = t.where(cl.after_sentinel(F.col("start_time")) & cl.after_sentinel(F.col("end_time"))
                   & F.col("total").isNotNull())
    return kept.select("o_orderkey", "total",
                       F.round(minutes_between("start_time", "end_time"), 6).alias("time_out_min"))


def dropna_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8 + P11 + F7 + F8: customer numbers as messy text, parsed, rows with any NULL dropped."""
    c = table(spark, sf_dir, "customer")
    bal = F.when(F.pmod("c_custkey", F.lit(13)) == 0, F.lit("nan")).otherwise(
        F.format_number("c_acctbal", 2))
    inc = F.when(F.pmod("c_custkey", F.lit(11)) == 0, F.lit("-")).otherwise(
        F.concat(F.format_number(F.floor(F.abs("c_acctbal")) * 100, 0),
                 F.when(F.pmod("c_custkey", F.lit(5)) == 0, F.lit("+")).otherwise(F.lit(""))))
    txt = c.select("c_custkey", bal.alias("acctbal"), inc.alias("income"),
                   F.col("c_nationkey").cast("string").alias("nation"))
    typed = txt.select("c_custkey", num.strip_commas_double("acctbal").alias("acctbal"),
                       num.census_number("income").alias("income"),
                       F.col("nation").try_cast("int").alias("nation"))
    return typed.dropna("any")


def null_aware_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL != 'MISSING' counts as True."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 0, F.lit("MISSING")).otherwise(F.lit("OK")).alias("label_name"))
    j = d.join(lab, "doc_id", "left")
    return j.withColumn("label_present", cl.not_equal_null_true(F.col("label_name"), "MISSING"))


def scalar_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, F9, F10, F18, F19, F20 on decorated part fields."""
    p = table(spark, sf_dir, "part")
    circuit = F.concat(F.upper("p_name"), F.lit(" "), (F.col("p_partkey") + 1000).cast("string"),
                       F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.lit("*")).otherwise(F.lit("")))
    lon_txt = F.concat(F.abs(synth_lon(F.col("p_partkey"), 7)).cast("string"), F.lit("W"))
    zip_txt = F.concat(F.lit("ZCTA5 "), (F.col("p_partkey") + 90000).cast("string"))
    return p.select(
        "p_partkey",
        tx.entity_name(circuit).alias("circuit"),
        tx.max_digit("p_brand").alias("tier"),
        num.hemisphere(lon_txt).alias("longitude"),
        tx.first_5digit(zip_txt).alias("zip5"),
        tx.name_stem(F.concat("p_type", F.lit("-"), F.col("p_size").cast("string"))).alias("stem"),
        tx.split_second(F.concat("p_type", F.lit(","), "p_name")).alias("second"),
        F.upper("p_name").alias("name_upper"),
        F.bround("p_retailprice", 0).alias("price_round"),
        F.round(F.sqrt(F.abs(F.col("p_retailprice") - 1000)), 6).alias("price_sqrt"),
    )


def duration_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6, F12, F13, F14 on lineitem x orders."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return j.select("l_orderkey", "l_linenumber",
                    minutes_between("o_orderdate", "l_shipdate").alias("minutes"),
                    F.dayofyear("l_shipdate").alias("ship_doy"),
                    F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("days_between"),
                    F.date_sub(F.to_date("l_shipdate"), 5).alias("ship_minus5"))


def outer_join_clean_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer join of two per-key summaries on a cleaned text key.
    Each side is reduced to one row per key first, so a hot key never
    multiplies into all its pairs."""
    c = table(spark, sf_dir, "customer")
    s = table(spark, sf_dir, "supplier")
    ckey = tx.join_key_clean(F.concat(F.lit("NATION "), F.col("c_nationkey").cast("string"), F.lit("*")))
    skey = tx.join_key_clean(F.concat(F.lit("NATION\r\n "), (F.col("s_nationkey") + 3).cast("string")))
    cs = c.groupBy(ckey.alias("k")).agg(F.count(F.lit(1)).alias("n_customers"),
                                        F.round(F.sum("c_acctbal"), 2).alias("customer_balance"))
    ss = s.groupBy(skey.alias("k")).agg(F.count(F.lit(1)).alias("n_suppliers"),
                                        F.round(F.sum("s_acctbal"), 2).alias("supplier_balance"))
    return cs.join(ss, "k", "full").withColumnRenamed("k", "nation_key")


def crosswalk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 + J3 + P10 + F10: customer zip -> crosswalk -> area code -> census row
    (with a second header row to drop) -> region."""
    c = table(spark, sf_dir, "customer")
    # The crosswalk sheet is exported as text and read back as strings,
    # projecting the two key columns
    sheet = c.select(F.format_string("%05d", F.col("c_custkey")).alias("zip"),
                     F.format_string("%05d", F.col("c_nationkey")).alias("zcta"),
                     F.col("c_mktsegment").alias("note"))
    path = scratch_dir(spark, "crosswalk")
    csvsrc.write_csv(sheet, path)
    xwalk = csvsrc.read_text_csv(spark, path, ["zip", "zcta", "note"], use=["zip", "zcta"])
    n = table(spark, sf_dir, "nation")
    census = n.select(F.concat(F.lit("ZCTA5 "), F.format_string("%05d", F.col("n_nationkey"))).alias("NAME"),
                      "n_name", "n_regionkey")
    header = spark.createDataFrame([("Geographic Area Name", "Name", None)], census.schema)
    census = census.unionByName(header).where(F.col("NAME").rlike(r"\d{5}"))
    census = census.select(tx.first_5digit("NAME").alias("zcta"), "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region")
    # nation and region are fixed-size dimensions (25 and 5 rows at every scale)
    return (c.select(F.col("c_custkey"), F.format_string("%05d", F.col("c_custkey")).alias("zip"))
             .join(xwalk, "zip").join(F.broadcast(census), "zcta")
             .join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
             .select("c_custkey", "zip", "zcta", "n_name", "r_name"))


def left_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 + F11: left join on differently named keys, right key dropped, safe ratio."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    j = o.join(c, o.o_custkey == c.c_custkey, "left").drop("c_custkey")
    return j.select("o_orderkey", "o_custkey", "c_mktsegment",
                    F.round(num.safe_ratio(F.col("o_totalprice"), F.col("c_acctbal")), 6).alias("price_ratio"))


def join_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the id join, both sides' keys and dates must agree."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    agree_key = F.col("l_orderkey").eqNullSafe(F.col("o_orderkey"))
    agree_date = F.to_date("l_shipdate") >= F.to_date("o_orderdate")
    return j.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(agree_key).alias("n_key_agree"),
                 F.count_if(agree_date).alias("n_date_agree"),
                 F.bool_and(agree_key & agree_date).alias("all_agree"))


def sibling_impute_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 on part: report-like rows (name = type-size) with some starts missing."""
    p = table(spark, sf_dir, "part")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    start = base + F.make_dt_interval(F.lit(0), F.col("p_size"), F.lit(0))
    end = start + F.make_dt_interval(F.lit(0), F.lit(0), F.pmod("p_partkey", F.lit(500)) + 30)
    miss = F.pmod("p_partkey", F.lit(10)) == 0
    rows = p.select("p_partkey",
                    F.concat("p_type", F.lit("-"), F.col("p_size").cast("string")).alias("name"),
                    F.when(miss, F.lit(None)).otherwise(start).alias("start_time"),
                    F.when(miss, F.lit(None)).otherwise(end).alias("end_time"),
                    F.when(miss, F.lit(None).cast("double")).otherwise(minutes_between(start, end)).alias("minutes"),
                    F.col("p_brand").alias("communities"))
    out = sibling_impute(rows, name="name", start="start_time", end="end_time", duration="minutes",
                         text="communities")
    return out.select("p_partkey", "stem",
                      F.date_format("start_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start_time"),
                      F.date_format("end_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("end_time"),
                      "minutes", "communities", "imputed")
