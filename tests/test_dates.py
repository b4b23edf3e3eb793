import datetime as dt

from pyspark.sql import functions as F

from panelkit.functions.dates import minutes_between, parse_time, spark_pattern


def test_pattern_map():
    assert spark_pattern("%m/%d/%y %H:%M") == "M/d/yy H:mm"
    # single letters accept one or two digits when parsing
    assert spark_pattern("%Y-%m-%d %H:%M:%S") == "yyyy-M-d H:mm:ss"


def test_parse_chain(spark):
    vals = ["10/14/18 20:05", "10/9/2019 0:07", "n/a", "13/45/19 9:00", None, "nan", "1/2/95 3:04", "10/14/18\r\n 20:05"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(parse_time("v", "%m/%d/%y %H:%M")).collect()]
    assert got == [dt.datetime(2018, 10, 14, 20, 5), dt.datetime(2019, 10, 9, 0, 7), dt.datetime(2000, 1, 1),
                   dt.datetime(1970, 1, 1), None, None, dt.datetime(1995, 1, 2, 3, 4), dt.datetime(2018, 10, 14, 20, 5)]


def test_four_digit_format_has_no_fallback(spark):
    df = spark.createDataFrame([("14/10/2018 20:05",)], "v string")
    # day-first 4-digit format: parsed as given
    assert df.select(parse_time("v", "%d/%m/%Y %H:%M")).first()[0] == dt.datetime(2018, 10, 14, 20, 5)


def test_minutes(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1, 0, 0), dt.datetime(2020, 1, 2, 1, 30))],
                               "s timestamp_ntz, e timestamp_ntz")
    assert df.select(minutes_between("s", "e")).first()[0] == 1530.0
    assert df.select(F.col("s")).first()[0] == dt.datetime(2020, 1, 1)


def test_parse_is_zone_free(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        df = spark.createDataFrame([("3/10/19 2:30",), ("12/31/99 23:30",)], "v string")
        got = [r[0] for r in df.select(parse_time("v", "%m/%d/%y %H:%M")).collect()]
        assert got == [dt.datetime(2019, 3, 10, 2, 30), dt.datetime(1999, 12, 31, 23, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
