"""Scalar cleaning rules on the edge values of FIXTURES section 11."""

from pyspark.sql import functions as F

from panelkit.functions import numeric as num
from panelkit.functions import text as tx


def _one(spark, col_expr, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(col_expr(F.col("v"))).collect()]


def test_entity_name(spark):
    got = _one(spark, tx.entity_name, ["SONOMA 1107*", "BIG BEND 1101", "BELL", "LINE\r\nX 22051", None, "A 123",
                                       "BIG\rBEND 1101"])
    assert got == ["SONOMA", "BIG BEND", "BELL", "X", None, "A 123", "BIG\rBEND"]


def test_max_digit(spark):
    assert _one(spark, tx.max_digit, ["Tier 2, Tier 3", "None", None, "3*"]) == [3, 0, 0, 3]


def test_numbers(spark):
    assert _one(spark, num.strip_commas_double, ["1,234", "nan", None, "x"]) == [1234.0, None, None, None]
    assert _one(spark, num.census_number, ["250,000+", "-", "1,234", None]) == [250000.0, None, 1234.0, None]
    assert _one(spark, num.hemisphere, ["121.5W", "38.1N", "10S", None]) == [-121.5, 38.1, -10.0, None]


def test_stem_and_keys(spark):
    assert _one(spark, tx.name_stem, ["ALPHA-12", "ALPHA 3", "BETA", "A-12\r", "A-12\n"]) == \
        ["ALPHA", "ALPHA", "BETA", "A-12", "A"]
    assert _one(spark, tx.join_key_clean, ["BIG BEND 1101*", "X\r\n 7"]) == ["BIG BEND1101", "X7"]
    assert _one(spark, tx.match_key_left, ["SONOMA NO. 1107", " A.B 2 "]) == ["SONOMA", "AB"]
    assert _one(spark, tx.match_key_right, ["BIG BEND TAP", "A & B 12"]) == ["BIG BEND", "A  B"]
    assert _one(spark, tx.split_second, ["CA,Sonoma", "CA", None]) == ["Sonoma", None, None]
    assert _one(spark, tx.first_5digit, ["ZCTA5 94110", "none"]) == ["94110", ""]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        new = [0]
        for j in range(1, len(b) + 1):
            new.append(row[j - 1] + 1 if b[j - 1] == ch else max(row[j], new[j - 1]))
        row = new
    return row[-1]


def _ratio(a, b):
    import re

    def norm(s):
        s = re.sub(r"[^\x00-\x7F]", "", s)
        s = re.sub(r"[^A-Za-z0-9_]", " ", s).lower()
        return " ".join(sorted(s.split()))
    a, b = norm(a), norm(b)
    if not a or not b:
        return 0
    return int(round(200 * _lcs(a, b) / (len(a) + len(b))))


def test_token_sort_ratio(spark):
    pairs = [("BEND BIG", "Big Bend Tap"), ("SONOMA", "SOMONA"), ("", "X"), ("A", "A"),
             ("Eel River", "EEL RIVER #2"), ("café du monde", "CAFE DU MONDE"), ("abcd", "dcba")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(tx.token_sort_ratio("a", "b")).collect()]
    assert got == [_ratio(a, b) for a, b in pairs]
    lcs = [r[0] for r in df.select(tx.lcs_length("a", "b")).collect()]
    assert lcs == [_lcs(a, b) for a, b in pairs]


def test_unicode_whitespace_like_python(spark):
    nbsp = " "
    assert _one(spark, tx.collapse_ws, [f"a{nbsp}{nbsp}b"]) == ["a b"]
    assert _one(spark, tx.strip_all, [f"{nbsp}x{nbsp}"]) == ["x"]
    assert _one(spark, tx.entity_name, [f"BIG BEND{nbsp}1101"]) == ["BIG BEND"]
