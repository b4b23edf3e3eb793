"""Header, projection and filter operators (DataFrame -> DataFrame)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise_headers(df: DataFrame, synonyms: dict[str, str], drop_suffix: str | None = None,
                      conditional: dict[str, str] | None = None) -> DataFrame:
    """Strip header text, drop a suffix, map synonyms to canonical names, then
    rename ``conditional`` sources only when their target is still absent.
    Pure metadata: one projection, no data pass."""
    names = [c.strip() for c in df.columns]
    if drop_suffix:
        names = [re.sub(re.escape(drop_suffix) + "$", "", n) for n in names]
    names = [synonyms.get(n, n) for n in names]
    for src, dst in (conditional or {}).items():
        if dst not in names and src in names:
            names = [dst if n == src else n for n in names]
    return df.toDF(*names)


def columns_matching(df: DataFrame, pattern: str) -> DataFrame:
    rx = re.compile(pattern)
    return df.select(*[c for c in df.columns if rx.search(c)])


def optional_filter(df: DataFrame, column: str, keep_upper: str) -> DataFrame:
    """If ``column`` exists keep rows whose upper-cased value equals ``keep_upper``
    and drop the column; otherwise pass through."""
    if column not in df.columns:
        return df
    return df.where(F.upper(F.col(column)) == keep_upper).drop(column)


def name_ok(c: Column) -> Column:
    """Usable entity name: not UNKNOWN, not starting with a digit, not ending in LINE."""
    u = F.upper(c)
    return (u != "UNKNOWN") & ~u.rlike(r"^\d") & ~u.endswith("LINE")


def after_sentinel(c: Column, sentinel: str = "2000-01-01 00:00:00") -> Column:
    """Strictly after the sentinel; NULL compares false, so NULL rows drop."""
    return c > F.lit(sentinel).cast("timestamp_ntz")


def not_equal_null_true(c: Column, value) -> Column:
    """``c != value`` where NULL counts as different (True), as in pandas."""
    return ~c.eqNullSafe(F.lit(value))


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: non-null count, null count, type -- one aggregation pass, then
    unpivot (long form: column, dtype, non_null, nulls)."""
    n = F.count(F.lit(1)).alias("_n")
    aggs = [n] + [F.count(F.col(c)).alias(f"_nn_{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', '{t}', _nn_{i}" for i, (c, t) in enumerate(df.dtypes))
    return (wide.selectExpr(f"stack({len(df.columns)}, {stack}) AS (column_name, dtype, non_null)", "_n")
                .select("column_name", "dtype", "non_null", (F.col("_n") - F.col("non_null")).alias("nulls")))
