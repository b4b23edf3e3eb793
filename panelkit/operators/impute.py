"""Sibling imputation: fill rows with a missing start from the rows whose name
shares the same stem (name without a trailing ``-?digits``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_stem


def _epoch():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _micros(c):
    """Microseconds since the epoch of a wall-clock time (no time zone)."""
    return F.timestamp_diff("MICROSECOND", _epoch(), c)


def sibling_impute(df: DataFrame, *, name: str, start: str, end: str, duration: str,
                   text: str, sentinel: str = "2000-01-01 00:00:00", all_texts_by: str | None = None) -> DataFrame:
    """Rows with NULL ``start`` take, over siblings with a real start (after the
    sentinel): mean start, mean end, half-even rounded mean duration, and the
    comma-joined sorted *distinct* sibling texts. A row with no sibling keeps
    its NULLs. Adds ``stem`` and ``imputed``.

    ``all_texts_by`` names a column: then every sibling's text is joined in that
    column's order, repeats included, as the source does. One text of that kind
    grows with the stem's rows, so it is not the default.

    Scale: the per-stem statistics are one grouped aggregation with map-side
    partial sums (a stem holding a third of the rows is pre-reduced per
    partition), over the stems that have a row to fill; the distinct text set is
    bounded by the number of distinct texts, not rows.
    """
    d = df.withColumn("stem", name_stem(F.col(name)))
    wanted = d.where(F.col(start).isNull()).select("stem").distinct()
    good = d.where(F.col(start) > F.lit(sentinel).cast("timestamp_ntz")).join(wanted, "stem", "left_semi")
    if all_texts_by:
        rows = F.array_sort(F.collect_list(F.struct(F.col(all_texts_by).alias("by"), F.col(text).alias("text"))))
        joined = F.array_join(F.transform(rows, lambda r: r["text"]), ", ")
    else:
        joined = F.array_join(F.array_sort(F.collect_set(F.col(text))), ", ")
    stats = good.groupBy("stem").agg(
        F.avg(_micros(F.col(start))).alias("_s"),
        F.avg(_micros(F.col(end))).alias("_e"),
        F.bround(F.avg(F.col(duration)), 0).alias("_d"),
        joined.alias("_t"))
    j = d.join(stats, "stem", "left")
    miss = F.col(start).isNull() & F.col("_s").isNotNull()
    to_ts = lambda c: F.timestamp_add("MICROSECOND", F.round(F.col(c)).cast("long"), _epoch())
    return j.select(
        *[c for c in df.columns if c not in (start, end, duration, text)], "stem",
        F.when(miss, to_ts("_s")).otherwise(F.col(start)).alias(start),
        F.when(miss, to_ts("_e")).otherwise(F.col(end)).alias(end),
        F.when(miss, F.col("_d")).otherwise(F.col(duration)).alias(duration),
        F.when(miss, F.col("_t")).otherwise(F.col(text)).alias(text),
        miss.alias("imputed"))

