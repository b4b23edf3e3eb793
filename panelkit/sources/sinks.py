"""Sinks: the main/reject split and keyed prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_rejects(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows passing ``ok`` and the rest (NULL counts as reject)."""
    flag = F.coalesce(ok, F.lit(False))
    return df.where(flag), df.where(~flag)


def write_split(df: DataFrame, ok: Column, path: str, good: str = "ok", bad: str = "rejected") -> None:
    """Write main and reject rows as two folders (status=...) of one table in one
    job: the input is computed once, and a retry writes both anew."""
    with_status(df, ok, good, bad).write.mode("overwrite").partitionBy("status").parquet(path)


def with_status(df: DataFrame, ok: Column, good: str = "ok", bad: str = "rejected") -> DataFrame:
    return df.withColumn("status", F.when(F.coalesce(ok, F.lit(False)), F.lit(good)).otherwise(F.lit(bad)))
