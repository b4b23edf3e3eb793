"""Batch loading: many report batches, each with its own schema family and
datetime formats, cleaned and stacked into one typed table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from ..functions.dates import parse_time


def union_batches(batches: list[DataFrame]) -> DataFrame:
    """Union by column name; columns missing in a batch are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def load_batches(config: list[dict], reader: Callable[[dict], DataFrame],
                 time_cols: dict[str, str],
                 normalise: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``config``: one dict per batch with its formats, e.g.
    ``{"batch": 3, "start": "%m/%d/%y %H:%M", "end": "%Y-%m-%d %H:%M:%S"}``;
    ``time_cols`` maps a (canonical) text column to the config key holding its
    format. Each batch gets its headers normalised (``normalise``), is parsed
    with its own formats (one projection per batch), then all are stacked."""
    parts = []
    for cfg in config:
        df = reader(cfg)
        if normalise is not None:
            df = normalise(df)
        for col, key in time_cols.items():
            if col in df.columns:
                df = df.withColumn(col, parse_time(col, cfg[key]))
        parts.append(df)
    return union_batches(parts)
