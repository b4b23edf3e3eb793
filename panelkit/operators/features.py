"""Leakage-safe split, fold assignment, encoding and scaling.

Every rule is a deterministic function of a row key (md5 of ``key:seed``), so
the split does not depend on partitioning, retries or row order, and any
engine with md5 reproduces it. Statistics (categories, means, deviations) are
fitted on the training part only and applied to every part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

TRAIN, TEST = "train", "test"


def hash_bucket(key: Column, seed: int, buckets: int) -> Column:
    """``int(md5(key:seed)[0:8], 16) % buckets``."""
    h = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10)
    return F.pmod(h.cast("long"), F.lit(buckets))


def hash_split(df: DataFrame, key: str, seed: int = 229, train_pct: int = 80, col: str = "part") -> DataFrame:
    return df.withColumn(col, F.when(hash_bucket(F.col(key), seed, 100) < train_pct, F.lit(TRAIN))
                         .otherwise(F.lit(TEST)))


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 229, col: str = "fold") -> DataFrame:
    return df.withColumn(col, hash_bucket(F.col(key), seed, k).cast("int"))


def kfold_contiguous(df: DataFrame, key: str, k: int = 5, col: str = "fold") -> DataFrame:
    """Unshuffled k-fold in ``key`` order: fold i holds the next
    ``n // k (+1 for the first n % k folds)`` rows, as a plain ``KFold``
    does on an ordered table. The k-1 boundary keys are exact order
    statistics (no global sort, no single-task row numbering); the fold is
    then a column predicate. ``key`` must be unique, of any orderable type."""
    from .rank import kth_values
    keys = cut_lineage(df.select(key).where(F.col(key).isNotNull()))
    n = keys.count()
    q, m = divmod(n, k)
    cuts, c = [], 0
    for i in range(k - 1):
        c += q + (1 if i < m else 0)
        cuts.append(c)
    if n == 0 or q == 0 and m == 0:
        return df.withColumn(col, F.lit(0))
    last = kth_values(keys, key, [r for r in cuts if r >= 1])
    fold = sum((F.when(F.col(key) > F.lit(v), 1).otherwise(0) for v in last), F.lit(0))
    return df.withColumn(col, fold.cast("int"))


def fit_categories(train: DataFrame, col: str, max_categories: int = 10_000) -> list:
    """Sorted distinct training values (the encoder's vocabulary). The list is
    metadata and bounded: more than ``max_categories`` values means the column
    should go through ``StringIndexer`` + a sparse vector instead."""
    vals = (train.select(col).where(F.col(col).isNotNull()).distinct()
                 .orderBy(col).limit(max_categories + 1).collect())
    if len(vals) > max_categories:
        raise ValueError(f"{col}: more than {max_categories} categories; use a sparse encoder")
    return [r[0] for r in vals]


def category_ids(train: DataFrame, col: str, bucket_values: int = 100_000) -> tuple[DataFrame, int]:
    """((value, id, n), size): ids from 0 by falling frequency in the training part
    (ties by hash), as a table. Values are numbered within (count, hash bucket)
    and the counts of those cells give the offsets, so no task holds the whole
    dictionary. NULL is no category."""
    counts = cut_lineage(train.select(F.col(col).alias("value")).where(F.col(col).isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n")))
    size = counts.count()
    cell = counts.withColumn("_b", F.pmod(F.xxhash64("value"), F.lit(-(-size // bucket_values) or 1)))
    before = Window.orderBy(F.col("n").desc(), "_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per distinct count and bucket
    offsets = cell.groupBy("n", "_b").agg(F.count(F.lit(1)).alias("_m")).select("n", "_b", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("n", "_b").orderBy(F.xxhash64("value"), "value")
    ids = cell.join(offsets, ["n", "_b"]).select("value", (F.col("_before") + F.row_number().over(within) - 1).cast("int").alias("id"), "n")
    return ids, size


def encode_ids(df: DataFrame, ids: DataFrame, col: str, size: int, out: str) -> DataFrame:
    """Adds the value's id; a value unseen in training, or NULL, gets ``size``."""
    named = ids.select(F.col("value").alias(col), F.col("id").alias(out))
    return df.join(named, col, "left").withColumn(out, F.coalesce(out, F.lit(size)).cast("int"))


def sparse_one_hot(df: DataFrame, id_col: str, size: int, out: str) -> DataFrame:
    """One sparse 0/1 vector of ``size`` per row from its id; the id ``size`` (unseen)
    gives the empty vector. No list of labels reaches the driver."""
    from pyspark.ml.feature import OneHotEncoder
    known = df.sparkSession.range(size).select(F.col("id").cast("double").alias(id_col))
    return OneHotEncoder(inputCol=id_col, outputCol=out, handleInvalid="keep", dropLast=True).fit(known).transform(
        df.withColumn(id_col, F.col(id_col).cast("double")))


def one_hot(df: DataFrame, col: str, categories: list, prefix: str | None = None) -> DataFrame:
    """One 0/1 column per training category; a value unseen in training encodes
    to all zeros (no column for it), on every part alike."""
    prefix = prefix or f"{col}_is_"
    return df.select(*df.columns, *[F.when(F.col(col) == F.lit(v), 1).otherwise(0).alias(f"{prefix}{v}")
                                    for v in categories])


def unseen_rows(test: DataFrame, train: DataFrame, col: str) -> DataFrame:
    """Test rows whose category never appears in training (anti join on the
    distinct training values)."""
    seen = train.select(col).distinct()
    return test.join(seen, col, "left_anti")


def fit_scaler(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column (divisor 1 for a
    constant column), from one aggregation over the training part."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    r = train.agg(*aggs).first()
    out = {}
    for c in cols:
        m, s = r[f"m_{c}"], r[f"s_{c}"]
        out[c] = (m, s if s not in (None, 0.0) else 1.0)
    return out


def apply_scaler(df: DataFrame, stats: dict[str, tuple[float, float]], prefix: str = "z_") -> DataFrame:
    return df.select(*df.columns, *[((F.col(c) - F.lit(m)) / F.lit(s)).alias(f"{prefix}{c}")
                                    for c, (m, s) in stats.items()])
