"""Exact dedup by two passes over a Bloom filter of text hashes.

Pass 1 builds a counting Bloom filter with cells that saturate at two: every
task counts its own hashes' cells and emits them by segment; segments are
summed in a stream and reduced to one bit a cell, "two or more". Pass 2 tests
each row: only if all its cells have the bit can its hash occur twice. Those
rows alone shuffle and are grouped by their SHA-256; the rest pass straight
through. The filter has `CELLS_PER_ROW` cells a row, `MOST_CELLS` at most (32
MB as bits, the bound of what is broadcast); beyond that more rows shuffle, and
the result is the same.

Defined cases: a NULL text is empty, so NULL and empty texts are equal; of
equal texts the largest doc_id stays (NULL ids lose to any other); of repeated
rows with that id exactly one stays; an empty table gives an empty table;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, discard, fresh, materialise, shuffle_width, texts, with_row_id

CELLS_PER_ROW = 16
MOST_CELLS = 1 << 28
SEGMENT = 1 << 16
PROBES = 4
FLUSH_ROWS = 500_000


def cells(h: np.ndarray, size: int) -> np.ndarray:
    """(len(h), PROBES) cells of 64-bit hashes: double hashing, size a power of two."""
    with np.errstate(over="ignore"):
        a = h.astype(np.uint64)
        b = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) >> np.uint64(64 - size.bit_length() + 1)


def hits(h: np.ndarray, size: int, bits: np.ndarray) -> np.ndarray:
    """Which hashes have all their bits set."""
    c = cells(h, size).astype(np.int64)
    return ((bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1).all(axis=1)


def _count(size: int) -> Callable:
    def flush(hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        # a row counts a cell once, however many of its probes meet there
        c = np.sort(cells(np.concatenate(hashes), size), axis=1)
        keep = np.ones(c.shape, bool)
        keep[:, 1:] = c[:, 1:] != c[:, :-1]
        at, n = np.unique(c[keep].astype(np.int64), return_counts=True)
        seg = at // SEGMENT
        cut = np.flatnonzero(np.diff(seg, prepend=-1))
        low, twice = (at % SEGMENT).astype("<u2"), n > 1
        ends = [*cut[1:].tolist(), len(at)]
        for i in range(0, len(cut), 256):
            spans = list(zip(cut[i:i + 256].tolist(), ends[i:i + 256]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(seg[cut[i:i + 256]].astype("i4")), pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()),
                 pa.array([np.packbits(twice[a:b]).tobytes() for a, b in spans], pa.binary())],
                ["segment", "cells", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rows = [], 0
        for b in batches:
            hashes.append(b.column("h").to_numpy(zero_copy_only=False).view(np.uint64))
            rows += b.num_rows
            if rows >= FLUSH_ROWS:
                yield from flush(hashes)
                hashes, rows = [], 0
        if rows:
            yield from flush(hashes)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream over rows sorted by segment; one running array of counts."""
    now, counts = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())],
                                          ["segment", "bits"])

    for b in batches:
        for seg, low, twice in zip(*(b.column(c).to_pylist() for c in ("segment", "cells", "twice"))):
            if seg != now:
                if now is not None:
                    yield done()
                now, counts = seg, np.zeros(SEGMENT, np.uint8)
            at = np.frombuffer(low, "<u2")
            more = 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=len(at))
            counts[at] = np.minimum(counts[at] + more, 2)
    if now is not None:
        yield done()


def repeated_hash_filter(hashes: DataFrame, rows: int, most_cells: int = MOST_CELLS) -> tuple[int, np.ndarray]:
    """Pass 1 over a column h of 64-bit hashes: (cells, bit array "seen twice")."""
    size = max(SEGMENT, min(most_cells, 1 << max(1, CELLS_PER_ROW * rows - 1).bit_length()))
    segments = size // SEGMENT
    parts = (hashes.select("h").mapInArrow(_count(size), "segment int, cells binary, twice binary")
             .repartition(min(segments, shuffle_width(hashes.sparkSession)), "segment")
             .sortWithinPartitions("segment").mapInArrow(_add, "segment int, bits binary"))
    bits = np.zeros(size // 8, np.uint8)
    for r in parts.toLocalIterator():  # size / 8 bytes in all, 32 MB at most
        bits[r.segment * (SEGMENT // 8):(r.segment + 1) * (SEGMENT // 8)] = np.frombuffer(r.bits, np.uint8)
    return size, bits


def flag_repeated(rows: DataFrame, size: int, bits: np.ndarray, flag: str = "maybe") -> DataFrame:
    """Pass 2: the rows with a boolean, false only if the hash h occurs once."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(bits)
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = shared.value
        for b in batches:
            hit = hits(b.column("h").to_numpy(zero_copy_only=False).view(np.uint64), size, got)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit)], [*b.schema.names, flag])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(flag, T.BooleanType())]))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                normalise: Callable[[Column], Column] | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Texts are equal when identical after `normalise` (a Column -> Column rule;
    none: as they are).
    """
    t = texts(docs, id_col, text_col)
    if normalise:
        t = t.withColumn("text", F.coalesce(normalise(F.col("text")), F.lit("")))
    hashed = t.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                      F.sha2("text", 256).alias("text_sha256"), F.xxhash64("text").alias("h"))
    size, bits = repeated_hash_filter(t.select(F.xxhash64("text").alias("h")), t.count(), most_cells)
    rows = materialise(flag_repeated(hashed, size, bits), "exact-rows")
    return _groups(rows)


def _groups(rows: DataFrame) -> DataFrame:
    out = ["row", "doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    alone = rows.where("not maybe").select("row", "doc_id", F.col("doc_id").alias("keep_id"),
                                           F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = rows.where("maybe")
    # written down so that both sides of the join are plain shuffles, which a hot key splits
    groups = materialise(some.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("best"),
                                                         F.count("*").alias("group_size")), "exact-groups")
    together = some.join(groups, "text_sha256").select(
        "row", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")
    return alone.select(out).union(together.select(out))


def drop_rows(docs: DataFrame, gone: DataFrame, row_id: str) -> DataFrame:
    """`docs` without the rows whose id is in the stored one-column table `gone`.

    A Bloom filter of the ids lets rows that can't be among them pass straight
    through; only the others shuffle, for an exact anti join by the unique id.
    """
    h = F.xxhash64(col(row_id))
    ids = gone.select(h.alias("h"))
    size, bits = repeated_hash_filter(ids.union(ids), gone.count())  # each id twice: "seen" is "seen twice"
    test = membership(docs.sparkSession, size, bits)
    names = [col(c) for c in docs.columns]
    return docs.where(~test(h)).select(names).union(docs.where(test(h)).join(gone, row_id, "left_anti").select(names))


def membership(spark: SparkSession, size: int, bits: np.ndarray) -> Callable[[Column], Column]:
    """A Column -> Column test of 64-bit hashes against a filter."""
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(hits(h.to_numpy(np.int64).view(np.uint64), size, shared.value))

    return test


def drop_exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                          most_cells: int = MOST_CELLS, stored: bool = False) -> DataFrame:
    """The rows of `docs` that stay, all columns (`stored`: see `with_row_id`)."""
    rid = fresh(docs.columns, "row_id")
    named = with_row_id(docs, "exact-docs", rid, stored)
    t = named.select(col(rid).alias("row"), col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    size, bits = repeated_hash_filter(t.select(F.xxhash64("text").alias("h")), t.count(), most_cells)
    rows = materialise(flag_repeated(t.select("row", "doc_id", F.sha2("text", 256).alias("text_sha256"),
                                              F.xxhash64("text").alias("h")), size, bits), "exact-rows")
    gone = materialise(_groups(rows).where("not kept").select(col("row").alias(rid)), "exact-gone")
    discard(rows)
    return drop_rows(named, gone, rid).select([col(c) for c in docs.columns])
