"""SimHash near-dedup with pivot distance tables.

Fingerprints: 64-bit majority vote over the XXH64 of all word shingles,
repeats included. Only distinct fingerprints are compared.

Links: each distinct fingerprint carries a table of its Hamming distances to
`PIVOTS` reference fingerprints. By the triangle inequality a pair within
`bits` differs by at most `bits` in every coordinate, so a pair is discarded by
its largest coordinate difference, and the survivors are verified bit by bit.
Which pairs meet at all is decided by agreement on blocks: two fingerprints
that differ in at most two bits agree on two of four 16-bit blocks, so rows
meet on those 32 bits (six keys a fingerprint). A key with over `MEET` members
is cut again in the same way by its remaining bits (32, then 16), down to keys
with 8 free bits and so at most 256 distinct members: no key's pairs grow with
the square of a group, and no pair is lost at any step.

Defined cases: a NULL or empty text (or one without words) has fingerprint
zero, linked like any other; fewer words than a shingle give the whole
sequence as one shingle; equal texts share a fingerprint; NULL ids are never a
component's smallest id unless it has no other; an empty table gives an empty
table; repeated rows get the same component; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, connected_components, discard, fresh, materialise, slices, with_row_id
from .exact_dedup import drop_rows

PIVOTS = 16
MEET = 64
BITS = 64


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    got = np.array([h(joined[a:b], 42) for a, b in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())],
                   np.uint64)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(got), 1 << 14):
        votes += np.unpackbits(got[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(got), bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame, shingle: int = 3) -> DataFrame:
    """(row, doc_id, text) -> (row, doc_id, fp long): the fingerprint's 64 bits, signed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(fp.view(np.int64))], ["row", "doc_id", "fp"])

    schema = T.StructType([rows.schema["row"], T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
    return rows.select("row", "doc_id", "text").mapInArrow(run, schema)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def child_masks(free: tuple[int, ...], bits: int) -> list[tuple[int, ...]]:
    """Ways to fix all but `bits` of bits + 2 blocks of the free bit positions;
    a pair that differs in at most `bits` of them agrees on one of the ways."""
    blocks = np.array_split(np.array(free), bits + 2)
    return [tuple(int(x) for b in gone for x in b) for gone in combinations(blocks, bits)]


def mask_tree(bits: int, depth: int = 3) -> list[list[tuple[int, int, int]]]:
    """Per level (parent path, path, mask of fixed bits); 6, 36 and 216 masks for two bits."""
    every, level, out = (1 << 64) - 1, [(0, tuple(range(BITS)))], []
    for _ in range(depth):
        rows, below = [], []
        for path, free in level:
            for k, left in enumerate(child_masks(free, bits)):
                below.append((len(rows), left))
                rows.append((path, len(rows), signed(every & ~sum(1 << b for b in left))))
        out.append(rows)
        level = below
    return out


def pivot_table(distinct: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """Adds d0 ...: Hamming distances to reference fingerprints fixed by a rule."""
    return distinct.select("*", *[F.bit_count(F.col("fp").bitwiseXOR(F.xxhash64(F.lit(f"pivot {i}")))).cast("tinyint").alias(f"d{i}")
                                  for i in range(pivots)])


def _meeting(rows: DataFrame, masks: list[tuple[int, int, int]], above: DataFrame | None) -> DataFrame:
    """Rows (fp, d*, path, key): each fingerprint under each mask of the level."""
    by_parent: dict[int, list[tuple[int, int]]] = {}
    for parent, path, m in masks:
        by_parent.setdefault(parent, []).append((path, m))

    def ways(parent: int) -> Column:
        return F.array(*[F.struct(F.lit(p).alias("path"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for p, m in by_parent[parent]])

    if above is None:
        return rows.select("*", F.explode(ways(0)).alias("w")).select("*", "w.path", "w.key").drop("w")
    pick = None
    for parent in sorted(by_parent):
        pick = F.when(F.col("path") == parent, ways(parent)) if pick is None else pick.when(F.col("path") == parent, ways(parent))
    return rows.select("*", F.explode(pick).alias("w")).drop("path", "key").select("*", "w.path", "w.key").drop("w")


def links(distinct: DataFrame, bits: int = 2, pivots: int = PIVOTS, meet: int = MEET) -> DataFrame:
    """(u, v): pairs of distinct fingerprints, u < v, at most `bits` bits apart."""
    table = materialise(pivot_table(distinct.select("fp"), pivots), "pivots")
    found, rows = None, table
    tree = mask_tree(bits)
    for depth, masks in enumerate(tree):
        rows = _meeting(rows, masks, None if depth == 0 else rows)
        last = depth == len(tree) - 1
        cold = rows
        if not last:
            hot = materialise(rows.groupBy("path", "key").agg(F.count("*").alias("n")).where(F.col("n") > meet).select("path", "key"), "hot-keys")
            if some := not hot.isEmpty():
                rows = materialise(rows, "hot-all")
                cold = rows.join(hot, ["path", "key"], "left_anti")
                rows = materialise(rows.join(hot, ["path", "key"], "left_semi"), "hot-rows")
        a = cold.select("path", "key", F.col("fp").alias("u"), *[F.col(f"d{i}").alias(f"a{i}") for i in range(pivots)])
        b = cold.select("path", "key", F.col("fp").alias("v"), *[F.col(f"d{i}").alias(f"b{i}") for i in range(pivots)])
        near = F.greatest(*[F.abs(F.col(f"a{i}") - F.col(f"b{i}")) for i in range(pivots)]) <= bits
        pairs = a.join(b, ["path", "key"]).where((F.col("u") < F.col("v")) & near
                                                 & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)).select("u", "v")
        found = pairs if found is None else found.union(pairs)
        if last or not some:
            break
    return found.distinct()


def _components(rows: DataFrame, bits: int) -> DataFrame:
    """(fp, component_id, keep_row) of stored rows (row, doc_id, fp)."""
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"),
                                                  F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")), "fps")
    labels = connected_components(links(distinct, bits), "simhash")
    named = distinct.join(labels, distinct["fp"] == labels["node"], "left").select(
        "fp", "least", "first", F.coalesce("label", "fp").alias("label"))
    named = materialise(named, "named")
    comp = named.groupBy("label").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    return materialise(named.select("fp", "label").join(comp, "label")
                       .select("fp", "component_id", F.col("first.row").alias("keep_row")), "components")


def simhash_groups(docs: DataFrame, shingle: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, fp, component_id), one row per input row; component_id is the
    smallest doc_id reachable over links of at most `bits` differing bits."""
    t = docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).cast("long").alias("doc_id"),
                    F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = materialise(fingerprints(t, shingle), "fingerprints")
    return rows.join(_components(rows, bits), "fp").select("row", "doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text",
                         stored: bool = False) -> DataFrame:
    """The rows of `docs` that stay, all columns: the first of each component
    (smallest doc_id). `stored`: see `with_row_id`."""
    rid = fresh(docs.columns, "row_id")
    named = with_row_id(docs, "near-docs", rid, stored)
    t = named.select(col(rid).alias("row"), col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = materialise(fingerprints(t, shingle), "fingerprints")
    gone = materialise(rows.join(_components(rows, bits), "fp").where("row <> keep_row").select(F.col("row").alias(rid)), "near-gone")
    discard(rows)
    return drop_rows(named, gone, rid).select([col(c) for c in docs.columns])


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
