"""Helpers shared by the training-data operators.

Conventions that hold for all operators here:

* columns are picked by name at once and renamed to names of the operator's
  own, so extra columns of the input can't clash with working columns;
* a NULL text is an empty text; a NULL id stays a row of its own;
* intermediate tables are written as Parquet under the shared checkpoint
  folder (`panelkit.session.scratch_dir`), which survives lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.session import scratch_dir

#: Words are runs of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def col(name: str) -> Column:
    """A column by its literal name (dots and back-ticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: list[str], base: str) -> str:
    """A column name that the table doesn't have yet (case ignored)."""
    have, name = {c.lower() for c in taken}, base
    while name.lower() in have:
        name += "_"
    return name


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a NULL text read as empty."""
    return docs.select(col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet into the shared scratch folder and read back: a lineage
    cut with columns, statistics and fresh partitions."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by `materialise` that no later step reads."""
    spark, path = df.sparkSession, getattr(df, "scratch_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def with_row_id(docs: DataFrame, name: str, row_id: str, stored: bool = False) -> DataFrame:
    """The table with a unique, non-NULL row id that is the same in every read.

    `stored`: the table is Parquet files read as they are (maybe filtered), so a
    row's file and place name it. Otherwise the rows are numbered and written.
    """
    if stored:
        return docs.select("*", F.concat(F.col("_metadata.file_path"), F.lit("#"), F.col("_metadata.row_index").cast("string")).alias(row_id))
    return materialise(docs.withColumn(row_id, F.monotonically_increasing_id()), name)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a batch holds about `most` bytes of text
    (one longer row makes a batch of its own)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()
        begin = total = 0
        for i, n in enumerate(sizes):
            if i > begin and total + n > most:
                yield b.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        yield b.slice(begin)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) -> (node, smallest node of its component among these edges)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    nodes = [x for x, up in parent.items() if x != up]
    for i in range(0, len(nodes), 1 << 16):
        part = nodes[i:i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["u", "v"])


def _sum_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first())


def connected_components(edges: DataFrame, name: str, part_edges: int = 200_000) -> DataFrame:
    """(node, label) for every node of an edge list (u, v) of longs; the label is
    the component's smallest node. Nodes without an edge aren't returned.

    The edges are dealt to partitions of about `part_edges` and contracted there
    by union-find to one edge per node. What several partitions hold is joined
    by alternating large-star and small-star rounds: each is two grouped minima
    and joins over the contracted edges, written down between rounds, until a
    round changes no edge.
    """
    e = materialise(edges.select("u", "v").where("u <> v"), f"{name}-edges")
    parts = max(1, -(-e.count() // part_edges))
    first = materialise(e.coalesce(parts).mapInArrow(_forest, "u long, v long"), f"{name}-forest")
    discard(e)
    e, seen = first, None
    while parts > 1:
        now = _sum_of(e)
        if now == seen:
            break
        seen = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .where("u <> v").distinct(), f"{name}-large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        new = materialise(small, f"{name}-small")
        discard(large)
        discard(e)
        e = new
    labels = e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return labels.union(roots)


def checked_small(df: DataFrame, rows: int) -> DataFrame:
    """The table marked for broadcast; only for tables whose row count is
    bounded by construction (`rows` documents the bound)."""
    assert rows <= 1 << 20
    return F.broadcast(df)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
