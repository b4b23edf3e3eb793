"""Text-file sources and sinks.

Reports arrive as CSV with unreliable types, so they are read with an
explicit all-string schema (no inference pass over the data) and cast in one
declared step. Column pruning reaches the CSV reader.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage


def string_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def read_text_csv(spark: SparkSession, path: str, columns: list[str],
                  use: list[str] | None = None, header: bool = True, multi_line: bool = True) -> DataFrame:
    """All-string CSV scan; ``use`` is the column subset (usecols).

    ``multi_line`` keeps quoted fields with embedded CR/LF intact (report
    headers and community lists have them) but makes each file one task; large
    files with such fields go through `read_quoted_csv`, and files without them
    can turn it off. Records end
    at LF: left to auto-detection, a quoted CR LF in the header makes the
    parser split records on CR LF and lose rows; a CR before the LF of
    Windows files is trimmed with the other trailing whitespace. A doubled quote
    in a quoted field is one quote."""
    df = (spark.read.schema(string_schema(columns)).option("header", header)
          .option("multiLine", multi_line).option("lineSep", "\n")
          .option("ignoreTrailingWhiteSpace", True).option("escape", '"').csv(path))
    return df.select(*(use or columns))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits, in file order -> whole records, and the pieces of records
    that cross a split: kind 0 whole, 1 the rest of an earlier split's record, 2 the
    begin of one. `first` marks what begins the file."""
    now, inside, begun, held, out = None, False, False, [], []

    def close() -> None:
        if held:
            out.append((*now, 2 if begun else 1, fresh, "\n".join(held)))

    for b in batches:
        for file, block, start, line in zip(*(b.column(c).to_pylist() for c in ("file", "block", "inside", "value"))):
            if (file, block) != now:
                if now is not None:
                    close()
                now, inside, held, first = (file, block), bool(start), [], block == 0
                begun = not inside
            if not held:
                fresh, first = first, False
            held.append(line)
            inside ^= bool(line.count('"') % 2)
            if not inside:
                out.append((file, block, 0 if begun else 1, fresh, "\n".join(held)))
                held, begun = [], True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()))],
                                             ["file", "block", "kind", "first", "record"])
            out.clear()
    if now is not None:
        close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()))],
                                         ["file", "block", "kind", "first", "record"])


MOST_SPLITS = 1 << 20  # splits whose start states (about 100 bytes each) are broadcast


def read_quoted_csv(spark: SparkSession, path: str, columns: list[str], use: list[str] | None = None,
                    header: bool = True) -> DataFrame:
    """`read_text_csv` for large files whose quoted fields hold line breaks: a file is
    read in as many tasks as it has splits.

    A line break ends a record only outside quotes, that is after an even number
    of quote characters. One pass counts each split's quotes, a running sum over
    a file's splits (one row each) says whether a split begins inside quotes,
    and the second pass cuts each split's lines into records. The pieces of
    records that cross splits, at most two a split, are put together by file.
    White space is trimmed at the end of a record only (the record parser fails
    on quoted fields of nothing but line breaks when told to trim all fields).
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = raw.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = cut_lineage(odd.select("file", "block", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).cast("int").alias("inside")))
    if (n := inside.count()) > MOST_SPLITS:
        raise ValueError(f"{n} splits are over {MOST_SPLITS}: raise spark.sql.files.maxPartitionBytes")
    # a broadcast join leaves the lines of a split in their order
    pieces = cut_lineage(raw.join(F.broadcast(inside), ["file", "block"]).mapInArrow(
        _records, "file string, block long, kind int, first boolean, record string"))
    whole = pieces.where("kind = 0").select("first", "record")
    order = Window.partitionBy("file").orderBy("block", "kind")
    parts = pieces.where("kind > 0").withColumn("of", F.count_if(F.col("kind") == 2).over(order))
    joined = parts.groupBy("file", "of").agg(F.bool_or("first").alias("first"),
                                             F.array_sort(F.collect_list(F.struct("block", "kind", "record"))).alias("p"))
    records = whole.unionByName(joined.select("first", F.array_join(F.col("p.record"), "\n").alias("record")))
    if header:
        records = records.where(~F.col("first"))
    records = records.withColumn("record", F.regexp_replace("record", r"[ \t\r]+$", "")).where("record <> ''")
    schema = ", ".join(f"`{c}` string" for c in columns)
    row = F.from_csv("record", schema, {"escape": '"'})
    return records.select(row.alias("r")).select([F.col(f"r.`{c}`") for c in use or columns])


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """ANSI-safe cast pass: bad text becomes NULL instead of failing the job."""
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c)
                       for c in df.columns])


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None,
              mode: str = "overwrite") -> None:
    w = df.write.mode(mode).option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def read_with_path_keys(spark: SparkSession, path: str, columns: list[str],
                        keys: dict[str, str]) -> DataFrame:
    """Scan a folder of many small files and lift keys out of each file's path.

    ``keys`` maps an output column to a regex with one group, applied to the
    URL-decoded ``_metadata.file_path``. Partition discovery is switched off
    (recursive lookup) so the keys come from the names themselves.
    """
    df = (spark.read.schema(string_schema(columns)).option("header", True)
          .option("recursiveFileLookup", True).csv(path))
    fp = F.url_decode(F.col("_metadata.file_path"))
    return df.select(*columns, *[F.regexp_extract(fp, rx, 1).alias(k) for k, rx in keys.items()])
