"""Corpus pipeline: toxicity, exact copies, near copies, repeated passages, packing.

Each stage takes what its predecessor kept, as a stored table, and returns the
columns of `documents` (the last one: packed pieces). All work is in the
operators of `panelkit.llm`.

Defined cases, for every stage: a NULL text is an empty document and stays
NULL; NULL ids and repeated rows are rows like any other (copies go in the
second stage); extra columns are carried along; an empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelkit.llm import exact_dedup, packing, simhash, suffix_dedup, toxicity
from panelkit.llm.common import materialise
from panelkit.session import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs, stored=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the row with the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs, shingle=3, bits=2, stored=True)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes inside repeated 400-byte strings go; every document stays."""
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 ids; one row per piece."""
    return packing.pack_documents(docs, length=4096).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("SimHash near-dedup", drop_near_copies),
          ("suffix-array dedup", remove_passages), ("best-fit packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
