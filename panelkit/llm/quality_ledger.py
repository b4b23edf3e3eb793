"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements
and one long of failure bits; a policy is a named, versioned set of rules and
only reads the bits, so policies and ablations need no second look at a text:
a document is dropped if `failed & policy` is not zero, and it hangs on rule r
alone if `failed & policy` is exactly that rule's bit. Ablation counts are
conditional sums over the ledger, pre-aggregated map side.

Defined cases: a NULL text is empty and has no words, so it fails the word
count; rules with a ratio hold for a text without words; repeated rows are
measured each; an empty table gives an empty ledger; extra columns are not
read. Whole texts are measured.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "longest_word")
SYMBOLS = "#*$%&|<>"

#: Rule name -> failure condition over the measurements. The bit is the place in this list.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "100 * n_symbols > 40 * n_words",
    "repeated_lines": "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines",
    "short_words": "n_words >= 20 and word_chars < 2 * n_words",
    "long_words": "n_words >= 20 and word_chars > 15 * n_words",
    "endless_word": "longest_word > 1000",
}
#: (policy, version) -> its rules. A version is never changed, only followed by another.
POLICIES: dict[tuple[str, int], tuple[str, ...]] = {
    ("base", 1): ("few_words", "repeated_windows"),
    ("pretraining", 1): ("few_words", "repeated_windows", "many_symbols"),
    ("pretraining", 2): tuple(RULES),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: tuple[str, int]) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def repeat_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words inside k-word windows that occur twice or more. Exact: windows get
    names by doubling (2, 4, 8 words), equal names only for equal windows."""
    n = len(words)
    if n <= k:
        return 0
    seen: dict[bytes, int] = {}
    names = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    width = 1
    while width < k:
        pair = names[:-width] * (len(names) + 1) + names[width:]
        uniq, names = np.unique(pair, return_inverse=True)
        if len(uniq) == len(pair):
            return 0
        width *= 2
    twice = np.flatnonzero(np.bincount(names)[names] > 1)
    if not len(twice):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + k, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:n]))


def measure(text: str) -> tuple[int, ...]:
    data = text.encode()
    words = data.split()  # bytes.split() cuts at exactly the six ASCII white-space bytes
    lines = [x for x in data.split(b"\n") if x.split(None, 1)] if words else []
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    return (len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeat_words(words), len(lines), max(map(len, words), default=0))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        got = list(zip(*map(measure, b.column("text").to_pylist())))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in got)], ["doc_id", *MEASURES])


def quality_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements, failed long): the failure bits of every rule."""
    measured = texts(docs, id_col, text_col).mapInArrow(_measure, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    failed = sum((F.when(F.expr(c), F.lit(bit(r)).cast("long")).otherwise(F.lit(0).cast("long")) for r, c in RULES.items()),
                 F.lit(0).cast("long"))
    return measured.withColumn("failed", failed)


def apply_policy(ledger: DataFrame, policy: tuple[str, int], kept: str = "kept") -> DataFrame:
    return ledger.withColumn(kept, F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(ledger: DataFrame, policy: tuple[str, int]) -> DataFrame:
    """(rule, n_failed, n_only, kept_without): for each rule of the policy, how many
    documents fail it, hang on it alone, and would be kept without it. One pass
    and one row per rule; all counts come from the stored bits."""
    m = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("b")) for r in POLICIES[policy]]))
    masks = ledger.groupBy(m.alias("m")).agg(F.count("*").alias("n"))  # at most 2**rules rows
    return (masks.withColumn("r", rules).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.expr("if(m & r.b <> 0, n, 0)")).alias("n_failed"),
        F.sum(F.expr("if(m = r.b, n, 0)")).alias("n_only"),
        F.sum(F.expr("if(m & ~r.b = 0, n, 0)")).alias("kept_without")))
