"""Runs (maximal periodic stretches) of words, by descending-LCP Kruskal.

Per text: words become numbers, a suffix array is built by prefix doubling and
its common-prefix values by one sweep. The edges between neighbouring suffixes
are taken by decreasing common prefix, and union-find unites their classes.
Each class keeps its positions in order; the smaller class is merged into the
larger one. When a union at value L makes positions i < j neighbours with
d = j - i <= L, the words from i to j + L have period d, and if the words
before i and j differ (or i is 0) that stretch is a run:

* every run (start, length, period q) is found: start and start + q share
  exactly length - q words, so they meet in one class at that value, and a
  position between them in the class would give the stretch a shorter period
  (both periods fit twice, so the smallest would not be q);
* no stretch is reported with a longer period than its smallest: the position
  that a shorter period gives shares more words, joined the class earlier and
  stands between i and j.

Runs of at least `min_exponent` periods and `min_length` words need a common
prefix of (min_exponent - 1) d and min_length - d words, so edges below the
least such value are never united, and a text in which no string of that many
words occurs twice has no run. The work is per text; memory is a few integers
a word of the longest text.

Defined cases: a NULL or empty text has no words and no runs; repeated rows
give equal rows; NULL ids are rows like any other; an empty table gives an
empty table; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts

Run = tuple[int, int, int]
Words = list[bytes]

MIN_LENGTH = 6
MIN_EXPONENT = 4


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a number sequence; a shorter suffix comes before
    the longer ones that begin with it."""
    n, k = len(ids), 1
    rank = ids.astype(np.int64)
    while True:
        key = (rank + 1) * (n + 2)
        key[:n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1 or k >= n:
            return order


def common_prefixes(ids: list[int], order: list[int]) -> list[int]:
    """lcp[r]: words shared by the suffixes at places r - 1 and r of the order."""
    n = len(ids)
    place = [0] * n
    for r, i in enumerate(order):
        place[i] = r
    lcp, h = [0] * n, 0
    for i in range(n):
        r = place[i]
        if not r:
            h = 0
            continue
        j = order[r - 1]
        end = n - (i if i > j else j)
        while h < end and ids[i + h] == ids[j + h]:
            h += 1
        lcp[r] = h
        if h:
            h -= 1
    return lcp


def _merged(large: list[int], small: list[int]) -> list[tuple[int, int]]:
    """Merge `small` into `large` (both sorted) and return the newly adjacent pairs."""
    pairs, places = [], [bisect_left(large, x) for x in small]
    last = len(small) - 1
    for k, (x, at) in enumerate(zip(small, places)):
        if at and (k == 0 or large[at - 1] > small[k - 1]):
            pairs.append((large[at - 1], x))
        if at < len(large) and (k == last or large[at] < small[k + 1]):
            pairs.append((x, large[at]))
    if 8 * len(small) < len(large):
        for x, at in zip(reversed(small), reversed(places)):
            large.insert(at, x)
    else:
        large += small
        large.sort()
    return pairs


def least_prefix(min_length: int, min_exponent: int) -> int:
    """The least common prefix with which a pair can seed a reported run."""
    return min(max(min_length - d, (min_exponent - 1) * d) for d in range(1, min_length + 1))


def find_runs(words: Words, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """(start, length, period) of every run with length >= min_length and
    length >= min_exponent * period, by start, then period. min_exponent >= 2."""
    n, least = len(words), least_prefix(min_length, min_exponent)
    if n < min_length or len(set(zip(*(words[k:] for k in range(least))))) == n - least + 1:
        return []
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    order = suffix_array(np.array(ids)).tolist()
    lcp = common_prefixes(ids, order)
    value = np.array(lcp)
    edges = np.flatnonzero(value >= least)
    edges = edges[np.argsort(-value[edges], kind="stable")].tolist()
    parent: dict[int, int] = {}
    places: dict[int, list[int]] = {}

    def root(r: int) -> int:
        top = r
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[r] != top:
            parent[r], r = top, parent[r]
        return top

    runs = []
    for r in edges:
        shared, a, b = lcp[r], root(r - 1), root(r)
        large, small = places.pop(a, None) or [order[a]], places.pop(b, None) or [order[b]]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        for i, j in _merged(large, small):
            d = j - i
            if shared >= (min_exponent - 1) * d and shared + d >= min_length and (i == 0 or ids[i - 1] != ids[j - 1]):
                runs.append((i, shared + d, d))
        parent[b] = a
        places[a] = large
    runs.sort(key=lambda x: (x[0], x[2]))
    return runs


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period; ties: smallest start, then period."""
    best = None
    for r in runs:  # sorted by start, then period: only a strictly greater exponent replaces
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: Words, runs: list[Run]) -> Words:
    """The words without those that any run contains after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(step).tolist()) if not inside]


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, id_col: str = "doc_id",
                  text_col: str = "text", rewrite: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_runs, the strongest run's start, length,
    period and exponent_milli (NULL without runs), runs (all, as an array of
    structs) and collapsed (the text's remaining words joined by one space).

    `rewrite` (doc_id, words) -> words changes a text's words beforehand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                words = t.split()  # bytes: the six ASCII white-space characters
                if rewrite:
                    words = rewrite(i, words)
                runs = find_runs(words, min_length, min_exponent)
                start, length, period = strongest(runs) or (None, None, None)
                rows.append((len(runs), start, length, period, 1000 * length // period if runs else None,
                             [{"start": s, "length": m, "period": q} for s, m, q in runs], b" ".join(collapsed(words, runs))))
            cols = list(zip(*rows))
            run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], run_type),
                 pa.array(cols[6], pa.binary()).cast(pa.string())],
                ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"])

    return texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
             "runs array<struct<start: long, length: long, period: long>>, collapsed string")
