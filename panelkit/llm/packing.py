"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best-fit: a task takes its pieces in hash order and holds
at most `open_bins` open sequences. A bitset (one Python integer) has bit f set
while some open sequence has f tokens free, so the best fit for a piece of n
tokens is the lowest set bit from n on. When a new sequence would exceed the
bound, the fullest open one (lowest set bit) closes first. Full pieces are
sequences of their own. Tasks get about `pieces_per_task` pieces each, so the
sequences a task leaves open are a vanishing share and memory is bounded.

Defined cases: a NULL or empty text is the end id alone (one piece of length
1); repeated rows and equal or NULL ids are separate documents; an empty table
gives an empty table; extra columns are not read. Only documents longer than
one sequence are cut.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, texts
from .word_ids import word_ids

#: Chunks a Python worker remembers, about 150 MB.
REMEMBERED = 800_000


class ChunkIds:
    """White-space chunk -> its ids as little-endian unsigned 32-bit bytes.

    The vocabulary's normaliser and splitter work within white-space chunks,
    so a text's ids are those of its chunks, one after another. Case is folded
    first (the vocabulary folds it too), unless a special token may be there.
    """

    def __init__(self, vocab: str):
        self.vocab = vocab
        self.known: dict[bytes, bytes] = {}

    def texts(self, texts: list[bytes]) -> list[bytes]:
        chunks = [(t if b"<|" in t else t.lower()).split() for t in texts]
        new = list({c for x in chunks for c in x if c not in self.known})
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list({c for x in chunks for c in x})
        ids = word_ids(self.vocab, new)
        ends = np.append(0, 4 * np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))).tolist()
        data = np.fromiter(chain.from_iterable(ids), "<u4", ends[-1] // 4).tobytes()
        known = self.known
        known.update(zip(new, [data[a:b] for a, b in zip(ends, ends[1:])]))
        return [b"".join(map(known.__getitem__, x)) for x in chunks]


@lru_cache(maxsize=2)
def chunk_ids(vocab: str) -> ChunkIds:
    return ChunkIds(vocab)


def token_pieces(docs: DataFrame, length: int = 4096, end_id: int = 1, vocab: str = "word_bpe_49k.json",
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32[, ids]) per piece of at most
    `length` ids; a document's ids end with `end_id`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_ids(vocab)
        end = np.array([end_id], "<u4").tobytes()
        gc.disable()  # many small lists and no cycles
        try:
            for b in slices(batches, most=8 << 20):
                rows: list[list] = [[] for _ in range(6)]
                ids = []
                for row, doc, data in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(),
                                          table.texts(b.column("text").cast(pa.binary()).to_pylist())):
                    data += end
                    for k, at in enumerate(range(0, len(data), 4 * length)):
                        part = data[at:at + 4 * length]
                        for to, x in zip(rows, (row, doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                            to.append(x)
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype("i4"))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                cols = [pa.array(x, k) for x, k in zip(rows, kinds)]
                names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
        finally:
            gc.enable()

    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema)


class OpenBins:
    """At most `most` open bins, found by their free space through a bitset."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open, self.made = size, most, 0, 0
        self.bits = 0
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def _pop(self, free: int) -> int:
        bins = self.at[free]
        b = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return b

    def put(self, n: int) -> tuple[int, int]:
        """(bin, offset) for n units."""
        above = self.bits >> n
        if above:
            free = n + (above & -above).bit_length() - 1
            b = self._pop(free)
        else:
            if self.open >= self.most and n < self.size:
                self._pop((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, b = self.size, self.made
            self.made += 1
        if free > n:
            if not self.at[free - n]:
                self.bits |= 1 << (free - n)
            self.at[free - n].append(b)
            self.open += 1
        return b, self.size - free


def best_fit_pack(pieces: DataFrame, length: int = 4096, open_bins: int = 512,
                  pieces_per_task: int = 100_000) -> DataFrame:
    """The pieces with (sequence_id long, offset long).

    `pieces` has (row, piece, length) and is read twice (a count, then the
    packing), so it should be a stored table.
    """
    tasks = max(1, -(-pieces.count() // pieces_per_task))
    schema = pieces.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base, bins = TaskContext.get().partitionId() << 40, OpenBins(length, open_bins)
        for b in batches:
            got = [bins.put(n) for n in b.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([base + x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())],
                [*b.schema.names, "sequence_id", "offset"])

    order = F.xxhash64("row", "piece")
    from pyspark.sql import types as T
    out = T.StructType([*schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return (pieces.repartition(tasks, "row", "piece").sortWithinPartitions(order, "row", "piece")
            .mapInArrow(run, out))


def pack_documents(docs: DataFrame, length: int = 4096, open_bins: int = 512, pieces_per_task: int = 100_000,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack every document; one row per piece."""
    pieces = materialise(token_pieces(docs, length, id_col=id_col, text_col=text_col, with_ids=with_ids), "pieces")
    return best_fit_pack(pieces, length, open_bins, pieces_per_task)
