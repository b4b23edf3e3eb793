"""Removal of every byte inside a repeated string of `LENGTH` bytes, by sorting suffixes.

How a 400-byte string that occurs twice is found without a suffix array of the
whole corpus in one place:

1. Anchors. The smallest 48-byte gram (by hash, then leftmost) of each 400-byte
   window is its anchor; equal windows have equal anchors at equal places. Only
   grams that are the anchor of a run of windows twice or more go on.
2. Shards. The windows of an anchor are cut into sub-ranges of `STEPS` = 64
   starts at fixed distances from it. All windows of a sub-range contain one
   337-byte core; a suffix tuple is (core hash, right context of 63 bytes, left
   context of 63 bytes). Tuples are dealt out by their core, so all suffixes
   that can have a common prefix of 400 bytes meet in a shard, and a tuple
   takes 200 bytes however long its document is.
3. Induction. The disk-backed priority queue is Spark's external sort: a
   shard's tuples leave it ordered by core and right context, whatever their
   size, and stream through a task group by group. The order and the
   common-prefix values of the right contexts are the base case; the suffixes
   that start one byte further left are then induced from it: a stable bucket
   pass over the preceding byte gives the new order, and range minima over the
   old common-prefix values give the new ones, 63 times. A start whose common
   prefix with a neighbour reaches 400 is covered.
4. Recursion. A core with more than `MOST_IN_GROUP` different contexts is never
   handled in one task: its tuples are cut in halves (upper starts join 32 left
   bytes to the core, lower ones 32 right bytes), collapse where they have
   become equal, and are dealt out and solved again with 32, 16, ... steps. At
   one step all members of a core are equal, so it always ends.

Everything is keyed by a text's SHA-256, so copies of a text are handled once
with their number, and equal tuples collapse in the task that makes them.

Defined cases: a NULL text is empty; texts under 400 bytes lose nothing; texts
are whole and matches never cross documents; a repeated row is a copy, so both
lose all their bytes if they have 400; an empty table gives an empty table;
extra columns are not read. Strings are judged on the input, not on what is
left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, discard, materialise, shuffle_width, slices

LENGTH, GRAM, STEPS = 400, 48, 64
MOST_IN_GROUP = 4_096
PIECE = 1 << 22
SEEN = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hash of every gram (a multiple of 16 bytes): polynomial hashes, doubled up to 16 bytes, then chained."""
    mul, width, h = 0x2545F4914F6CDD1D, 1, BYTE[data]
    while width < 16:
        h = h[:-width] * np.uint64(pow(mul, width, 1 << 64)) + h[width:]
        width *= 2
    unit, out, done = h, h, 16
    while done < gram:
        n = len(data) - done - 16 + 1
        out = out[:n] * np.uint64(pow(mul, 16, 1 << 64)) + unit[done:done + n]
        done += 16
    return _mix(out)


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, place, first start, last start) of the anchor of each run of windows."""
    whole, low = np.frombuffer(text, np.uint8), np.uint64((1 << 23) - 1)
    for base in range(0, len(whole) - length + 1, PIECE):
        h = gram_hashes(whole[base:base + PIECE + length - 1], gram)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width, want = 1, length - gram + 1
        while 2 * width <= want:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < want:
            m = np.minimum(m[:width - want], m[want - width:])
        at = (m & low).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        yield h[at[first]].view(np.int64), at[first] + base, first + base, last + base


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows: list[list] = [[], [], [], [], []]
        for key, text in zip(b.column("key").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
            if len(text) >= LENGTH:
                got = [np.concatenate(x) for x in zip(*anchors(text))]
                for to, x in zip(rows, (key, *got)):
                    to.append(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.list_(pa.int64())),
             *[pa.array([y.astype("i4") for y in x], pa.list_(pa.int32())) for x in rows[2:]]], ["key", "h", "at", "first", "last"])


class Once:
    """Lets a tuple through twice (so that a count of two shows), then no more;
    forgets when full, which only lets more through."""

    def __init__(self) -> None:
        self.times: dict[bytes, int] = {}

    def __call__(self, name: bytes, weight: int) -> bool:
        n = self.times.get(name, 0)
        if n >= 2:
            return False
        if len(self.times) >= SEEN:
            self.times.clear()
        self.times[name] = n + weight
        return True


TUPLES = "name binary, core binary, lft binary, rgt binary, n int"


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix tuples of the anchored windows, and where each came from (owner, at)."""
    hash128, once, before = xxhash.xxh3_128_digest, Once(), None
    core_len = LENGTH - STEPS + 1
    for b in slices(batches, most=2 << 20):
        rows: list[tuple] = []
        for key, text, copies, spans in zip(b.column("key").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(),
                                            b.column("copies").to_pylist(), b.column("spans").to_pylist()):
            if key == before:  # copies lie together; the count stands for them
                continue
            before, done = key, set()  # sub-ranges of two anchors may be the same place
            for s in spans:
                at, first, last = s["at"], s["first"], s["last"]
                for q in range((at - last) // STEPS, (at - first) // STEPS + 1):
                    a = at - STEPS * q
                    if a in done:
                        continue
                    done.add(a)
                    core, left, right = text[a:a + core_len], text[max(0, a - STEPS + 1):a], text[a + core_len:a + LENGTH]
                    name = hash128(bytes([len(left)]) + left + core + right)
                    if once(name, copies):
                        rows.append((name, hash128(core), left, right, min(copies, 2), key, a))
                    else:
                        rows.append((name, None, None, None, 0, key, a))
        kinds = [pa.binary()] * 4 + [pa.int32(), pa.binary(), pa.int32()]
        for i in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[i:i + 20_000]), kinds)],
                                             ["name", "core", "lft", "rgt", "n", "owner", "at"])


def _halve(steps: int) -> Callable:
    """Tuples of `steps` starts -> tuples of half as many, each with its owner's name and shift."""
    half = steps // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash128, once = xxhash.xxh3_128_digest, Once()
        for b in batches:
            rows = []
            for name, core, left, right, n in zip(*(b.column(c).to_pylist() for c in ("name", "core", "lft", "rgt", "n"))):
                ways = []
                if len(left) >= half:
                    ways.append((hash128(b"L" + core + left[-half:]), left[:-half], right[:half - 1], half))
                if len(right) >= half:
                    ways.append((hash128(b"R" + core + right[:half]), left[len(left) - half + 1:] if len(left) >= half else left, right[half:], 0))
                for c, lft, rgt, shift in ways:
                    own = hash128(bytes([len(lft)]) + lft + c + rgt)
                    if once(own, n):
                        rows.append((own, c, lft, rgt, n, name, shift))
                    else:
                        rows.append((own, None, None, None, 0, name, shift))
            kinds = [pa.binary()] * 4 + [pa.int32(), pa.binary(), pa.int32()]
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, kinds)],
                                             ["name", "core", "lft", "rgt", "n", "owner", "at"])

    return run


def _matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    out = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)
    return out, size


def induce(core: np.ndarray, left: list[bytes], right: list[bytes], n: np.ndarray, steps: int) -> np.ndarray:
    """Covered starts (bit i: i bytes left of the core) of different tuples, sorted by (core, right context).

    At step i the live tuples are ordered by (core, the i bytes left of it,
    right context), `near` is the common prefix of the right contexts of a
    tuple and the one before it (-1: other core or other left bytes).
    """
    count, width = len(left), max(steps - 1, 1)
    rgt, rsize = _matrix(right, width)
    back, lsize = _matrix([x[::-1] for x in left], width)
    mask = np.zeros(count, np.uint64)
    for k in np.flatnonzero(n > 1).tolist():  # equal tuples: every start whose string lies inside
        mask[k] = sum(1 << i for i in range(max(0, steps - 1 - int(rsize[k])), min(steps - 1, int(lsize[k])) + 1))
    near = np.full(count, -1, np.int64)
    if count > 1:
        differs = rgt[1:] != rgt[:-1]
        common = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        common = np.minimum(common, np.minimum(rsize[1:], rsize[:-1]))
        near[1:] = np.where(core[1:] == core[:-1], np.minimum(common, steps - 1), -1)
    live, group = np.arange(count), np.cumsum(near < 0)
    for i in range(steps):
        whole = near >= steps - 1 - i
        if whole.any():
            covered = whole.copy()
            covered[:-1] |= whole[1:]
            mask[live[covered]] |= np.uint64(1 << i)
        if i == steps - 1:
            break
        # a stable bucket pass over the byte that precedes
        old = np.flatnonzero(lsize[live] > i)
        key = group[old] * 256 + back[live[old], i]
        order = np.argsort(key, kind="stable")
        old, key = old[order], key[order]
        same = key[1:] == key[:-1]
        keep = np.zeros(len(old), bool)
        keep[1:] |= same
        keep[:-1] |= same
        old, key = old[keep], key[keep]
        if not len(old):
            break
        joined = np.append(False, key[1:] == key[:-1])
        low = np.full(len(old), -1, np.int64)
        here = np.flatnonzero(joined)
        pairs = np.empty(2 * len(here), np.int64)
        pairs[0::2], pairs[1::2] = old[here - 1] + 1, old[here] + 1
        low[here] = np.minimum.reduceat(np.append(near, -1), pairs)[0::2]
        live, near, group = live[old], low, np.cumsum(~joined)
    return mask


def _solve_sorted(steps: int) -> Callable:
    """Stream of tuples in queue order -> (name, mask) of those with a covered start."""

    def work(names: list, cores: list, lefts: list, rights: list, counts: list) -> pa.RecordBatch:
        at, pick = [], []
        for i, name in enumerate(names):  # equal tuples are neighbours in the order
            if pick and name == names[pick[-1]]:
                at[-1] += counts[i]
            else:
                pick.append(i)
                at.append(counts[i])
        core, number = np.empty(len(pick), np.int64), -1
        for k, i in enumerate(pick):
            if k == 0 or cores[i] != cores[pick[k - 1]]:
                number += 1
            core[k] = number
        mask = induce(core, [lefts[i] for i in pick], [rights[i] for i in pick], np.array(at), steps)
        hit = np.flatnonzero(mask)
        return pa.RecordBatch.from_arrays([pa.array([names[pick[i]] for i in hit], pa.binary()), pa.array(mask[hit].view(np.int64))],
                                          ["name", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        for b in batches:
            for to, c in zip(held, ("name", "core", "lft", "rgt", "n")):
                to += b.column(c).to_pylist()
            if len(held[0]) >= 20_000:  # all groups but the last are whole
                cut = len(held[1])
                while cut and held[1][cut - 1] == held[1][-1]:
                    cut -= 1
                if cut:
                    yield work(*(x[:cut] for x in held))
                    held = [x[cut:] for x in held]
        if held[0]:
            yield work(*held)

    return run


def solve(tuples: DataFrame, steps: int = STEPS, most: int = MOST_IN_GROUP) -> DataFrame:
    """(name, mask) of the stored tuples that have a start covered by a repeated string."""
    spark = tuples.sparkSession
    full = tuples.where("core is not null").select("name", "core", "lft", "rgt", "n")
    members = full.groupBy("core", "name").agg(F.sum("n").alias("n"))
    hot = materialise(members.groupBy("core").agg(F.count("*").alias("c")).where(F.col("c") > most).select("core"), "suffix-hot")
    cold, below = full, None
    if steps > 1 and not hot.isEmpty():
        cold = full.join(hot, "core", "left_anti")
        smaller = materialise(full.join(hot, "core", "left_semi").mapInArrow(_halve(steps), TUPLES + ", owner binary, at int"),
                              f"suffix-{steps // 2}")
        got = materialise(solve(smaller, steps // 2, most), f"suffix-masks-{steps // 2}")
        below = (smaller.select("name", "owner", "at").join(got, "name")
                 .groupBy("owner").agg(F.bit_or(F.expr("shiftleft(mask, at)")).alias("mask")).withColumnRenamed("owner", "name"))
    width = shuffle_width(spark)
    out = (cold.repartition(width, "core").sortWithinPartitions("core", "rgt", "lft", "name")
           .mapInArrow(_solve_sorted(steps), "name binary, mask long"))
    return out.union(below) if below is not None else out


def covered_spans(texts: DataFrame, most: int = MOST_IN_GROUP) -> DataFrame:
    """(key, text) -> (key, spans array<struct<at int, mask long>>): bit i of a mask
    says that the 400-byte string from at - i on also starts elsewhere."""
    found = materialise(texts.select("key", "text").mapInArrow(
        _find, "key binary, h array<long>, at array<int>, first array<int>, last array<int>"), "suffix-anchors")
    one = F.explode(F.arrays_zip("h", "at", "first", "last"))
    twice = materialise(found.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"),
                        "suffix-grams")
    # a text's copies collapse before the join; one row per text and anchor is left
    places = found.dropDuplicates(["key"]).select("key", one.alias("x")).select("key", "x.*")
    wanted = materialise(places.join(twice, "h").groupBy("key").agg(F.collect_list(F.struct("at", "first", "last")).alias("spans")),
                         "suffix-wanted")
    copies = materialise(texts.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1"), "suffix-copies")
    wanted = materialise(wanted.join(copies, "key", "left").select("key", "spans", F.coalesce("copies", F.lit(1)).cast("int").alias("copies")),
                         "suffix-listed")
    discard(found)
    tuples = materialise(texts.join(wanted, "key").select("key", "text", "copies", "spans")
                         .mapInArrow(_tuples, TUPLES + ", owner binary, at int"), "suffix-tuples")
    masks = materialise(solve(tuples, STEPS, most), "suffix-masks")
    return (tuples.select("name", "owner", "at").join(masks, "name").groupBy(F.col("owner").alias("key"))
            .agg(F.collect_list(F.struct("at", "mask")).alias("spans")))


def covered(size: int, spans: list[dict]) -> np.ndarray:
    """Which bytes of a text of `size` bytes are covered."""
    edge = np.zeros(size + 1, np.int64)
    if spans:
        at = np.array([s["at"] for s in spans], np.int64)
        bits = np.array([s["mask"] for s in spans], np.int64).view(np.uint8).reshape(-1, 8)
        k, i = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
        start = np.unique(at[k] - i)
        edge[start] += 1
        np.subtract.at(edge, start + LENGTH, 1)
    return np.cumsum(edge[:size]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
                   most: int = MOST_IN_GROUP, as_text: bool = False) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans, spans) and the `carry`
    columns, one row per input row. kept is what is left, spans are the removed
    [begin, end) byte ranges. `as_text`: kept is a string, and characters of
    which a part is removed go as a whole. `docs` must be a stored table."""
    from pyspark.sql import types as T
    extra = carry or []
    packed = F.struct(*[(col(c) if c != text_col else col(c).isNotNull().alias(c)) for c in extra]).alias("carried") if extra else F.lit(None).cast("string").alias("carried")
    t = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"), packed)
    t = t.withColumn("key", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    spans = materialise(covered_spans(t.select("key", "text"), most), "suffix-spans")
    joined = t.join(spans, "key", "left").select("doc_id", "text", "spans", "carried")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("kept", T.StringType() if as_text else T.BinaryType())]
                          + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
                          + [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
                             joined.schema["carried"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=8 << 20):
            rows: list[list] = [[] for _ in range(5)]
            for text, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist()):
                kept, gone, runs = text, 0, []
                if spans:
                    c = covered(len(text), spans)
                    edges = np.flatnonzero(np.diff(c, prepend=False, append=False)).tolist()
                    runs = [{"begin": x, "end": y} for x, y in zip(edges[0::2], edges[1::2])]
                    kept, gone = np.frombuffer(text, np.uint8)[~c].tobytes(), int(c.sum())
                if as_text:
                    kept = kept.decode("utf-8", "ignore")
                for to, x in zip(rows, (kept, len(text), gone, len(runs), runs)):
                    to.append(x)
            kinds = [pa.string() if as_text else pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, k) for x, k in zip(rows, kinds)], b.column("carried")],
                                             ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "spans", "carried"])

    return joined.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars",
                    most: int = MOST_IN_GROUP) -> DataFrame:
    """`docs` with the same columns and rows, the text without its repeats, and
    `chars_col` (where there is one) its new length."""
    out = remove_repeats(docs, id_col, text_col, carry=docs.columns, most=most, as_text=True)
    old = F.col("carried")

    def value(c: str):
        if c == text_col:
            return F.when(old.getField(c), F.col("kept")).alias(c)
        if c == chars_col:
            return F.length("kept").cast(docs.schema[c].dataType).alias(c)
        return old.getField(c).alias(c)

    return out.select([value(c) for c in docs.columns])
