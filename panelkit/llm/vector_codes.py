"""Vector code compression: product codebooks by dual-tree Lloyd.

Vectors become integers and are cut into equal parts; each part position has a
codebook of at most 256 entries. The kept rows are written once as blocks of
up to `BLOCK` rows; in a block every part position has its points in the order
of a tree (halved at the median of the widest dimension). A round reads the
blocks and walks two trees together, level by level: the points' tree and a
tree over the entries, each node with its bounding box. For a pair of nodes the
least and greatest distances between the boxes bound all distances between
members. A pair goes when its least distance exceeds the smallest greatest
distance of that point node (ties stay). A point node with one entry left is
assigned whole through its cached sum and count. What is undecided at the
leaves is settled by integer distances, ties to the lower index.

Sums and counts are added up in the task and then over Spark by (part, entry);
4 x 256 rows reach the driver in a round. Integers are exact: int64 while every
component is within 2**24, Python integers otherwise (sums then travel as
24-bit limbs). Codes are the same in any partitioning.

Defined cases: a row whose vector is NULL, empty, holds a NULL or non-finite
component, or has another length than the first kept one, is dropped; a NULL
vec_id is a row like any other but starts no codebook entry unless there are
fewer than 256 others; equal vec_ids are ordered by their vectors; with fewer
rows the codebooks are smaller; lengths that the parts don't divide are cut as
evenly as possible; an error over 2**63 - 1 is NULL; an empty table gives an
empty table; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, discard, materialise

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK = 8192
LEAF = 32
SAFE = 1 << 24  # components up to here keep squared distances and sums of 2**39 rows in int64
LIMB = 24
LABELS_IN_MEMORY = 100_000


def cuts(size: int, parts: int) -> list[slice]:
    edges = [size * k // parts for k in range(parts + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def to_integers(values: np.ndarray, big: bool) -> np.ndarray:
    """floor(SCALE * x); SCALE is a power of two, so the product is exact."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if not big:
        return scaled.astype(np.int64)
    exact = [int(x) if np.isfinite(x) else int(v) * SCALE for x, v in zip(scaled.ravel(), values.astype(np.float64).ravel())]
    return np.array(exact, object).reshape(values.shape)


class Tree:
    """A balanced tree over rows of integers: level k has 2**k spans of the order,
    with boxes, sums and counts. Leaves hold about `leaf` rows."""

    def __init__(self, points: np.ndarray, leaf: int, order: np.ndarray | None = None):
        n = len(points)
        depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
        self.edges = [np.array([n * k >> d for k in range((1 << d) + 1)]) for d in range(depth + 1)]
        self.order = self._sorted(points) if order is None else order
        self.points = points[self.order]
        self.boxes = []
        for e in self.edges:
            self.boxes.append((np.minimum.reduceat(self.points, e[:-1]), np.maximum.reduceat(self.points, e[:-1])))

    def _sorted(self, points: np.ndarray) -> np.ndarray:
        order = np.arange(len(points))
        for level in self.edges[:-1]:
            for a, b in zip(level[:-1].tolist(), level[1:].tolist()):
                own = points[order[a:b]]
                wide = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                order[a:b] = order[a:b][np.argsort(own[:, wide], kind="stable")]
        return order

    def sums(self, level: int) -> np.ndarray:
        return np.add.reduceat(self.points, self.edges[level][:-1])


def entry_tree(book: np.ndarray) -> Tree:
    """A tree with one entry a leaf; copies of the last entry fill it up to a power of two."""
    full = 1 << max(0, len(book) - 1).bit_length()
    return Tree(book[np.minimum(np.arange(full), len(book) - 1)], 1)


def assign(tree: Tree, book: np.ndarray, entries: Tree, choice: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict]:
    """Sums and counts of the points nearest to each entry, walking both trees.

    `choice`, if given, receives every point's entry in the tree's order. The
    third result counts rows settled whole, rows settled at leaves, and the
    point-entry distances computed there.
    """
    sums = np.zeros(book.shape, book.dtype)
    counts = np.zeros(len(book), np.int64)
    seen = {"whole": 0, "leaf": 0, "distances": 0}
    d, e = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs of nodes, sorted by point node
    deepest, last = len(tree.edges) - 1, len(entries.edges) - 1
    dl = el = 0
    while len(d):
        (plo, phi), (elo, ehi) = tree.boxes[dl], entries.boxes[el]
        lo, hi, a, b = plo[d], phi[d], elo[e], ehi[e]
        gap = np.maximum(np.maximum(a - hi, lo - b), 0)
        far = np.maximum(hi - a, b - lo)
        least, most = (gap * gap).sum(axis=1), (far * far).sum(axis=1)
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        bound = np.minimum.reduceat(most, first)
        keep = least <= np.repeat(bound, np.diff(np.append(first, len(d))))
        if el == last:  # single entries, without the filling copies
            keep &= entries.order[e] < len(book)
        d, e = d[keep], e[keep]
        if el == last:
            first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            alone = np.diff(np.append(first, len(d))) == 1
            nodes, own = d[first[alone]], entries.order[e[first[alone]]]
            if len(nodes):
                span = np.diff(tree.edges[dl])
                np.add.at(counts, own, span[nodes])
                np.add.at(sums, own, tree.sums(dl)[nodes])
                seen["whole"] += int(span[nodes].sum())
                if choice is not None:
                    for node, c in zip(nodes.tolist(), own.tolist()):
                        choice[tree.edges[dl][node]:tree.edges[dl][node + 1]] = c
                open_ = ~np.repeat(alone, np.diff(np.append(first, len(d))))
                d, e = d[open_], e[open_]
            if dl == deepest:
                break
        if el < last:
            d, e = np.repeat(d, 2), np.stack([2 * e, 2 * e + 1], 1).ravel()
            el += 1
        if dl < deepest:
            runs = np.diff(np.append(np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])), len(d)))
            place = np.repeat(np.cumsum(runs) - runs, runs)  # each node's pairs, once a child
            at = np.arange(len(d)) - place
            width = np.repeat(runs, runs)
            twice_d = np.concatenate([2 * d, 2 * d + 1])
            spot = np.concatenate([2 * place + at, 2 * place + width + at])
            new_d, new_e = np.empty(2 * len(d), np.int64), np.empty(2 * len(d), np.int64)
            new_d[spot], new_e[spot] = twice_d, np.concatenate([e, e])
            d, e = new_d, new_e
            dl += 1
    if len(d):
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        for k, stop in zip(first.tolist(), np.append(first[1:], len(d)).tolist()):
            x, y = tree.edges[dl][d[k]], tree.edges[dl][d[k] + 1]
            points, own = tree.points[x:y], np.sort(entries.order[e[k:stop]])
            best = own[squared(points, book[own]).argmin(axis=1)]
            np.add.at(counts, best, 1)
            np.add.at(sums, best, points)
            seen["leaf"] += len(points)
            seen["distances"] += len(points) * len(own)
            if choice is not None:
                choice[x:y] = best
    return sums, counts, seen


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    if points.dtype == object:
        return np.array([[int(((p - c) ** 2).sum()) for c in entries] for p in points], object)
    diff = points[:, None, :] - entries[None, :, :]
    return np.einsum("ijk,ijk->ij", diff, diff)


def _blocks(size: int, parts: int, big: bool):
    """Arrow batches (vec_id, label, v) -> blocks of integers with a tree order per part."""

    def block(ids: list, labels: list, values: np.ndarray) -> pa.RecordBatch:
        points = to_integers(values, big)
        orders = [Tree(points[:, c], LEAF).order.astype("<i4") for c in cuts(size, parts)]
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())),
             pa.array([values.astype("<f8").tobytes()], pa.binary()),
             pa.array([[o.tobytes() for o in orders]], pa.list_(pa.binary()))], ["ids", "labels", "vectors", "orders"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            v = t.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            return block(t.column("vec_id").to_pylist(), t.column("label").to_pylist(), v)

        for b in batches:
            while b.num_rows:
                head, b = b.slice(0, BLOCK - rows), b.slice(BLOCK - rows)
                held.append(head)
                rows += head.num_rows
                if rows == BLOCK:
                    yield flush()
                    held, rows = [], 0
        if rows:
            yield flush()

    return run


def _read(b: pa.RecordBatch, k: int, size: int, parts: int, big: bool) -> list[Tree]:
    points = to_integers(np.frombuffer(b.column("vectors")[k].as_buffer(), "<f8").reshape(-1, size), big)
    return [Tree(points[:, c], LEAF, np.frombuffer(o.as_buffer(), "<i4"))
            for c, o in zip(cuts(size, parts), b.column("orders")[k].values)]


def _round(books: list[np.ndarray], size: int, parts: int, big: bool, limbs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [entry_tree(book) for book in books]
        total = [[np.zeros(book.shape, book.dtype), np.zeros(len(book), np.int64)] for book in books]
        for b in batches:
            for k in range(b.num_rows):
                for p, tree in enumerate(_read(b, k, size, parts, big)):
                    s, n, _ = assign(tree, books[p], trees[p])
                    total[p][0] += s
                    total[p][1] += n
        rows = [(p, int(j), int(n[j]), split(s[j], limbs)) for p, (s, n) in enumerate(total) for j in np.flatnonzero(n)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))],
                                             ["part", "entry", "n", "sums"])

    return run


def split(sums: np.ndarray, limbs: int) -> list[int]:
    """Integers as `limbs` signed pieces each, lowest first (one: as they are)."""
    if limbs == 1:
        return [int(x) for x in sums]
    out = []
    for x in sums:
        sign, x = (-1, -int(x)) if x < 0 else (1, int(x))
        out += [sign * (x >> (LIMB * i) & ((1 << LIMB) - 1)) for i in range(limbs)]
    return out


def joined(pieces: list[int], limbs: int) -> list[int]:
    return [sum(pieces[k + i] << (LIMB * i) for i in range(limbs)) for k in range(0, len(pieces), limbs)]


def _codes(books: list[np.ndarray], size: int, parts: int, big: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [entry_tree(book) for book in books]
        for b in batches:
            for k in range(b.num_rows):
                ids, labels = b.column("ids")[k].values, b.column("labels")[k].values
                codes = np.empty((len(ids), parts), np.uint8)
                error = np.zeros(len(ids), object if big else np.int64)
                for p, tree in enumerate(_read(b, k, size, parts, big)):
                    choice = np.empty(len(ids), np.int64)
                    assign(tree, books[p], trees[p], choice)
                    codes[tree.order, p] = choice
                    away = tree.points - books[p][choice]
                    error[tree.order] += (away * away).sum(axis=1)
                told = [int(x) if x < 1 << 63 else None for x in error] if big else error
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in codes]), pa.array(told, pa.int64())],
                                                 ["vec_id", "label", "code", "error"])

    return run


def fit_and_encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id",
                   vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label as text, code, error) of every kept row, final codebooks)."""
    v = F.transform(col(vector_col), lambda x: x.cast("double"))
    t = vectors.select(col(id_col).cast("long").alias("vec_id"), col(label_col).cast("string").alias("label"), v.alias("v"))
    t = t.where((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    by = [F.col("vec_id").asc_nulls_last(), "v"]
    out = "vec_id long, label string, code string, error long"
    first = t.orderBy(*by).limit(1).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], out), []
    size = len(first[0].v)
    t = t.where(F.size("v") == size)
    seeds = t.orderBy(*by).select("v").limit(entries).collect()  # `entries` rows start the codebooks
    most, rows = t.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v"))), F.count("*")).first()
    big = most * SCALE >= SAFE
    limbs = -(-(int(most).bit_length() + 11 + rows.bit_length()) // LIMB) if big else 1
    start = to_integers(np.array([r.v for r in seeds]), big)
    books = [start[:, c] for c in cuts(size, parts)]
    blocks = materialise(t.mapInArrow(_blocks(size, parts, big), "ids array<long>, labels array<string>, vectors binary, orders array<binary>"),
                         "code-blocks")
    for _ in range(rounds):
        cells = blocks.mapInArrow(_round(books, size, parts, big, limbs), "part int, entry int, n long, sums array<long>")
        width = [b.shape[1] * limbs for b in books]
        total = cells.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(max(width))])
        new = [b.copy() for b in books]
        for r in total.collect():  # parts x entries rows
            s = joined([r[f"s{i}"] for i in range(width[r.part])], limbs)
            new[r.part][r.entry] = [x // r.n for x in s]
        books = new
    return blocks.mapInArrow(_codes(books, size, parts, big), out), books


def codebooks_text(books: list[np.ndarray]) -> str:
    """All entries' decimal components by part, entry and position, joined by commas."""
    return ",".join(str(int(x)) for b in books for x in b.ravel())


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id",
                 vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row per kept row."""
    coded, books = fit_and_encode(vectors, parts, entries, rounds, id_col, vector_col, label_col)
    coded = materialise(coded, "codes")
    sums = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.count() <= LABELS_IN_MEMORY:
        sums = F.broadcast(sums)
    sums = sums.withColumnRenamed("label", "of_label")
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
