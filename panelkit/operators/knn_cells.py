"""Exact k-nearest-neighbour join for many features: Voronoi cells around pivots.

With many features no grid prunes, so both sides are related to sampled
reference points instead (at most `MOST_PIVOTS`, about the square root of the
reference's size, drawn by hash). Every reference point belongs to its nearest
pivot's cell and, by its distance to that pivot, to one of `RINGS` rings of the
cell. A ring is dealt by hash into tiles of about `TILE` points, so no task
holds a whole cell, however dense it is.

1. each query visits the rings of its nearest cells that together hold enough
   points; the k-th distance found is its radius;
2. it then meets every ring that may hold a point within the radius: a ring at
   distances lo .. hi around pivot p is skipped if d(q, p) lies outside
   [lo - radius, hi + radius], or if the plane between p and the query's own
   pivot is farther away than the radius. Nothing else is skipped, so the
   result is exact (ties: lowest reference id).

First visits meet tiles by a cogroup on (ring, tile, query chunk): at most about
`TILE` points and `CHUNK` queries at once. Afterwards most rings are needed where
features are many, and a row per query and ring would grow with the square of the
rows: so queries of neighbouring cells and rings of neighbouring cells are cut into
blocks, a block is sent once to each block it needs, and rings are skipped inside.
With m rows a side, blocks of `MOST_BLOCK` rows copy a row m / `MOST_BLOCK` times at
most. Only k rows per query leave a task. What reaches the driver and every task is one
row per pivot and per ring (`MOST_PIVOTS` x `RINGS` rows at most).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

MOST_PIVOTS = 1024
RINGS = 8
TILE = 1024
CHUNK = 4096
FIRST_CELLS = 8
MOST_BLOCK = 1 << 15  # rows of a block (25 features: 7 MB)
LEAST_BLOCK = 1 << 10
SLACK = 1e-6  # relative: bounds must not lose a point to rounding


def _points(b: pa.RecordBatch | pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([np.asarray(b.column(n).to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b.column(n).to_numpy(), np.float64)
                     for n in names], axis=1)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of points to all pivots."""
    square = (x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(axis=1)
    return np.sqrt(np.maximum(square, 0))


def _with_cell(rows: DataFrame, names: list[str], pivots: np.ndarray) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_dist", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _points(b, names)
            cell = _to_pivots(x, pivots).argmin(axis=1)
            away = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(away)], [*b.schema.names, "_cell", "_dist"])

    return rows.mapInArrow(run, schema)


class _Rings:
    """The rings' pivots, bounds and sizes, and which of them a query must visit."""

    def __init__(self, pivots: np.ndarray, rows: list):
        self.pivots = pivots
        self.unit = np.array([r["_unit"] for r in rows])
        self.cell = self.unit // RINGS
        self.low, self.high = (np.array([r[c] for r in rows]) for c in ("lo", "hi"))
        self.count = np.array([r["n"] for r in rows])
        self.apart = _to_pivots(pivots, pivots)
        self.slack = SLACK * (1 + self.high.max() + np.abs(pivots).max())

    def first(self, away: np.ndarray, enough: int) -> np.ndarray:
        """Rings of the nearest cells, up to the cell that makes the points enough."""
        held = np.bincount(self.cell, self.count, len(self.pivots))
        near = np.argsort(np.where(held > 0, away, np.inf), axis=1)[:, :FIRST_CELLS]
        before = np.cumsum(held[near], axis=1) - held[near]
        chosen = np.zeros(away.shape, bool)
        np.put_along_axis(chosen, near, before < enough, axis=1)
        return chosen[:, self.cell]

    def within(self, away: np.ndarray, radius: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Which of the rings `some` (numbers) may hold a point within the radius."""
        own, cell = away.argmin(axis=1), self.cell[some]
        to_pivot = away[:, cell]
        least = np.maximum(to_pivot - self.high[some], self.low[some] - to_pivot)
        gap = self.apart[own][:, cell]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (to_pivot ** 2 - away.min(axis=1)[:, None] ** 2) / (2 * gap)
        least = np.maximum(least, np.where(gap > 0, plane, 0))
        return ~(least > radius[:, None] + self.slack)  # too large for products: not skipped


def _visits(points: DataFrame, names: list[str], rings: _Rings, enough: int) -> DataFrame:
    """One row per query and ring of its nearest cells."""
    schema = T.StructType([*points.schema.fields, T.StructField("_unit", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                row, ring = np.nonzero(rings.first(_to_pivots(_points(b, names), rings.pivots), enough))
                for j in range(0, len(row), 1 << 16):
                    part = b.take(pa.array(row[j:j + (1 << 16)]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rings.unit[ring[j:j + (1 << 16)]], pa.int32())], schema.names)

    return points.mapInArrow(run, schema)


def _nearest(k: int, names: list[str], exclude: bool, keep: list[str], rings: _Rings | None = None):
    """The k nearest of a tile for each of its queries; with `rings`, of a block of rings,
    each query meeting only the rings that it needs."""
    def run(refs: pa.Table, queries: pa.Table) -> pa.Table:
        if refs.num_rows and queries.num_rows:
            refs = refs.take(pa.array(np.argsort(refs.column("_place").to_numpy())))
            if rings:
                queries = queries.take(pa.array(np.argsort(queries.column("_cell").to_numpy(), kind="stable")))
        n = queries.num_rows
        out_q, out_r, out_d = [], [], []
        every = _points(refs, names) if refs.num_rows else np.zeros((0, len(names)))
        groups = refs.column("_group").to_numpy() if exclude and len(every) else None
        if rings and len(every):
            some, ring = np.unique(np.searchsorted(rings.unit, refs.column("_unit").to_numpy()), return_inverse=True)
        step = min(256, max(16, (1 << 21) // max(len(every), 1)))
        whole = (every * every).sum(axis=1)
        for i in range(0, n if len(every) else 0, step):
            q_rows = queries.slice(i, step)
            x, radius = _points(q_rows, names), q_rows.column("_radius2").to_numpy()
            y, own, live = every, whole, None
            if rings:
                need = rings.within(_to_pivots(x, rings.pivots), np.sqrt(radius), some)
                live = np.flatnonzero(need.any(axis=0)[ring])
                if not len(live):
                    continue
                if len(live) < len(every):
                    y, own = every[live], whole[live]
            with np.errstate(over="ignore", invalid="ignore"):
                size = (x * x).sum(axis=1)[:, None]
                near = size - 2 * x @ y.T + own  # the distance to within `off`
                off = 1e-11 * (size + own.max())
            if not np.isfinite(near).all():  # too large for products
                near, off = np.zeros(near.shape), np.full(size.shape, np.inf)
            allowed = near <= radius[:, None] + off
            if exclude:
                allowed &= q_rows.column("_group").to_numpy()[:, None] != (groups if live is None else groups[live])[None, :]
            many = np.flatnonzero(allowed.sum(axis=1) > k)
            if len(many):
                bound = np.partition(np.where(allowed[many], near[many], np.inf), k - 1, axis=1)[:, k - 1]
                allowed[many] &= near[many] <= bound[:, None] + 2 * off[many]
            q, r = np.nonzero(allowed)
            d = np.zeros(len(q))
            for f in range(len(names)):  # summed in the features' order
                diff = x[q, f] - y[r, f]
                d += diff * diff
            close = d <= radius[q]
            q, r, d = q[close], r[close], d[close]
            order = np.lexsort((r, d, q))  # equal distances: the refs are in id order
            q, r, d = q[order], r[order], d[order]
            start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
            rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
            top = rank < k
            out_q.append(q[top] + i)
            out_r.append(r[top] if live is None else live[r[top]])
            out_d.append(d[top])
        q, r = (np.concatenate(o) if o else np.zeros(0, int) for o in (out_q, out_r))
        refs = refs.take(pa.array(r))
        return pa.table([queries.column("_q").take(pa.array(q)), pa.array(np.concatenate(out_d) if out_d else np.zeros(0)),
                         *[refs.column(c) for c in keep]], names=["_q", "d2", *keep])

    return run


def _meet(visits: DataFrame, tiles: DataFrame, sizes: DataFrame, k: int, names: list[str], exclude: bool, keep: list[str]) -> DataFrame:
    """Top k of every query in every tile of the rings it visits."""
    asked = visits.groupBy("_unit").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_chunks"))  # a row per ring
    asked = cut_lineage(asked.join(sizes, "_unit"))
    q = (visits.join(F.broadcast(asked), "_unit").withColumn("_chunk", F.pmod(F.xxhash64("_q"), F.col("_chunks")).cast("int"))
         .withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))))
    r = (tiles.join(F.broadcast(asked.select("_unit", "_chunks")), "_unit")
         .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))))
    group = ["_group"] if exclude else []
    on = ["_unit", "_tile", "_chunk"]
    schema = T.StructType([T.StructField("_q", T.LongType()), T.StructField("d2", T.DoubleType()), *[tiles.schema[c] for c in keep]])
    return (r.select(*on, "_place", *names, *group, *keep).groupBy(*on)
            .cogroup(q.select(*on, "_q", "_radius2", *names, *group).groupBy(*on))
            .applyInArrow(_nearest(k, names, exclude, keep), schema))


def _starts(counts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(number, rows before it, its rows) in the numbers' order."""
    out, before = [], 0
    for number, n in sorted(counts):
        out.append((number, before, n))
        before += n
    return out


def _in_blocks(rows: DataFrame, by: str, starts: list[tuple[int, int, int]], key: str, size: int, block: str) -> DataFrame:
    """Adds `block`: rows of neighbouring values of `by`, about `size` of them."""
    table = rows.sparkSession.createDataFrame(starts, f"{by} int, _before long, _rows long")  # a row per pivot or ring
    at = F.col("_before") + F.pmod(F.xxhash64(key, F.lit("block")), F.col("_rows"))
    return rows.join(F.broadcast(table), by).withColumn(block, F.floor(at / F.lit(size)).cast("int")).drop("_before", "_rows")


def _meet_blocks(queries: DataFrame, ringed: DataFrame, rings: _Rings, k: int, names: list[str], exclude: bool, keep: list[str]) -> DataFrame:
    """Top k of every query in every block of rings that may hold a point within its radius."""
    spark, group = queries.sparkSession, ["_group"] if exclude else []
    celled = cut_lineage(_with_cell(queries, names, rings.pivots).drop("_dist"))
    cells = _starts([(r["_cell"], r["count"]) for r in celled.groupBy("_cell").count().collect()])
    units = _starts(list(zip(rings.unit.tolist(), rings.count.tolist())))
    # blocks small enough for every core to have some
    sizes = [min(MOST_BLOCK, max(LEAST_BLOCK, -(-sum(n for *_, n in t) // spark.sparkContext.defaultParallelism))) for t in (cells, units)]
    q = _in_blocks(celled, "_cell", cells, "_q", sizes[0], "_asks")
    r = _in_blocks(ringed, "_unit", units, "_r", sizes[1], "_holds")
    r = r.withColumn("_place", F.row_number().over(Window.partitionBy("_holds").orderBy("_r")))
    first = np.array([before // sizes[1] for _, before, _ in units])
    last = np.array([(before + n - 1) // sizes[1] for _, before, n in units])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, every = set(), np.arange(len(rings.unit))
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                need = rings.within(_to_pivots(_points(b, names), rings.pivots), np.sqrt(b.column("_radius2").to_numpy()), every)
                asks = b.column("_asks").to_numpy()
                for a in np.unique(asks):
                    some = np.flatnonzero(need[asks == a].any(axis=0))
                    pairs.update((int(a), h) for f, e in set(zip(first[some].tolist(), last[some].tolist())) for h in range(f, e + 1))
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*sorted(pairs))], ["_asks", "_holds"])

    on = ["_asks", "_holds"]
    pairs = cut_lineage(q.select("_asks", "_radius2", *names).mapInArrow(needed, "_asks int, _holds int").distinct())  # a row per two blocks
    schema = T.StructType([T.StructField("_q", T.LongType()), T.StructField("d2", T.DoubleType()), *[ringed.schema[c] for c in keep]])
    return (r.join(F.broadcast(pairs), "_holds").select(*on, "_place", "_unit", *names, *group, *keep).groupBy(*on)
            .cogroup(q.join(F.broadcast(pairs), "_asks").select(*on, "_q", "_cell", "_radius2", *names, *group).groupBy(*on))
            .applyInArrow(_nearest(k, names, exclude, keep, rings), schema))


def knn_cells_join(queries: DataFrame, refs: DataFrame, names: list[str], k: int, payload: list[str], exclude: bool) -> DataFrame:
    """(_q, rank, _r, d2, *payload): the k nearest of `refs` (_r, [_group,] features,
    payload) for each of `queries` (_q, [_group,] features); with `exclude` only
    refs of another _group count. Both tables are stored; no feature is NULL or NaN."""
    keep = ["_r", *payload]
    n = refs.count()
    m = max(1, min(MOST_PIVOTS, int(np.ceil(np.sqrt(n)))))
    sample = refs.orderBy(F.xxhash64(*names), "_r").select(*names).limit(m).collect()  # m rows
    if not sample:
        return refs.sparkSession.createDataFrame([], T.StructType([T.StructField("_q", T.LongType()), T.StructField("rank", T.IntegerType()), refs.schema["_r"],
                                                                   T.StructField("d2", T.DoubleType()), *[refs.schema[c] for c in payload]]))
    pivots = np.array([list(r) for r in sample], float)
    celled = cut_lineage(_with_cell(refs, names, pivots))
    reach = celled.groupBy("_cell").agg(F.max("_dist").alias("_reach"))  # a row per pivot
    ring = F.least(F.floor(F.col("_dist") / F.greatest("_reach", F.lit(1e-300)) * RINGS), F.lit(RINGS - 1)).cast("int")
    ringed = celled.join(F.broadcast(reach), "_cell").withColumn("_unit", F.col("_cell") * RINGS + ring)
    facts = ringed.groupBy("_unit").agg(F.count("*").alias("n"), F.min("_dist").alias("lo"), F.max("_dist").alias("hi"))
    facts = cut_lineage(facts.withColumn("_tiles", F.ceil(F.col("n") / TILE).cast("int")))  # MOST_PIVOTS x RINGS rows at most
    rings = _Rings(pivots, sorted(facts.collect(), key=lambda r: r["_unit"]))
    sizes = facts.select("_unit", "_tiles")
    # ids of any type are compared by Spark; their order inside a tile travels as a number
    tiles = ringed.join(F.broadcast(sizes), "_unit").withColumn("_tile", F.pmod(F.xxhash64("_r"), F.col("_tiles")).cast("int"))
    tiles = cut_lineage(tiles.withColumn("_place", F.row_number().over(Window.partitionBy("_unit", "_tile").orderBy("_r")))
                        .drop("_cell", "_dist", "_reach", "_tiles"))
    enough = 3 * k
    order = Window.partitionBy("_q").orderBy("d2", "_r")
    first = _visits(queries.withColumn("_radius2", F.lit(float("inf"))), names, rings, enough)
    got = _meet(cut_lineage(first), tiles, sizes, k, names, exclude, keep)
    top = cut_lineage(got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    radius = top.where(F.col("rank") == k).select("_q", F.col("d2").alias("_radius2"))
    known = queries.join(radius, "_q", "left").withColumn("_radius2", F.coalesce("_radius2", F.lit(float("inf"))))
    found = _meet_blocks(known, ringed, rings, k, names, exclude, keep)
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("_q", "rank", "_r", "d2", *payload)
