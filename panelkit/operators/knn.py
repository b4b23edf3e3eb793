"""Exact k-nearest-neighbour join.

No pair list per block: both sides are placed on grids of halving cell side,
searched fine to coarse. A query point is settled at a level once at least
``k`` reference points lie within the cell side of it -- every point that
close sits in the 3^d cells around the query's cell, so the k nearest (ties:
lowest reference id) are exact. The coarsest level spans the whole data, so
everything settles there. Reference points with identical features are cut
to their ``k`` lowest ids first (no more can ever be chosen from one spot),
planned as a window group limit that runs before the shuffle.

More than ``GRID_FEATURES`` features: a grid prunes nothing there, so the
search goes by Voronoi cells around pivots (`knn_cells`). Blocks (with any
number of features) always use the grid: its cells come from the first
``grid_dims`` (<= 3) feature columns, a coordinate projection, while distances
use all of them; a projection never lengthens a distance, so the settle rule
stays exact.

No query row is dropped: one without neighbours (a NULL or NaN feature, or
nothing to find) comes back once with NULL rank, id and distance.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .knn_cells import knn_cells_join

GRID_FEATURES = 3


def knn_join(query: DataFrame, ref: DataFrame, *, qid: str, rid: str, features: list[str], k: int,
             payload: list[str] | None = None, block: list[str] | None = None,
             extra_levels: int = 12, grid_dims: int = 3, exclude: str | None = None) -> DataFrame:
    """Returns ``qid, *block, rank (1..k), rid, d2, *payload`` -- the k nearest
    ``ref`` rows of every ``query`` row (squared Euclidean distance ``d2``),
    restricted to the same ``block`` values, or to other values of the column
    ``exclude``, when given (``exclude`` isn't available with blocks)."""
    block = block or []
    payload = payload or []
    nf = len(features)
    if nf < 1:
        raise ValueError("k-NN needs at least one feature column")
    if exclude and block:
        raise ValueError("exclude and block can't be combined")
    if exclude or (nf > GRID_FEATURES and not block):
        return _by_cells(query, ref, qid, rid, features, k, payload, exclude)
    found = _by_grid(query, ref, rid, features, k, payload, block, extra_levels, grid_dims)
    qkey = _location(block, features)
    keyed = query.select(F.col(qid), *block, qkey.alias("_q"))
    return keyed.join(found.drop(*block), "_q", "left").select(qid, *block, "rank", rid, "d2", *payload)


def _location(block: list[str], features: list[str]):
    return F.struct(*[F.col(b) for b in block], *[F.col(f).alias(f"_k{i}") for i, f in enumerate(features)])


def _by_cells(query: DataFrame, ref: DataFrame, qid: str, rid: str, features: list[str], k: int,
              payload: list[str], exclude: str | None) -> DataFrame:
    names = [f"_x{i}" for i in range(len(features))]
    values = [F.col(f).cast("double").alias(n) for f, n in zip(features, names)]
    group = [F.col(exclude).cast("long").alias("_group")] if exclude else []
    known = F.lit(True)
    for n in names:
        known = known & F.col(n).isNotNull() & ~F.isnan(n)
    if exclude:
        known = known & F.col("_group").isNotNull()
    at = [*names, *(["_group"] if exclude else [])]
    asked = query.select(F.col(qid), *values, *group)
    # neighbours depend only on the location: each distinct one is searched once
    points = cut_lineage(asked.where(known).select(*at).distinct().withColumn("_q", F.monotonically_increasing_id()))
    # of equal locations at most k rows can ever be chosen
    same = Window.partitionBy(*at).orderBy("_r")
    refs = (ref.select(F.col(rid).alias("_r"), *values, *group, *payload).where(known)
            .withColumn("_dup", F.row_number().over(same)).where(F.col("_dup") <= k).drop("_dup"))
    found = knn_cells_join(points, cut_lineage(refs), names, k, payload, bool(exclude))
    return (asked.join(points, at, "left").join(found, "_q", "left")
            .select(qid, "rank", F.col("_r").alias(rid), "d2", *payload))


def _by_grid(query: DataFrame, ref: DataFrame, rid: str, features: list[str], k: int, payload: list[str],
             block: list[str], extra_levels: int, grid_dims: int) -> DataFrame:
    """(_q, *block, rank, rid, d2, *payload) per distinct query location that has neighbours."""
    nf = len(features)
    d = min(nf, max(1, min(grid_dims, 3)))     # grid dimensions (a coordinate projection)
    # neighbours depend only on (block, feature vector): search each distinct
    # query point once and join the result back to every query row at the end
    qkey = _location(block, features)
    q = query.select(qkey.alias("_q"), *block, *[F.col(f).alias(f"_x{i}") for i, f in enumerate(features)])
    r = ref.select(F.col(rid).alias("_r"), *block, *[F.col(f).alias(f"_y{i}") for i, f in enumerate(features)],
                   *payload)
    for i in range(nf):
        q = q.where(F.col(f"_x{i}").isNotNull() & ~F.isnan(f"_x{i}"))
        r = r.where(F.col(f"_y{i}").isNotNull() & ~F.isnan(f"_y{i}"))
    q = q.dropDuplicates(["_q"])
    # at most k reference rows per identical location can ever be selected
    loc = Window.partitionBy(*block, *[f"_y{i}" for i in range(nf)]).orderBy("_r")
    r = r.withColumn("_dup", F.row_number().over(loc)).where(F.col("_dup") <= k).drop("_dup")

    aggs = []
    for i in range(d):
        aggs += [F.min(f"_v{i}").alias(f"lo{i}"), F.max(f"_v{i}").alias(f"hi{i}")]
    both = (q.select(*[F.col(f"_x{i}").alias(f"_v{i}") for i in range(d)])
             .unionByName(r.select(*[F.col(f"_y{i}").alias(f"_v{i}") for i in range(d)])))
    st = both.agg(*aggs, ).first()
    if block:
        c = r.groupBy(*block).count().agg(F.sum("count").alias("n"), F.max("count").alias("m")).first()
        n_ref, n_blk = (c["n"] or 0), (c["m"] or 1)
    else:
        n_ref = r.count()
        n_blk = n_ref
    if st["lo0"] is None or n_ref == 0:
        none = r.select(F.lit(None).cast(q.schema["_q"].dataType).alias("_q"), *block, F.lit(None).cast("int").alias("rank"),
                        F.col("_r").alias(rid), F.lit(None).cast("double").alias("d2"), *payload)
        return none.limit(0)
    lo = [st[f"lo{i}"] for i in range(d)]
    s0 = max(max(st[f"hi{i}"] - st[f"lo{i}"] for i in range(d)), 1e-12)
    # start level: about k reference points per cell on uniform data, refined
    # further where the busiest cell holds many more (dense clusters settle on
    # finer grids, so no neighbourhood holds a hot spot's whole population)
    base = max(0, int(math.ceil(math.log2(max(1.0, (n_blk / k) ** (1.0 / d))))))
    side_b = s0 / (2 ** base)
    occ = (r.groupBy(*block, *[F.floor((F.col(f"_y{i}") - F.lit(lo[i])) / F.lit(side_b)).alias(f"_b{i}")
                               for i in range(d)])
            .agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]) or 1
    # refine only for real hot spots (a cell with far more than k points);
    # ordinary density variation settles at the base level
    extra = min(extra_levels, max(0, int(math.ceil(math.log(max(occ / (16.0 * k), 1.0), 2 ** d)))))
    levels = list(range(base + extra, 0, -2)) + [0]
    offsets = [list(o) for o in itertools.product((-1, 0, 1), repeat=d)]
    offs = F.array(*[F.array(*[F.lit(v) for v in o]) for o in offsets])

    pending = q
    found = []
    for lvl in levels:
        side = s0 / (2 ** lvl) if lvl > 0 else s0 * 1.000001
        qc = pending.select("*", *[F.floor((F.col(f"_x{i}") - F.lit(lo[i])) / F.lit(side)).cast("long")
                                   .alias(f"_c{i}") for i in range(d)])
        rc = (r.select("*", F.explode(offs).alias("_o"))
               .select("*", *[(F.floor((F.col(f"_y{i}") - F.lit(lo[i])) / F.lit(side)).cast("long")
                               + F.col("_o")[i]).alias(f"_c{i}") for i in range(d)])
               .drop("_o"))
        pairs = qc.join(rc, [*block, *[f"_c{i}" for i in range(d)]], "inner")
        d2 = sum(((F.col(f"_x{i}") - F.col(f"_y{i}")) * (F.col(f"_x{i}") - F.col(f"_y{i}")) for i in range(nf)),
                 F.lit(0.0))
        pairs = pairs.select("_q", *block, "_r", d2.alias("d2"), *payload)
        if lvl > 0:
            pairs = pairs.where(F.col("d2") <= F.lit(side * side))
        w = Window.partitionBy("_q").orderBy("d2", "_r")
        ranked = (pairs.withColumn("rank", F.row_number().over(w))
                       .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_q"))))
        if lvl > 0:
            # settled rows are materialised in the shared checkpoint folder so
            # that later levels do not recompute earlier ones (and a lost
            # executor only costs the current level)
            ok = cut_lineage(ranked.where((F.col("_n") >= k) & (F.col("rank") <= k)).drop("_n"))
            pending = cut_lineage(pending.join(ok.select("_q").distinct(), "_q", "left_anti"))
            found.append(ok)
            if pending.isEmpty():
                break
        else:
            found.append(ranked.where(F.col("rank") <= k).drop("_n"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("_q", *block, F.col("rank").cast("int").alias("rank"), F.col("_r").alias(rid), "d2", *payload)


def knn_regress(neigh: DataFrame, qid: str, y: str, k: int, block: list[str] | None = None) -> DataFrame:
    """Uniform-weight mean of the k nearest targets; a query without neighbours
    gets a NULL prediction and 0 neighbours."""
    near = F.col("rank") <= k
    return (neigh.groupBy(qid, *(block or []))
                 .agg(F.avg(F.when(near, F.col(y))).alias("prediction"), F.count_if(near).alias("n_neighbours")))


def knn_cv_curve(neigh: DataFrame, qid: str, y_query: str, y_ref: str, ks: list[int],
                 fold: str = "fold") -> DataFrame:
    """Mean squared error for every k at once: the running mean of neighbour
    targets over rank gives each k's prediction from a single neighbour pass
    with k = max(ks); MSE per fold, then the mean over folds."""
    w = Window.partitionBy(qid).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    run = neigh.withColumn("_pred", F.sum(y_ref).over(w) / F.col("rank"))
    sel = run.where(F.col("rank").isin(ks)).withColumn("_se", F.pow(F.col(y_query) - F.col("_pred"), 2))
    per_fold = sel.groupBy(fold, F.col("rank").alias("k")).agg(F.avg("_se").alias("_mse"))
    return per_fold.groupBy("k").agg(F.avg("_mse").alias("cv_mse"))
