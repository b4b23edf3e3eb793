"""Spatial joins: nearest donor within a distance cap, and point-in-polygon.

Both are exact and built from equi-joins on grid cells, so no pair list is
ever formed for a whole block (date, region, ...): a point only meets
candidates in the 3 x 3 neighbouring cells of its own cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_MILE, geodesic_from_terms, point_terms
from ..session import cut_lineage

# Smallest meridional radius of curvature of WGS-84 (at the equator), km.
_MIN_MERIDIAN_RADIUS_KM = 6335.439
_MARGIN = 1.02


def _cell_sizes(cap_miles: float, max_abs_lat: float) -> tuple[float, float]:
    """Degree sizes (lat, lon) of a grid cell such that any two points within
    ``cap_miles`` of each other fall in the same or adjacent cells. Longitude
    cells tile 360 degrees exactly so that the +-180 wrap is just ``mod n``."""
    sigma = cap_miles * KM_PER_MILE / _MIN_MERIDIAN_RADIUS_KM * _MARGIN  # radians
    dlat = math.degrees(sigma)
    coslat = math.cos(math.radians(min(90.0, max_abs_lat + dlat)))
    s = math.sin(sigma / 2) / coslat if coslat > 1e-9 else 2.0
    dlon = 360.0 if s >= 1 else math.degrees(2 * math.asin(s))
    n_lon = max(1, int(360.0 // dlon))
    return dlat, 360.0 / n_lon


def _cells(lat: Column, lon: Column, dlat: float, dlon: float) -> tuple[Column, Column]:
    n_lon = int(round(360.0 / dlon))
    cy = F.floor((lat + 90.0) / dlat).cast("long")
    cx = F.pmod(F.floor((lon + 180.0) / dlon).cast("long"), F.lit(n_lon))
    return cy, cx


def nearest_within(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str,
                   block: list[str], cap_miles: float = 60.0,
                   lat: str = "lat", lon: str = "lon",
                   refine_levels: tuple[int, ...] | None = None,
                   max_abs_lat: float | None = None) -> DataFrame:
    """For every ``left`` row, the nearest ``right`` row of the same ``block``
    within ``cap_miles`` (ties: lowest ``right_id``).

    Returns ``left_id, right_id, distance_mi`` for every left row; ``right_id``
    and ``distance_mi`` are NULL when no right row of the block lies within
    the cap. Exactness: the search runs from fine to coarse grids (cell side
    cap / 2^level). A left point is settled at a level once its nearest
    candidate lies within that level's cell side, because every closer
    point must then sit in the 3 x 3 cells around it. Dense areas settle at
    fine levels, so no cell neighbourhood ever holds a hot block's whole
    population. Right rows with identical coordinates collapse to the lowest
    id first (only that one can win a tie).

    Levels: unless given, the finest level is chosen from the busiest
    cap-sized cell of the right side (about one right point per cell at the
    finest level, assuming 2-D spread), then every third level (x8 coarser)
    down to 0. This costs two small aggregates over the right side.
    """
    if max_abs_lat is None:
        m = right.agg(F.max(F.abs(F.col(lat)))).first()[0]
        max_abs_lat = float(m) if m is not None else 0.0
    if refine_levels is None:
        dlat0, dlon0 = _cell_sizes(cap_miles, max_abs_lat)
        cy0, cx0 = _cells(F.col(lat), F.col(lon), dlat0, dlon0)
        occ = (right.groupBy(*block, cy0.alias("_cy"), cx0.alias("_cx")).agg(F.count(F.lit(1)).alias("_n"))
                    .agg(F.max("_n")).first()[0]) or 1
        finest = max(0, min(20, int(math.ceil(math.log(max(occ, 1), 4)))))
        refine_levels = tuple(range(finest, 0, -3)) + (0,)
    r = (right.select(*block, F.col(right_id).alias("_rid"), F.col(lat).alias("_rlat"),
                      F.col(lon).alias("_rlon"))
         .where(F.col("_rlat").isNotNull() & F.col("_rlon").isNotNull())
         .groupBy(*block, "_rlat", "_rlon").agg(F.min("_rid").alias("_rid")))
    rb, rcb, rl = point_terms(F.col("_rlat"), F.col("_rlon"))
    r = r.select("*", rb.alias("_rb"), rcb.alias("_rcb"), rl.alias("_rl"))
    # the answer depends only on (block, location): search each distinct one
    # once (a hot entity with many rows at one spot is one lookup) and join the
    # result back to every left row at the end
    loc_key = F.struct(*[F.col(b) for b in block], F.col(lat).alias("_la"), F.col(lon).alias("_lo"))
    pending = (left.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
                   .select(loc_key.alias("_lid"), *block, F.col(lat).alias("_llat"), F.col(lon).alias("_llon"))
                   .dropDuplicates(["_lid"]))
    lb, lcb, ll_ = point_terms(F.col("_llat"), F.col("_llon"))
    pending = pending.select("*", lb.alias("_lb"), lcb.alias("_lcb"), ll_.alias("_ll"))
    settled = []
    levels = sorted(set(refine_levels), reverse=True)
    if 0 not in levels:
        levels.append(0)
    offs = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    for lvl in levels:
        side = cap_miles / (2 ** lvl)
        dlat, dlon = _cell_sizes(side, max_abs_lat)
        n_lon = int(round(360.0 / dlon))
        ly, lx = _cells(F.col("_llat"), F.col("_llon"), dlat, dlon)
        ry, rx = _cells(F.col("_rlat"), F.col("_rlon"), dlat, dlon)
        # duplicates from a wrap with fewer than 3 longitude cells do not change a min
        rr = (r.withColumn("_cy", F.explode(F.transform(offs, lambda o: ry + o)))
               .withColumn("_cx", F.explode(F.transform(offs, lambda o: F.pmod(rx + o, F.lit(n_lon))))))
        ll = pending.withColumn("_cy", ly).withColumn("_cx", lx)
        # the distance is computed once per candidate pair; the cap test runs
        # on the per-point minimum (same result as filtering every pair first)
        pairs = (ll.join(rr, [*block, "_cy", "_cx"], "inner")
                   .select("_lid", "_rid", geodesic_from_terms("_lb", "_lcb", "_ll", "_rb", "_rcb", "_rl").alias("_d")))
        best = (pairs.groupBy("_lid")
                .agg(F.min(F.struct(F.col("_d"), F.col("_rid"))).alias("_b"))
                .select("_lid", F.col("_b._rid").alias("_rid"), F.col("_b._d").alias("_d"))
                .where(F.col("_d") <= F.lit(side)))
        if lvl == 0:
            out = pending.select("_lid").join(best, "_lid", "left")
        else:
            # materialise each level in the shared checkpoint folder: later
            # levels then do not recompute earlier ones
            out = cut_lineage(best)
            pending = cut_lineage(pending.join(out.select("_lid"), "_lid", "left_anti"))
        settled.append(out)
        if lvl > 0 and pending.isEmpty():
            break
    res = settled[0]
    for s in settled[1:]:
        res = res.unionByName(s)
    return (left.select(F.col(left_id), loc_key.alias("_lid")).join(res, "_lid", "left")
                .select(F.col(left_id), F.col("_rid").alias(right_id), F.col("_d").alias("distance_mi")))


CELLS_ACROSS = 8  # least cells along the longer side of a polygon's box


def polygon_cells(edges: DataFrame, poly_id: str = "poly_id") -> tuple[DataFrame, DataFrame]:
    """A raster of each polygon at its own scale.

    Returns (cells, rows). cells: ``poly_id, _level, _gx, _gy, _border`` for the
    cells (side ``2 ** _level``, 8 to 16 along the longer side of the box) that an
    edge touches (border) or that lie wholly inside; cells outside are left out.
    rows: the edges by the rows of cells they reach. A cell that no edge touches
    is inside or outside as a whole, which its centre's crossings decide.
    """
    e = edges.select(poly_id, "x1", "y1", "x2", "y2")
    bbox = e.groupBy(poly_id).agg(
        F.least(F.min("x1"), F.min("x2")).alias("_xmin"), F.greatest(F.max("x1"), F.max("x2")).alias("_xmax"),
        F.least(F.min("y1"), F.min("y2")).alias("_ymin"), F.greatest(F.max("y1"), F.max("y2")).alias("_ymax"))
    box = F.greatest(F.col("_xmax") - F.col("_xmin"), F.col("_ymax") - F.col("_ymin"), F.lit(1e-9))
    bbox = cut_lineage(bbox.withColumn("_level", F.floor(F.log2(box / CELLS_ACROSS)).cast("int"))
                       .withColumn("_side", F.pow(F.lit(2.0), F.col("_level"))))

    def at(c: Column) -> Column:
        return F.floor(c / F.col("_side")).cast("long")

    slack = F.col("_side") * 1e-6  # an edge also touches cells it only nearly reaches
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = e.join(bbox.select(poly_id, "_level", "_side"), poly_id).withColumn(
        "_gy", F.explode(F.sequence(at(low - slack), at(high + slack))))
    rows = cut_lineage(rows)
    slope = (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))

    def x_at(y: Column) -> Column:
        return F.col("x1") + (y - F.col("y1")) * slope

    bottom = x_at(F.greatest(low, F.col("_gy") * F.col("_side") - slack))
    top = x_at(F.least(high, (F.col("_gy") + 1) * F.col("_side") + slack))
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    # a flat edge reaches over its whole length
    from_x = F.greatest(left, F.coalesce(F.least(bottom, top), left)) - slack
    to_x = F.least(right, F.coalesce(F.greatest(bottom, top), right)) + slack
    border = rows.select(poly_id, "_gy", F.explode(F.sequence(at(F.least(from_x, to_x)), at(F.greatest(from_x, to_x)))).alias("_gx")).distinct()
    middle = (F.col("_gy") + 0.5) * F.col("_side")
    crossings = (rows.where((F.col("y1") > middle) != (F.col("y2") > middle))
                 .groupBy(poly_id, "_gy").agg(F.collect_list(x_at(middle)).alias("_cross")))
    boxes = (bbox.withColumn("_gy", F.explode(F.sequence(at(F.col("_ymin")), at(F.col("_ymax")))))
             .join(crossings, [poly_id, "_gy"])
             .withColumn("_gx", F.explode(F.sequence(at(F.col("_xmin")), at(F.col("_xmax"))))))
    centre = (F.col("_gx") + 0.5) * F.col("_side")
    inside = boxes.where(F.size(F.filter("_cross", lambda c: c > centre)) % 2 == 1).select(poly_id, "_gx", "_gy")
    inside = inside.join(border, [poly_id, "_gx", "_gy"], "left_anti")
    cells = (border.select(poly_id, "_gx", "_gy", F.lit(True).alias("_border"))
             .unionByName(inside.withColumn("_border", F.lit(False)))
             .join(bbox.select(poly_id, "_level"), poly_id))
    return cut_lineage(cells), rows.select(poly_id, "_gy", "x1", "y1", "x2", "y2")


def point_in_polygon(points: DataFrame, edges: DataFrame, *, point_id: str = "point_id",
                     poly_id: str = "poly_id", x: str = "lon", y: str = "lat") -> DataFrame:
    """Which polygon holds each point (ray-crossing parity). Points outside all
    polygons get NULL; when polygons overlap, the lowest ``poly_id`` wins.

    ``edges`` has one row per polygon edge: ``poly_id, x1, y1, x2, y2`` (a ring
    closes on itself). Two equi-joins, no pair list:
    1. points meet the cells of the polygons' rasters, one look-up per scale in
       use (scales are powers of two, so they are few); a point in an inside
       cell is done;
    2. a point in a border cell meets only that polygon's edges in its row of
       cells, and counts the crossings to its right.
    """
    cells, rows = polygon_cells(edges, poly_id)
    p = points.select(F.col(point_id).alias("_pid"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    levels = [r[0] for r in cells.select("_level").distinct().collect()]  # one number per scale
    if not levels:
        return p.select(F.col("_pid").alias(point_id), F.lit(None).cast(edges.schema[poly_id].dataType).alias(poly_id))
    side = F.pow(F.lit(2.0), F.col("_level"))
    met = (p.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels])))
           .withColumn("_gx", F.floor(F.col("_x") / side).cast("long")).withColumn("_gy", F.floor(F.col("_y") / side).cast("long"))
           .join(cells, ["_level", "_gx", "_gy"]))
    done = met.where(~F.col("_border")).select("_pid", poly_id)
    cross = (met.where("_border").select("_pid", poly_id, "_gy", "_x", "_y").join(rows, [poly_id, "_gy"])
             .where((F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y")))
             .where(F.col("_x") < F.col("x1") + (F.col("_y") - F.col("y1")) * (F.col("x2") - F.col("x1"))
                    / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))))
    odd = cross.groupBy("_pid", poly_id).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") % 2 == 1).select("_pid", poly_id)
    inside = done.unionByName(odd).groupBy("_pid").agg(F.min(poly_id).alias(poly_id))
    return (p.join(inside, "_pid", "left")
             .select(F.col("_pid").alias(point_id), F.col(poly_id)))
