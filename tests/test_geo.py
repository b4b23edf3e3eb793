"""Geodesy, nearest donor within a cap, point in polygon -- against brute force."""

import math
import random

from pyspark.sql import functions as F

from panelkit.functions.geo import geodesic_miles
from panelkit.operators.geo import nearest_within, point_in_polygon


def vincenty_miles(lat1, lon1, lat2, lon2):
    """Independent reference: Vincenty's inverse on WGS-84."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    L = math.radians(lon2 - lon1)
    U1, U2 = math.atan((1 - f) * math.tan(math.radians(lat1))), math.atan((1 - f) * math.tan(math.radians(lat2)))
    sU1, cU1, sU2, cU2 = math.sin(U1), math.cos(U1), math.sin(U2), math.cos(U2)
    lam = L
    for _ in range(200):
        sl, cl = math.sin(lam), math.cos(lam)
        ss = math.hypot(cU2 * sl, cU1 * sU2 - sU1 * cU2 * cl)
        if ss == 0:
            return 0.0
        cs = sU1 * sU2 + cU1 * cU2 * cl
        sig = math.atan2(ss, cs)
        sa = cU1 * cU2 * sl / ss
        c2a = 1 - sa * sa
        c2m = cs - 2 * sU1 * sU2 / c2a if c2a else 0.0
        C = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
        lp, lam = lam, L + (1 - C) * f * sa * (sig + C * ss * (c2m + C * cs * (-1 + 2 * c2m * c2m)))
        if abs(lam - lp) < 1e-13:
            break
    u2 = c2a * (a * a - b * b) / (b * b)
    A = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    B = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    ds = B * ss * (c2m + B / 4 * (cs * (-1 + 2 * c2m * c2m) - B / 6 * c2m * (-3 + 4 * ss * ss) * (-3 + 4 * c2m * c2m)))
    return b * A * (sig - ds) / 1609.344


def test_lambert_close_to_vincenty(spark):
    rnd = random.Random(3)
    pts = [(rnd.uniform(34, 41), rnd.uniform(-124, -118), rnd.uniform(34, 41), rnd.uniform(-124, -118)) for _ in range(200)]
    pts.append((38.0, -122.0, 38.0, -122.0))
    df = spark.createDataFrame(pts, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geodesic_miles("a", "b", "c", "d")).collect()]
    for (a, b, c, d), g in zip(pts, got):
        assert abs(g - vincenty_miles(a, b, c, d)) < 0.01


def _brute(left, right, cap):
    out = {}
    for lid, blk, la, lo in left:
        best = None
        for rid, rb, ra, ro in right:
            if rb != blk:
                continue
            d = vincenty_miles(la, lo, ra, ro)
            if d <= cap and (best is None or (d, rid) < best):
                best = (d, rid)
        out[lid] = best[1] if best else None
    return out


def test_nearest_within_matches_brute_force(spark):
    rnd = random.Random(7)
    left = [(i, rnd.randint(0, 2), rnd.uniform(37, 39), rnd.uniform(-123, -121)) for i in range(150)]
    right = [(100 + j, rnd.randint(0, 2), rnd.uniform(37, 39), rnd.uniform(-123, -121)) for j in range(40)]
    right += [(500, 0, right[0][2], right[0][3])] if right[0][1] == 0 else []   # an identical point, higher id
    ldf = spark.createDataFrame(left, "lid long, blk int, lat double, lon double")
    rdf = spark.createDataFrame(right, "rid long, blk int, lat double, lon double")
    res = nearest_within(ldf, rdf, left_id="lid", right_id="rid", block=["blk"], cap_miles=20.0)
    got = {r.lid: r.rid for r in res.collect()}
    assert got == _brute(left, right, 20.0)


def test_cap_edges_and_ties(spark):
    # donors due north at ~59.9 and ~60.1 miles; two equidistant donors east/west
    lat0, lon0 = 38.0, -122.0
    per_deg = vincenty_miles(lat0, lon0, lat0 + 1, lon0)
    left = spark.createDataFrame([(1, 0, lat0, lon0), (2, 1, lat0, lon0), (3, 2, lat0, lon0), (4, 3, lat0, lon0)],
                                 "lid long, blk int, lat double, lon double")
    right = spark.createDataFrame([
        (10, 0, lat0 + 59.9 / per_deg, lon0), (11, 1, lat0 + 60.1 / per_deg, lon0),
        (21, 2, lat0, lon0 + 0.1), (20, 2, lat0, lon0 - 0.1), (30, 3, lat0, lon0)],
        "rid long, blk int, lat double, lon double")
    got = {r.lid: (r.rid, r.distance_mi) for r in
           nearest_within(left, right, left_id="lid", right_id="rid", block=["blk"], cap_miles=60.0).collect()}
    assert got[1][0] == 10 and got[2][0] is None and got[3][0] == 20 and got[4] == (30, 0.0)


def test_point_in_polygon_concave(spark):
    # a U shape: the notch (x in 1..2, y > 1) is outside
    ring = [(0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3)]
    edges = spark.createDataFrame([(7, float(x1), float(y1), float(ring[(i + 1) % 8][0]), float(ring[(i + 1) % 8][1]))
                                   for i, (x1, y1) in enumerate(ring)], "poly_id int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 0.5, 2.5), (2, 1.5, 2.5), (3, 1.5, 0.5), (4, 5.0, 1.0), (5, 2.5, 2.9)],
                                "point_id long, lon double, lat double")
    got = {r.point_id: r.poly_id for r in point_in_polygon(pts, edges).collect()}
    assert got == {1: 7, 2: None, 3: 7, 4: None, 5: 7}
    assert F is not None


def _inside(px, py, ring):
    c = False
    for i, (x1, y1) in enumerate(ring):
        x2, y2 = ring[(i + 1) % len(ring)]
        if (y1 > py) != (y2 > py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1):
            c = not c
    return c


def test_point_in_polygon_random_stars(spark):
    rnd = random.Random(2)
    polys = []
    for pid in range(1, 13):
        cx, cy = rnd.uniform(0, 20), rnd.uniform(0, 20)
        n = rnd.randint(5, 14)
        ring = []
        for j in range(n):
            a = 2 * math.pi * j / n
            r = rnd.uniform(0.5, 3.0)
            ring.append((cx + r * math.cos(a), cy + r * math.sin(a)))
        polys.append((pid, ring))
    edges = spark.createDataFrame(
        [(pid, x1, y1, ring[(i + 1) % len(ring)][0], ring[(i + 1) % len(ring)][1])
         for pid, ring in polys for i, (x1, y1) in enumerate(ring)],
        "poly_id int, x1 double, y1 double, x2 double, y2 double")
    pts = [(i, rnd.uniform(-2, 22), rnd.uniform(-2, 22)) for i in range(1500)]
    got = {r.point_id: r.poly_id for r in
           point_in_polygon(spark.createDataFrame(pts, "point_id long, lon double, lat double"), edges).collect()}
    for i, x, y in pts:
        hits = [pid for pid, ring in polys if _inside(x, y, ring)]
        assert got[i] == (min(hits) if hits else None)


def test_hot_location_and_missing_coordinates(spark):
    left = [(i, 0, 38.0, -122.0) for i in range(500)] + [(999, 0, None, None), (998, 1, 38.0, -122.0)]
    right = [(10, 0, 38.1, -122.0), (11, 0, 38.3, -122.0), (12, 1, 40.0, -122.0)]
    ldf = spark.createDataFrame(left, "lid long, blk int, lat double, lon double")
    rdf = spark.createDataFrame(right, "rid long, blk int, lat double, lon double")
    got = {r.lid: r.rid for r in nearest_within(ldf, rdf, left_id="lid", right_id="rid", block=["blk"]).collect()}
    assert len(got) == 502
    assert all(got[i] == 10 for i in range(500))
    assert got[999] is None and got[998] is None


def test_ten_thousand_polygons(spark):
    """Stars of very different sizes against brute force; few edges are tested."""
    import numpy as np

    from panelkit.operators import geo
    r = np.random.default_rng(12)
    rings = []
    for _ in range(10_000):
        n, size = int(r.integers(4, 24)), 10 ** r.uniform(-2, 0.3)
        a = 2 * np.pi * np.arange(n) / n
        rad = r.uniform(0.3, 1, n) * size
        rings.append(r.uniform(0, 100, 2) + np.stack([rad * np.cos(a), rad * np.sin(a)], axis=1))
    rings[0] = np.array([[10.0, 10], [90, 10], [90, 90], [10, 90]])  # a large one with flat edges
    rows = [(i, *map(float, a), *map(float, b)) for i, ring in enumerate(rings) for a, b in zip(ring, np.roll(ring, -1, axis=0))]
    edges = spark.createDataFrame(rows, "poly_id int, x1 double, y1 double, x2 double, y2 double").repartition(4)
    centres = np.array([ring.mean(axis=0) for ring in rings[::5]])
    pts = np.concatenate([r.uniform(-2, 102, (2000, 2)), centres + r.normal(0, 0.05, centres.shape)])
    want = np.full(len(pts), -1)
    for i in range(len(rings) - 1, -1, -1):
        ring = rings[i]
        near = np.flatnonzero(((pts >= ring.min(axis=0)) & (pts <= ring.max(axis=0))).all(axis=1))
        x, y = pts[near].T
        c = np.zeros(len(near), int)
        for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, axis=0)):
            with np.errstate(divide="ignore", invalid="ignore"):
                c += ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * (x2 - x1) / (y2 - y1))
        want[near[c % 2 == 1]] = i
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "point_id long, lon double, lat double").cache()
    got = {x.point_id: -1 if x.poly_id is None else x.poly_id for x in point_in_polygon(points, edges).collect()}
    assert got == dict(enumerate(want.tolist()))
    cells, by_row = geo.polygon_cells(edges)
    side = F.pow(F.lit(2.0), F.col("_level"))
    border = cells.where("_border").join(by_row, ["poly_id", "_gy"])
    tests = (points.crossJoin(cells.select("_level").distinct()).withColumn("_gx", F.floor(F.col("lon") / side)).withColumn("_gy", F.floor(F.col("lat") / side))
             .join(border, ["_level", "_gx", "_gy"]).count())
    assert tests < 12 * len(pts)
    points.unpersist()
