"""Geodesy as closed-form Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS-84 ellipsoid and the statute mile.
WGS84_A_KM = 6378.137
WGS84_F = 1 / 298.257223563
KM_PER_MILE = 1.609344
# Smallest length of one degree of latitude, in miles (at the equator).
MILES_PER_DEG_LAT_MIN = 68.7


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def point_terms(lat, lon) -> tuple[Column, Column, Column]:
    """Per-point parts of the distance: reduced latitude beta, cos(beta) and the
    longitude in radians. Computing them once per point (before a join) keeps
    the per-pair work to the terms that really depend on both points."""
    f = F.lit(WGS84_F)
    beta = F.atan((1 - f) * F.tan(F.radians(_c(lat))))
    return beta, F.cos(beta), F.radians(_c(lon))


def geodesic_from_terms(b1, cb1, l1, b2, cb2, l2) -> Column:
    """Lambert's long-line formula from precomputed point terms (see
    ``geodesic_miles``)."""
    b1, cb1, l1, b2, cb2, l2 = (_c(x) for x in (b1, cb1, l1, b2, cb2, l2))
    f = F.lit(WGS84_F)
    h = F.pow(F.sin((b2 - b1) / 2), 2) + cb1 * cb2 * F.pow(F.sin((l2 - l1) / 2), 2)
    sigma = 2 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
    p = (b1 + b2) / 2
    q = (b2 - b1) / 2
    x = (sigma - F.sin(sigma)) * F.pow(F.sin(p) * F.cos(q) / F.cos(sigma / 2), 2)
    y = (sigma + F.sin(sigma)) * F.pow(F.cos(p) * F.sin(q) / F.sin(sigma / 2), 2)
    d = F.lit(WGS84_A_KM) * (sigma - f / 2 * (x + y)) / F.lit(KM_PER_MILE)
    return F.when(sigma == 0, F.lit(0.0)).otherwise(d)


def geodesic_miles(lat1, lon1, lat2, lon2) -> Column:
    """Ellipsoidal distance in miles by Lambert's formula for long lines.

    Reduced latitudes beta = atan((1-f) tan phi); sigma is the central angle
    (haversine on the reduced latitudes); the flattening correction uses
    P = (b1+b2)/2 and Q = (b2-b1)/2. Error is far below a metre at the
    distances the donor cap uses. Identical points give 0.
    """
    return geodesic_from_terms(*point_terms(lat1, lon1), *point_terms(lat2, lon2))
