"""Distances, projections and hexagon lattices as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = (F.pow(F.sin((b - a) / 2), 2)
         + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(h))


def flat_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def bearing180(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Undirected bearing of a segment in degrees, 0..180."""
    return F.pmod(F.degrees(F.atan2(x2 - x1, y2 - y1)), F.lit(180.0))


def angle_gap(a: Column, b: Column) -> Column:
    """Smaller angle between two undirected bearings."""
    d = F.abs(a - b)
    return F.least(d, 180 - d)


def point_segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, ((px - x1) * dx + (py - y1) * dy) / length2).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return flat_distance(px, py, x1 + t * dx, y1 + t * dy)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the point's UTM zone, zone clamped to 1..60."""
    zone = F.least(F.lit(60), F.greatest(F.lit(1), ((lon + 180) / 6).cast("int") + 1))
    return F.when(lat >= 0, 32600).otherwise(32700) + zone


def transverse_mercator_to_lonlat(x: Column, y: Column, *, lon0: float = 19.0, k0: float = 0.9993,
                                  x0: float = 500000.0, y0: float = -5300000.0,
                                  a: float = 6378137.0, inverse_flattening: float = 298.257222101
                                  ) -> tuple[Column, Column]:
    """Inverse transverse Mercator by the usual series; defaults are the Polish national grid."""
    f = 1 / inverse_flattening
    e2 = f * (2 - f)
    root = math.sqrt(1 - e2)
    n = (1 - root) / (1 + root)
    mu = (y - y0) / k0 / (a * (1 - e2 / 4 - 3 * e2**2 / 64))
    # Footpoint latitude series coefficients of sin(2mu), sin(4mu), sin(6mu).
    series = (3 * n / 2 - 27 * n**3 / 32, 21 * n**2 / 16, 151 * n**3 / 96)
    foot = mu
    for i, k in enumerate(series, start=1):
        foot = foot + k * F.sin(2 * i * mu)
    sin2 = F.pow(F.sin(foot), 2)
    ep = e2 / (1 - e2)
    c, t = ep * F.pow(F.cos(foot), 2), F.pow(F.tan(foot), 2)
    normal = a / F.sqrt(1 - e2 * sin2)
    meridian = a * (1 - e2) / F.pow(1 - e2 * sin2, 1.5)
    d = (x - x0) / (normal * k0)
    lat = foot - normal * F.tan(foot) / meridian * (
        d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep) * F.pow(d, 4) / 24)
    lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6) / F.cos(foot)
    return lon0 + F.degrees(lon), F.degrees(lat)


def hex_axial(x: Column, y: Column, spacing: float, offset: tuple[float, float] = (0.0, 0.0)
              ) -> tuple[Column, Column]:
    """Axial (q, r) of the hexagon holding the point; ``spacing`` is the centre distance."""
    px, py = x - offset[0], y - offset[1]
    size = spacing / math.sqrt(3)
    qf = (px * (math.sqrt(3) / 3) - py / 3) / size
    rf = py * 2 / 3 / size
    sf = -qf - rf
    q, r, s = F.round(qf), F.round(rf), F.round(sf)
    dq, dr, ds = F.abs(q - qf), F.abs(r - rf), F.abs(s - sf)
    q_out = F.when((dq > dr) & (dq > ds), -r - s).otherwise(q)
    r_out = F.when(((dq > dr) & (dq > ds)) | (dr <= ds), r).otherwise(-q - s)
    return q_out.cast("bigint"), r_out.cast("bigint")


def hex_centre(q: Column, r: Column, spacing: float, offset: tuple[float, float] = (0.0, 0.0)
               ) -> tuple[Column, Column]:
    size = spacing / math.sqrt(3)
    return (size * math.sqrt(3) * (q + r / 2) + offset[0], size * 1.5 * r + offset[1])
