"""Geodesy as column expressions: everything stays inside code generation but the geodesic distance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EARTH_M = 6_371_000.0
DEGREE_M = 111_320.0

# WGS84 and zone 35 north of UTM
_A, _FLAT = 6_378_137.0, 1 / 298.257223563
_K0, _E0, _LON0 = 0.9996, 500_000.0, math.radians(27.0)
_N = _FLAT / (2 - _FLAT)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_ECC = 2 * math.sqrt(_N) / (1 + _N)


def to_utm(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(easting, northing) in EPSG:32635 by the Krueger series."""
    phi, lam = F.radians(lat), F.radians(lon) - _LON0
    t = F.sinh(F.atanh(F.sin(phi)) - _ECC * F.atanh(_ECC * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _E0 + _K0 * _RECT * east, _K0 * _RECT * north


def from_utm(east: Column, north: Column) -> tuple[Column, Column]:
    """(lat, lon) of a point in EPSG:32635."""
    xi, eta = north / (_K0 * _RECT), (east - _E0) / (_K0 * _RECT)
    x, y = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(phi), F.degrees(F.lit(_LON0) + F.atan2(F.sinh(y), F.cos(x)))


def destination(lat: Column, lon: Column, azimuth: Column, metres: float | Column = 5.0) -> tuple[Column, Column]:
    """The point `metres` away along an azimuth, on a sphere."""
    phi, lam, az = F.radians(lat), F.radians(lon), F.radians(azimuth)
    d = (F.lit(metres) if not isinstance(metres, Column) else metres) / EARTH_M
    to = F.asin(F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(az))
    return F.degrees(to), F.degrees(lam + F.atan2(F.sin(az) * F.sin(d) * F.cos(phi), F.cos(d) - F.sin(phi) * F.sin(to)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))) + 360, F.lit(360.0))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def project_on_segment(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """Nearest point of a segment in flat metres around its point; a segment without length gives its start."""
    kx = F.cos(F.radians(lat)) * DEGREE_M
    dx, dy = (lon2 - lon1) * kx, (lat2 - lat1) * DEGREE_M
    px, py = (lon - lon1) * kx, (lat - lat1) * DEGREE_M
    squared = dx * dx + dy * dy
    t = F.when(squared > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / squared))).otherwise(0.0)
    return lat1 + t * (lat2 - lat1), lon1 + t * (lon2 - lon1)


def azimuth_change(first: Column, last: Column) -> Column:
    """last - first, wrapped to (-180, 180]."""
    d = last - first
    return F.when(d > 180, d - 360).when(d <= -180, d + 360).otherwise(d)


def azimuth_apart(a: Column, b: Column) -> Column:
    """The smaller angle between two azimuths."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360 - d)


def lateral_azimuth(azimuth: Column, is_left: Column) -> Column:
    return F.pmod(azimuth + F.when(is_left, -90.0).otherwise(90.0), F.lit(360.0))


def cell(value: Column, size: float = 20.0) -> Column:
    return F.floor(value / size).cast("long")


def sign_line(east: Column, north: Column, back_east: Column, back_north: Column, slot: Column, is_side: Column, is_left: Column) -> tuple[Column, Column, Column, Column]:
    """Both ends of the line of a sign, in projected metres.

    The offset is a multiple of the step from the point behind the car, turned to the side: slot - 1 on the left,
    slot on the right. A sign across the road takes the next multiple as its second end, a lateral one the
    same multiple at the point behind.
    """
    dx, dy = east - back_east, north - back_north
    k = F.when(is_left, slot - 1).otherwise(slot).cast("double")
    turn = F.when(is_left, -1.0).otherwise(1.0)
    far = F.when(is_left, k - 1).otherwise(k + 1)
    e1, n1 = east + turn * dy * k, north - turn * dx * k
    e2 = F.when(is_side, back_east + turn * dy * k).otherwise(east + turn * dy * far)
    n2 = F.when(is_side, back_north - turn * dx * k).otherwise(north - turn * dx * far)
    return e1, n1, e2, n2


def turn_anchors(lat0: Column, lon0: Column, lat1: Column, lon1: Column, az0: Column, az1: Column) -> Column:
    """start, end, rev_start, rev_end of a turn: (lat, lon, lat2, lon2, azimuth) each."""
    side = F.when(azimuth_change(az0, az1) >= 0, 60.0).otherwise(-60.0)
    s = destination(lat0, lon0, F.pmod(az0 + side, F.lit(360.0)))
    e = destination(lat0, lon0, F.pmod(az0 + side / 2, F.lit(360.0)))
    point = lambda a, b, c, d, z: F.struct(a.alias("lat"), b.alias("lon"), c.alias("lat2"), d.alias("lon2"), z.alias("azimuth"))
    return F.struct(point(lat0, lon0, lat0, lon0, az0).alias("start"), point(lat1, lon1, lat1, lon1, az1).alias("end"), point(*s, lat0, lon0, az0).alias("rev_start"), point(*e, lat0, lon0, az1).alias("rev_end"))


def geodesic_m(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Distance on WGS84 (Vincenty's inverse formula)."""
    b = _A * (1 - _FLAT)
    u1, u2 = (math.atan((1 - _FLAT) * math.tan(math.radians(x))) for x in (lat1, lat2))
    gap = lam = math.radians(lon2 - lon1)
    for _ in range(200):
        s, c = math.sin(lam), math.cos(lam)
        sin_s = math.hypot(math.cos(u2) * s, math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * c)
        if sin_s == 0:
            return 0.0
        cos_s = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * c
        sigma = math.atan2(sin_s, cos_s)
        sin_a = math.cos(u1) * math.cos(u2) * s / sin_s
        cos2 = 1 - sin_a**2
        mid = cos_s - 2 * math.sin(u1) * math.sin(u2) / cos2 if cos2 else 0.0
        k = _FLAT / 16 * cos2 * (4 + _FLAT * (4 - 3 * cos2))
        before, lam = lam, gap + (1 - k) * _FLAT * sin_a * (sigma + k * sin_s * (mid + k * cos_s * (2 * mid**2 - 1)))
        if abs(lam - before) < 1e-13:
            break
    w = cos2 * (_A**2 - b**2) / b**2
    p = 1 + w / 16384 * (4096 + w * (w * (320 - 175 * w) - 768))
    q = w / 1024 * (256 + w * (w * (74 - 47 * w) - 128))
    d = q * sin_s * (mid + q / 4 * (cos_s * (2 * mid**2 - 1) - q / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
    return b * p * (sigma - d)


def geodesic_np(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """geodesic_m() of arrays, a step for all that haven't settled at a time; NaN where a value is missing."""
    b = _A * (1 - _FLAT)
    u1, u2 = (np.arctan((1 - _FLAT) * np.tan(np.radians(x))) for x in (np.asarray(lat1, float), np.asarray(lat2, float)))
    gap = np.radians(np.asarray(lon2, float) - np.asarray(lon1, float))
    out = np.full(len(gap), np.nan)
    at, lam = np.nonzero(~np.isnan(u1 + u2 + gap))[0], gap.copy()
    for step in range(200):
        s, c, p, q = np.sin(lam[at]), np.cos(lam[at]), u1[at], u2[at]
        sin_s = np.hypot(np.cos(q) * s, np.cos(p) * np.sin(q) - np.sin(p) * np.cos(q) * c)
        out[at[sin_s == 0]] = 0.0
        at, s, c, p, q, sin_s = (x[sin_s > 0] for x in (at, s, c, p, q, sin_s))
        if not len(at):
            break
        cos_s = np.sin(p) * np.sin(q) + np.cos(p) * np.cos(q) * c
        sigma = np.arctan2(sin_s, cos_s)
        sin_a = np.cos(p) * np.cos(q) * s / sin_s
        cos2 = 1 - sin_a**2
        mid = cos_s - np.divide(2 * np.sin(p) * np.sin(q), cos2, out=np.zeros_like(cos2), where=cos2 != 0) if len(cos2) else cos_s
        mid = np.where(cos2 != 0, mid, 0.0)
        k = _FLAT / 16 * cos2 * (4 + _FLAT * (4 - 3 * cos2))
        after = gap[at] + (1 - k) * _FLAT * sin_a * (sigma + k * sin_s * (mid + k * cos_s * (2 * mid**2 - 1)))
        done = (np.abs(after - lam[at]) < 1e-13) | (step == 199)
        lam[at] = after
        w = cos2 * (_A**2 - b**2) / b**2
        big = 1 + w / 16384 * (4096 + w * (w * (320 - 175 * w) - 768))
        small = w / 1024 * (256 + w * (w * (74 - 47 * w) - 128))
        d = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid**2 - 1) - small / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
        out[at[done]] = (b * big * (sigma - d))[done]
        at = at[~done]
    return out


@F.pandas_udf(DoubleType())
def geodesic(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    made = geodesic_np(*(x.to_numpy(float, na_value=np.nan) for x in (lat1, lon1, lat2, lon2)))
    return pd.Series(made, dtype=float)


def projected_distance(east1: Column, north1: Column, east2: Column, north2: Column) -> Column:
    """Metres on the ground between two points of EPSG:32635."""
    return geodesic(*from_utm(east1, north1), *from_utm(east2, north2))
