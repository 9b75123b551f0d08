"""Projections, great-circle measures and other scalar geometry as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sphere of the length measures, sphere of web mercator, gravity of the two turn-radius forms.
EARTH_RADIUS_M = 6_371_000.0
MERCATOR_RADIUS_M = 6_378_137.0
GRAVITY, GRAVITY_ROUNDED = 9.80665, 9.81
MERCATOR_MAX_LAT, TILE_MAX_LAT = 85.06, 85.05112878


@dataclass(frozen=True)
class Ellipsoid:
    """``a`` in metres and the inverse flattening."""

    name: str
    a: float
    inverse_flattening: float

    @property
    def f(self) -> float:
        return 1 / self.inverse_flattening

    @property
    def b(self) -> float:
        return self.a * (1 - self.f)

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def ep2(self) -> float:
        return self.e2 / (1 - self.e2)


WGS84 = Ellipsoid("WGS84", 6_378_137.0, 298.257223563)
CGCS2000 = Ellipsoid("CGCS2000", 6_378_137.0, 298.257222101)
GRS80 = Ellipsoid("GRS80", 6_378_137.0, 298.257222101)
ELLIPSOIDS = {e.name: e for e in (WGS84, CGCS2000, GRS80)}
EPSG = {4326: WGS84, 4490: CGCS2000}


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, lit(lo)), lit(hi))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < lit(math.inf))


def valid_coordinate(lon: Column, lat: Column) -> Column:
    return finite(lon) & finite(lat) & lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial great-circle bearing, 0 to 360 from true north."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    deg = F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)))
    return F.when(deg < 0, deg + 360).otherwise(deg)


def angle_diff_deg(a: Column, b: Column) -> Column:
    """a - b wrapped to [-180, 180)."""
    return F.pmod(a - b + 180, F.lit(360.0)) - 180


def norm_angle(a: Column) -> Column:
    return F.pmod(a, F.lit(2 * math.pi))


def in_angle_window(h: Column, lo: Column, hi: Column) -> Column:
    """Whether heading ``h`` lies on the arc from ``lo`` clockwise to ``hi``."""
    return F.pmod(h - lo, F.lit(360.0)) <= F.pmod(hi - lo, F.lit(360.0)) + 1e-6


def meridian_arc(phi: Column, e: Ellipsoid) -> Column:
    """Arc length from the equator, as the usual series in e squared."""
    e2, e4, e6 = e.e2, e.e2**2, e.e2**3
    c0 = 1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256
    c2 = 3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024
    c4 = 15 * e4 / 256 + 45 * e6 / 1024
    c6 = 35 * e6 / 3072
    return e.a * (c0 * phi - c2 * F.sin(2 * phi) + c4 * F.sin(4 * phi) - c6 * F.sin(6 * phi))


@dataclass(frozen=True)
class TransverseMercator:
    ellipsoid: Ellipsoid = WGS84
    scale: float = 0.9996
    false_easting: float = 500_000.0
    false_northing: float = 0.0

    def forward(self, lon: Column, lat: Column, meridian) -> tuple[Column, Column]:
        e, phi = self.ellipsoid, F.radians(lat)
        sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
        n = e.a / F.sqrt(1 - e.e2 * sin * sin)
        t, c, q = tan * tan, e.ep2 * cos * cos, F.radians(lon - lit(meridian)) * cos
        q2 = q * q
        east = q * (1 + q2 * ((1 - t + c) / 6 + q2 * (5 - 18 * t + t * t + 72 * c - 58 * e.ep2) / 120))
        north = n * tan * q2 * (0.5 + q2 * ((5 - t + 9 * c + 4 * c * c) / 24 + q2 * (61 - 58 * t + t * t + 600 * c - 330 * e.ep2) / 720))
        return self.scale * n * east + self.false_easting, self.scale * (meridian_arc(phi, e) + north) + self.false_northing

    def footpoint(self, northing: Column) -> Column:
        """Latitude whose meridian arc is the northing: eight steps of a fixed-point iteration, as one fold."""
        e, y = self.ellipsoid, northing - self.false_northing
        per_rad = e.a * (1 - e.e2 / 4 - 3 * e.e2**2 / 64 - 5 * e.e2**3 / 256)
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), y / (self.scale * per_rad), lambda phi, _: phi + (y - self.scale * meridian_arc(phi, e)) / per_rad)

    def inverse(self, easting: Column, northing: Column, meridian) -> tuple[Column, Column]:
        e = self.ellipsoid
        phi = self.footpoint(northing)
        sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
        w = 1 - e.e2 * sin * sin
        n, r, t, c = e.a / F.sqrt(w), e.a * (1 - e.e2) / F.pow(w, 1.5), tan * tan, e.ep2 * cos * cos
        d = (easting - self.false_easting) / (self.scale * n)
        d2 = d * d
        lat = phi - n * tan / r * d2 * (0.5 - d2 * ((5 + 3 * t + 10 * c - 4 * c * c - 9 * e.ep2) / 24 - d2 * (61 + 90 * t + 298 * c + 45 * t * t - 252 * e.ep2 - 3 * c * c) / 720))
        lam = d * (1 - d2 * ((1 + 2 * t + c) / 6 - d2 * (5 - 2 * c + 28 * t - 3 * c * c + 8 * e.ep2 + 24 * t * t) / 120)) / cos
        return lit(meridian) + F.degrees(lam), F.degrees(lat)


def utm_zone(lon: Column) -> Column:
    return clamp(F.floor((lon + 180) / 6) + 1, 1, 60).cast("int")


def utm(lon: Column, lat: Column, e: Ellipsoid = WGS84) -> tuple[Column, Column]:
    """Easting and northing in the point's own zone, without a false northing."""
    return TransverseMercator(e).forward(lon, lat, utm_zone(lon) * 6 - 183.0)


def gauss_kruger_3deg(lon: Column, lat: Column, zone: Column, e: Ellipsoid = CGCS2000) -> tuple[Column, Column]:
    return TransverseMercator(e, 1.0).forward(lon, lat, zone * 3.0)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    phi = F.radians(clamp(lat, -MERCATOR_MAX_LAT, MERCATOR_MAX_LAT))
    return MERCATOR_RADIUS_M * F.radians(lon), MERCATOR_RADIUS_M * F.ln(F.tan(math.pi / 4 + phi / 2))


def web_mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_RADIUS_M), F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS_M)) - math.pi / 2)


def tile_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """The unit square of tiles: x to the east, y to the south."""
    phi = F.radians(clamp(lat, -TILE_MAX_LAT, TILE_MAX_LAT))
    return (lon + 180) / 360, (1 - F.asinh(F.tan(phi)) / math.pi) / 2


def enu(lon: Column, lat: Column, alt: Column, lon0, lat0, alt0) -> tuple[Column, Column, Column]:
    """East, north, up in metres near an origin, on a sphere of the ellipsoid's radius."""
    r = MERCATOR_RADIUS_M
    return r * F.radians(lon - lit(lon0)) * F.cos(F.radians(lit(lat0))), r * F.radians(lat - lit(lat0)), alt - lit(alt0)


def enu_inverse(east: Column, north: Column, up: Column, lon0, lat0, alt0) -> tuple[Column, Column, Column]:
    r = MERCATOR_RADIUS_M
    return lit(lon0) + F.degrees(east / (r * F.cos(F.radians(lit(lat0))))), lit(lat0) + F.degrees(north / r), up + lit(alt0)


def local_xy(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Equirectangular metres about (lon0, lat0)."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * EARTH_RADIUS_M, F.radians(lat - lat0) * EARTH_RADIUS_M


def local_lonlat(x: Column, y: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    return lon0 + F.degrees(x / (EARTH_RADIUS_M * F.cos(F.radians(lat0)))), lat0 + F.degrees(y / EARTH_RADIUS_M)


def project(kind: str, lon: Column, lat: Column, **origin) -> tuple[Column, Column]:
    """Forward projection by name: utm, gk3, web_mercator, tile, enu, geographic."""
    if kind == "utm":
        return utm(lon, lat)
    if kind == "gk3":
        return gauss_kruger_3deg(lon, lat, lit(origin["zone"]))
    if kind == "web_mercator":
        return web_mercator(lon, lat)
    if kind == "tile":
        return tile_mercator(lon, lat)
    if kind == "enu":
        return enu(lon, lat, F.lit(0.0), origin["lon0"], origin["lat0"], 0.0)[:2]
    if kind == "geographic":
        return lon, lat
    raise ValueError(f"no projection {kind!r}")


def bilinear(h00: Column, h01: Column, h10: Column, h11: Column, fr: Column, fc: Column) -> Column:
    """Between rows by ``fr`` and columns by ``fc``; null if any corner is."""
    low, high = h00 + (h01 - h00) * fc, h10 + (h11 - h10) * fc
    return low + (high - low) * fr


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def circumradius(ax, ay, bx, by, cx, cy) -> Column:
    """Radius of the circle through three points; null where they are collinear."""
    ux, uy, vx, vy = bx - ax, by - ay, cx - ax, cy - ay
    det, uu, vv = cross(ux, uy, vx, vy), ux * ux + uy * uy, vx * vx + vy * vy
    px, py = (vy * uu - uy * vv) / (2 * det), (ux * vv - vx * uu) / (2 * det)
    return F.when(F.abs(det) >= 1e-12, F.sqrt(px * px + py * py))


def turn_radius_m(speed: Column, bank_deg: Column, gravity: float = GRAVITY) -> Column:
    return speed * speed / (gravity * F.tan(F.radians(bank_deg)))


def cell_of(lon: Column, lat: Column, lon0, lat0, cell, rows: int, cols: int) -> tuple[Column, Column]:
    """Row and column, clamped to the grid, of the cell that holds a point; (lon0, lat0) is the grid's corner."""
    return clamp(F.floor((lat - lit(lat0)) / lit(cell)), 0, rows - 1).cast("int"), clamp(F.floor((lon - lit(lon0)) / lit(cell)), 0, cols - 1).cast("int")


def cell_centre(r: Column, c: Column, lon0, lat0, cell) -> tuple[Column, Column]:
    return lit(lon0) + (c + 0.5) * lit(cell), lit(lat0) + (r + 0.5) * lit(cell)
