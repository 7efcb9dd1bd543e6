"""Map projections, poses and tile arithmetic as column expressions on the WGS84 ellipsoid."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, functions as F

#: WGS84: semi-major axis and flattening.
A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
K0 = 0.9996
#: GRS80, for the state-plane zone.
GRS80_E = math.sqrt((1 / 298.257222101) * (2 - 1 / 298.257222101))
#: International foot.
FOOT = 0.3048

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Coefficients of the Krueger series in the third flattening.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180 - 127 * _N**5 / 288,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440 + 281 * _N**5 / 630,
    61 * _N**3 / 240 - 103 * _N**4 / 140 + 15061 * _N**5 / 26880,
    49561 * _N**4 / 161280 - 179 * _N**5 / 168,
    34729 * _N**5 / 80640,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360 - 81 * _N**5 / 512,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440 + 46 * _N**5 / 105,
    17 * _N**3 / 480 - 37 * _N**4 / 840 - 209 * _N**5 / 4480,
    4397 * _N**4 / 161280 - 11 * _N**5 / 504,
    4583 * _N**5 / 161280,
)


def utm_zone(lon: Column) -> Column:
    """G1."""
    return (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")


def is_south(lat: Column) -> Column:
    """G1."""
    return lat < 0


def utm_srs(lon: Column, lat: Column) -> Column:
    """The name of the zone of a position."""
    return F.concat(F.lit("WGS84 UTM "), utm_zone(lon).cast("string"), F.when(is_south(lat), "S").otherwise("N"))


def to_utm(lon: Column, lat: Column, zone: Column, south: Column) -> Column:
    """(x, y) in a zone by the Krueger series to the fifth order."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e = math.sqrt(E2)
    tau = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi = F.atan2(tau, F.cos(lam))
    eta = F.asinh(F.sin(lam) / F.sqrt(tau * tau + F.cos(lam) * F.cos(lam)))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((500000 + K0 * _RADIUS * x).alias("x"), (F.when(south, 10000000.0).otherwise(0.0) + K0 * _RADIUS * y).alias("y"))


def from_utm(x: Column, y: Column, zone: Column, south: Column) -> Column:
    """(lon, lat) of a position in a zone."""
    xi = (y - F.when(south, 10000000.0).otherwise(0.0)) / (K0 * _RADIUS)
    eta = (x - 500000) / (K0 * _RADIUS)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    conformal = F.sin(u) / F.cosh(v)
    lam = F.atan2(F.sinh(v), F.cos(u))
    # The geodetic latitude by four rounds of the fixed-point iteration.
    e = math.sqrt(E2)
    q = F.atanh(conformal)
    phi = F.asin(conformal)
    for _ in range(5):
        phi = F.asin(F.tanh(q + e * F.atanh(e * F.sin(phi))))
    return F.struct((F.degrees(lam) + (zone * 6 - 183)).alias("lon"), F.degrees(phi).alias("lat"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class Srs(NamedTuple):
    """A parsed reference system; zone and south are for kind 'utm'."""

    kind: str
    zone: int = 0
    south: bool = False


def parse_srs(text: str) -> Srs:
    """G5: 'WGS84 UTM 16N', '+proj=...' and 'EPSG:n'; ValueError for anything else."""
    line = text.strip()
    if m := re.fullmatch(r"WGS84\s+UTM\s+(\d{1,2})\s*([NS])", line, re.I):
        return Srs("utm", int(m[1]), m[2].upper() == "S")
    if line.lower().startswith("+proj"):
        parts = dict(p.partition("=")[::2] for p in line.replace("+", " ").split())
        if parts.get("proj") == "utm":
            return Srs("utm", int(parts["zone"]), "south" in parts)
        if parts.get("proj") in ("longlat", "latlong"):
            return Srs("lonlat")
        if parts.get("proj") in ("merc", "webmerc"):
            return Srs("mercator")
    if m := re.fullmatch(r"EPSG:(\d+)", line, re.I):
        code = int(m[1])
        if code == 4326:
            return Srs("lonlat")
        if 32601 <= code <= 32660 or 32701 <= code <= 32760:
            return Srs("utm", code % 100, code >= 32701)
        if code in (3857, 900913):
            return Srs("mercator")
        if code == 2251:
            return Srs("michigan_feet")
    raise ValueError(f"unknown reference system: {text!r}")


def srs_name(found: Srs) -> str:
    """The code of a parsed system, as files state it."""
    if found.kind == "utm":
        return f"EPSG:{(327 if found.south else 326) * 100 + found.zone}"
    return {"lonlat": "EPSG:4326", "mercator": "EPSG:3857", "michigan_feet": "EPSG:2251"}[found.kind]


#: Lambert conformal conic of EPSG:2251: standard parallels, origin and false easting in metres.
_LCC = {"phi1": 45 + 29 / 60, "phi2": 47 + 5 / 60, "phi0": 44 + 47 / 60, "lam0": -87.0, "x0": 7999999.999968}


def _lcc() -> tuple[float, float, float]:
    def m(p: float) -> float:
        return math.cos(p) / math.sqrt(1 - (GRS80_E * math.sin(p)) ** 2)

    def t(p: float) -> float:
        s = GRS80_E * math.sin(p)
        return math.tan(math.pi / 4 - p / 2) / ((1 - s) / (1 + s)) ** (GRS80_E / 2)

    p1, p2, p0 = (math.radians(_LCC[k]) for k in ("phi1", "phi2", "phi0"))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    return n, f, A * f * t(p0) ** n


def from_michigan_feet(x: Column, y: Column) -> Column:
    """(lon, lat) of state-plane feet; heights stay as they are."""
    n, f, rho0 = _lcc()
    east, north = x * FOOT - _LCC["x0"], y * FOOT
    rho = F.sqrt(east * east + (rho0 - north) * (rho0 - north))
    t = F.pow(rho / (A * f), F.lit(1 / n))
    lam = F.atan2(east, rho0 - north) / n
    phi = math.pi / 2 - 2 * F.atan(t)
    for _ in range(6):
        phi = bound(GRS80_E * F.sin(phi), lambda s: math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(GRS80_E / 2))))
    return F.struct((F.degrees(lam) + _LCC["lam0"]).alias("lon"), F.degrees(phi).alias("lat"))


def to_lonlat(srs: Srs, x: Column, y: Column) -> Column:
    """(lon, lat) of a position in any supported system; x is the longitude or easting."""
    if srs.kind == "lonlat":
        return F.struct(x.alias("lon"), y.alias("lat"))
    if srs.kind == "utm":
        return from_utm(x, y, F.lit(srs.zone), F.lit(srs.south))
    if srs.kind == "mercator":
        return mercator_to_lonlat(x, y)
    return from_michigan_feet(x, y)


def transform(source: Srs, target: Srs, x: Column, y: Column) -> Column:
    """(x, y) in another system."""
    if target.kind not in ("lonlat", "utm", "mercator"):
        raise ValueError(f"no projection to {target.kind}")

    def placed(place: Column) -> Column:
        lon, lat = place["lon"], place["lat"]
        if target.kind == "lonlat":
            return F.struct(lon.alias("x"), lat.alias("y"))
        return to_utm(lon, lat, F.lit(target.zone), F.lit(target.south)) if target.kind == "utm" else lonlat_to_mercator(lon, lat)

    return bound(to_lonlat(source, x, y), placed)


def to_ecef(lon: Column, lat: Column, alt: Column) -> Column:
    """Earth-centred (x, y, z)."""
    phi, lam = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    return F.struct(((n + alt) * F.cos(phi) * F.cos(lam)).alias("x"), ((n + alt) * F.cos(phi) * F.sin(lam)).alias("y"), ((n * (1 - E2) + alt) * F.sin(phi)).alias("z"))


def _times(a: list[list], b: list[list]) -> list[list]:
    return [[sum((a[i][k] * b[k][j] for k in range(1, 3)), a[i][0] * b[0][j]) for j in range(3)] for i in range(3)]


def omega_phi_kappa(lon: Column, lat: Column, alt: Column, yaw: Column, pitch: Column, roll: Column, delta: float = 1e-7) -> Column:
    """Photogrammetric angles in degrees from yaw, pitch and roll."""
    y, p, r = F.radians(yaw), F.radians(pitch), F.radians(roll)
    cy, sy, cp, sp, cr, sr = F.cos(y), F.sin(y), F.cos(p), F.sin(p), F.cos(r), F.sin(r)
    cnb = [
        [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr],
        [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr],
        [-sp, cp * sr, cp * cr],
    ]
    # The north direction, by a small step of latitude.
    a, b = to_ecef(lon, lat + delta, alt), to_ecef(lon, lat - delta, alt)
    d = [a[k] - b[k] for k in "xyz"]
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    xn = [v / length for v in d]
    # Down is the pole's axis here, whatever the latitude.
    cen = [[xn[0], xn[1], F.lit(0.0)], [xn[1], -xn[0], F.lit(0.0)], [xn[2], F.lit(0.0), F.lit(-1.0)]]
    # Body axes to image axes: swap the first two, flip the third.
    turn = [[F.lit(float(v)) for v in row] for row in ((0, 1, 0), (1, 0, 0), (0, 0, -1))]
    m = _times(_times(cen, cnb), turn)
    return F.struct(
        F.degrees(F.atan2(-m[1][2], m[2][2])).alias("omega"),
        F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m[0][2])))).alias("phi"),
        F.degrees(F.atan2(-m[0][1], m[0][0])).alias("kappa"),
    )


def rotation(rx: Column, ry: Column, rz: Column) -> list[list[Column]]:
    """The matrix of a rotation vector."""
    angle = F.sqrt(rx * rx + ry * ry + rz * rz)
    safe = F.when(angle > 0, angle).otherwise(1.0)
    x, y, z = rx / safe, ry / safe, rz / safe
    c, s = F.cos(angle), F.sin(angle)
    t = 1 - c
    return [[c + x * x * t, x * y * t - z * s, x * z * t + y * s], [y * x * t + z * s, c + y * y * t, y * z * t - x * s], [z * x * t - y * s, z * y * t + x * s, c + z * z * t]]


def pose_origin(rx: Column, ry: Column, rz: Column, tx: Column, ty: Column, tz: Column) -> Column:
    """The camera's place, minus the transposed rotation of the translation."""
    r = rotation(rx, ry, rz)
    o = [-(r[0][j] * tx + r[1][j] * ty + r[2][j] * tz) for j in range(3)]
    return F.struct(*(v.alias(k) for v, k in zip(o, "xyz")))


def affine(matrix: list[float], x: Column, y: Column, z: Column) -> Column:
    """A 4 by 4 matrix, row by row, applied to a point."""
    rows = [matrix[4 * i] * x + matrix[4 * i + 1] * y + matrix[4 * i + 2] * z + matrix[4 * i + 3] for i in range(3)]
    return F.struct(*(v.alias(k) for v, k in zip(rows, "xyz")))


#: Pseudo-georeference: zone 30 north, coordinates scaled to a tenth.
PSEUDO_SRS, PSEUDO_SCALE = Srs("utm", 30, False), 0.1


def pseudo_place(x: Column, y: Column, z: Column) -> Column:
    """A place without georeference in metres."""
    k = 1 / PSEUDO_SCALE**2
    return F.struct((x * k).alias("x"), (y * k).alias("y"), (z * k).alias("z"))


def offset_ring(ring: Column, dx: Column, dy: Column) -> Column:
    """A ring moved by minus an offset; heights stay."""
    return F.transform(ring, lambda p: F.struct((p["x"] - dx).alias("x"), (p["y"] - dy).alias("y"), p["z"].alias("z")))


def las_scale(spacing: Column) -> Column:
    """A tenth of the spacing's power of ten, 0.001 at most."""
    return F.least(F.pow(F.lit(10.0), F.rint(F.log10(spacing))) / 10, F.lit(0.001))


# ---- tiles -----------------------------------------------------------------

TILE = 256
_SHIFT = math.pi * A
_RESOLUTION = 2 * _SHIFT / TILE


def lonlat_to_mercator(lon: Column, lat: Column) -> Column:
    """G18."""
    y = F.log(F.tan((90 + lat) * math.pi / 360)) / (math.pi / 180)
    return F.struct((lon * _SHIFT / 180).alias("x"), (y * _SHIFT / 180).alias("y"))


def mercator_to_lonlat(x: Column, y: Column) -> Column:
    """G18."""
    lat = y / _SHIFT * 180
    return F.struct((x / _SHIFT * 180).alias("lon"), (180 / math.pi * (2 * F.atan(F.exp(lat * math.pi / 180)) - math.pi / 2)).alias("lat"))


def resolution(zoom: Column) -> Column:
    """Metres of a pixel."""
    return _RESOLUTION / F.pow(F.lit(2.0), zoom)


def zoom_for_pixel(size: Column, last: int = 32) -> Column:
    """The deepest zoom whose pixels are not smaller than the size, -1 if none."""
    return F.least(F.lit(last - 2), F.greatest(F.lit(-1), F.floor(F.log2(_RESOLUTION / size)).cast("int")))


def max_zoom(pixel: Column) -> Column:
    """Zoom of a ground resolution, 5 to 23."""
    return F.least(F.lit(23), F.greatest(F.lit(5), F.ceil(F.log2(_RESOLUTION / pixel)).cast("int")))


def metres_to_tile(x: Column, y: Column, zoom: Column) -> Column:
    """The tile of a place, counted from the south-west."""
    px, py = (x + _SHIFT) / resolution(zoom), (y + _SHIFT) / resolution(zoom)
    return F.struct((F.ceil(px / TILE) - 1).cast("long").alias("tx"), (F.ceil(py / TILE) - 1).cast("long").alias("ty"))


def tile_bounds(tx: Column, ty: Column, zoom: Column) -> Column:
    """Metres."""
    r = resolution(zoom) * TILE
    return F.struct((tx * r - _SHIFT).alias("min_x"), (ty * r - _SHIFT).alias("min_y"), ((tx + 1) * r - _SHIFT).alias("max_x"), ((ty + 1) * r - _SHIFT).alias("max_y"))


def google_y(ty: Column, zoom: Column) -> Column:
    """Rows counted from the north."""
    return (F.pow(F.lit(2.0), zoom) - 1 - ty).cast("long")


def quadkey(tx: Column, ty: Column, zoom: Column) -> Column:
    """One digit for each level, from the first."""
    y = google_y(ty, zoom)

    def digit(level: Column) -> Column:
        bit = F.pow(F.lit(2.0), level - 1).cast("long")
        return (F.when(F.floor(tx / bit) % 2 != 0, 1).otherwise(0) + F.when(F.floor(y / bit) % 2 != 0, 2).otherwise(0)).cast("string")

    return F.when(zoom > 0, F.array_join(F.transform(F.sequence(zoom, F.lit(1), F.lit(-1)), digit), "")).otherwise("")


def geodetic_tile(lon: Column, lat: Column, zoom: Column, first: float = 1.40625 / 2) -> Column:
    """The tile of a position in the profile of plain degrees (two tiles at the first level)."""
    r = first / F.pow(F.lit(2.0), zoom)
    return F.struct((F.ceil((180 + lon) / r / TILE) - 1).cast("long").alias("tx"), (F.ceil((90 + lat) / r / TILE) - 1).cast("long").alias("ty"))


def zoomify_tiers(width: int, height: int, size: int = TILE) -> list[tuple[int, int, int, int]]:
    """(tier, columns, rows, first tile's number) from the smallest tier on."""
    sizes = [(width, height)]
    while sizes[-1][0] > size or sizes[-1][1] > size:
        sizes.append((sizes[-1][0] // 2, sizes[-1][1] // 2))
    out, number = [], 0
    for tier, (w, h) in enumerate(reversed(sizes)):
        columns, rows = -(-w // size), -(-h // size)
        out.append((tier, columns, rows, number))
        number += columns * rows
    return out


def clip_window(west: Column, north: Column, x0: Column, y0: Column, x1: Column, y1: Column, pixel: Column, width: int, height: int, size: int) -> Column:
    """(read and write windows) of a geographic window on a raster, clipped to the raster."""
    rx, ry = ((x0 - west) / pixel + 0.001).cast("int"), ((north - y0) / pixel + 0.001).cast("int")
    rw = F.greatest(F.lit(1), ((x1 - x0) / pixel + 0.5).cast("int"))
    rh = F.greatest(F.lit(1), ((y0 - y1) / pixel + 0.5).cast("int"))

    def axis(start: Column, n: Column, limit: int) -> tuple[Column, Column, Column, Column]:
        before = F.greatest(F.lit(0), -start)
        write = F.when(start < 0, (size * (before.cast("double") / n)).cast("int")).otherwise(0)
        left = F.greatest(start, F.lit(0))
        span = n - before
        over = left + span > limit
        out = size - write
        return left, F.when(over, limit - left).otherwise(span), write, F.when(over, (out * ((limit - left).cast("double") / span)).cast("int")).otherwise(out)

    a, b = axis(rx, rw, width), axis(ry, rh, height)
    names = ("rx", "rw", "wx", "ww", "ry", "rh", "wy", "wh")
    return F.struct(*(c.cast("int").alias(k) for c, k in zip((*a, *b), names)))
