"""Geometry on a sphere as Column expressions, so that all of it stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.00877141506
#: Degrees and radians below which two points are the same.
SAME = 1e-9
#: km of a degree in the flat projection.
FLAT_KM = math.pi * 6371.0 / 180.0


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def square(x: Column) -> Column:
    return x * x


def km_of_degree(depth: Column | float = 0.0) -> Column:
    return (F.lit(EARTH_KM) - col(depth)) * F.lit(math.pi / 180.0)


def deg2km(deg: Column, depth: Column | float = 0.0) -> Column:
    return deg * km_of_degree(depth)


def km2deg(km: Column, depth: Column | float = 0.0) -> Column:
    return km / km_of_degree(depth)


def rad2km(rad: Column, depth: Column | float = 0.0) -> Column:
    return rad * (F.lit(EARTH_KM) - col(depth))


def km2rad(km: Column, depth: Column | float = 0.0) -> Column:
    return km / (F.lit(EARTH_KM) - col(depth))


def normalize_lon(deg: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(deg + 180.0, F.lit(360.0)) - 180.0


def normalize_azimuth(deg: Column) -> Column:
    """To [0, 360)."""
    return F.pmod(deg, F.lit(360.0))


def _same(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return (F.abs(lat1 - lat2) < SAME) & (F.abs(F.radians(lon2 - lon1)) < SAME)


def azimuth(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Radians clockwise from north of point 2 as seen from point 1; 0 if they are the same."""
    dlon, f1, f2 = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    y = F.sin(dlon) * F.cos(f2)
    x = F.cos(f1) * F.sin(f2) - F.sin(f1) * F.cos(f2) * F.cos(dlon)
    return F.when(_same(lat1, lon1, lat2, lon2), F.lit(0.0)).otherwise(F.atan2(y, x))


def angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Radians between two points, by haversines."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = square(F.sin(dlat / 2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * square(F.sin(dlon / 2))
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))
    return F.when(_same(lat1, lon1, lat2, lon2), F.lit(0.0)).otherwise(2.0 * F.asin(F.sqrt(a)))


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, depth: Column | float = 0.0) -> Column:
    """km between two points at one depth."""
    return rad2km(angle(lat1, lon1, lat2, lon2), depth)


def distance3d(lat1: Column, lon1: Column, depth1: Column, lat2: Column, lon2: Column, depth2: Column) -> Column:
    """km between two points: along the surface at their mean depth, and across."""
    along = distance(lat1, lon1, lat2, lon2, (depth1 + depth2) / 2)
    return F.sqrt(F.pow(along, F.lit(2.0)) + square(depth1 - depth2))  # along stands here once, as expressions are inlined


def station_depth(elevation: Column) -> Column:
    return -(elevation / 1000.0)


def move(lat: Column, lon: Column, km: Column, az: Column, depth: Column | float = 0.0) -> tuple[Column, Column]:
    """Latitude and longitude of the point some km away in a direction (radians)."""
    d, f, l0 = km2rad(km, depth), F.radians(lat), F.radians(lon)
    s = F.asin(F.sin(f) * F.cos(d) + F.cos(f) * F.sin(d) * F.cos(az))
    to = l0 + F.atan2(F.sin(az) * F.sin(d) * F.cos(f), F.cos(d) - F.sin(f) * F.sin(s))
    still = km == 0.0
    return F.when(still, lat).otherwise(F.degrees(s)), F.when(still, lon).otherwise(normalize_lon(F.degrees(to)))


def bilinear(x: Column, y: Column, v00: Column, v01: Column, v10: Column, v11: Column) -> Column:
    """Value at fractions x, y of a square; v01 is the corner x = 0, y = 1."""
    low = v00 * (1.0 - y) + v01 * y
    high = v10 * (1.0 - y) + v11 * y
    return low * (1.0 - x) + high * x


def trilinear(x: Column, y: Column, z: Column, v: list[Column]) -> Column:
    """Value at fractions of a cube; v[4 * i + 2 * j + k] is the corner x = i, y = j, z = k."""
    on_z = [v[2 * m] * (1.0 - z) + v[2 * m + 1] * z for m in range(4)]
    return bilinear(x, y, *on_z)


def bilinear_angle(x: Column, y: Column, *degrees: Column) -> Column:
    """Angles of a square, by their cosines and sines; in [0, 360)."""
    r = [F.radians(d) for d in degrees]
    return normalize_azimuth(F.degrees(F.atan2(bilinear(x, y, *map(F.sin, r)), bilinear(x, y, *map(F.cos, r)))))


def trilinear_angle(x: Column, y: Column, z: Column, degrees: list[Column]) -> Column:
    r = [F.radians(d) for d in degrees]
    return normalize_azimuth(F.degrees(F.atan2(trilinear(x, y, z, list(map(F.sin, r))), trilinear(x, y, z, list(map(F.cos, r))))))


def in_rectangle(lat: Column, lon: Column, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> Column:
    """Inside a box that may cross the date line."""
    width = lon_max - lon_min
    width = width + 360.0 if width < 0 else width
    step = lon - lon_min
    return lat.between(lat_min, lat_max) & (F.when(step < 0, step + 360.0).otherwise(step) <= width)


def in_circle(lat: Column, lon: Column, lat0: float, lon0: float, km: float) -> Column:
    return distance(lat, lon, F.lit(lat0), F.lit(lon0)) <= km


def in_ellipsoid(lat: Column, lon: Column, depth: Column, lat0: Column, lon0: Column, depth0: Column, across: float, along: float) -> Column:
    """Inside an upright ellipsoid with horizontal half axes of ``along`` km and a vertical one of ``across`` km.

    Horizontal distances are taken at the centre's depth; half axes of 0 admit the centre alone."""
    d = distance(lat, lon, lat0, lon0, depth0)
    h = d == 0.0 if along == 0 else None
    dz = depth - depth0
    if along == 0 or across == 0:
        return (d == 0.0 if h is not None else d <= along) & ((dz == 0.0) if across == 0 else (F.abs(dz) <= across))
    return square(d / along) + square(dz / across) <= 1.0


def octants(lat: Column, lon: Column, depth: Column, lat0: Column, lon0: Column, depth0: Column) -> Column:
    """Numbers 1 to 8 of the octants around a centre that hold a point: 1 to 4 at its depth or deeper, 5 to 8 at its depth or
    above, by quadrant; points on a plane are in the octants on both its sides."""
    north, south, east, west = lat >= lat0, lat <= lat0, normalize_lon(lon - lon0) >= 0, normalize_lon(lon - lon0) <= 0
    sides = [(north, east), (south, east), (south, west), (north, west)]
    found = [F.when(a & b & d, k) for n, d in ((0, depth >= depth0), (4, depth <= depth0)) for k, (a, b) in enumerate(sides, n + 1)]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def to_flat(lat: Column, lon: Column, lat0: Column | float, lon0: Column | float, rotation: Column | float = 0.0) -> tuple[Column, Column]:
    """x and y in km of the flat projection around an origin; directions are ``rotation`` degrees more in it than on the earth."""
    x = normalize_lon(lon - col(lon0)) * FLAT_KM * F.cos(F.radians(lat))
    return turned(x, (lat - col(lat0)) * FLAT_KM, col(rotation))


def turned(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    """A place after its direction has grown by some degrees, clockwise."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return x * c + y * s, y * c - x * s


def from_flat(x: Column, y: Column, lat0: Column | float, lon0: Column | float, rotation: Column | float = 0.0) -> tuple[Column, Column]:
    x, y = turned(x, y, -col(rotation))
    lat = col(lat0) + y / FLAT_KM
    return lat, normalize_lon(col(lon0) + x / (FLAT_KM * F.cos(F.radians(lat))))


def to_map_angle(degrees: Column, rotation: Column | float) -> Column:
    return normalize_azimuth(degrees + col(rotation))


def from_map_angle(degrees: Column, rotation: Column | float) -> Column:
    return normalize_azimuth(degrees - col(rotation))


#: Equatorial radius in m and flattening of the ellipsoids that map headers name.
ELLIPSOIDS = {
    "WGS-84": (6378137.0, 1 / 298.254),
    "GRS-80": (6378137.0, 1 / 298.257),
    "WGS-72": (6378135.0, 1 / 298.26),
    "Australian": (6378160.0, 1 / 298.25),
    "Krasovsky": (6378245.0, 1 / 298.3),
    "International": (6378388.0, 1 / 297.0),
    "Hayford-1909": (6378388.0, 1 / 297.0),
    "Clarke-1880": (6378249.1, 1 / 293.46),
    "Clarke-1866": (6378206.4, 1 / 294.98),
    "Airy": (6377563.4, 1 / 299.32),
    "Bessel": (6377397.2, 1 / 299.15),
    "Hayford-1830": (6377276.3, 1 / 300.80),
    "Sphere": (6371008.7714, 0.0),
    "NAD-27": (6378206.4, 1 / 294.98),
    "NAD-83": (6378137.4, 1 / 294.26),
}
#: Fixed values of the short-distance projection: equatorial radius in km, flattening, and ratio of geocentric to geographic tangents.
SHORT_KM, SHORT_FLATTENING, SHORT_RATIO = 6378.135, 1 / 298.26, 0.99330647


def _arc(phi: Column, e2: float) -> Column:
    """Length of the meridian from the equator, in half axes."""
    e4, e6 = e2 * e2, e2**3
    return (
        (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
        - (3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
        + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi)
        - (35 * e6 / 3072) * F.sin(6 * phi)
    )


def transverse_mercator(lat: Column, lon: Column, lat0: float, lon0: float, ellipsoid: str = "WGS-84") -> tuple[Column, Column]:
    """x and y in km of the transverse Mercator projection, by the usual series."""
    a, f = ELLIPSOIDS[ellipsoid]
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi = F.radians(lat)
    n = F.lit(a) / F.sqrt(1 - e2 * square(F.sin(phi)))
    t, c = square(F.tan(phi)), ep2 * square(F.cos(phi))
    k = F.radians(normalize_lon(lon - lon0)) * F.cos(phi)
    k2 = square(k)
    m, m0 = F.lit(a) * _arc(phi, e2), F.lit(a) * _arc(F.radians(F.lit(lat0)), e2)
    x = n * (k + (1 - t + c) * k * k2 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * k * k2 * k2 / 120)
    y = m - m0 + n * F.tan(phi) * (k2 / 2 + (5 - t + 9 * c + 4 * c * c) * k2 * k2 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * k2 * k2 * k2 / 720)
    return x / 1000.0, y / 1000.0


def _cone(lat0: float, lat1: float, lat2: float, ellipsoid: str) -> tuple[float, float, float, float, float]:
    """Radius in m, eccentricity, and of the cone its constant, scale and the radius of the origin's parallel in m."""
    a, f = ELLIPSOIDS[ellipsoid]
    e = math.sqrt(f * (2 - f))

    def m(p: float) -> float:
        return math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)

    def t(p: float) -> float:
        return math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)

    p0, p1, p2 = (math.radians(x) for x in (lat0, lat1, lat2))
    n = math.sin(p1) if lat1 == lat2 else (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    big = m(p1) / (n * t(p1) ** n)
    return a, e, n, big, a * big * t(p0) ** n


def lambert(lat: Column, lon: Column, lat0: float, lon0: float, lat1: float, lat2: float, ellipsoid: str = "WGS-84") -> tuple[Column, Column]:
    """x and y in km of the conformal conic projection with two standard parallels."""
    a, e, n, big, rho0 = _cone(lat0, lat1, lat2, ellipsoid)
    phi = F.radians(lat)
    s = F.sin(phi)
    tt = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2))
    rho = a * big * F.pow(tt, F.lit(n))
    theta = n * F.radians(normalize_lon(lon - lon0))
    return rho * F.sin(theta) / 1000.0, (rho0 - rho * F.cos(theta)) / 1000.0


def azimuthal_equidistant(lat: Column, lon: Column, lat0: float, lon0: float, radius_km: float = EARTH_KM) -> tuple[Column, Column]:
    """x and y in km: distance and direction from the origin stay true (on the sphere)."""
    d = angle(F.lit(lat0), F.lit(lon0), lat, lon) * radius_km
    az = azimuth(F.lit(lat0), F.lit(lon0), lat, lon)
    return d * F.sin(az), d * F.cos(az)


def _short_scales(lat0: float) -> tuple[float, float]:
    """km of a degree of latitude, and of longitude at the equator, around an origin."""
    near, far = (math.atan(SHORT_RATIO * math.tan(math.radians(p))) for p in (lat0, lat0 + 1.0))
    r = SHORT_KM * (1.0 - math.sin(near) ** 2 * SHORT_FLATTENING)
    return r * (far - near), r * math.acos(1.0 - (1.0 - math.cos(math.radians(1.0))) * math.cos(near) ** 2) / math.cos(near)


def _short_cosine(lat: Column, lat0: float) -> Column:
    return F.cos(F.atan(SHORT_RATIO * F.tan(F.radians((lat + lat0) / 2.0))))


def short_distance(lat: Column, lon: Column, lat0: float, lon0: float, rotation: float = 0.0) -> tuple[Column, Column]:
    """x and y in km of the short-distance conversion on geocentric latitudes."""
    per_lat, per_lon = _short_scales(lat0)
    return turned(normalize_lon(lon - lon0) * per_lon * _short_cosine(lat, lat0), (lat - lat0) * per_lat, F.lit(rotation))


def from_short_distance(x: Column, y: Column, lat0: float, lon0: float, rotation: float = 0.0) -> tuple[Column, Column]:
    per_lat, per_lon = _short_scales(lat0)
    x, y = turned(x, y, F.lit(-rotation))
    lat = F.lit(lat0) + y / per_lat
    return lat, normalize_lon(F.lit(lon0) + x / (per_lon * _short_cosine(lat, lat0)))


def _steps(start: Column, step, n: int = 10) -> Column:
    """A fixed point, by n steps of one expression."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda at, _: step(at))


def from_transverse_mercator(x: Column, y: Column, lat0: float, lon0: float, ellipsoid: str = "WGS-84") -> tuple[Column, Column]:
    """Degrees of a place on the transverse Mercator map: latitude and longitude are mended by what the projection of the last guess is off, in km
    of a degree there; the error shrinks by the map's distortion each time."""
    a, f = ELLIPSOIDS[ellipsoid]
    e2 = f * (2 - f)

    def step(at: Column) -> Column:
        px, py = transverse_mercator(at["lat"], at["lon"], lat0, lon0, ellipsoid)
        phi = F.radians(at["lat"])
        w = 1 - e2 * square(F.sin(phi))
        # grid north isn't true north away from the middle meridian: turn by the convergence
        turn = F.atan(F.tan(F.radians(normalize_lon(at["lon"] - lon0))) * F.sin(phi))
        dx, dy = x - px, y - py
        east, north = dx * F.cos(turn) + dy * F.sin(turn), dy * F.cos(turn) - dx * F.sin(turn)
        lat = at["lat"] + F.degrees(north * 1000.0 / (a * (1 - e2)) * w * F.sqrt(w))
        lon = at["lon"] + F.degrees(east * 1000.0 / a * F.sqrt(w) / F.cos(phi))
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    first = F.struct((F.lit(lat0) + y / FLAT_KM).alias("lat"), (F.lit(lon0) + x / (FLAT_KM * F.cos(F.radians(F.lit(lat0) + y / FLAT_KM)))).alias("lon"))
    found = _steps(first, step)
    return found["lat"], normalize_lon(found["lon"])


def from_lambert(x: Column, y: Column, lat0: float, lon0: float, lat1: float, lat2: float, ellipsoid: str = "WGS-84") -> tuple[Column, Column]:
    """Degrees of a place on the conformal conic map; the latitude by the fixed point of its isometric form."""
    a, e, n, big, rho0 = _cone(lat0, lat1, lat2, ellipsoid)
    east, north = x * 1000.0, rho0 - y * 1000.0
    sign = 1.0 if n > 0 else -1.0
    rho, theta = sign * F.hypot(east, north), F.atan2(sign * east, sign * north)
    t = F.pow(rho / (a * big), F.lit(1 / n))
    phi = _steps(F.lit(math.pi / 2) - 2 * F.atan(t), lambda p: F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2))))
    return F.degrees(phi), normalize_lon(F.degrees(theta / n) + lon0)


def from_azimuthal_equidistant(x: Column, y: Column, lat0: float, lon0: float, radius_km: float = EARTH_KM) -> tuple[Column, Column]:
    return move(F.lit(lat0), F.lit(lon0), F.hypot(x, y) * (EARTH_KM / radius_km), F.atan2(x, y))
