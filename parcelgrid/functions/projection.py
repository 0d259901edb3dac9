"""Closed-form map projections as SQL text: (lon, lat) expressions in, (x, y) expressions out.

* ``mercator`` / ``mercator_inverse``: spherical Web Mercator, metres (EPSG:3857).
* ``state_plane`` / ``state_plane_inverse``: Lambert conformal conic with two standard
  parallels, California zone 6 in US survey feet (EPSG:2230); NAD83 is taken as WGS84.
* ``authalic``: ellipsoidal equal-area cylinder; with the longitude in radians, plane area
  equals area on the ellipsoid.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from .units import US_FT_PER_M

# WGS84 / GRS80 ellipsoids and the Web Mercator sphere.
EARTH_RADIUS = 6378137.0
WGS84_INVERSE_FLATTENING = 298.257223563
GRS80_INVERSE_FLATTENING = 298.257222101

# EPSG:2230 (degrees, metres).
ZONE6_PARALLELS = (32 + 47 / 60, 33 + 53 / 60)
ZONE6_ORIGIN = (32 + 10 / 60, -(116 + 15 / 60))
ZONE6_FALSE = (2_000_000.0, 500_000.0)

_DEG = math.pi / 180.0


def _eccentricity(inverse_flattening: float) -> float:
    f = 1.0 / inverse_flattening
    return math.sqrt(2 * f - f * f)


def _d(value: float) -> str:
    """A double literal."""
    return f"{float(value)!r}D"


def mercator(lon: str, lat: str) -> tuple[str, str]:
    return (
        f"(({lon}) * {_d(EARTH_RADIUS * _DEG)})",
        f"(ln(tan(({lat}) * {_d(_DEG / 2)} + {_d(math.pi / 4)})) * {_d(EARTH_RADIUS)})",
    )


def mercator_inverse(x: str, y: str) -> tuple[str, str]:
    return (
        f"(({x}) / {_d(EARTH_RADIUS * _DEG)})",
        f"((atan(exp(({y}) / {_d(EARTH_RADIUS)})) * 2 - {_d(math.pi / 2)}) / {_d(_DEG)})",
    )


@dataclass(frozen=True)
class _Cone:
    e: float
    n: float
    scale: float
    rho0: float
    lon0: float

    @staticmethod
    def zone6() -> "_Cone":
        e = _eccentricity(GRS80_INVERSE_FLATTENING)

        def m(phi: float) -> float:
            return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)

        def t(phi: float) -> float:
            s = e * math.sin(phi)
            return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (e / 2)

        p1, p2 = (p * _DEG for p in ZONE6_PARALLELS)
        p0, lon0 = (v * _DEG for v in ZONE6_ORIGIN)
        n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
        scale = EARTH_RADIUS * m(p1) / (n * t(p1) ** n)
        return _Cone(e, n, scale, scale * t(p0) ** n, lon0)


_ZONE6 = _Cone.zone6()


def state_plane(lon: str, lat: str) -> tuple[str, str]:
    """Longitude/latitude in degrees to zone 6 easting/northing in US survey feet."""
    c = _ZONE6
    s = f"sin(({lat}) * {_d(_DEG)}) * {_d(c.e)}"
    t = f"tan({_d(math.pi / 4)} - ({lat}) * {_d(_DEG / 2)}) / pow((1 - {s}) / (1 + {s}), {_d(c.e / 2)})"
    rho = f"pow({t}, {_d(c.n)}) * {_d(c.scale)}"
    theta = f"((({lon}) * {_d(_DEG)} - {_d(c.lon0)}) * {_d(c.n)})"
    return (
        f"(({rho} * sin({theta}) + {_d(ZONE6_FALSE[0])}) * {_d(US_FT_PER_M)})",
        f"(({_d(c.rho0)} - {rho} * cos({theta}) + {_d(ZONE6_FALSE[1])}) * {_d(US_FT_PER_M)})",
    )


def state_plane_inverse(x: str, y: str) -> tuple[str, str]:
    """Zone 6 feet to degrees; the latitude series is good to about 1e-10 degrees."""
    c = _ZONE6
    e2 = c.e * c.e
    dx = f"(({x}) / {_d(US_FT_PER_M)} - {_d(ZONE6_FALSE[0])})"
    dy = f"({_d(c.rho0 + ZONE6_FALSE[1])} - ({y}) / {_d(US_FT_PER_M)})"
    t = f"pow(sqrt({dx} * {dx} + {dy} * {dy}) / {_d(c.scale)}, {_d(1 / c.n)})"
    chi = f"({_d(math.pi / 2)} - atan({t}) * 2)"
    series = (
        (2, e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360),
        (4, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520),
        (6, 7 * e2**3 / 120 + 81 * e2**4 / 1120),
        (8, 4279 * e2**4 / 161280),
    )
    terms = " + ".join(f"sin(h * {k}) * {_d(v)}" for k, v in series)
    lat = f"transform(array({chi}), h -> (h + {terms}) / {_d(_DEG)})[0]"
    return f"((atan2({dx}, {dy}) / {_d(c.n)} + {_d(c.lon0)}) / {_d(_DEG)})", lat


def authalic_y(lat: str) -> str:
    """Equal-area northing in m^2 per radian of longitude."""
    e = _eccentricity(WGS84_INVERSE_FLATTENING)
    q = (
        f"(s / (1 - s * s * {_d(e * e)}) - ln((1 - s * {_d(e)}) / (1 + s * {_d(e)})) / {_d(2 * e)})"
        f" * {_d((1 - e * e) * EARTH_RADIUS**2 / 2)}"
    )
    return f"transform(array(sin(({lat}) * {_d(_DEG)})), s -> {q})[0]"


def authalic(lon: str, lat: str) -> tuple[str, str]:
    return f"(({lon}) * {_d(_DEG)})", authalic_y(lat)
