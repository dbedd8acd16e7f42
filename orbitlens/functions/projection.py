"""Map projections as column expressions: longitude and latitude to the metres of a UTM zone."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS 84 ellipsoid and the transverse Mercator series in its third flattening (Krueger, 1912; three terms hold a millimetre within a zone).
AXIS, FLATTENING, SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_TERMS = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_E = 2 * math.sqrt(_N) / (1 + _N)
#: EPSG codes: longitude and latitude themselves; UTM zones north and south of the equator.
GEOGRAPHIC, UTM_NORTH, UTM_SOUTH = 4326, 32600, 32700


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing (as if north of the equator) of a point in a zone, 1 to 60."""
    phi, away = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - _E * F.atanh(_E * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_TERMS, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EAST + SCALE * _RADIUS * east, SCALE * _RADIUS * north


def project(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """x and y of a point in the reference system of that code: 4326, or a UTM zone (326zz, 327zz); null in others."""
    south = epsg.between(UTM_SOUTH + 1, UTM_SOUTH + 60)
    zoned = south | epsg.between(UTM_NORTH + 1, UTM_NORTH + 60)
    east, north = utm(lon, lat, epsg % 100)
    x = F.when(epsg == GEOGRAPHIC, lon).when(zoned, east)
    y = F.when(epsg == GEOGRAPHIC, lat).when(south, north + FALSE_NORTH).when(zoned, north)
    return x, y
