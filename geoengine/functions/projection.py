"""Longitude and latitude to and from a transverse Mercator zone, as Column expressions.

Krueger's series in the third flattening on the GRS80 ellipsoid, to the fourth
order (below a millimetre inside a zone). Zone 33 is central meridian 15 east.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoengine.functions.geometry import vertex

SEMI_MAJOR, FLATTENING, SCALE, EAST = 6378137.0, 1 / 298.257222101, 0.9996, 500_000.0
N = FLATTENING / (2 - FLATTENING)
RADIUS = SEMI_MAJOR / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)


def meridian(crs: int) -> float:
    """Central meridian in degrees of EPSG 258zz and 326zz, zone zz."""
    if crs // 100 not in (258, 326) or not 1 <= crs % 100 <= 60:
        raise ValueError(f"no transverse Mercator zone is known for EPSG:{crs}")
    return (crs % 100) * 6 - 183


def from_4326(lon: Column, lat: Column, crs: int = 25833) -> Column:
    """struct<x, y>: projected metres of a longitude and latitude in degrees."""
    phi, lam = F.radians(lat), F.radians(lon - meridian(crs))
    e = 2 * math.sqrt(N) / (1 + N)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return vertex(EAST + SCALE * RADIUS * x, SCALE * RADIUS * y)


def to_4326(x: Column, y: Column, crs: int = 25833) -> Column:
    """struct<x, y>: longitude and latitude in degrees of projected metres."""
    xi, eta = y / (SCALE * RADIUS), (x - EAST) / (SCALE * RADIUS)
    a, b = xi, eta
    for j, c in enumerate(BETA, 1):
        a = a - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return vertex(F.degrees(F.atan2(F.sinh(b), F.cos(a))) + meridian(crs), F.degrees(phi))


def crs_to_string(crs: int | str | None) -> str | None:
    """A reference system's name: a number is an EPSG code; names of authorities are upper case."""
    if crs is None or crs == "":
        return None
    text = str(crs).strip()
    return f"EPSG:{text}" if text.isdigit() else text.upper()


def get_common_crs(systems: Iterable[int | str | None], strict: bool = False) -> str | None:
    """The one reference system that all name; several are an error. Those without one are passed over, or, if ``strict``, an error beside others."""
    named = {crs_to_string(x) for x in systems}
    if strict and None in named and len(named) > 1:
        raise ValueError("some have a reference system, some have none")
    named.discard(None)
    if len(named) > 1:
        raise ValueError(f"several reference systems: {', '.join(sorted(named))}")
    return next(iter(named), None)
