"""Longitude and latitude to local east-north metres, and from there to Earth-centred coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..model import GeoReference

#: Metres of a degree of latitude, and the WGS84 ellipsoid.
METRES_PER_DEGREE = 111_320.0
SEMI_MAJOR_AXIS, FLATTENING = 6_378_137.0, 1 / 298.257223563
ECCENTRICITY_2 = FLATTENING * (2 - FLATTENING)


def east_north(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """An equirectangular projection around (lon0, lat0), for survey-sized areas."""
    return (lon - lon0) * METRES_PER_DEGREE * F.cos(F.radians(lat0)), (lat - lat0) * METRES_PER_DEGREE


def ecef_matrix(lat: Column, lon: Column, height: Column) -> Column:
    """Local to Earth-centred, sixteen numbers by columns: east, north, up, origin."""
    one, zero = F.lit(1.0), F.lit(0.0)
    phi, lam = F.radians(lat), F.radians(lon)
    sp, cp, sl, cl = F.sin(phi), F.cos(phi), F.sin(lam), F.cos(lam)
    n = F.lit(SEMI_MAJOR_AXIS) / F.sqrt(one - F.lit(ECCENTRICITY_2) * sp * sp)
    east = (-sl, cl, zero, zero)
    north = (-sp * cl, -sp * sl, cp, zero)
    up = (cp * cl, cp * sl, sp, zero)
    origin = ((n + height) * cp * cl, (n + height) * cp * sl, (n * (1 - ECCENTRICITY_2) + height) * sp, one)
    return F.array(*east, *north, *up, *origin)


def reference_matrix(reference: GeoReference) -> list[float]:
    """The same for one reference, on the driver."""
    phi, lam = math.radians(reference.latitude), math.radians(reference.longitude)
    up = (math.cos(phi) * math.cos(lam), math.cos(phi) * math.sin(lam), math.sin(phi))
    n = SEMI_MAJOR_AXIS / math.sqrt(1 - ECCENTRICITY_2 * up[2] ** 2)
    scale = (n + reference.height, n + reference.height, n * (1 - ECCENTRICITY_2) + reference.height)
    east = (-math.sin(lam), math.cos(lam), 0.0)
    north = (-up[2] * math.cos(lam), -up[2] * math.sin(lam), math.cos(phi))
    return [*east, 0.0, *north, 0.0, *up, 0.0, *(s * u for s, u in zip(scale, up)), 1.0]


def to_ecef(matrix: Column) -> dict[str, Column]:
    """The point x y z, moved by a matrix column."""
    at = lambda row: sum((matrix[4 * k + row] * F.col(a) for k, a in enumerate(("x", "y", "z"))), matrix[12 + row])
    return {"ecef_x": at(0), "ecef_y": at(1), "ecef_z": at(2)}
