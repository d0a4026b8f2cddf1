"""Column expressions on coordinates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
EARTH_RADIUS_M = 6378137.0
MILES_PER_DEGREE = 69.0
EARTH_RADIUS_MILES = 3958.7613

MICRO = 1_000_000


def point(lat: Column, lon: Column) -> Column:
    """Geometry point, x = longitude and y = latitude."""
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def mercator_x(lon: Column) -> Column:
    """Spherical Web Mercator (EPSG:3857) easting in metres."""
    return F.lit(EARTH_RADIUS_M) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    """Spherical Web Mercator (EPSG:3857) northing in metres."""
    return F.lit(EARTH_RADIUS_M) * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2.0))


def planar_miles(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Distance in degrees times 69 miles, without shrinking longitudes by latitude."""
    dlat, dlon = lat - lat0, lon - lon0
    return F.sqrt(dlat * dlat + dlon * dlon) * F.lit(MILES_PER_DEGREE)


def haversine_miles(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Great-circle distance, the optional alternative to :func:`planar_miles`."""
    s1 = F.sin(F.radians(lat - lat0) / 2.0)
    s2 = F.sin(F.radians(lon - lon0) / 2.0)
    h = s1 * s1 + F.cos(F.radians(lat)) * F.cos(F.radians(lat0)) * s2 * s2
    return F.lit(2 * EARTH_RADIUS_MILES) * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def micro(degrees: Column) -> Column:
    """Degrees as whole micro-degrees (about 11 cm), so that sums and ties are exact."""
    return F.round(degrees * F.lit(float(MICRO))).try_cast("bigint")


def morton(x: Column, y: Column) -> Column:
    """Z-order code of two non-negative integers below 2^31: near codes are near places."""

    def spread(c: Column) -> Column:
        # The usual bit masks for spreading 32 bits over 64.
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF),
                            (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333),
                            (1, 0x5555555555555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))
