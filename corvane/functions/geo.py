"""Geometry on the sphere as column expressions; longitudes before latitudes, in degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Kilometres of a degree of latitude at least, anywhere.
KM_PER_DEGREE = 110.5


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half = lambda a, b: F.sin((F.radians(b) - F.radians(a)) / 2)
    h = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial course in degrees from north, 0 <= b < 360."""
    d = F.radians(lon2) - F.radians(lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def turn(before: Column, after: Column) -> Column:
    """Change of course, 0 to 180 degrees."""
    return F.abs(F.pmod(after - before + 180, F.lit(360.0)) - 180)


def in_box(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def is_lonlat(lon: Column, lat: Column) -> Column:
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))


def grid_cell(x: Column, size: float) -> Column:
    """The cell of a coordinate, cut toward zero."""
    return (x / size).cast("long")


def bounds_of(points: DataFrame) -> DataFrame:
    """west, south, east, north of points (lon, lat); zeros if there are none."""
    edge = lambda f, c: F.coalesce(f(c), F.lit(0.0))
    return points.agg(edge(F.min, "lon").alias("west"), edge(F.min, "lat").alias("south"), edge(F.max, "lon").alias("east"), edge(F.max, "lat").alias("north"))


def along(a: Column, b: Column, share: Column) -> Column:
    """The point a share of the straight way from ``a`` to ``b`` (structs of lon and lat)."""
    at = lambda c: (a[c] + (b[c] - a[c]) * share).alias(c)
    return F.struct(at("lon"), at("lat"))


def densified(a: Column, b: Column, step: float) -> Column:
    """Points from ``a`` to ``b``, both included, about ``step`` degrees apart, none closer."""
    far = F.sqrt((b["lon"] - a["lon"]) * (b["lon"] - a["lon"]) + (b["lat"] - a["lat"]) * (b["lat"] - a["lat"]))
    n = F.greatest(F.lit(1), F.floor(far / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), n), lambda k: along(a, b, k / n))


def arc(a: Column, b: Column, n: int) -> Column:
    """``n`` (2 or more) points on the great circle from ``a`` to ``b``, both included; n times ``a`` where the two are one."""
    lon1, lat1, lon2, lat2 = (F.radians(p[c]) for p in (a, b) for c in ("lon", "lat"))
    omega = haversine_km(a["lon"], a["lat"], b["lon"], b["lat"]) / EARTH_KM

    def point(k: Column) -> Column:
        share = k / (n - 1)
        u, v = F.sin((1 - share) * omega) / F.sin(omega), F.sin(share * omega) / F.sin(omega)
        x, y = u * F.cos(lat1) * F.cos(lon1) + v * F.cos(lat2) * F.cos(lon2), u * F.cos(lat1) * F.sin(lon1) + v * F.cos(lat2) * F.sin(lon2)
        z = u * F.sin(lat1) + v * F.sin(lat2)
        return F.struct(F.degrees(F.atan2(y, x)).alias("lon"), F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"))

    ends = F.struct(a["lon"].cast("double").alias("lon"), a["lat"].cast("double").alias("lat"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(omega < 1e-9, ends).otherwise(point(k)))


def sliced(shape: Column, u: Column, v: Column) -> Column:
    """The part of a shape (array of structs of lon and lat) between its points nearest to ``u`` and ``v``, in that direction."""
    gap = lambda p, q: (p["lon"] - q["lon"]) * (p["lon"] - q["lon"]) + (p["lat"] - q["lat"]) * (p["lat"] - q["lat"])

    def nearest(q: Column) -> Column:
        gaps = F.transform(shape, lambda p: gap(p, q))
        return F.array_position(gaps, F.array_min(gaps)).cast("int")

    i, j = nearest(u), nearest(v)
    return F.when(i <= j, F.slice(shape, i, j - i + 1)).otherwise(F.reverse(F.slice(shape, j, i - j + 1)))
