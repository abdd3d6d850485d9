"""Places on the WGS 84 ellipsoid as Column expressions: geodetic, earth-centred, and east-north-up from an origin.

All angles are degrees and lengths metres; a null gives nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoid's long half-axis and flattening.
AXIS = 6378137.0
FLATTENING = 1.0 / 298.257223563
SQUARE = 1.0 - (1.0 - FLATTENING) ** 2  # of the eccentricity

Point = tuple[Column, Column, Column]


def _across(sine: Column) -> Column:
    """The radius of curvature across the meridian, by the sine of the latitude."""
    return AXIS / F.sqrt(1.0 - SQUARE * sine * sine)


def to_ecef(lat: Column, lon: Column, alt: Column) -> Point:
    la, lo = F.radians(lat), F.radians(lon)
    n = _across(F.sin(la))
    return (n + alt) * F.cos(la) * F.cos(lo), (n + alt) * F.cos(la) * F.sin(lo), (n * (1.0 - SQUARE) + alt) * F.sin(la)


def _axes(lat: Column, lon: Column) -> tuple[Point, Point, Point]:
    """East, north and up at a place, in earth-centred coordinates."""
    la, lo = F.radians(lat), F.radians(lon)
    east = (-F.sin(lo), F.cos(lo), F.lit(0.0))
    north = (-F.sin(la) * F.cos(lo), -F.sin(la) * F.sin(lo), F.cos(la))
    return east, north, (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))


def to_enu(point: Point, lat: Column, lon: Column, alt: Column) -> Point:
    """An earth-centred point from an origin."""
    away = [p - o for p, o in zip(point, to_ecef(lat, lon, alt), strict=True)]
    return tuple(a[0] * away[0] + a[1] * away[1] + a[2] * away[2] for a in _axes(lat, lon))


def from_enu(point: Point, lat: Column, lon: Column, alt: Column, rounds: int = 5) -> tuple[Column, Column]:
    """Latitude and longitude of a point given from an origin; the latitude is refined ``rounds`` times."""
    axes = _axes(lat, lon)
    x, y, z = (o + sum((point[k] * axes[k][i] for k in (1, 2)), point[0] * axes[0][i]) for i, o in enumerate(to_ecef(lat, lon, alt)))
    out = F.hypot(x, y)
    state = F.struct(F.atan2(z, out * (1.0 - SQUARE)).alias("la"), out.alias("out"), z.alias("z"))

    def closer(s: Column, _: Column) -> Column:
        n = _across(F.sin(s["la"]))
        up = s["out"] / F.cos(s["la"]) - n
        return F.struct(F.atan2(s["z"], s["out"] * (1.0 - SQUARE * n / (n + up))).alias("la"), s["out"].alias("out"), s["z"].alias("z"))

    refined = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, closer)
    return F.degrees(refined["la"]), F.degrees(F.atan2(y, x))
