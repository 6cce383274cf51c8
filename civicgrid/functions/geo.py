"""Geographic column functions: degrees in, kilometres or metres out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS, EARTH_KM, Settings
from .rounding import portable_round

METRES_PER_DEGREE = 111139.0
OFFSET_METRES_PER_DEGREE = 111000.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def box_distance_km(lat: Column, lon: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """0 inside the box, else the distance to its nearest edge point."""
    return haversine_km(
        lat, lon, F.least(F.greatest(lat, ymin), ymax), F.least(F.greatest(lon, xmin), xmax)
    )


def polyline_distance_m(lat: Column, lon: Column, points: Column) -> Column:
    """Distance to the nearest piece of a polyline ``array<struct<lat,lon>>`` on a local flat projection."""
    east = F.lit(METRES_PER_DEGREE) * F.greatest(F.lit(0.1), F.cos(F.radians(lat)))

    def piece(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        x1, y1 = (a["lon"] - lon) * east, (a["lat"] - lat) * METRES_PER_DEGREE
        dx, dy = (b["lon"] - a["lon"]) * east, (b["lat"] - a["lat"]) * METRES_PER_DEGREE
        length2 = dx * dx + dy * dy
        t = F.coalesce(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x1 * dx + y1 * dy) / F.nullif(length2, F.lit(0.0)))),
            F.lit(0.0),
        )
        return F.sqrt(F.pow(x1 + t * dx, F.lit(2.0)) + F.pow(y1 + t * dy, F.lit(2.0)))

    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))),
        lambda i: F.struct(F.try_element_at(points, i).alias("a"), F.try_element_at(points, i + 1).alias("b")),
    )
    only = F.try_element_at(points, F.lit(1))
    return (
        F.when(F.size(points) > 1, F.array_min(F.transform(pairs, piece)))
        .when(F.size(points) == 1, haversine_km(lat, lon, only["lat"], only["lon"]) * 1000.0)
    )


def near_box(lat: Column, lon: Column, ymin: Column, ymax: Column, xmin: Column, xmax: Column,
             radius_km: float) -> Column:
    """Cheap superset test: the box widened by 1.5 times the radius."""
    up = radius_km / 111.0 * 1.5
    side = F.lit(radius_km) / (F.lit(111.0) * F.greatest(F.lit(0.1), F.cos(F.radians(lat)))) * 1.5
    return lat.between(ymin - up, ymax + up) & lon.between(xmin - side, xmax + side)


def offset_point(lat: Column, lon: Column, metres: Column, bearing: Column) -> tuple[Column, Column]:
    up = metres * F.cos(bearing) / OFFSET_METRES_PER_DEGREE
    east = metres * F.sin(bearing) / (F.lit(OFFSET_METRES_PER_DEGREE) * F.cos(F.radians(lat)))
    return portable_round(lat + up, 7), portable_round(lon + east, 7)


def public_coordinate(value: Column, basis: Column, cfg: Settings = DEFAULTS) -> Column:
    """Register coordinates are public; a citizen's pin leaves only coarsened."""
    return F.when(basis == "register_coordinates", value).otherwise(
        portable_round(value, cfg.public_decimals))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    south, north, west, east = box
    return lat.between(south, north) & lon.between(west, east)


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return F.coalesce(in_box(lat, lon, (-90.0, 90.0, -180.0, 180.0)), F.lit(False))


def effective_point(plat: Column, plon: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """The citizen's pin when both halves are there, else the village centroid."""
    pinned = plat.isNotNull() & plon.isNotNull()
    return F.when(pinned, plat).otherwise(lat), F.when(pinned, plon).otherwise(lon)


def accepted_pin(lat_text: Column, lon_text: Column, village_lat: Column, village_lon: Column,
                 cfg: Settings = DEFAULTS) -> tuple[Column, Column]:
    lat, lon = F.trim(lat_text).try_cast("double"), F.trim(lon_text).try_cast("double")
    finite = valid_coordinates(lat, lon) & ~F.isnan(lat) & ~F.isnan(lon)
    ok = finite & (haversine_km(lat, lon, village_lat, village_lon) <= cfg.pin_max_km)
    return F.when(ok, lat), F.when(ok, lon)
