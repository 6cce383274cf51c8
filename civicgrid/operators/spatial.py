"""Distance joins written as equi-joins on grid cells, so Spark shuffles by place and no cross product is planned.

``radius_join`` puts the left row in one cell and the right row in every cell its bounding box touches. Rows of cells
have a fixed height in latitude; the width of a cell follows the latitude of its row, so cells stay about square
everywhere. ``box_join`` files boxes by size on a ladder of grids, so a box as large as a state still covers a handful
of cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EARTH_KM
from ..functions.geo import box_distance_km, haversine_km
from .state import checkpoint

KM_PER_DEGREE = EARTH_KM * math.pi / 180.0
PAD = 1e-9


def _row_width(row: Column, height: float) -> Column:
    """Cell width in degrees of longitude for a row of cells, from the row edge farthest from the equator."""
    edge = F.greatest(F.abs(row * height), F.abs((row + 1) * height))
    cosine = F.greatest(F.lit(0.01), F.cos(F.radians(F.least(edge, F.lit(90.0)))))
    return F.lit(height) / cosine


def _point_cell(lat: Column, lon: Column, height: float) -> list[Column]:
    row = F.floor(lat / height)
    return [row.alias("_cy"), F.floor(lon / _row_width(row, height)).alias("_cx")]


def _cover(df: DataFrame, south: Column, north: Column, west: Column, east: Column, height: float) -> DataFrame:
    """One row per cell touched by the box."""
    rows = F.sequence(F.floor((south - PAD) / height), F.floor((north + PAD) / height))
    with_row = df.withColumn("_cy", F.explode(rows))
    width = _row_width(F.col("_cy"), height)
    cols = F.sequence(F.floor((west - PAD) / width), F.floor((east + PAD) / width))
    return with_row.withColumn("_cx", F.explode(cols))


def _reach(lat: Column, radius_km: float) -> tuple[float, Column]:
    """Largest latitude and longitude differences of points within the radius."""
    angle = radius_km / EARTH_KM
    up = math.degrees(angle)
    ratio = F.lit(math.sin(min(angle, math.pi / 2))) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))
    side = F.when(ratio >= 1.0, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))
    return up, side


def radius_join(
    left: DataFrame,
    right: DataFrame,
    radius_km: float,
    on: Sequence[str] = (),
    left_point: tuple[str, str] = ("lat", "lon"),
    right_point: tuple[str, str] = ("p_lat", "p_lon"),
    km: str = "km",
    own_radius: Column | None = None,
) -> DataFrame:
    """Pairs at most ``radius_km`` apart with their distance. Column names of the sides must differ except ``on``.

    ``own_radius`` narrows the result to each row's own radius, which must not exceed ``radius_km``.
    The exploded side is the right one: give the register as right, the facts as left.
    """
    height = radius_km / KM_PER_DEGREE
    llat, llon = F.col(left_point[0]), F.col(left_point[1])
    rlat, rlon = F.col(right_point[0]), F.col(right_point[1])
    lhs = left.filter(llat.isNotNull() & llon.isNotNull()).select("*", *_point_cell(llat, llon, height))
    up, side = _reach(rlat, radius_km)
    rhs = _cover(
        right.filter(rlat.isNotNull() & rlon.isNotNull()), rlat - up, rlat + up, rlon - side, rlon + side, height)
    pairs = lhs.join(rhs, [*on, "_cy", "_cx"]).drop("_cy", "_cx")
    out = pairs.withColumn(km, haversine_km(llat, llon, rlat, rlon))
    keep = F.col(km) <= radius_km
    return out.filter(keep if own_radius is None else keep & (F.col(km) <= own_radius))


def nearest_within(
    left: DataFrame,
    right: DataFrame,
    radius_km: float,
    left_key: str,
    order: Sequence[str],
    on: Sequence[str] = (),
    left_point: tuple[str, str] = ("lat", "lon"),
    right_point: tuple[str, str] = ("p_lat", "p_lon"),
) -> DataFrame:
    """Nearest right row per left key within a cap: ``left_key``, ``km``, then the right columns.

    Ties go to the smallest ``order`` columns. Rows share points on either side: distances run once per pair of distinct points, of
    the right rows at a point only the first in order takes part, and left rows of a point share its answer. The minimum is
    combined on the map side, so a crowded cell sends one row per left point and task.
    """
    rest = [c for c in right.columns if c not in (*on, *order, *right_point)]
    lhs = left.select(left_key, *on, *left_point).dropDuplicates([left_key])
    nodes = right.groupBy(*on, *right_point).agg(F.min(F.struct(*order, *rest)).alias("_row"))
    pairs = radius_join(lhs.select(*on, *left_point).distinct(), nodes, radius_km, on, left_point, right_point)
    best = pairs.groupBy(*on, *left_point).agg(F.min(F.struct("km", "_row", *right_point)).alias("_best"))
    return lhs.join(best, [*on, *left_point]).select(
        left_key, "_best.km", "_best._row.*", *[f"_best.{c}" for c in right_point])


RINGS_KM = (25.0, 100.0, 400.0, 1600.0, 6400.0, EARTH_KM * math.pi + 1.0)


def nearest_any(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    order: Sequence[str],
    left_point: tuple[str, str] = ("lat", "lon"),
    right_point: tuple[str, str] = ("p_lat", "p_lon"),
    rings_km: Sequence[float] = RINGS_KM,
) -> DataFrame:
    """Nearest right row without a cap, by widening rings: a hit inside a ring is the true nearest.

    Only keys that found nothing go on to the next ring.
    """
    found = None
    todo = checkpoint(left.select(left_key, *left_point).dropna().dropDuplicates([left_key]))
    for i, ring in enumerate(rings_km):
        hit = checkpoint(nearest_within(todo, right, ring, left_key, order, (), left_point, right_point))
        found = hit if found is None else found.unionByName(hit)
        if i == len(rings_km) - 1:
            break
        todo = todo.join(hit.select(left_key), left_key, "left_anti")
        if todo.isEmpty():
            break
    return found


LADDER = 8


def box_join(
    points: DataFrame,
    boxes: DataFrame,
    radius_km: float,
    point: tuple[str, str] = ("lat", "lon"),
    box: tuple[str, str, str, str] = ("xmin", "ymin", "xmax", "ymax"),
    km: str = "km",
) -> DataFrame:
    """Points at most ``radius_km`` from a box (0 inside it)."""
    base = max(radius_km, 1.0) / KM_PER_DEGREE * 2.0
    lat, lon = F.col(point[0]), F.col(point[1])
    xmin, ymin, xmax, ymax = (F.col(c) for c in box)
    known = boxes.filter(xmin.isNotNull() & ymin.isNotNull() & xmax.isNotNull() & ymax.isNotNull())
    up, side = _reach(F.greatest(F.abs(ymin), F.abs(ymax)), radius_km)
    extent = F.greatest(ymax - ymin + 2 * up, xmax - xmin + side * 2.0)
    level = F.greatest(F.lit(0), F.least(F.lit(LADDER - 1), F.ceil(F.log(4.0, extent / F.lit(base)))))
    leveled = known.withColumn("_lv", level.cast("int"))
    size = F.lit(base) * F.pow(F.lit(4.0), F.col("_lv"))
    rhs = (
        leveled
        .withColumn("_by", F.explode(F.sequence(F.floor((ymin - up - PAD) / size), F.floor((ymax + up + PAD) / size))))
        .withColumn("_bx", F.explode(
            F.sequence(F.floor((xmin - side - PAD) / size), F.floor((xmax + side + PAD) / size))))
    )
    lhs = (
        points.filter(lat.isNotNull() & lon.isNotNull())
        .withColumn("_lv", F.explode(F.sequence(F.lit(0), F.lit(LADDER - 1))))
        .withColumn("_by", F.floor(lat / size))
        .withColumn("_bx", F.floor(lon / size))
    )
    pairs = lhs.join(rhs, ["_lv", "_by", "_bx"]).drop("_lv", "_by", "_bx")
    return pairs.withColumn(km, box_distance_km(lat, lon, xmin, ymin, xmax, ymax)).filter(F.col(km) <= radius_km)


def segments_near(
    points: DataFrame,
    segments: DataFrame,
    radius_m: float,
    key: str,
    point: tuple[str, str] = ("lat", "lon"),
) -> DataFrame:
    """Nearest polyline per key within ``radius_m``; the smallest segment id wins ties.

    ``segments``: segment_id, points, min_lat, max_lat, min_lon, max_lon and any carried columns. Candidate pairs come
    from ``box_join``; the exact distance runs on them only, once per distinct point and line: keys of a point share its answer, and
    of segments with the same line only the first takes part. A few bytes are much work, so the number of tasks is given.
    """
    from ..functions.geo import polyline_distance_m

    lat, lon = F.col(point[0]), F.col(point[1])
    line = ["points", "min_lat", "max_lat", "min_lon", "max_lon"]
    carry = [c for c in segments.columns if c not in (*line[1:], "segment_id")]
    rest = [c for c in carry if c != "points"]
    lhs = points.select(key, *point).dropDuplicates([key])
    lines = segments.groupBy(*line).agg(F.min_by(F.struct("segment_id", *rest), F.struct("segment_id")).alias("_first")).select(
        *line, "_first.*")
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spots = lhs.select(*point).distinct().repartition(tasks, F.xxhash64(*point))
    pairs = box_join(
        spots, lines, radius_m / 1000.0 * 1.5, point, ("min_lon", "min_lat", "max_lon", "max_lat"), "_box_km")
    exact = pairs.withColumn("metres", polyline_distance_m(lat, lon, F.col("points"))).filter(
        F.col("metres") <= radius_m)
    best = exact.groupBy(*point).agg(F.min_by(
        F.struct("metres", "segment_id", *carry), F.struct("metres", "segment_id")).alias("_best"))
    return lhs.join(best, [*point]).select(key, "_best.*")
