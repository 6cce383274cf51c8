"""Repair of the place register and of reports that could not be placed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..operators.lookup import insert_absent

C = F.col


def add_headquarters(places: DataFrame, headquarters: DataFrame) -> DataFrame:
    """Insert block headquarters (name, district, lat, lon) missing by (name, district)."""
    rows = headquarters.select(
        "name", F.lit("block").alias("admin_level"), "district", C("name").alias("block"),
        F.lit(None).cast("bigint").alias("population"), "lat", "lon")
    return insert_absent(places, rows, ["name", "district"])


def assign_blocks(places: DataFrame, headquarters: DataFrame) -> DataFrame:
    """Block of every place = name of the nearest headquarters of its district; adds ``hq_km``.

    Places and headquarters share points, so distances run once per district and pair of distinct points, and of the headquarters
    at a point only the one with the smallest id takes part. They travel as one array row per district, so the join stays
    one row per point even where a district holds most places.
    """
    first = headquarters.groupBy("district", "lat", "lon").agg(F.min(F.struct("id", "name")).alias("_hq"))
    per_district = first.groupBy("district").agg(
        F.array_sort(F.collect_list(F.struct("_hq.id", "_hq.name", "lat", "lon"))).alias("_hqs"))
    options = F.transform("_hqs", lambda h: F.struct(
        haversine_km(C("lat"), C("lon"), h["lat"], h["lon"]).alias("km"), h["id"].alias("id"), h["name"].alias("name")))
    spots = places.select("district", "lat", "lon").distinct().join(per_district, "district").select(
        *[C(c).alias("_" + c) for c in ("district", "lat", "lon")], F.array_min(options).alias("_best"))
    same = [C(c).eqNullSafe(C("_" + c)) for c in ("district", "lat", "lon")]
    return (
        places.join(spots, same, "left")
        .withColumns({"block": F.coalesce(C("_best.name"), C("block")), "hq_km": C("_best.km")})
        .drop("_best", "_district", "_lat", "_lon"))


def regeocode(reports: DataFrame, places: DataFrame, threshold: float = 75.0) -> DataFrame:
    """Run the text rules again on reports without a village; only gaps are filled.

    ``reports``: id, raw_text, duplicate_count, district, block, village, issue_category, latitude, longitude.
    """
    from .structure import structure_reports

    todo = reports.filter("village is null").select("id", "raw_text", "duplicate_count", "district")
    found = structure_reports(todo, places, threshold).select(
        "id", C("village").alias("_v"), C("block").alias("_b"), C("district").alias("_d"), C("latitude").alias("_lat"),
        C("longitude").alias("_lon"), C("issue_category").alias("_cat"))
    fill = C("village").isNull() & C("_v").isNotNull()
    return reports.join(found, "id", "left").withColumns({
        "issue_category": F.coalesce("issue_category", F.when(C("village").isNull(), C("_cat"))),
        "district": F.coalesce("district", F.when(fill, C("_d"))),
        "block": F.when(fill, C("_b")).otherwise(C("block")),
        "latitude": F.when(fill, C("_lat")).otherwise(C("latitude")),
        "longitude": F.when(fill, C("_lon")).otherwise(C("longitude")),
        "village": F.coalesce("village", "_v")}).drop("_v", "_b", "_d", "_lat", "_lon", "_cat")


def repair(places: DataFrame, headquarters: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Missing headquarters, blocks, coordinates and places, in that order.

    ``headquarters``: id, name, district, lat, lon.
    """
    from ..operators.lookup import backfill_point

    whole = assign_blocks(add_headquarters(places, headquarters), headquarters)
    return whole, regeocode(backfill_point(reports, whole), whole)
