"""Feeds that change by the hour: alerts, river gauges, water level stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import as_of, utc_time
from ..functions.geo import in_box
from ..functions.text import safe_float
from ..operators.hazards import DISTRICT_BOXES
from ..operators.lookup import latest_by
from .stations import last_two

C = F.col

ALERT_INFO = (
    "event string, severity string, urgency string, effective string, expires string, senderName string, "
    "area array<struct<areaDesc:string>>")

# Words that tag a district in an area description.
DISTRICT_WORDS = {"Nashik": ("nashik", "नाशिक"), "Kolhapur": ("kolhapur", "कोल्हापूर")}


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alert files: one ``info`` element per row, with its identifier from the file's own ``identifier``."""
    return spark.read.format("xml").option("rowTag", "alert").schema(
        f"identifier string, info struct<{ALERT_INFO.replace(' string', ':string').replace('area array', 'area:array')}>"
    ).load(path)


def alerts_from_xml(rows: DataFrame, xml: str) -> DataFrame:
    """Alerts out of a text column that holds one ``info`` element."""
    return rows.withColumn("info", F.from_xml(xml, ALERT_INFO))


def alerts(rows: DataFrame) -> DataFrame:
    """identifier, info to one alert row: descriptions joined, districts tagged, times in UTC."""
    desc = F.array_compact(F.transform("info.area", lambda a: a["areaDesc"]))
    tags = [_tag(desc, name, words) for name, words in sorted(DISTRICT_WORDS.items())]
    return rows.select(
        "identifier", C("info.event").alias("event"), C("info.severity").alias("severity"),
        C("info.urgency").alias("urgency"), F.array_join(desc, "; ").alias("area_desc"),
        F.nullif(F.concat_ws(",", *tags), F.lit("")).alias("districts"),
        utc_time(C("info.effective")).alias("effective"), utc_time(C("info.expires")).alias("expires"),
        C("info.senderName").alias("sender"))


def _tag(desc: Column, name: str, words: tuple[str, ...]) -> Column:
    pattern = "|".join(words)
    return F.when(F.exists(desc, lambda d: F.lower(d).rlike(pattern)), F.lit(name))


def in_districts(lat: Column, lon: Column) -> Column:
    inside = F.lit(False)
    for box in DISTRICT_BOXES.values():
        inside = inside | in_box(lat, lon, box)
    return inside


def river_gauges(readings: DataFrame, now: str | Column, days: int = 7) -> DataFrame:
    """Newest reading of each station inside the districts, at most a week old.

    ``readings``: station_code, name, lat, lon, datatype_code, value, observed_at.
    """
    inside = readings.filter(in_districts(C("lat"), C("lon")) & C("observed_at").isNotNull())
    last = latest_by(inside, ["station_code"], ["observed_at", "value"])
    return last.filter(C("observed_at") >= F.timestamp_add("DAY", F.lit(-days), as_of(now)))


def groundwater_stations(rows: DataFrame) -> DataFrame:
    """Latest level, previous level and trend per station. Stations without a usable reading have no level.

    ``rows``: station, district, tehsil, lat, lon, level (text), ts.
    """
    lat, lon = safe_float(C("lat")), safe_float(C("lon"))
    t = rows.withColumns({"lat": lat, "lon": lon, "level": safe_float(C("level"))}).filter(
        in_box(C("lat"), C("lon"), (15.0, 22.0, 72.0, 76.0)))
    about = t.groupBy("station").agg(F.min_by(F.struct("district", "tehsil", "lat", "lon"), "ts").alias("_a")).select(
        "station", "_a.*")
    two = last_two(t, "station", ["ts"], "level")
    return about.join(two, "station", "left").select(
        C("station").alias("station_name"), "district", "tehsil", "lat", "lon", C("level").alias("current_level_m"),
        C("previous").alias("previous_level_m"), F.coalesce("trend", F.lit("stable")).alias("trend"),
        C("ts").alias("recorded_at"))
