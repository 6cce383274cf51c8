"""From a raw report to a structured row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text
from ..functions.geo import accepted_pin, haversine_km
from ..functions.numeric import picked_location_confidence
from ..functions.rounding import portable_round
from ..operators.fuzzy import best_match
from ..operators.state import checkpoint

C = F.col
# Stands for every district in the comparison of names.
ANYWHERE = "*"


def accept_facility(reports: DataFrame, facilities: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Keep a picked ``facility_id`` only when it is of the report's category and near its village (v_lat, v_lon)."""
    f = facilities.select(
        F.col("id").alias("facility_id"), F.col("category").alias("_cat"), F.col("p_lat").alias("_flat"),
        F.col("p_lon").alias("_flon"))
    near = haversine_km(F.col("v_lat"), F.col("v_lon"), F.col("_flat"), F.col("_flon")) <= cfg.facility_max_km
    picked = F.col("facility_id").isNotNull()
    ok = picked & (F.col("_cat") == F.col("issue_category")) & near
    # Most reports pick nothing: those spread over all tasks under a hash of their own id, which ``picked`` keeps from counting.
    keyed = reports.withColumn("_fid", F.coalesce(F.col("facility_id").cast("bigint"), F.xxhash64("id")))
    return (
        keyed.join(f.withColumnRenamed("facility_id", "_fid"), "_fid", "left")
        .withColumn("facility_id", F.when(ok, F.col("facility_id"))).drop("_cat", "_flat", "_flon", "_fid")
    )


def structure_reports(reports: DataFrame, places: DataFrame, threshold: float = 75.0, strict: bool = True) -> DataFrame:
    """Raw text to language, category, severity, place and confidence.

    ``reports``: id, raw_text, duplicate_count, and ``district`` where it is known beforehand (it limits the place names
    compared; without one the name meets the places of all districts, and the district is filled from the match).
    Works on a stream as well, up to the place match (see ``structure_columns``). The text rules are costly and their rows are read
    several times, so they are dealt over all tasks first (small files give few) and written once.
    """
    tasks = int(reports.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = checkpoint(structure_columns(reports.repartition(tasks, "id")))
    named = t.filter("location_raw is not null").select(
        "id", F.coalesce("district", F.lit(ANYWHERE)).alias("district"), C("location_raw").alias("name"))
    known = places.select("id", "district", "name")
    known = known.unionByName(known.withColumn("district", F.lit(ANYWHERE)))
    found = best_match(named, known, threshold, strict)
    p = places.select(
        C("id").alias("match_id"), C("name").alias("village"), "block", C("lat").alias("latitude"),
        C("lon").alias("longitude"), C("district").alias("_district"))
    t = t.join(found, "id", "left").join(p, "match_id", "left")
    t = t.withColumn("district", F.coalesce("district", "_district")).drop("_district")
    return t.withColumn("confidence", _confidence(t)).withColumnRenamed("match_id", "place_id")


def _confidence(t: DataFrame):
    geo = F.coalesce(portable_round(C("score") / 100.0, 2), F.lit(0.20))
    scores = [
        text.language_confidence(C("language")), text.category_confidence(C("issue_category")),
        text.severity_confidence(C("severity")), geo]
    return F.when(C("raw_text") == "", 0.10).otherwise(text.overall_confidence(scores))


def structure_columns(reports: DataFrame) -> DataFrame:
    """The part that needs the text only."""
    t = reports.withColumn("raw_text", text.strip_space(F.coalesce("raw_text", F.lit(""))))
    t = t.withColumns({
        "language": text.detect_language(C("raw_text")), "clean_text": text.normalize_text(C("raw_text"))})
    t = text.with_location_phrase(t, "clean_text", "location_raw")
    # lower-cased once: inside a condition every one of the searches would do it again
    blank, low = C("raw_text") == "", C("_low")
    return t.withColumn("_low", F.lower("clean_text")).withColumns({
        "issue_category": F.when(~blank, text.category_of(low)),
        "severity": F.when(blank, "medium").otherwise(text.severity_of(low, C("duplicate_count"))),
        "location_raw": F.when(~blank, C("location_raw"))}).drop("_low")


IDENTITY = ("full_name", "gender", "mobile", "email", "address", "pincode")


def resolve_intake(forms: DataFrame, places: DataFrame, facilities: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """A picked village outranks the text; pin and facility are checked against it; wording is redacted.

    ``forms``: structured rows plus picked_district, picked_block, picked_village, department, report_lat, report_lon and
    the identity columns. The result carries no identity column and no raw text.
    """
    p = places.groupBy(
        C("district").alias("picked_district"), C("block").alias("picked_block"), C("name").alias("picked_village")
    ).agg(F.min_by(F.struct("lat", "lon"), "id").alias("_pt"))
    t = forms.join(p, ["picked_district", "picked_block", "picked_village"], "left")
    picked = C("_pt").isNotNull()
    t = t.withColumns({
        "v_lat": F.when(picked, C("_pt.lat")).otherwise(C("latitude")),
        "v_lon": F.when(picked, C("_pt.lon")).otherwise(C("longitude"))})
    pin = accepted_pin(C("report_lat"), C("report_lon"), C("v_lat"), C("v_lon"), cfg)
    has_pin = picked & pin[0].isNotNull()
    t = t.withColumns({
        "issue_category": F.coalesce("issue_category", F.when(picked, text.department_category(C("department")))),
        "district": F.when(picked, C("picked_district")).otherwise(C("district")),
        "block": F.when(picked, C("picked_block")).otherwise(C("block")),
        "village": F.when(picked, C("picked_village")).otherwise(C("village")),
        "location_raw": F.when(picked, C("picked_village")).otherwise(C("location_raw")),
        "precise_lat": F.when(has_pin, pin[0]), "precise_lon": F.when(has_pin, pin[1]),
        "pin_source": F.when(has_pin, "citizen_gps"),
        "facility_id": F.when(picked, C("facility_id")),
        "confidence": F.when(picked, picked_location_confidence(C("confidence"))).otherwise(C("confidence"))})
    t = accept_facility(t, facilities, cfg)
    return t.select(
        "id", text.redact(C("raw_text")).alias("raw_text"), "language", "issue_category", "severity", "location_raw",
        "district", "block", "village", C("v_lat").alias("latitude"), C("v_lon").alias("longitude"), "precise_lat",
        "precise_lon", "pin_source", "facility_id", "department", "confidence")


def identity_rows(forms: DataFrame) -> DataFrame:
    """Identity and the untouched text, for tables of their own that no analysis reads."""
    return forms.select(C("id").alias("linked_request_id"), *IDENTITY, C("raw_text").alias("original_text"))
