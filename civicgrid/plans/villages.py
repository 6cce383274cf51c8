"""Villages ranked by their neediest asset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nested import count_map
from ..operators.photos import grade_rank
from ..operators.ranking import rank_within

C = F.col


def village_priorities(reports: DataFrame, assets: DataFrame, places: DataFrame) -> DataFrame:
    """One row per place with reports.

    ``reports``: id, place_id, issue_category, asset_id, is_synthetic. ``assets``: asset_id, priority_score, grade_label,
    grade_confidence.
    """
    r = reports.filter("place_id is not null")
    per = r.groupBy("place_id", "issue_category").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("is_synthetic").alias("demo"))
    counts = per.groupBy("place_id").agg(
        F.sum("n").alias("report_count"), count_map(C("issue_category"), C("n")).alias("counts_by_category"),
        F.bool_and("demo").alias("is_demo"))
    pairs = r.select("place_id", "asset_id").filter("asset_id is not null").distinct().join(assets, "asset_id")
    rank = grade_rank(C("grade_label"))
    urgent = C("grade_label").isNotNull()
    tops = pairs.groupBy("place_id").agg(
        F.count(F.lit(1)).alias("asset_count"),
        F.max(F.struct("priority_score", "asset_id")).alias("top"),
        F.max_by(F.when(urgent, F.struct("asset_id", "grade_label")), F.when(
            urgent, F.struct(rank, F.coalesce("grade_confidence", F.lit(0.0)), -C("asset_id")))).alias("urgent"))
    p = places.select(C("id").alias("place_id"), C("name").alias("village"), "block", "district", "lat", "lon", "population")
    out = p.join(counts, "place_id").join(tops, "place_id", "left").select(
        "place_id", "village", "block", "district", "lat", "lon", "population", "report_count", "counts_by_category",
        F.coalesce("asset_count", F.lit(0)).alias("asset_count"),
        F.coalesce("top.priority_score", F.lit(0.0)).alias("priority_score"), C("top.asset_id").alias("top_asset_id"),
        C("urgent.asset_id").alias("urgent_asset_id"), C("urgent.grade_label").alias("urgent_grade_label"), "is_demo")
    return rank_in_district(out)


def rank_in_district(villages: DataFrame) -> DataFrame:
    order = [C("priority_score").desc(), C("report_count").desc(), F.coalesce("village", F.lit("")), C("place_id")]
    held = villages.withColumn("_district", F.coalesce("district", F.lit("Unknown")))
    return rank_within(held, ["_district"], order, "rank_in_district").drop("_district")
